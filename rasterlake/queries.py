"""Every grid operator as a query over grids derived from the driver's tables, with DuckDB SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as _np
from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterlake import extract, grid as G, sources
from rasterlake.operators import basic, hydrology, ml, spatial, spectral, tables, terrain, texture, window
from rasterlake.plans import cut, scratch_path
from rasterlake.streaming import player_frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


# ---------------------------------------------------------------- grids


def emb(spark: SparkSession, sf_dir: str, masked: bool = True) -> DataFrame:
    """A row of cells a vector: its components in ten-thousandths; masked leaves a fixed pattern of cells empty."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("int").alias("r"), F.posexplode("embedding").alias("c", "x"))
    z = F.round(F.col("x").cast("double") * 10000).cast("long").cast("double")
    hole = (7 * F.col("r") + 13 * F.col("c")) % 17 == 0
    return rows.select(F.lit("emb").alias("raster_id"), "r", "c", (F.when(~hole, z) if masked else z).alias("z"))


def ship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Week of shipping by supplier: the mean price, in whole units; dense, with cells that nothing was shipped in."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    first = rows.agg(F.min(F.to_date("l_shipdate")).alias("d0"), F.min("l_suppkey").alias("s0"))
    week = F.floor(F.datediff(F.to_date("l_shipdate"), "d0") / 7).cast("int")
    got = rows.crossJoin(F.broadcast(first)).groupBy(week.alias("r"), (F.col("l_suppkey") - F.col("s0")).cast("int").alias("c")).agg(F.round(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / F.count("*") / 100).cast("double").alias("z"))
    return G.densify(got.select(F.lit("ship").alias("raster_id"), "r", "c", "z"))


def _g(masked: bool = True) -> str:
    hole = "CASE WHEN (7 * vec_id + 13 * (i - 1)) % 17 = 0 THEN NULL ELSE {} END" if masked else "{}"
    z = hole.format("CAST(CAST(round(CAST(embedding[i] AS DOUBLE) * 10000) AS BIGINT) AS DOUBLE)")
    return f"g AS (SELECT CAST(vec_id AS INTEGER) AS r, CAST(i - 1 AS INTEGER) AS c, {z} AS z FROM embeddings, range(1, 65) t(i))"


SHIP = """a AS (SELECT min(CAST(l_shipdate AS DATE)) d0, min(l_suppkey) s0 FROM lineitem),
h AS (SELECT CAST(floor(date_diff('day', d0, CAST(l_shipdate AS DATE)) / 7.0) AS INTEGER) r, CAST(l_suppkey - s0 AS INTEGER) c, round(CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100) z FROM lineitem, a GROUP BY 1, 2),
g AS (SELECT CAST(x.i AS INTEGER) r, CAST(y.i AS INTEGER) c, h.z FROM range(0, (SELECT max(r) + 1 FROM h)) x(i) CROSS JOIN range(0, (SELECT max(c) + 1 FROM h)) y(i) LEFT JOIN h ON h.r = x.i AND h.c = y.i)"""

#: Neighbours by row and column step, numbered row by row.
_AT = {i * 3 + j + 1: (i - 1, j - 1) for i in range(3) for j in range(3)}


def _near(clamp: bool = False, source: str = "g", col: str = "z", name: str = "s") -> str:
    r, c = (lambda d: f"greatest(0, least(a.r + {d}, (SELECT max(r) FROM {source})))", lambda d: f"greatest(0, least(a.c + {d}, (SELECT max(c) FROM {source})))") if clamp else (lambda d: f"a.r + {d}", lambda d: f"a.c + {d}")
    joins = " ".join(f"LEFT JOIN {source} n{k} ON n{k}.r = {r(y)} AND n{k}.c = {c(x)}" for k, (y, x) in _AT.items())
    return f"{name} AS (SELECT a.*, {', '.join(f'n{k}.{col} AS z{k}' for k in _AT)} FROM {source} a {joins})"


def _win(size: int, source: str = "g", name: str = "w", col: str = "z") -> str:
    h = size // 2
    return f"{name} AS (SELECT a.r, a.c, a.z AS zc, b.{col} AS v, dr, dc FROM {source} a CROSS JOIN range({-h}, {h + 1}) x(dr) CROSS JOIN range({-h}, {h + 1}) y(dc) JOIN {source} b ON b.r = a.r + dr AND b.c = a.c + dc)"


def _r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


def _out(df: DataFrame, *values: str, digits: int = 6, keys: tuple[str, ...] = ("r", "c")) -> DataFrame:
    """Keys, and values rounded; -0 becomes 0."""
    return df.select(*keys, *[(F.round(F.col(v).cast("double"), digits) + 0.0).alias(v) for v in values])


def whole(sql: str) -> str:
    """The same rows, worked out before anything around the query: DuckDB carries a LIMIT written around a chain of joins
    down into it and then takes minutes for what takes a tenth of a second."""
    return f"WITH whole AS MATERIALIZED ({sql}) SELECT * FROM whole"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = whole(sql)
        return f

    return add


def plain(name: str, sql: str | None, f: Callable[[DataFrame], DataFrame], *values: str, masked: bool = True, digits: int = 6) -> None:
    query(name, sql)(lambda spark, d: _out(f(emb(spark, d, masked)), *values, digits=digits))


# ---------------------------------------------------------------- sources and projections

plain("grid_dense", f"WITH {_g(False)} SELECT r, c, z + 0.0 AS z FROM g", lambda g: g, "z", masked=False)
plain("grid_masked", f"WITH {_g()} SELECT r, c, z + 0.0 AS z FROM g", lambda g: g, "z")
query("grid_ship", f"WITH {SHIP} SELECT r, c, z + 0.0 AS z FROM g")(lambda spark, d: _out(ship(spark, d), "z"))
T = G.Transform(500000.0, 4200000.0, 10.0, -10.0)
query("coords_affine", f"WITH {_g()} SELECT r, c, CAST(r AS BIGINT) * 64 + c AS id, 500000.0 + 10.0 * c AS x, 4200000.0 - 10.0 * r AS y FROM g")(lambda spark, d: G.coordinates(emb(spark, d), T).select("r", "c", "id", "x", "y"))
query("feature_table", f"WITH {_g()}, {_near()} SELECT 'emb' AS raster_id, CAST(r AS BIGINT) * 64 + c AS id, 500000.0 + 10.0 * c AS x, 4200000.0 - 10.0 * r AS y, z AS elevation, coalesce(round(z6 - z4, 6), 0.0) + 0.0 AS east FROM s WHERE z IS NOT NULL")(
    lambda spark, d: G.feature_table(emb(spark, d).join(_east(emb(spark, d)), list(G.KEYS)), ["east"], T, "zero")
)


def _east(cells: DataFrame) -> DataFrame:
    from rasterlake.functions import stencil

    return stencil(cells).select(*G.KEYS, (F.round(F.col("z6") - F.col("z4"), 6) + 0.0).alias("east"))


plain("normalize01", f"WITH {_g()} SELECT r, c, {_r('(z - (SELECT min(z) FROM g)) / ((SELECT max(z) FROM g) - (SELECT min(z) FROM g))', 'norm')} FROM g", G.normalize, "norm")
plain("downsample_stride", f"WITH {_g()} SELECT CAST(r // 2 AS INTEGER) AS r, CAST(c // 2 AS INTEGER) AS c, z + 0.0 AS z FROM g WHERE r % 2 = 0 AND c % 2 = 0", lambda g: G.downsample(g, 2), "z")
plain(
    "upsample_nearest",
    f"""WITH {_g()}, k AS (SELECT r // 4 AS r, c // 4 AS c, z FROM g WHERE r % 4 = 0 AND c % 4 = 0), m AS (SELECT max(r) AS mr, max(c) AS mc FROM k), n AS (SELECT max(r) AS nr, max(c) AS nc FROM g)
SELECT g.r, g.c, k.z + 0.0 AS z FROM g, m, n LEFT JOIN k ON k.r = CAST(round_even(g.r * 1.0 / nr * mr, 0) AS INTEGER) AND k.c = CAST(round_even(g.c * 1.0 / nc * mc, 0) AS INTEGER)""".replace("FROM g, m, n LEFT JOIN", "FROM g CROSS JOIN m CROSS JOIN n LEFT JOIN"),
    lambda g: G.upsample_nearest(G.downsample(g, 4), g),
    "z",
)

# ---------------------------------------------------------------- terrain

_DX, _DY = "((z3 + 2 * z6 + z9) - (z1 + 2 * z4 + z7))", "((z7 + 2 * z8 + z9) - (z1 + 2 * z2 + z3))"


def _terrain(name: str, out: str, dx: str, dy: str, value: str, f, clamp: bool = False) -> None:
    sql = f"WITH {_g()}, {_near(clamp)}, d AS (SELECT *, {dx} AS dx, {dy} AS dy FROM s) SELECT r, c, CASE WHEN z IS NOT NULL AND dx IS NOT NULL AND dy IS NOT NULL THEN {value} END AS {out} FROM d"
    plain(name, sql, f, out)


_SLOPE = "round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) + 0.0"
_TURN = "(CASE WHEN degrees(atan2(dy, -dx)) < 0 THEN degrees(atan2(dy, -dx)) + 360 ELSE degrees(atan2(dy, -dx)) END)"
_FLAT = "abs(dx) < 1e-4 AND abs(dy) < 1e-4"
_terrain("slope_horn", "slope", f"{_DX} / 8", f"{_DY} / 8", _SLOPE, terrain.slope)
_terrain("slope_zt", "slope", "(z6 - z4) / 2", "(z8 - z2) / 2", _SLOPE, lambda g: terrain.slope(g, method="zevenbergen"))
_terrain("slope_simple", "slope", f"{_DX} / 32", f"{_DY} / 32", _SLOPE, lambda g: terrain.slope(g, method="simple"), True)
_terrain("aspect_horn", "aspect", f"{_DX} / 8", f"{_DY} / 8", f"round(CASE WHEN {_FLAT} THEN -1.0 ELSE {_TURN} END, 6) + 0.0", terrain.aspect)
_terrain("hillshade", "hillshade", f"{_DX} / 8", f"{_DY} / 8", "round(greatest(0.0, least(255.0, 255 * (cos(radians(45)) * sin(atan(sqrt(dx * dx + dy * dy))) * cos(atan2(dy, -dx) - radians(135)) + sin(radians(45)) * cos(atan(sqrt(dx * dx + dy * dy)))))), 6) + 0.0", terrain.hillshade)
_terrain("slope_sobel", "slope", f"{_DX} / 8", f"{_DY} / 8", _SLOPE, lambda g: terrain.slope(g, method="sobel"), True)
_terrain("aspect_sobel", "aspect", f"{_DX} / 8", f"{_DY} / 8", f"round(CASE WHEN {_FLAT} THEN 0.0 ELSE {_TURN} END, 6) + 0.0", lambda g: terrain.aspect(g, method="sobel"), True)
_terrain("hillshade_sobel", "hillshade", f"{_DX} / 8", f"{_DY} / 8", f"round(greatest(0.0, least(255.0, 255 * (cos(radians(45)) * sin(atan(sqrt(dx * dx + dy * dy))) * cos(radians(CASE WHEN {_FLAT} THEN 0.0 ELSE {_TURN} END) - radians(315)) + sin(radians(45)) * cos(atan(sqrt(dx * dx + dy * dy)))))), 6) + 0.0", lambda g: terrain.hillshade(g, method="sobel"), True)
_PQ = "p AS (SELECT *, greatest(dx * dx + dy * dy, 1e-4) AS p FROM d), q AS (SELECT *, dx / sqrt(p) AS e, dy / sqrt(p) AS f FROM p)"
_WHOLE = " AND ".join(f"z{i} IS NOT NULL" for i in range(1, 10))
for _kind, _v in {"total": "-(xx + yy)", "profile": "-(xx * e * e + 2 * xy * e * f + yy * f * f)", "planform": "-(xx * f * f - 2 * xy * e * f + yy * e * e)"}.items():
    for _diag, _xx, _yy in ((True, "z3 - 2 * z5 + z7", "z1 - 2 * z5 + z9"), (False, "z4 - 2 * z5 + z6", "z2 - 2 * z5 + z8")):
        plain(
            f"curv_{_kind}" + ("" if _diag else "_axes"),
            f"WITH {_g()}, {_near()}, d AS (SELECT *, (z6 - z4) / 2 AS dx, (z8 - z2) / 2 AS dy, {_xx} AS xx, {_yy} AS yy, (z3 + z7 - z1 - z9) / 4 AS xy FROM s), {_PQ} SELECT r, c, CASE WHEN {_WHOLE} THEN {_v.join(('round(', ', 6) + 0.0'))} END AS curvature FROM q",
            lambda g, k=_kind, x=_diag: terrain.curvature(g, kind=k, diagonal=x),
            "curvature",
        )
plain(
    "curv_sobel",
    f"WITH {_g()}, {_near(True)}, o AS (SELECT r, c, z, {_DX} AS x, {_DY} AS y FROM s), {_near(True, 'o', 'x', 'sx')}, {_near(True, 'o', 'y', 'sy')} SELECT a.r, a.c, CASE WHEN a.z IS NOT NULL THEN {_r('-(((a.z3 + 2 * a.z6 + a.z9) - (a.z1 + 2 * a.z4 + a.z7)) + ((b.z7 + 2 * b.z8 + b.z9) - (b.z1 + 2 * b.z2 + b.z3))) / 4', 'curvature').replace(' AS curvature', '')} END AS curvature FROM sx a JOIN sy b USING (r, c)",
    terrain.curvature_sobel,
    "curvature",
)
plain("roughness", f"WITH {_g()}, {_win(3)} SELECT r, c, {_r('stddev_pop(v)', 'roughness')} FROM w GROUP BY r, c", terrain.roughness, "roughness")
plain("tpi", f"WITH {_g()}, {_win(5)} SELECT r, c, {_r('max(zc) - avg(v)', 'tpi')} FROM w GROUP BY r, c", lambda g: terrain.tpi(g, 5), "tpi")
plain("tri", f"WITH {_g()}, {_win(3)} SELECT r, c, {_r('avg(CASE WHEN v <> zc THEN abs(v - zc) END)', 'tri')} FROM w WHERE zc IS NOT NULL GROUP BY r, c", terrain.tri, "tri")
plain(
    "max_slope",
    f"WITH {_g()}, {_near()}, m AS (SELECT r, c, CASE WHEN r = 0 OR c = 0 OR r = (SELECT max(r) FROM g) OR c = 63 THEN 0.0 WHEN z IS NOT NULL THEN degrees(atan(sqrt(pow({_DX} / 8, 2) + pow({_DY} / 8, 2)))) END AS z FROM s), {_win(5, 'm')} SELECT r, c, {_r('max(v)', 'max_slope_angle')} FROM w GROUP BY r, c",
    lambda g: terrain.max_slope(g, size=5),
    "max_slope_angle",
)

# ---------------------------------------------------------------- windows

plain("win_basic", f"WITH {_g()}, {_win(5)} SELECT r, c, {_r('avg(v)', 'mean')}, {_r('stddev_pop(v)', 'stddev')}, min(v) + 0.0 AS min, max(v) + 0.0 AS max, CAST(count(v) AS DOUBLE) AS valid_count FROM w GROUP BY r, c", window.basic_stats, "mean", "stddev", "min", "max", "valid_count")
_M = "m AS (SELECT r, c, count(v) AS n, avg(v) AS a, var_pop(v) AS s2 FROM w GROUP BY r, c), k AS (SELECT w.r, w.c, n, s2, sum(pow(v - a, 3)) / n AS m3, sum(pow(v - a, 4)) / n AS m4 FROM w JOIN m USING (r, c) GROUP BY w.r, w.c, n, s2)"
plain("win_skew_kurt", f"WITH {_g()}, {_win(5)}, {_M} SELECT r, c, CASE WHEN n >= 3 AND s2 > 1e-12 THEN round(m3 / pow(s2, 1.5), 6) + 0.0 END AS skewness, CASE WHEN n >= 4 AND s2 > 1e-12 THEN round(m4 / (s2 * s2) - 3, 6) + 0.0 END AS kurtosis FROM k", window.higher_order_stats, "skewness", "kurtosis")
_B = "b AS (SELECT w.r, w.c, n, CASE WHEN lo = hi THEN 0 ELSE {at} END AS bin, count(*) AS k FROM w JOIN (SELECT r, c, min(v) AS lo, max(v) AS hi, count(v) AS n FROM w GROUP BY r, c) USING (r, c) WHERE v IS NOT NULL AND n >= 2 GROUP BY ALL)"
plain("win_entropy", f"WITH {_g()}, {_win(5)}, {_B.format(at='floor((v - lo) / (hi - lo) * 10)')} SELECT r, c, {_r('-sum(k * 1.0 / n * log2(k * 1.0 / n))', 'entropy')} FROM b GROUP BY r, c", window.entropy, "entropy")
plain("win_entropy_sqrt", f"WITH {_g()}, {_win(5)}, {_B.format(at='least(floor((v - lo) / (hi - lo) * least(32, greatest(1, floor(sqrt(n))))), least(32, greatest(1, floor(sqrt(n)))) - 1)')} SELECT r, c, {_r('-sum(k * 1.0 / n * log2(k * 1.0 / n))', 'entropy')} FROM b GROUP BY r, c", window.sqrt_bin_entropy, "entropy")
_SIDE = "CAST(floor(sqrt(n)) AS INTEGER)"
plain(
    "win_fractal",
    f"""WITH {_g()}, {_win(9)}, m AS (SELECT r, c, count(v) AS n, min(v) AS lo, max(v) AS hi FROM w GROUP BY r, c),
p AS (SELECT DISTINCT n, {_SIDE} AS side, CAST(floor(log2({_SIDE})) AS INTEGER) AS top FROM m WHERE n >= 9),
x AS (SELECT n, -k * ln(2) AS lx, ln(pow(ceil(side / pow(2, k)), 2)) AS ly FROM p, range(0, 8) t(k) WHERE k < top),
f AS (SELECT n, CASE WHEN count(*) >= 2 THEN least(2.0, greatest(1.0, regr_slope(ly, lx))) END AS d FROM x GROUP BY n)
SELECT r, c, CASE WHEN m.n >= 9 AND lo = hi THEN 1.0 ELSE round(d, 6) END + 0.0 AS fractal_dimension FROM m LEFT JOIN f USING (n)""",
    window.fractal_dimension,
    "fractal_dimension",
)
plain(
    "win_fractal_variation",
    f"""WITH {_g()}, {_win(5)}, o AS (SELECT r, c, v, row_number() OVER (PARTITION BY r, c ORDER BY dr, dc) - 1 AS k FROM w WHERE v IS NOT NULL),
p AS (SELECT r, c, count(*) AS n, var_pop(v) AS a, var_pop(v) FILTER (k % 2 = 0) AS b, var_pop(v) FILTER (k % 4 = 0) AS d FROM o GROUP BY r, c),
h AS (SELECT r, c, CASE WHEN n >= 16 AND a > 0 AND d > 0 THEN (ln(d) - ln(a)) / (2 * ln(2)) WHEN n BETWEEN 8 AND 15 AND a > 0 AND b > 0 THEN (ln(b) - ln(a)) / ln(2) END AS s FROM p)
SELECT g.r, g.c, CASE WHEN s IS NOT NULL THEN round(greatest(1.0, least(2.0, 2 - s / 2)), 6) + 0.0 END AS fractal_dimension FROM g LEFT JOIN h USING (r, c)""",
    lambda g: window.fractal_variation(g, 5),
    "fractal_dimension",
)
plain(
    "win_median_range",
    f"WITH {_g()}, {_win(5)} SELECT r, c, {_r('median(v)', 'median')}, {_r('var_pop(v)', 'variance', 4)}, max(v) - min(v) + 0.0 AS value_range, {_r('quantile_cont(v, 0.75) - quantile_cont(v, 0.25)', 'iqr')}, CASE WHEN var_pop(v) > 1e-12 THEN round((max(zc) - avg(v)) / stddev_pop(v), 6) + 0.0 END AS z_score FROM w WHERE v IS NOT NULL GROUP BY r, c",
    lambda g: window.order_stats(g).withColumn("variance", F.round("variance", 4)),
    "median", "variance", "value_range", "iqr", "z_score",
)
plain("basic_laplacian", f"WITH {_g()}, {_near()} SELECT r, c, z2 + z4 + z6 + z8 - 4 * z5 + 0.0 AS laplacian FROM s", lambda g: _laplacian(g), "laplacian")
plain("multi_resolution", f"WITH {_g()}, {_win(3, name='w3')}, {_win(9, name='w9')}, a AS (SELECT r, c, avg(v) m3, stddev_pop(v) s3 FROM w3 GROUP BY r, c), b AS (SELECT r, c, avg(v) m9, stddev_pop(v) s9 FROM w9 GROUP BY r, c) SELECT r, c, {_r('m3', 'mean_3')}, {_r('s3', 'stddev_3')}, {_r('m9', 'mean_9')}, {_r('s9', 'stddev_9')} FROM a JOIN b USING (r, c)", lambda g: window.multi_resolution(g, (3, 9)), "mean_3", "stddev_3", "mean_9", "stddev_9")
#: All nine positions of each cell: the operator's offsets as literals, since at odd i they lie at halves.
_T = ", ".join(f"({i}, {round(i * __import__('math').sin(__import__('math').radians(30)))}, {round(i * __import__('math').cos(__import__('math').radians(30)))})" for i in range(-4, 5))
for _name in ("transect", "transect_whole"):  # the second is its name from before, when the first left out odd positions
    query(_name, f"WITH {_g()} SELECT a.r, a.c, CAST(i AS INTEGER) AS i, b.z + 0.0 AS z FROM g a CROSS JOIN (VALUES {_T}) t(i, dr, dc) JOIN g b ON b.r = a.r + dr AND b.c = a.c + dc WHERE b.z IS NOT NULL")(
        lambda spark, d: _out(window.transect(emb(spark, d), 9, 30.0), "z", keys=("r", "c", "i"))
    )


_BG = "f AS (SELECT r, c, z IS NOT NULL AS valid, coalesce(z, 0) AS z FROM g), pl AS (SELECT a.r, a.c, a.z AS o, greatest(0, least((SELECT max(r) FROM g), a.r + dr)) AS nr, greatest(0, least((SELECT max(c) FROM g), a.c + dc)) AS nc FROM f a CROSS JOIN range(-2, 3) x(dr) CROSS JOIN range(-2, 3) y(dc)), w AS (SELECT pl.r, pl.c, o, b.z AS v FROM pl JOIN f b ON b.r = nr AND b.c = nc), k AS (SELECT r, c, avg(abs(v - o)) AS tri, max(o) - avg(v) AS tpi, max(v) - min(v) AS span, stddev_pop(v) AS sd, avg(v) AS mean, median(v) AS med FROM w GROUP BY r, c)"
_BASIC = {"slope": f"sqrt(pow({_DX}, 2) + pow({_DY}, 2))", "aspect": f"atan2({_DY}, {_DX})", "tri": "tri", "tpi": "tpi", "roughness": "span", "range": "span", "std": "sd", "mean": "mean", "median": "med", "laplacian": "z2 + z4 + z6 + z8 - 4 * z5"}
plain("basic_features", f"WITH {_g()}, {_BG}, {_near(True, 'f')} SELECT r, c, " + ", ".join(f"CASE WHEN valid THEN round({v}, 6) ELSE 0 END + 0.0 AS basic_{k}" for k, v in _BASIC.items()) + " FROM s JOIN k USING (r, c)", basic.basic_features, *[f"basic_{k}" for k in _BASIC])


def _laplacian(cells: DataFrame) -> DataFrame:
    from rasterlake.functions import stencil

    return stencil(cells).select(*G.KEYS, (F.col("z2") + F.col("z4") + F.col("z6") + F.col("z8") - 4 * F.col("z5")).alias("laplacian"))


# ---------------------------------------------------------------- spatial


def _edges(kind: str) -> str:
    off = ", ".join(f"({i}, {j})" for i, j in spatial.offsets(kind, 2.0))
    return f"e AS (SELECT a.r, a.c, a.z, b.r AS nr, b.c AS nc, b.z AS nz FROM g a CROSS JOIN (VALUES {off}) o(dr, dc) JOIN g b ON b.r = a.r + dr AND b.c = a.c + dc WHERE a.z IS NOT NULL AND b.z IS NOT NULL)"


for _kind in ("rook", "queen", "distance"):
    query(f"adjacency_{_kind}", f"WITH {_g()}, {_edges(_kind)} SELECT r, c, nr, nc FROM e")(lambda spark, d, k=_kind: spatial.adjacency(emb(spark, d), k, 2.0).select("r", "c", "nr", "nc"))
_MS = "m AS (SELECT avg(z) AS a, stddev_pop(z) AS sd, var_pop(z) AS v, count(z) AS n FROM g)"
query("moran_global", f"WITH {_g()}, {_edges('queen')}, {_MS} SELECT round((SELECT n FROM m) * 1.0 / count(*) * sum((z - a) * (nz - a)) / ((SELECT v * n FROM m)), 9) AS morans_i FROM e, m")(lambda spark, d: spatial.moran_global(emb(spark, d)).select(F.round("morans_i", 9).alias("morans_i")))
query("geary_global", f"WITH {_g()}, {_edges('queen')}, {_MS} SELECT round((max(n) - 1) * sum(pow(z - nz, 2)) / (2.0 * count(*) * max(n) * max(v)), 9) AS gearys_c FROM e, m")(lambda spark, d: spatial.geary_global(emb(spark, d)).select(F.round("gearys_c", 9).alias("gearys_c")))
_N = f"k AS (SELECT g.r, g.c, g.z, count(nz) AS k, coalesce(sum(nz), 0) AS s FROM g LEFT JOIN e USING (r, c) WHERE g.z IS NOT NULL GROUP BY g.r, g.c, g.z)"
plain("moran_local", f"WITH {_g()}, {_edges('queen')}, {_MS}, {_N} SELECT r, c, {_r('(z - a) / sd * ((s - k * a) / sd)', 'local_moran')} FROM k, m", spatial.moran_local, "local_moran")
plain("getis_ord", f"WITH {_g()}, {_edges('queen')}, {_MS}, {_N} SELECT r, c, {_r('CASE WHEN k > 0 THEN (s / k - a * k) / (sd * sqrt((n * k - k * k) * 1.0 / (n - 1))) ELSE 0 END', 'getis_ord')} FROM k, m", spatial.getis_ord, "getis_ord")
plain("getis_ord_star", f"WITH {_g()}, {_edges('queen')}, {_MS}, {_N} SELECT r, c, {_r('(s + z - a * (k + 1)) / (sd * sqrt((n * (k + 1) - (k + 1) * (k + 1)) * 1.0 / (n - 1)))', 'getis_ord')} FROM k, m", lambda g: spatial.getis_ord(g, star=True), "getis_ord")
plain("spatial_lag", f"WITH {_g()}, {_edges('rook')}, {_N} SELECT r, c, {_r('CASE WHEN k > 0 THEN s / k ELSE 0 END', 'spatial_lag')} FROM k", lambda g: spatial.spatial_lag(g, "rook"), "spatial_lag")

# ---------------------------------------------------------------- texture

_Q = "q AS (SELECT r, c, coalesce(CAST(round_even((z - (SELECT min(z) FROM g)) / ((SELECT max(z) FROM g) - (SELECT min(z) FROM g)) * 31, 0) AS INTEGER), 0) AS q FROM g)"
_O = ", ".join(f"({d}, {a}, {round(d * __import__('math').sin(__import__('math').radians(a)))}, {round(d * __import__('math').cos(__import__('math').radians(a)))})" for d in texture.DISTANCES for a in texture.ANGLES)
_C = f"f AS (SELECT d, a, x.q AS i, y.q AS j FROM q x CROSS JOIN (VALUES {_O}) o(d, a, dr, dc) JOIN q y ON y.r = x.r + dr AND y.c = x.c + dc), n AS (SELECT d, a, i, j, count(*) AS n FROM (SELECT d, a, i, j FROM f UNION ALL SELECT d, a, j, i FROM f) GROUP BY ALL)"
query("glcm_counts", f"WITH {_g()}, {_Q}, {_C} SELECT d, a, i, j, CAST(n AS BIGINT) AS n FROM n")(lambda spark, d: texture.glcm(emb(spark, d)).select("d", "a", "i", "j", "n"))
_GP = "p AS (SELECT d, a, i, j, n * 1.0 / sum(n) OVER (PARTITION BY d, a) AS p FROM n), u AS (SELECT d, a, sum(p * i) AS m, sum(p * i * i) - pow(sum(p * i), 2) AS v FROM p GROUP BY d, a), o AS (SELECT p.d, p.a, sum(p * pow(i - j, 2)) AS x1, sum(p * abs(i - j)) AS x2, sum(p / (1 + pow(i - j, 2))) AS x3, sqrt(sum(p * p)) AS x4, sum(p * (i - m) * (j - m)) / max(v) AS x5 FROM p JOIN u USING (d, a) GROUP BY p.d, p.a)"
query("glcm_props", f"WITH {_g()}, {_Q}, {_C}, {_GP} SELECT {', '.join(_r(f'avg(x{k})', f'glcm_{v}') for k, v in enumerate(('contrast', 'dissimilarity', 'homogeneity', 'energy', 'correlation'), 1))} FROM o")(
    lambda spark, d: _out(texture.glcm_properties(texture.glcm(emb(spark, d))), *[f"glcm_{v}" for v in ("contrast", "dissimilarity", "homogeneity", "energy", "correlation")], keys=())
)
_RING = [6, 3, 2, 1, 4, 7, 8, 9]
_BITS = ", ".join(f"CASE WHEN coalesce(z{k}, 0) >= z5 THEN 1 ELSE 0 END AS b{n}" for n, k in enumerate(_RING))
_LBP = f"im AS (SELECT r, c, z, coalesce(CAST(floor((z - (SELECT min(z) FROM g)) / ((SELECT max(z) FROM g) - (SELECT min(z) FROM g)) * 255) AS INTEGER), 0) AS i FROM g), {_near(False, 'im', 'i')}, bt AS (SELECT r, c, z, {_BITS} FROM s), lb AS (SELECT r, c, CASE WHEN z IS NOT NULL THEN CASE WHEN {' + '.join(f'abs(b{n} - b{(n + 1) % 8})' for n in range(8))} <= 2 THEN {' + '.join(f'b{n}' for n in range(8))} ELSE 9 END END AS z FROM bt)"
plain("lbp_r1", f"WITH {_g()}, {_LBP} SELECT r, c, CAST(z AS DOUBLE) AS lbp FROM lb", texture.lbp_r1, "lbp")
plain(
    "lbp_hist",
    f"WITH {_g()}, {_LBP}, {_win(5, 'lb')}, n AS (SELECT r, c, count(v) AS n FROM w GROUP BY r, c HAVING count(v) >= 5), h AS (SELECT n.r, n.c, b, count(v) * 1.0 / max(n) - 0.1 AS p FROM n CROSS JOIN range(0, 10) t(b) LEFT JOIN w ON w.r = n.r AND w.c = n.c AND w.v = b GROUP BY n.r, n.c, b), x AS (SELECT r, c, sum(p * p) / 10 AS v, sum(p * p * p) / 10 AS t FROM h GROUP BY r, c) SELECT r, c, 0.1 + 0.0 AS lbp_hist_mean, {_r('v', 'lbp_hist_var')}, {_r('CASE WHEN v > 0 THEN t / pow(v, 1.5) ELSE 0 END', 'lbp_hist_skew')} FROM x".replace("0.1 + 0.0 AS", "CAST(0.1 AS DOUBLE) AS"),
    texture.lbp_histogram,
    "lbp_hist_mean", "lbp_hist_var", "lbp_hist_skew",
)
plain("keypoint_density", f"WITH {_g()}, p AS (SELECT r, c, CASE WHEN z > 2500 THEN 1 ELSE 0 END AS z FROM g), {_win(21, 'p')} SELECT r, c, CAST(sum(v) AS DOUBLE) AS density FROM w GROUP BY r, c", lambda g: texture.keypoint_density(g.withColumn("key", F.when(F.col("z") > 2500, 1).otherwise(0))), "density")
_GX = "gy AS (SELECT r, c, z, coalesce(abs(CASE WHEN r = 0 THEN lead(z) OVER p - z WHEN r = (SELECT max(r) FROM g) THEN z - lag(z) OVER p ELSE (lead(z) OVER p - lag(z) OVER p) / 2 END), 0.0) AS g FROM g WINDOW p AS (PARTITION BY c ORDER BY r))"
_GK = "gk AS (SELECT pl.r, pl.c, sum(n.g * CASE WHEN dr = 0 AND dc = 0 THEN 5 ELSE 1 END) AS sharp, avg(n.g) AS mean, sum(n.g * exp(-(dr * dr + dc * dc) / 9.0)) / sum(exp(-(dr * dr + dc * dc) / 9.0)) AS bell FROM (SELECT a.r, a.c, dr, dc, greatest(0, least((SELECT max(r) FROM g), a.r + dr)) AS nr, greatest(0, least((SELECT max(c) FROM g), a.c + dc)) AS nc FROM gy a CROSS JOIN range(-3, 4) x(dr) CROSS JOIN range(-3, 4) y(dc)) pl JOIN gy n ON n.r = nr AND n.c = nc GROUP BY pl.r, pl.c)"
_GA = "av AS (SELECT " + ", ".join(f"CASE WHEN avg(x{i}) = 0 THEN {texture.TYPICAL[k]} ELSE avg(x{i}) END AS {k}" for i, k in enumerate(texture.TYPICAL, 1)) + " FROM o)"
plain(
    "glcm_localised",
    f"WITH {_g()}, {_Q}, {_C}, {_GP}, {_GX}, {_GK}, {_GA} SELECT gy.r, gy.c, " + ", ".join(f"CASE WHEN gy.z IS NOT NULL THEN round(least({texture.RANGES[k][1]}.0, greatest({texture.RANGES[k][0]}.0, {k} + 0.5 * {k} * {w})), 6) ELSE 0.0 END + 0.0 AS glcm_{k}" for k, w in zip(texture.TYPICAL, ("sharp", "sharp", "mean", "mean", "bell"))) + " FROM gy JOIN gk USING (r, c) CROSS JOIN av",
    lambda g: texture.localised_glcm(g, 7), *[f"glcm_{k}" for k in texture.TYPICAL],
)


def _ring_points(radius: int = 3, points: int = 8) -> str:
    """(point, row step, column step, weight) of the cells around each point on the circle; those without weight are left out."""
    out = []
    for k in range(points):
        y, x = (round(radius * f(2 * _np.pi * k / points), 5) for f in (lambda a: -_np.sin(a), _np.cos))
        y0, x0 = int(_np.floor(y)), int(_np.floor(x))
        out += [(k, y0 + i, x0 + j, (abs(1 - i - (y - y0))) * abs(1 - j - (x - x0))) for i in (0, 1) for j in (0, 1)]
    return ", ".join(f"({k}, {i}, {j}, {w!r}::DOUBLE)" for k, i, j, w in ((k, i, j, float(w)) for k, i, j, w in out) if w)


plain(
    "lbp_r3",
    f"WITH {_g()}, im AS (SELECT r, c, z, coalesce(floor((z - (SELECT min(z) FROM g)) / ((SELECT max(z) FROM g) - (SELECT min(z) FROM g)) * 255), 0) AS i FROM g), pt AS (SELECT a.r, a.c, a.z, k, CASE WHEN sum(w * coalesce(b.i, 0)) - a.i > -1e-9 THEN 1 ELSE 0 END AS b FROM im a CROSS JOIN (VALUES {_ring_points()}) o(k, dr, dc, w) LEFT JOIN im b ON b.r = a.r + dr AND b.c = a.c + dc GROUP BY a.r, a.c, a.z, a.i, k), "
    "ls AS (SELECT r, c, z, list(b ORDER BY k) AS b FROM pt GROUP BY r, c, z) SELECT r, c, CASE WHEN z IS NOT NULL THEN CASE WHEN " + " + ".join(f"abs(b[{n + 1}] - b[{(n + 1) % 8 + 1}])" for n in range(8)) + " <= 2 THEN list_sum(b) ELSE 9 END END + 0.0 AS lbp FROM ls",
    texture.lbp,
    "lbp",
)
_PAIRS_IN = ", ".join(f"({a}, {y}, {x})" for a, (y, x) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))))
plain(
    "glcm_local",
    f"WITH {_g()}, qq AS (SELECT r, c, z, coalesce(CAST(round_even((z - (SELECT min(z) FROM g)) / ((SELECT max(z) FROM g) - (SELECT min(z) FROM g)) * 15, 0) AS INTEGER), 0) AS q FROM g), "
    # pairs that lie in the grid with a margin of windows around it, at the place of their first cell
    f"bx AS (SELECT max(r) AS mr, max(c) AS mc FROM g), ex AS (SELECT CAST(y.i AS INTEGER) AS r, CAST(x.i AS INTEGER) AS c, coalesce(q, 0) AS q FROM bx, range(-3, 100000) y(i), range(-3, 1000) x(i) LEFT JOIN qq ON qq.r = y.i AND qq.c = x.i WHERE y.i <= mr + 3 AND x.i <= mc + 3), "
    f"pp AS (SELECT p.r, p.c, a, dy, dx, p.q AS i, n.q AS j FROM ex p CROSS JOIN (VALUES {_PAIRS_IN}) o(a, dy, dx) JOIN ex n ON n.r = p.r + dy AND n.c = p.c + dx), "
    "wp AS (SELECT r + sy AS r, c + sx AS c, a, i, j FROM pp, range(-3, 4) y(sy), range(-3, 4) x(sx) WHERE dy - sy <= 3 AND dx - sx BETWEEN -3 AND 3), "
    "ct AS (SELECT r, c, a, i, j, count(*) AS k FROM (SELECT * FROM wp UNION ALL SELECT r, c, a, j, i FROM wp) GROUP BY ALL), "
    "pr AS (SELECT r, c, a, sum(k) AS t, sum(k * i) / sum(k) AS m, sum(k * i * i) / sum(k) AS s2, sum(k * i * j) / sum(k) AS ij, sum(k * (i - j) * (i - j)) / sum(k) AS x1, sum(k * abs(i - j)) / sum(k) AS x2, sum(k / (1.0 + (i - j) * (i - j))) / sum(k) AS x3, sqrt(sum(k * k)) / sum(k) AS x4 FROM ct GROUP BY r, c, a), "
    f"av AS (SELECT r, c, avg(x1) AS x1, avg(x2) AS x2, avg(x3) AS x3, avg(x4) AS x4, avg(CASE WHEN s2 - m * m < 1e-15 THEN 1.0 ELSE (ij - m * m) / (s2 - m * m) END) AS x5 FROM pr GROUP BY r, c), {_win(7)}, n AS (SELECT r, c, count(v) AS n FROM w GROUP BY r, c) "
    "SELECT r, c, " + ", ".join(f"CASE WHEN n >= 4 THEN round(x{i}, 6) + 0.0 END AS local_glcm_{v}" for i, v in enumerate(("contrast", "dissimilarity", "homogeneity", "energy", "correlation"), 1)) + " FROM n JOIN av USING (r, c)",
    texture.local_glcm,
    *[f"local_glcm_{v}" for v in ("contrast", "dissimilarity", "homogeneity", "energy", "correlation")],
)
plain(
    "keypoint_corners",
    f"WITH {_g()}, {_near()}, pr AS (SELECT r, c, (z6 - z4) / 2 AS gx, (z8 - z2) / 2 AS gy FROM s), bs AS (SELECT a.r, a.c, sum(b.gx * b.gx) AS xx, sum(b.gx * b.gy) AS xy, sum(b.gy * b.gy) AS yy FROM pr a CROSS JOIN range(-1, 2) y(dr) CROSS JOIN range(-1, 2) x(dc) JOIN pr b ON b.r = a.r + dr AND b.c = a.c + dc GROUP BY a.r, a.c), "
    f"hm AS (SELECT r, c, xx * yy - xy * xy - 0.04 * (xx + yy) * (xx + yy) AS m FROM bs), p AS (SELECT r, c, CASE WHEN m > 0.01 * (SELECT max(m) FROM hm) THEN 1 ELSE 0 END AS z FROM hm), {_win(21, 'p')} SELECT r, c, CAST(sum(v) AS DOUBLE) AS density FROM w GROUP BY r, c",
    lambda g: texture.keypoint_density(texture.corners(g)),
    "density",
)

# ---------------------------------------------------------------- hydrology

_DROP = " UNION ALL ".join(f"SELECT r, c, {code} AS code, {n} AS turn, (z5 - z{z}) / {1.0 if 0 in (y, x) else 1.414} AS drop FROM s WHERE z IS NOT NULL AND z{z} IS NOT NULL" for n, (code, y, x, z) in enumerate(hydrology.D8))
_D8 = f"{_near()}, dr AS ({_DROP}), bs AS (SELECT r, c, first(code ORDER BY drop DESC, turn) AS code FROM dr GROUP BY r, c), fd AS (SELECT g.r, g.c, g.z, CASE WHEN g.z IS NOT NULL THEN coalesce(code, 0) END AS f FROM g LEFT JOIN bs USING (r, c))"
_FE = "fe AS (SELECT r, c, r + CASE f " + " ".join(f"WHEN {code} THEN {y}" for code, y, _, _ in hydrology.D8) + " END AS nr, c + CASE f " + " ".join(f"WHEN {code} THEN {x}" for code, _, x, _ in hydrology.D8) + " END AS nc FROM fd WHERE f > 0)"
_ED = "ed AS (SELECT CAST(r AS BIGINT) * 64 + c AS a, CAST(nr AS BIGINT) * 64 + nc AS b FROM fe)"
#: Walks (start, now, step); a walk ends on reaching a cell of the cycle, which the square of steps would show twice.
_REACH = "rc AS (SELECT a AS s, b AS t FROM ed UNION SELECT rc.s, ed.b FROM rc JOIN ed ON ed.a = rc.t)"
_CY = "cy AS (SELECT s AS v FROM rc WHERE s = t)"
plain("d8_direction", f"WITH {_g()}, {_D8} SELECT r, c, CAST(f AS DOUBLE) AS flow_direction FROM fd", hydrology.flow_direction, "flow_direction")
_OFF = "up AS (SELECT t AS v, count(*) AS k FROM rc WHERE s NOT IN (SELECT v FROM cy) GROUP BY t)"
#: Upstream of a cell on a cycle: only the walks that enter the cycle there.
_IN = "en AS (SELECT rc.s, ed.b AS v FROM (SELECT a AS s, a AS t FROM ed UNION ALL SELECT s, t FROM rc) rc JOIN ed ON ed.a = rc.t WHERE rc.t NOT IN (SELECT v FROM cy) AND ed.b IN (SELECT v FROM cy)), ec AS (SELECT v, count(DISTINCT s) AS k FROM en GROUP BY v)"
plain(
    "flow_accumulation",
    f"WITH RECURSIVE {_g()}, {_D8}, {_FE}, {_ED}, {_REACH}, {_CY}, {_OFF}, {_IN}, ac AS (SELECT r, c, 1 + CASE WHEN CAST(r AS BIGINT) * 64 + c IN (SELECT v FROM cy) THEN coalesce(ec.k, 0) ELSE coalesce(up.k, 0) END AS n FROM fd LEFT JOIN up ON up.v = CAST(r AS BIGINT) * 64 + c LEFT JOIN ec ON ec.v = CAST(r AS BIGINT) * 64 + c WHERE f IS NOT NULL) SELECT r, c, CAST(n AS DOUBLE) AS flow_accumulation, {_r('ln(1 + n)', 'flow_accumulation_log')} FROM ac",
    lambda g: hydrology.flow_accumulation(hydrology.flow_direction(g)),
    "flow_accumulation", "flow_accumulation_log",
)
for _method, _side, _mid in (("sobel", 1, 2), ("prewitt", 1, 1), ("scharr", 3, 10)):
    _ex = f"({_side} * (z3 - z1) + {_mid} * (z6 - z4) + {_side} * (z9 - z7))"
    _ey = f"({_side} * (z7 - z1) + {_mid} * (z8 - z2) + {_side} * (z9 - z3))"
    plain(f"edge_{_method}", f"WITH {_g()}, {_near(True)} SELECT r, c, CASE WHEN z IS NULL THEN 0.0 ELSE coalesce(round(sqrt(pow({_ex}, 2) + pow({_ey}, 2)), 6), 0.0) END + 0.0 AS edge FROM s", lambda g, m=_method: hydrology.edge_detection(g, m), "edge")
plain("slope_aspect", f"WITH {_g()}, {_near(True)}, d AS (SELECT *, {_DX} / 8 AS dx, {_DY} / 8 AS dy FROM s) SELECT r, c, CASE WHEN z IS NOT NULL THEN round(sqrt(dx * dx + dy * dy), 6) + 0.0 END AS slope, CASE WHEN z IS NOT NULL THEN round(atan2(0.0 - dy, 0.0 - dx), 6) + 0.0 END AS aspect FROM d", hydrology.slope_aspect, "slope", "aspect")


def _drainage(spark: SparkSession, sf_dir: str):
    directions = hydrology.flow_direction(emb(spark, sf_dir))
    network = hydrology.drainage_network(hydrology.flow_accumulation(directions), 2.0)
    return network, hydrology.drainage_edges(network, directions)


_NET = f"ac AS (SELECT r, c, 1 + CASE WHEN CAST(r AS BIGINT) * 64 + c IN (SELECT v FROM cy) THEN coalesce(ec.k, 0) ELSE coalesce(up.k, 0) END AS n FROM fd LEFT JOIN up ON up.v = CAST(r AS BIGINT) * 64 + c LEFT JOIN ec ON ec.v = CAST(r AS BIGINT) * 64 + c WHERE f IS NOT NULL), nw AS (SELECT r, c, CAST(r AS BIGINT) * 64 + c AS v FROM ac WHERE n > 2), de AS (SELECT a, b FROM ed WHERE a IN (SELECT v FROM nw) AND b IN (SELECT v FROM nw))"
_DRAIN = f"WITH RECURSIVE {_g()}, {_D8}, {_FE}, {_ED}, {_REACH}, {_CY}, {_OFF}, {_IN}, {_NET}"
_DR = "dr2 AS (SELECT a AS s, b AS t FROM de UNION SELECT dr2.s, de.b FROM dr2 JOIN de ON de.a = dr2.t)"
query("drainage_network", f"{_DRAIN} SELECT r, c FROM nw")(lambda spark, d: _drainage(spark, d)[0].select("r", "c"))
query("drainage_edges", f"{_DRAIN} SELECT CAST(a // 64 AS INTEGER) AS r, CAST(a % 64 AS INTEGER) AS c, CAST(b // 64 AS INTEGER) AS nr, CAST(b % 64 AS INTEGER) AS nc FROM de")(lambda spark, d: _drainage(spark, d)[1].select("r", "c", "nr", "nc"))
query("reach_degrees", f"{_DRAIN}, {_DR} SELECT r, c, (SELECT count(*) FROM dr2 WHERE t = v AND s <> v) AS upstream_degree, (SELECT count(*) FROM dr2 WHERE s = v AND t <> v) AS downstream_degree FROM nw")(lambda spark, d: hydrology.graph_metrics(*_drainage(spark, d)).select("r", "c", "upstream_degree", "downstream_degree"))
query("drainage_density", f"{_DRAIN} SELECT r, c, round((SELECT count(*) FROM de) * 1.0 / (SELECT count(*) * (count(*) - 1) FROM nw), 12) AS density FROM nw")(lambda spark, d: hydrology.graph_metrics(*_drainage(spark, d)).select("r", "c", F.round("density", 12).alias("density")))
#: A walk of as many steps as it reaches cells meets each of them once, itself last if it is on a cycle; between it and the ends of the walk lies what comes after.
_WALK = "rs AS (SELECT s, count(*) AS n, count(*) FILTER (s = t) AS own FROM dr2 GROUP BY s), wk AS (SELECT a AS s, b AS t, 1 AS k FROM de UNION ALL SELECT wk.s, de.b, k + 1 FROM wk JOIN rs ON rs.s = wk.s JOIN de ON de.a = wk.t WHERE k < n)"
query("betweenness", f"{_DRAIN}, {_DR}, {_WALK}, th AS (SELECT t AS v, sum(n - own - k) AS pairs FROM wk JOIN rs USING (s) WHERE wk.s <> t GROUP BY t) SELECT r, c, round(coalesce(pairs, 0) / ((SELECT count(*) FROM nw) - 1.0) / ((SELECT count(*) FROM nw) - 2.0), 15) AS betweenness FROM nw LEFT JOIN th USING (v)")(
    lambda spark, d: hydrology.graph_metrics(*_drainage(spark, d)).select("r", "c", F.round("betweenness", 15).alias("betweenness"))
)
query("drainage_thinned")(lambda spark, d: hydrology.thin(_drainage(spark, d)[0], emb(spark, d)).select("r", "c"))

# ---------------------------------------------------------------- spectral

plain("fft_local", None, spectral.fft_local, "fft_peak", "fft_mean", "fft_entropy")
def _mirror(i: str, n: str) -> str:
    return f"CASE WHEN abs({i}) < {n} THEN abs({i}) ELSE 2 * ({n} - 1) - abs({i}) END"


def _fft_sql(size: int) -> str:
    """The transform of all windows one axis at a time: a sum over a row's weights and waves, then over a column's."""
    h, hann = size // 2, 0.5 - 0.5 * _np.cos(2 * _np.pi * _np.arange(size) / (size - 1))
    waves = ", ".join(f"({k}, {u}, {float(hann[k] * _np.cos(2 * _np.pi * u * k / size))!r}::DOUBLE, {float(-hann[k] * _np.sin(2 * _np.pi * u * k / size))!r}::DOUBLE)" for k in range(size) for u in range(-h, h))
    return (
        f"mx AS (SELECT max(r) + 1 AS nr, max(c) + 1 AS nc FROM g), tw AS (SELECT * FROM (VALUES {waves}) t(k, u, re, im)), "
        f"ac AS (SELECT g.r, g.c, k, u, re, im, {_mirror(f'(g.c + k - {h})', 'nc')} AS place FROM g, mx, tw), rp AS (SELECT a.r, a.c, u, sum(coalesce(b.z, 0) * re) AS re, sum(coalesce(b.z, 0) * im) AS im FROM ac a JOIN g b ON b.r = a.r AND b.c = place GROUP BY a.r, a.c, u), "
        f"ar AS (SELECT g.r, g.c, k, u AS v, re, im, {_mirror(f'(g.r + k - {h})', 'nr')} AS place FROM g, mx, tw), cp AS (SELECT a.r, a.c, p.u, v, sum(p.re * a.re - p.im * a.im) AS re, sum(p.re * a.im + p.im * a.re) AS im FROM ar a JOIN rp p ON p.c = a.c AND p.r = place GROUP BY a.r, a.c, p.u, v), "
        "mg AS (SELECT r, c, u, v, sqrt(re * re + im * im) AS m, sqrt(u * u + v * v) AS d FROM cp), tt AS (SELECT r, c, sum(m) AS t FROM mg GROUP BY r, c), "
        f"sn AS (SELECT a.r, a.c, count(b.z) AS seen FROM g a CROSS JOIN range({-h}, {h}) y(dr) CROSS JOIN range({-h}, {h}) x(dc) JOIN g b ON b.r = a.r + dr AND b.c = a.c + dc GROUP BY a.r, a.c), "
        f"ft AS (SELECT r, c, arg_max(d, m) FILTER (u <> 0 OR v <> 0) / sqrt({2 * h * h}) AS peak, sum(m / t * d) / sqrt({2 * h * h}) AS mean, -sum(m / t * log2(m / t + 1e-10)) / log2({size * size}) AS e FROM mg JOIN tt USING (r, c) GROUP BY r, c)"
    )


plain(
    "fft_power",
    f"WITH {_g()}, {_fft_sql(16)} SELECT g.r, g.c, " + ", ".join(f"CASE WHEN g.z IS NOT NULL AND 2 * seen >= 256 THEN round({v}, 6) + 0.0 END AS spectral_fft_{n}" for n, v in (("peak", "peak"), ("mean", "mean"), ("entropy", "e"))) + " FROM g JOIN ft USING (r, c) JOIN sn USING (r, c)",
    spectral.fft_power,
    "spectral_fft_peak", "spectral_fft_mean", "spectral_fft_entropy",
)
plain("mse_local", None, spectral.multiscale_entropy, "mse_1", "mse_2", "mse_4", "mse_8", "mse_slope")
plain("wavelet_local", None, spectral.wavelet_local, "wavelet_local_entropy", "wavelet_local_energy_ratio")
#: One level at a time, first along the rows, then the columns: coefficient k sums the values at 2k + 1 - j, mirrored half a cell beyond the ends.
_TAPS = spectral.daubechies(4)
_TP = "tp AS (SELECT * FROM (VALUES " + ", ".join(f"({j}, {float(lo)!r}::DOUBLE, {float(hi)!r}::DOUBLE)" for j, (lo, hi) in enumerate(zip(_TAPS[::-1], _TAPS * (-1.0) ** _np.arange(1, 9)))) + ") t(j, lo, hi))"


def _dwt_sql(levels: int = 3, source: str = "g") -> str:
    out, left = [_TP, f"x0 AS (SELECT r, c, coalesce(z, 0.0) AS z FROM {source})"], "x0"
    for i in range(1, levels + 1):
        for axis, other, src, values, name in (("r", "c", left, ("z",), f"y{i}"), ("c", "r", f"y{i}", ("l", "h"), f"b{i}")):
            n = f"(SELECT max({axis}) + 1 FROM {src})"
            at = f"(((2 * k + 1 - j) % (2 * {n})) + 2 * {n}) % (2 * {n})"
            sums = ", ".join(f"sum(s.{v} * lo) AS {v if v != 'z' else ''}l, sum(s.{v} * hi) AS {v if v != 'z' else ''}h" for v in values)
            out.append(f"p{name} AS (SELECT k, j, lo, hi, CASE WHEN e < {n} THEN e ELSE 2 * {n} - 1 - e END AS e FROM (SELECT k, j, lo, hi, {at} AS e FROM range(0, CAST(({n} + 7) // 2 AS BIGINT)) t(k), tp))")
            out.append(f"{name} AS (SELECT {f'CAST(k AS INTEGER) AS r, s.c' if axis == 'r' else 's.r, CAST(k AS INTEGER) AS c'}, {sums} FROM p{name} p JOIN {src} s ON s.{axis} = p.e GROUP BY k, s.{other})")
        left = f"x{i}"
        out.append(f"{left} AS (SELECT r, c, ll AS z FROM b{i})")
    bands = " UNION ALL ".join(f"SELECT '{band}' AS band, {levels + 1 - i} AS level, r, c, {col} AS w FROM b{i}" for i in range(1, levels + 1) for band, col in (("v", "lh"), ("h", "hl"), ("d", "hh")))
    return ", ".join([*out, f"bd AS ({bands} UNION ALL SELECT 'a', 0, r, c, z FROM {left})"])


query("wavelet_bands", f"WITH {_g()}, {_dwt_sql()} SELECT band, CAST(level AS INTEGER) AS level, r, c, {_r('w', 'w', 4)} FROM bd")(lambda spark, d: _out(spectral.wavelet_bands(emb(spark, d)), "w", digits=4, keys=("band", "level", "r", "c")))
query("wavelet_global", f"WITH {_g()}, {_dwt_sql()}, e AS (SELECT level, sum(w * w) AS energy FROM bd GROUP BY level) SELECT CAST(level AS INTEGER) AS level, round(energy, 2) AS energy, round(energy / (SELECT sum(energy) FROM e), 9) AS share FROM e")(
    lambda spark, d: spectral.wavelet_global(emb(spark, d)).select("level", F.round("energy", 2).alias("energy"), F.round("share", 9).alias("share"))
)
_ONE = {
    "energy": "SELECT level, sum(w * w) AS v FROM bd GROUP BY level",
    "variance": "SELECT level, avg(v) AS v FROM (SELECT level, band, var_pop(w) AS v FROM bd GROUP BY level, band) GROUP BY level",
    "entropy": "SELECT level, avg(v) AS v FROM (SELECT level, band, log2(sum(k)) - sum(k * log2(k)) / sum(k) AS v FROM (SELECT level, band, round(w, 9) AS w, count(*) AS k FROM bd GROUP BY ALL) GROUP BY level, band) GROUP BY level",
}
for _mode, _sum in _ONE.items():
    _share = ", ".join(f"round((SELECT v FROM e WHERE level = {k}) / sum(v), 9) AS {n}" for k, n in enumerate(("wavelet_approx_ratio", "wavelet_detail_1_ratio", "wavelet_detail_2_ratio", "wavelet_detail_3_ratio")))
    query(f"wavelet_metrics_{_mode}", f"WITH {_g()}, {_dwt_sql()}, e AS ({_sum}) SELECT round(sum(v), 2) AS wavelet_{_mode}, {_share}, round(1 - (SELECT v FROM e WHERE level = 0) / sum(v), 9) AS wavelet_detail_ratio FROM e")(
        lambda spark, d, m=_mode: spectral.wavelet_metrics(emb(spark, d), mode=m).select(F.round(f"wavelet_{m}", 2).alias(f"wavelet_{m}"), *[F.round(c, 9).alias(c) for c in ("wavelet_approx_ratio", "wavelet_detail_1_ratio", "wavelet_detail_2_ratio", "wavelet_detail_3_ratio", "wavelet_detail_ratio")])
    )
_BLOCK = lambda f, level, band: f"LEFT JOIN bd {band}{level} ON {band}{level}.band = '{band}' AND {band}{level}.level = {level} AND {band}{level}.r = g.r // {f} AND {band}{level}.c = g.c // {f}"
_BLOCKS = " ".join([_BLOCK(8, 0, "a"), *(_BLOCK(2 ** (4 - k), k, b) for k in (1, 2, 3) for b in "hvd")])
plain(
    "wavelet_coefficients",
    f"WITH {_g()}, {_dwt_sql()} SELECT g.r, g.c, " + ", ".join(f"CASE WHEN g.z IS NOT NULL THEN {_r(f'{b}{k}.w', n, 4).replace(f' AS {n}', '')} END AS {n}" for b, k, n in [("a", 0, "wavelet_approx_coef"), *((b, k, f"wavelet_{b}_detail_{k}") for k in (1, 2, 3) for b in "hvd")]) + f" FROM g {_BLOCKS}",
    spectral.wavelet_coefficients,
    "wavelet_approx_coef", *[f"wavelet_{b}_detail_{k}" for k in (1, 2, 3) for b in "hvd"],
    digits=4,
)
_LV = {k: " + ".join(f"{b}{k}.w * {b}{k}.w" for b in "hvd") for k in (1, 2, 3)}
plain(
    "wavelet_maps",
    f"WITH {_g()}, q AS (SELECT min(z) AS lo, quantile_cont(z, 0.99) AS hi FROM g), st AS (SELECT r, c, greatest(0.0, least(1.0, (z - lo) / (hi - lo))) AS z FROM g, q WHERE z IS NOT NULL UNION ALL SELECT r, c, NULL FROM g WHERE z IS NULL), {_dwt_sql(source='st')}, "
    f"m AS (SELECT g.r, g.c, g.z, a0.w AS low, {', '.join(f'{v} AS e{k}' for k, v in _LV.items())}, {', '.join(f'{b}{k}.w * {b}{k}.w AS {b}{k}' for k in (1, 2, 3) for b in 'hvd')} FROM g {_BLOCKS}) "
    "SELECT r, c, " + ", ".join(f"CASE WHEN z IS NOT NULL THEN round({v}, 6) ELSE 0.0 END + 0.0 AS {n}" for n, v in {"wavelet_approximation": "low", "wavelet_details": "e1 + e2 + e3", "wavelet_ratio": "CASE WHEN low <> 0 THEN (e1 + e2 + e3) / low ELSE 0.0 END", **{f"wavelet_level{k}": f"e{k}" for k in (1, 2, 3)}, **{f"wavelet_{n}_level{k}": f"{b}{k}" for k in (1, 2, 3) for b, n in spectral.DIRECTIONS.items()}}.items()) + " FROM m",
    spectral.wavelet_maps,
    "wavelet_approximation", "wavelet_details", "wavelet_ratio", *[f"wavelet_level{k}" for k in (1, 2, 3)], *[f"wavelet_{n}_level{k}" for k in (1, 2, 3) for n in spectral.DIRECTIONS.values()],
)
for _mode in ("energy", "entropy", "variance"):
    plain(f"local_wavelet_{_mode}", None, lambda g, m=_mode: spectral.local_wavelet(g, mode=m), f"local_wavelet_{_mode}", "local_wavelet_approx_ratio", "local_wavelet_detail_ratio", "local_wavelet_detail_1_ratio", "local_wavelet_detail_2_ratio")
plain("scale_entropy", None, spectral.scale_entropy, *[f"spectral_entropy_scale{s}" for s in (1, 2, 4, 8)])
plain("entropy_ratios", None, spectral.entropy_ratios, "mse_local_base", "mse_ratio_2_4", "mse_ratio_4_8")


def _se_sql(size: int, scales: tuple[int, ...]) -> str:
    """Sliding means of whole blocks, their distinct values in windows that reach size // 2 up and left."""
    out = []
    for s in scales:
        lo, hi = -(s // 2), s - s // 2
        out.append(f"sm{s} AS (SELECT a.r, a.c, round(avg(b.z), 9) AS v FROM g a CROSS JOIN range({lo}, {hi}) x(dr) CROSS JOIN range({lo}, {hi}) y(dc) JOIN g b ON b.r = a.r + dr AND b.c = a.c + dc GROUP BY a.r, a.c HAVING count(b.z) = {s * s})")
        lo, hi = -(size // 2), size - size // 2
        out.append(f"sc{s} AS (SELECT a.r, a.c, v, count(*) AS k FROM g a CROSS JOIN range({lo}, {hi}) x(dr) CROSS JOIN range({lo}, {hi}) y(dc) JOIN sm{s} b ON b.r = a.r + dr AND b.c = a.c + dc WHERE a.z IS NOT NULL GROUP BY a.r, a.c, v)")
        out.append(f"se{s} AS (SELECT r, c, log2(sum(k)) - sum(k * log2(k)) / sum(k) AS e FROM sc{s} GROUP BY r, c HAVING sum(k) >= {max(size // 2, 1)})")
    return ", ".join(out)


plain(
    "scale_entropy_6", f"WITH {_g()}, {_se_sql(6, (1, 2))} SELECT g.r, g.c, {_r('se1.e', 'spectral_entropy_scale1')}, {_r('se2.e', 'spectral_entropy_scale2')} FROM g LEFT JOIN se1 USING (r, c) LEFT JOIN se2 USING (r, c)",
    lambda g: spectral.scale_entropy(g, (1, 2), 6), "spectral_entropy_scale1", "spectral_entropy_scale2",
)
plain(
    "entropy_ratios_6", f"WITH {_g()}, {_se_sql(6, (1, 2, 3))} SELECT g.r, g.c, {_r('se1.e', 'mse_local_base')}, CASE WHEN g.z IS NOT NULL THEN coalesce(CASE WHEN se3.e > 0 THEN round(se2.e / se3.e, 6) END, 0.0) + 0.0 END AS mse_ratio_2_3 FROM g LEFT JOIN se1 USING (r, c) LEFT JOIN se2 USING (r, c) LEFT JOIN se3 USING (r, c)",
    lambda g: spectral.entropy_ratios(g, (2, 3), 6), "mse_local_base", "mse_ratio_2_3",
)
plain(
    "spectral_sobel",
    f"WITH {_g()}, f AS (SELECT r, c, z IS NOT NULL AS valid, coalesce(z, 0.0) AS z FROM g), {_near(True, 'f')}, w AS (SELECT a.r, a.c, coalesce(b.z, 0.0) AS v, count(*) AS k FROM g a CROSS JOIN range(-2, 3) x(dr) CROSS JOIN range(-2, 3) y(dc) LEFT JOIN g b ON b.r = a.r + dr AND b.c = a.c + dc GROUP BY a.r, a.c, coalesce(b.z, 0.0)), e AS (SELECT r, c, log2(25) - sum(k * log2(k)) / 25 AS e FROM w GROUP BY r, c) SELECT r, c, CASE WHEN valid THEN round(sqrt(pow({_DX}, 2) + pow({_DY}, 2)), 6) ELSE 0.0 END + 0.0 AS grad_mag_sobel, CASE WHEN valid THEN round(e, 6) ELSE 0.0 END + 0.0 AS entropy FROM s JOIN e USING (r, c)",
    spectral.spectral_sobel, "grad_mag_sobel", "entropy",
)
plain(
    "spectral_basic",
    f"WITH {_g()}, {_near()}, {_win(3, name='w3')}, {_win(5, name='w5')}, {_win(9, name='w9')}, a AS (SELECT r, c, stddev_pop(v) AS s3 FROM w3 GROUP BY r, c), b AS (SELECT r, c, stddev_pop(v) AS s5, count(v) AS n5 FROM w5 GROUP BY r, c), d AS (SELECT r, c, stddev_pop(v) AS s9 FROM w9 GROUP BY r, c), x AS (SELECT s.*, s3, s5, s9, (z IS NOT NULL AND n5 >= 13) AS ok FROM s JOIN a USING (r, c) JOIN b USING (r, c) JOIN d USING (r, c)), y AS (SELECT *, coalesce(CASE WHEN ok THEN (z6 - z4) / 2 END, 0.0) AS gx, coalesce(CASE WHEN ok THEN (z8 - z2) / 2 END, 0.0) AS gy FROM x) SELECT r, c, coalesce(CASE WHEN ok THEN round(s5, 6) END, 0.0) + 0.0 AS std, gx + 0.0 AS grad_x, gy + 0.0 AS grad_y, {_r('sqrt(gx * gx + gy * gy)', 'grad_mag')}, coalesce(CASE WHEN ok THEN z2 + z4 + z6 + z8 - 4 * z5 END, 0.0) + 0.0 AS laplacian, coalesce(CASE WHEN z IS NOT NULL AND s9 > 0 THEN round(s3 / s9, 6) END, 0.0) + 0.0 AS freq_ratio FROM y",
    spectral.spectral_basic,
    "std", "grad_x", "grad_y", "grad_mag", "laplacian", "freq_ratio",
)

# ---------------------------------------------------------------- learning

query("patches", f"WITH {_g(False)}, {_win(7)} SELECT r, c, sum(v * ((dr + 3) * 7 + dc + 4)) + 0.0 AS checksum, CAST(count(*) AS BIGINT) AS n FROM w WHERE v IS NOT NULL GROUP BY r, c HAVING count(*) = 49")(
    lambda spark, d: ml.patches(emb(spark, d, False)).select("r", "c", (F.aggregate(F.zip_with("patch", F.sequence(F.lit(1), F.lit(49)), lambda v, i: v * i), F.lit(0.0), lambda s, x: s + x) + 0.0).alias("checksum"), F.size("patch").cast("long").alias("n"))
)
query("pca")(lambda spark, d: _out(ml.pca(ml.patches(emb(spark, d, False)))[0], "pca_1", "pca_2"))
query("kmeans")(lambda spark, d: ml.clusters(ml.patches(emb(spark, d, False))).select("r", "c", "cluster_label"))
query("spectral_clusters")(lambda spark, d: ml.spectral_clusters(ml.patches(emb(spark, d, False), 3)).select("r", "c", "cluster_label"))
query("autoencoder")(lambda spark, d: _out(ml.autoencoder(ml.patches(emb(spark, d, False))), "autoencoder_latent_1", "autoencoder_latent_2"))
query("feature_pca")(lambda spark, d: ml.feature_pca(_items(spark, d).withColumn("id", F.struct("l_orderkey", "l_linenumber")), NUMBERS)[0].select("id.*", F.round("pca_1", 6).alias("pca_1"), F.round("pca_2", 6).alias("pca_2")))

# ---------------------------------------------------------------- feature tables

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def _each(sql: str, names=tuple(NUMBERS)) -> str:
    return " UNION ALL ".join(sql.replace("$", n) for n in names)


_SK = "SELECT '$' AS feature, count($) * 1.0 AS n, min($) AS mn, max($) AS mx, avg($) AS a, median($) AS md, stddev_samp($) AS sd, var_pop($) AS v, count(*) - count($) AS missing, count(DISTINCT $) AS nu, (SELECT sum(pow($ - (SELECT avg($) FROM lineitem), 3)) / count($) FROM lineitem) AS m3, (SELECT sum(pow($ - (SELECT avg($) FROM lineitem), 4)) / count($) FROM lineitem) AS m4 FROM lineitem"
query("profile", f"WITH t AS ({_each(_SK)}) SELECT feature, round(mn, 6) AS min, round(mx, 6) AS max, round(a, 4) AS mean, round(md, 6) AS median, round(sd, 6) AS std, round(sqrt(n * (n - 1)) / (n - 2) * m3 / pow(v, 1.5), 6) AS skew, round((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (v * v) - 3) + 6), 6) AS kurtosis, CAST(n AS BIGINT) AS count, CAST(missing AS BIGINT) AS missing, nu AS n_unique FROM t")(
    lambda spark, d: tables.profile(_items(spark, d), NUMBERS).select("feature", *[F.round(c, 4 if c == "mean" else 6).alias(c) for c in ("min", "max", "mean", "median", "std", "skew", "kurtosis")], "count", "missing", "n_unique")
)
_PAIRS = [(a, b) for i, a in enumerate(sorted(NUMBERS)) for b in sorted(NUMBERS)[i + 1 :]]
query("corr_pearson", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS corr FROM lineitem" for a, b in _PAIRS))(lambda spark, d: tables.correlations(_items(spark, d), NUMBERS).select("a", "b", F.round("corr", 8).alias("corr")))
_RK = ", ".join(f"rank() OVER (ORDER BY {n}) + (count(*) OVER (PARTITION BY {n}) - 1) / 2.0 AS {n}" for n in ("p_size", "p_retailprice"))
query("corr_spearman", f"WITH t AS (SELECT {_RK} FROM part) SELECT 'p_retailprice' AS a, 'p_size' AS b, round(corr(p_retailprice, p_size), 8) AS corr FROM t")(lambda spark, d: tables.correlations(spark.read.parquet(f"{d}/part.parquet"), ["p_size", "p_retailprice"], "spearman").select("a", "b", F.round("corr", 8).alias("corr")))
_KD = "WITH t AS (SELECT s_suppkey AS i, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier), p AS (SELECT sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy FROM t a JOIN t b ON a.i < b.i) SELECT 's_acctbal' AS a, 's_nationkey' AS b, round(sum(sx * sy) / sqrt(sum(abs(sx)) * sum(abs(sy))), 8) AS corr FROM p"
query("corr_kendall", _KD)(lambda spark, d: tables.correlations(spark.read.parquet(f"{d}/supplier.parquet"), ["s_acctbal", "s_nationkey"], "kendall").select("a", "b", F.round("corr", 8).alias("corr")))
query("corr_topk", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS corr FROM lineitem" for a, b in _PAIRS) + ") WHERE abs(corr) >= 0.002")(lambda spark, d: tables.strong_correlations(_items(spark, d), NUMBERS, 0.002).select("a", "b", F.round("corr", 8).alias("corr")))
query("topk_variance", f"SELECT feature, round(v, 4) AS variance FROM ({_each("SELECT '$' AS feature, var_pop($) AS v FROM lineitem")}) ORDER BY v DESC LIMIT 2")(lambda spark, d: tables.top_variance(_items(spark, d), NUMBERS, 2).select("feature", F.round("variance", 4).alias("variance")))
query("feature_ranges", _each("SELECT '$' AS feature, round(min($), 8) AS min, round(max($), 8) AS max FROM lineitem"))(lambda spark, d: tables.feature_ranges(_items(spark, d), NUMBERS))
query("histogram", "WITH b AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) AS t FROM lineitem), k AS (SELECT CAST(least(floor((l_quantity - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1) SELECT bin, round(lo + bin * ((hi - lo) / 30), 6) AS lo, n, round(n * 1.0 / t / ((hi - lo) / 30), 9) AS density FROM k, b")(
    lambda spark, d: tables.histogram(_items(spark, d), "l_quantity").select("bin", F.round("lo", 6).alias("lo"), "n", F.round("density", 9).alias("density"))
)
plain("percentile_stretch", f"WITH {_g()}, p AS (SELECT quantile_cont(z, 0.01) AS lo, quantile_cont(z, 0.99) AS hi FROM g) SELECT r, c, {_r('CASE WHEN z IS NOT NULL THEN greatest(0.0, least(1.0, (z - lo) / (hi - lo))) END', 'stretched')} FROM g, p", lambda g: tables.percentile_stretch(g, "z"), "stretched")
_FEATURES = sorted({f for v in tables.CATEGORIES.values() for f in v} | {"pca_7", "cluster_size", "glcm_x", "wavelet_detail_3", "multiscale_entropy_8", "flow_x", "total_degree", "spectral_x", "elevation", "local_glcm_energy", "meander", "basic_std"})
query("category_lookup", "WITH f AS (SELECT unnest([" + ", ".join(f"'{f}'" for f in _FEATURES) + "]) AS feature), k AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}', '{f}')" for i, (c, v) in enumerate(tables.CATEGORIES.items()) for f in v) + ") t(o, cat, name) UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({10 + i}, '{c}', '{h}')" for i, (c, h, t) in enumerate(tables.LATER) if h) + ") u(o, cat, name)) SELECT feature, coalesce((SELECT first(cat ORDER BY o) FROM k WHERE starts_with(feature, name)), CASE WHEN ends_with(feature, '_degree') THEN 'hydrology' ELSE 'other' END) AS category FROM f")(
    lambda spark, d: spark.createDataFrame([(f,) for f in _FEATURES], "feature string").select("feature", tables.category(F.col("feature")).alias("category"))
)
_DS = "".join(f" WHEN feature = '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in tables.DESCRIPTIONS.items())
_DT = " WHEN starts_with(feature, 'pca_') THEN 'Principal component ' || split_part(feature, '_', 2) WHEN starts_with(feature, 'autoencoder_latent_') THEN 'Autoencoder latent dimension ' || split_part(feature, '_', -1) WHEN starts_with(feature, 'wavelet_detail_') THEN 'Ratio of detail coefficients energy at level ' || split_part(feature, '_', -1) WHEN regexp_matches(feature, '^multiscale_entropy_.*[0-9]+$') THEN 'Entropy at scale ' || split_part(feature, '_', -1) WHEN starts_with(feature, 'local_glcm_') THEN 'Local GLCM ' || replace(feature, 'local_glcm_', '') || ' in window'"
query("feature_descriptions", "WITH f AS (SELECT unnest([" + ", ".join(f"'{f}'" for f in _FEATURES) + f"]) AS feature) SELECT feature, CASE{_DS}{_DT} ELSE 'Feature derived from elevation data' END AS description FROM f")(lambda spark, d: spark.createDataFrame([(f,) for f in _FEATURES], "feature string").select("feature", tables.description(F.col("feature")).alias("description")))
_PTS = "pt AS (SELECT event_id AS id, CAST(user_id AS DOUBLE) AS x, CAST(hour(ts) AS DOUBLE) AS y, round(value, 4) AS v FROM events)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.col("user_id").cast("double").alias("x"), F.hour("ts").cast("double").alias("y"), F.round("value", 4).alias("v"))


query("points_to_grid", f"WITH {_PTS}, l AS (SELECT x, y, max_by(v, id) AS z FROM pt GROUP BY x, y) SELECT CAST(dense_rank() OVER (ORDER BY y) - 1 AS INTEGER) AS r, CAST(dense_rank() OVER (ORDER BY x) - 1 AS INTEGER) AS c, z FROM l")(lambda spark, d: tables.points_to_grid(_points(spark, d), "v").select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "z"))
query("aspect_repair", f"WITH {_PTS}, q AS (SELECT id, 1.0 AS x, id AS y, v FROM pt), s AS (SELECT CAST(floor(sqrt(count(v))) AS BIGINT) AS side FROM q), o AS (SELECT v, row_number() OVER (ORDER BY id) - 1 AS k FROM q WHERE v IS NOT NULL) SELECT k // side AS r, k % side AS c, v AS z FROM o, s WHERE k < side * side")(
    lambda spark, d: tables.square_repair(_points(spark, d).select("id", F.lit(1.0).alias("x"), F.col("id").alias("y"), "v"), "v").select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "z")
)
_WG = "exp(-dr * dr / 2.0) * exp(-dc * dc / 2.0)"
plain("gaussian_smooth", f"WITH {_g()}, {_win(9)} SELECT r, c, {_r(f'sum(v * {_WG}) / sum(CASE WHEN v IS NOT NULL THEN {_WG} END)', 'smooth')} FROM w GROUP BY r, c", tables.gaussian_smooth, "smooth")
query("density", f"WITH {SHIP} SELECT 'ship' AS raster_id, count(z) AS valid, count(*) AS total, round(100.0 * count(z) / count(*), 9) AS percent FROM g")(lambda spark, d: tables.density(ship(spark, d), "z").select("raster_id", "valid", "total", F.round("percent", 9).alias("percent")))
query("raster_stats", f"WITH {_g()} SELECT min(z) AS min, max(z) AS max, round(avg(z), 6) AS mean, round(stddev_pop(z), 6) AS std, median(z) AS median, count(z) AS count, count(*) AS total, round(100.0 * count(z) / count(*), 9) AS valid_percentage FROM g")(
    lambda spark, d: tables.raster_stats(emb(spark, d)).select("min", "max", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "median", "count", "total", F.round("valid_percentage", 9).alias("valid_percentage"))
)
query("compare_join", "SELECT p_partkey AS id, p_retailprice AS a, CAST(p_size AS DOUBLE) AS b FROM part")(
    lambda spark, d: tables.compare({"a": spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), "p_retailprice"), "b": spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("p_size"))}, {"a": "retail", "b": "p_size"})
)
query("player_frames", "WITH t AS (SELECT s_suppkey AS id, s_acctbal AS v, s_name AS name, lead(s_acctbal) OVER (ORDER BY s_suppkey) AS nv, lead(s_suppkey) OVER (ORDER BY s_suppkey) AS ni FROM supplier) SELECT id, CAST(k AS INTEGER) AS k, round(v + (nv - v) * (k * 16 / 500.0), 6) AS v, name FROM t, range(0, 32) r(k) WHERE ni IS NOT NULL")(
    lambda spark, d: player_frames(spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v"), F.col("s_name").alias("name")), ["v", "name"]).select("id", "k", F.round("v", 6).alias("v"), "name")
)
_CM = " UNION ALL ".join("SELECT '$' AS feature, ".replace("$", a) + ", ".join(f"round({'1.0' if a == b else f'corr({a}, {b})'}, 8) AS {b}" for b in sorted(NUMBERS)) + " FROM lineitem" for a in sorted(NUMBERS))
query("correlation_matrix", _CM)(lambda spark, d: tables.correlation_matrix(_items(spark, d), NUMBERS).select("feature", *[F.round(n, 8).alias(n) for n in sorted(NUMBERS)]))
query("feature_metadata", _each("SELECT '$' AS feature, 'other' AS category, 'Feature derived from elevation data' AS description, 'double' AS dtype, min($) AS min, max($) AS max, round(avg($), 4) AS mean, round(median($), 6) AS median, round(stddev_samp($), 6) AS std, count($) AS count, count(*) - count($) AS missing FROM lineitem"))(
    lambda spark, d: tables.feature_metadata(_items(spark, d), NUMBERS).select("feature", "category", "description", "dtype", "min", "max", F.round("mean", 4).alias("mean"), F.round("median", 6).alias("median"), F.round("std", 6).alias("std"), "count", "missing")
)
query("first_features", " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS place, '{n}' AS feature, min({n}) AS min, max({n}) AS max, round(avg({n}), 4) AS mean FROM lineitem" for i, n in enumerate(NUMBERS[:3])))(
    lambda spark, d: tables.first_features(_items(spark, d), NUMBERS, 3).select("place", "feature", "min", "max", F.round("mean", 4).alias("mean"))
)
query("feature_names", "SELECT unnest(['l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature")(
    lambda spark, d: spark.createDataFrame([(n,) for n in tables.feature_names(_items(spark, d), ("l_orderkey", "l_partkey", "l_suppkey"))], "feature string")
)
query("analyze_categories", "SELECT * FROM (VALUES ('ml', 2, 'autoencoder_latent_1,pca_9'), ('other', 2, 'basic_x,elevation'), ('terrain', 1, 'slope')) t(category, n, features)")(
    lambda spark, d: tables.analyze(spark.range(1), ["slope", "pca_9", "basic_x", "elevation", "autoencoder_latent_1"]).select("category", F.col("n").cast("int").alias("n"), F.array_join("features", ",").alias("features"))
)
_VG = "SELECT 'emb' AS raster_id, feature, cells, missing, cells AS rows, true AS ok, missing = cells AS empty, mn AS min, mx AS max, round(a, 4) AS mean, round(sd, 4) AS std FROM ("
query("validate_features", f"WITH {_g()} {_VG}SELECT 'z' AS feature, count(*) AS cells, count(*) - count(z) AS missing, min(z) AS mn, max(z) AS mx, avg(z) AS a, stddev_pop(z) AS sd FROM g UNION ALL SELECT 'none', count(*), count(*), NULL, NULL, NULL, NULL FROM g)")(
    lambda spark, d: tables.validate(emb(spark, d).withColumn("none", F.lit(None).cast("double")), emb(spark, d), ["z", "none"]).select("raster_id", "feature", "cells", "missing", "rows", "ok", "empty", "min", "max", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))
)
query("gather_by_id", f"WITH {_g()} SELECT CAST(r AS BIGINT) * 64 + c AS id, z AS elevation, 2 * z AS twice FROM g WHERE z IS NOT NULL")(
    lambda spark, d: G.gather(G.feature_table(emb(spark, d), []), emb(spark, d).withColumn("twice", 2 * F.col("z")), "twice").select("id", "elevation", "twice")
)


def _roundtrip(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    path = scratch_path(spark, "ascii")
    sources.write_ascii_grid(emb(spark, sf_dir).unionByName(ship(spark, sf_dir)), path, G.Transform(500.0, 900.0, 2.0, -2.0))
    return sources.join_parts(*sources.read_ascii_grid(spark, f"{path}/*/*.txt"))


def _written(spark: SparkSession, sf_dir: str, cells: DataFrame) -> DataFrame:
    """cells without the rows of emb that no vector has: the files are dense and hold them as missing."""
    there = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.lit("emb").alias("raster_id"), F.col("vec_id").cast("int").alias("r"), F.lit(True).alias("there"))
    return cells.join(there, ["raster_id", "r"], "left").where("there or raster_id <> 'emb'")


query("ascii_roundtrip", f"WITH e AS (WITH {_g()} SELECT * FROM g), s AS (WITH {SHIP} SELECT r, c, z FROM g) SELECT 'emb' AS raster_id, r, c, z + 0.0 AS z FROM e UNION ALL SELECT 'ship', r, c, z + 0.0 FROM s")(
    lambda spark, d: _out(_written(spark, d, _roundtrip(spark, d)[0]), "z", keys=G.KEYS)
)
query("ascii_headers", f"WITH e AS (WITH {_g()} SELECT * FROM g), s AS (WITH {SHIP} SELECT r, c, z FROM g), n AS (SELECT 'emb' AS raster_id, max(c) + 1.0 AS ncols, max(r) + 1.0 AS nrows FROM e UNION ALL SELECT 'ship', max(c) + 1.0, max(r) + 1.0 FROM s) SELECT raster_id, CAST(ncols AS DOUBLE) AS ncols, CAST(nrows AS DOUBLE) AS nrows, CAST(500 AS DOUBLE) AS xll, CAST(900 - 2 * nrows AS DOUBLE) AS yll, CAST(2 AS DOUBLE) AS cellsize, CAST(-9999 AS DOUBLE) AS nodata, CAST(500 AS DOUBLE) AS x0, CAST(900 AS DOUBLE) AS y0 FROM n")(
    lambda spark, d: _roundtrip(spark, d)[1]
)
_TWO = f"e AS (WITH {_g()} SELECT 'emb' AS raster_id, r, c, z FROM g), s AS (WITH {SHIP} SELECT 'ship' AS raster_id, r, c, z FROM g), b AS (SELECT * FROM e UNION ALL SELECT * FROM s)"


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    # both are read several times: written once, they are not made anew each time
    both, t = cut(emb(spark, sf_dir).unionByName(ship(spark, sf_dir))), G.Transform(500.0, 900.0, 2.0, -2.0)
    table = cut(G.feature_table(both.withColumn("half", F.col("z") / 2), ["half"], t))
    meta = sources.with_feature_stats(sources.metadata(both, table, ["half"], ["own"], t), table, ["half", "elevation"])
    at = lambda path, kind: F.get_json_object("json", f"$.{path}").cast(kind)
    return meta.select(
        "raster_id", at("raster_info.stats.min", "double").alias("min"), at("raster_info.stats.median", "double").alias("median"), at("raster_info.stats.total", "long").alias("total"), at("extraction_info.exported_rows", "long").alias("exported_rows"),
        at("raster_info.bounds.bottom", "double").alias("bottom"), at("raster_info.bounds.right", "double").alias("right_"), at("feature_stats.half.max", "double").alias("half_max"), at("feature_stats.elevation.min", "double").alias("elevation_min"),
    )


query("metadata_stats", f"WITH {_TWO} SELECT raster_id, min(z) AS min, median(z) AS median, count(*) AS total, count(z) AS exported_rows, CAST(900 - 2 * (max(r) + 1) AS DOUBLE) AS bottom, CAST(500 + 2 * (max(c) + 1) AS DOUBLE) AS right_, round(max(z) / 2, 8) AS half_max, round(min(z), 8) AS elevation_min FROM b GROUP BY raster_id")(_metadata)
query("extract_table", f"WITH {_g()}, {_near(True)}, {_win(5)}, k AS (SELECT r, c, avg(v) AS a, stddev_pop(v) AS sd, count(v) AS n FROM w GROUP BY r, c), d AS (SELECT *, {_DX} / 80 AS dx, {_DY} / 80 AS dy FROM s) SELECT 'emb' AS raster_id, CAST(r AS BIGINT) * 64 + c AS id, 500000.0 + 10.0 * c AS x, 4200000.0 - 10.0 * r AS y, z AS elevation, CASE WHEN dx IS NOT NULL AND dy IS NOT NULL THEN {_SLOPE} END AS slope, {_r('a', 'mean')}, {_r('sd', 'stddev')}, n AS valid_count FROM d JOIN k USING (r, c) WHERE z IS NOT NULL")(
    lambda spark, d: extract.extract(emb(spark, d), ("terrain", "stats"), extract.Settings(cell=10.0), T).select("raster_id", "id", "x", "y", "elevation", *[(F.round(c, 6) + 0.0).alias(c) for c in ("slope", "mean", "stddev")], "valid_count")
)
query("sample_rows")(lambda spark, d: tables.sample_rows(_points(spark, d), n=500))
