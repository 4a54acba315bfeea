"""Spatial autocorrelation over adjacency by key arithmetic; only cells with a value take part."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from rasterlake.functions import neighbourhood
from rasterlake.grid import KEYS
from rasterlake.plans import cut


def offsets(kind: str = "queen", threshold: float = math.sqrt(2)) -> list[tuple[int, int]]:
    """rook, queen or distance: which (dr, dc) are neighbours."""
    h = int(threshold) if kind == "distance" else 1
    every = [(i, j) for i in range(-h, h + 1) for j in range(-h, h + 1) if (i, j) != (0, 0)]
    return [(i, j) for i, j in every if kind == "queen" or (kind == "rook" and abs(i) + abs(j) == 1) or (kind == "distance" and i * i + j * j <= threshold * threshold + 1e-9)]


def _sent(cells: DataFrame, kind: str, threshold: float, value: Column) -> DataFrame:
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("y"), F.lit(j).alias("x")) for i, j in offsets(kind, threshold)]))
    return cells.where("z is not null").select(*KEYS, value.alias("nz"), steps.alias("o")).select("raster_id", (F.col("r") + F.col("o.y")).alias("r"), (F.col("c") + F.col("o.x")).alias("c"), F.col("r").alias("nr"), F.col("c").alias("nc"), "nz")


def adjacency(cells: DataFrame, kind: str = "queen", threshold: float = math.sqrt(2)) -> DataFrame:
    """Edges (raster_id, r, c, nr, nc) between cells with a value, each in both directions."""
    return _sent(cells, kind, threshold, F.col("z")).join(cells.where("z is not null").select(*KEYS), list(KEYS), "left_semi").select(*KEYS, "nr", "nc")


def _neighbour_sums(cells: DataFrame, kind: str, threshold: float) -> DataFrame:
    """z, the neighbours' number k, and the sums s and q of their values and squares about the raster's mean m; also sd and n."""
    steps = offsets(kind, threshold)
    h = max(1, *(max(abs(i), abs(j)) for i, j in steps)) if steps else 1
    centred = cells.select(*KEYS, "z").join(_moments(cells), "raster_id").withColumn("d", F.col("z") - F.col("m"))
    near = [F.col("near")[(i + h) * (2 * h + 1) + j + h] for i, j in steps]
    k = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in near), F.lit(0))
    s = sum((F.coalesce(x, F.lit(0.0)) for x in near), F.lit(0.0))
    q = sum((F.coalesce(x * x, F.lit(0.0)) for x in near), F.lit(0.0))
    return neighbourhood(centred, h, "d").where("z is not null").select(*KEYS, "z", "d", "m", "sd", "n", k.cast("long").alias("k"), s.alias("s"), q.alias("q"))


def _moments(cells: DataFrame) -> DataFrame:
    return cells.where("z is not null").groupBy("raster_id").agg(F.avg("z").alias("m"), F.stddev_pop("z").alias("sd"), F.count("*").alias("n"))


def _moran_i(by: DataFrame) -> DataFrame:
    got = by.groupBy("raster_id").agg(F.first("n").alias("n"), F.sum("k").alias("s0"), F.sum(F.col("d") * F.col("s")).alias("num"), F.sum(F.col("d") * F.col("d")).alias("den"))
    return got.select("raster_id", F.when((F.col("s0") == 0) | (F.col("den") == 0), 0.0).otherwise(F.col("n") / F.col("s0") * F.col("num") / F.col("den")).alias("morans_i"))


def _geary_c(by: DataFrame) -> DataFrame:
    gaps = F.col("k") * F.col("d") * F.col("d") - 2 * F.col("d") * F.col("s") + F.col("q")
    got = by.groupBy("raster_id").agg(F.first("n").alias("n"), F.first("sd").alias("sd"), F.sum("k").alias("s0"), F.sum(gaps).alias("num"))
    return got.select("raster_id", F.when((F.col("s0") == 0) | (F.col("sd") == 0), 0.0).otherwise((F.col("n") - 1) * F.col("num") / (2 * F.col("s0") * F.col("n") * F.col("sd") * F.col("sd"))).alias("gearys_c"))


def _local_moran() -> Column:
    return F.when(F.col("sd") > 0, F.col("d") * F.col("s") / (F.col("sd") * F.col("sd"))).otherwise(0.0)


def _getis_ord(star: bool) -> Column:
    n, k, m, sd = (F.col(x) for x in ("n", "k", "m", "sd"))
    if star:
        k = k + 1
        num = F.col("s") + F.col("d")
    else:
        num = F.when(k > 0, F.col("s") / k + m).otherwise(0.0) - m * k
    den = sd * F.sqrt((n * k - k * k) / (n - 1))
    return F.when(den > 0, num / den).otherwise(0.0)


def _lag() -> Column:
    return F.when(F.col("k") > 0, F.col("s") / F.col("k") + F.col("m")).otherwise(0.0)


def moran_global(cells: DataFrame, kind: str = "queen", threshold: float = math.sqrt(2)) -> DataFrame:
    """(raster_id, morans_i); 0 without variance or links."""
    return _moran_i(_neighbour_sums(cells, kind, threshold))


def geary_global(cells: DataFrame, kind: str = "queen", threshold: float = math.sqrt(2)) -> DataFrame:
    """(raster_id, gearys_c); 0 without variance or links."""
    return _geary_c(_neighbour_sums(cells, kind, threshold))


def moran_local(cells: DataFrame, kind: str = "queen", threshold: float = math.sqrt(2)) -> DataFrame:
    return _neighbour_sums(cells, kind, threshold).select(*KEYS, _local_moran().alias("local_moran"))


def getis_ord(cells: DataFrame, kind: str = "queen", threshold: float = math.sqrt(2), star: bool = False) -> DataFrame:
    """G* with the neighbours' mean against the mean times their number, the cell left out; star=True is the usual form."""
    return _neighbour_sums(cells, kind, threshold).select(*KEYS, _getis_ord(star).alias("getis_ord"))


def spatial_lag(cells: DataFrame, kind: str = "queen", threshold: float = math.sqrt(2)) -> DataFrame:
    """Mean of the neighbours; 0 without any."""
    return _neighbour_sums(cells, kind, threshold).select(*KEYS, _lag().alias("spatial_lag"))


def spatial_features(cells: DataFrame, kind: str = "queen", threshold: float = math.sqrt(2)) -> DataFrame:
    """All five columns from one pass over the neighbours; the global ones are the same in every cell of a raster."""
    by = cut(_neighbour_sums(cells, kind, threshold))
    out = by.select(*KEYS, _local_moran().alias("local_moran"), _getis_ord(False).alias("getis_ord"), _lag().alias("spatial_lag"))
    return out.join(_moran_i(by), "raster_id").join(_geary_c(by), "raster_id")
