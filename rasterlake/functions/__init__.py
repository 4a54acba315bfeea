"""How neighbourhoods are lowered: stencils, separable windows, neighbourhoods as arrays, tiles, windows of tiles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterlake.grid import KEYS, with_shape

def _row():
    return Window.partitionBy("raster_id", "r").orderBy("c")


def _column():
    return Window.partitionBy("raster_id", "c").orderBy("r")


def stencil(cells: DataFrame, edge: str = "null", value: str = "z") -> DataFrame:
    """z1 to z9 (row above first, z5 the cell itself) beside each cell, in two window steps.

    Beyond the grid there is NULL, or with edge="clamp" the nearest cell of the grid. A missing cell inside
    the grid stays NULL either way. The grid must be dense.
    """

    def near(f, name, w):
        if edge == "clamp":
            return F.when(f(F.lit(1), 1).over(w).isNull(), F.col(name)).otherwise(f(name, 1).over(w))
        return f(name, 1).over(w)

    rows = cells.withColumns({"_w": near(F.lag, value, _row()), "_m": F.col(value), "_e": near(F.lead, value, _row())})
    new = {}
    for i, name in enumerate(("_w", "_m", "_e"), 1):
        new |= {f"z{i}": near(F.lag, name, _column()), f"z{i + 3}": F.col(name), f"z{i + 6}": near(F.lead, name, _column())}
    return rows.withColumns(new).drop("_w", "_m", "_e")


def _around(name: str, h: int, over) -> list[Column]:
    return [F.lag(name, -i).over(over) for i in range(-h, h + 1)]


def _total(terms: list[Column]) -> Column:
    return sum((F.coalesce(t, F.lit(0.0)) for t in terms[1:]), F.coalesce(terms[0], F.lit(0.0)))


def moving(cells: DataFrame, size: int, value: str = "z", prefix: str = "w_", powers: int = 4) -> DataFrame:
    """n, mean, std, min and max of value over size x size windows, and skew and kurt if powers is 4.

    Windows at the border and around missing cells use what there is. Central sums are taken about the mean of each row
    of the window, and the rows are merged about the window's, so that nothing is lost to cancellation
    wherever the values lie. The grid must be dense.
    """
    h, every = size // 2, range(2, powers + 1)
    v = [F.col(f"_v{i}") for i in range(2 * h + 1)]
    rows = cells.withColumns({f"_v{i}": x.cast("double") for i, x in enumerate(_around(value, h, _row()))})
    n = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in v), F.lit(0))
    rows = rows.withColumns({"_n": n, "_m": _total(v) / F.nullif(n, F.lit(0)), "_lo": F.least(*v, v[0]), "_hi": F.greatest(*v, v[0])})
    rows = rows.withColumns({f"_d{i}": x - F.col("_m") for i, x in enumerate(v)})
    power = lambda x, k: x * power(x, k - 1) if k > 1 else x
    sums = [_total([power(F.col(f"_d{i}"), k) for i in range(len(v))]).alias(f"q{k}") for k in every]
    one = F.struct(F.col("_n").alias("n"), F.col("_m").alias("m"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), *sums)
    rows = rows.select(*cells.columns, F.when(F.col("_n") > 0, one).alias("_g"))
    g = [F.col(f"_g{i}") for i in range(len(v))]
    rows = rows.withColumns({f"_g{i}": x for i, x in enumerate(_around("_g", h, _column()))})
    rows = rows.withColumn("_n", _total([x["n"] for x in g]).cast("long"))
    rows = rows.withColumns({"_m": _total([x["n"] * x["m"] for x in g]) / F.nullif(F.col("_n"), F.lit(0)), "_lo": F.least(*[x["lo"] for x in g], g[0]["lo"]), "_hi": F.greatest(*[x["hi"] for x in g], g[0]["hi"])})
    rows = rows.withColumns({f"_d{i}": x["m"] - F.col("_m") for i, x in enumerate(g)})
    d = [F.col(f"_d{i}") for i in range(len(v))]
    merged = {
        2: lambda x, y: x["q2"] + x["n"] * y * y,
        3: lambda x, y: x["q3"] + 3 * y * x["q2"] + x["n"] * y * y * y,
        4: lambda x, y: x["q4"] + 4 * y * x["q3"] + 6 * y * y * x["q2"] + x["n"] * y * y * y * y,
    }
    rows = rows.withColumns({f"_m{k}": _total([merged[k](x, y) for x, y in zip(g, d)]) / F.col("_n") for k in every})
    n, m2 = F.col("_n"), F.col("_m2")
    out = {"n": n, "mean": F.col("_m"), "std": F.when(n > 0, F.sqrt(m2)), "min": F.col("_lo"), "max": F.col("_hi")}
    if powers >= 4:
        out |= {"skew": F.when((n >= 3) & (m2 > 1e-12), F.col("_m3") / F.pow(m2, 1.5)), "kurt": F.when((n >= 4) & (m2 > 1e-12), F.col("_m4") / (m2 * m2) - 3)}
    return rows.select(*cells.columns, *[x.alias(prefix + k) for k, x in out.items()])


def neighbourhood(cells: DataFrame, h: int, value: str = "z", out: str = "near") -> DataFrame:
    """The (2h + 1)**2 values around each cell as an array in row order, NULL beyond the grid, in two window steps."""
    kind = dict(cells.dtypes)[value]
    rows = cells.withColumn("_near", F.array(*_around(value, h, _row())))
    none = F.array(*[F.lit(None).cast(kind)] * (2 * h + 1))
    return rows.withColumn(out, F.concat(*[F.coalesce(x, none) for x in _around("_near", h, _column())])).drop("_near")


def moving_sum(cells: DataFrame, size: int, value: str, out: str) -> DataFrame:
    h = size // 2
    return cells.withColumn(out, F.sum(value).over(_row().rangeBetween(-h, h))).withColumn(out, F.sum(out).over(_column().rangeBetween(-h, h)))


def reflect(i: np.ndarray, n: int) -> np.ndarray:
    """Index of a mirror that does not repeat the edge."""
    if n == 1:
        return np.zeros_like(i)
    i = np.abs(i) % (2 * (n - 1))
    return np.where(i >= n, 2 * (n - 1) - i, i)


def tiled(cells: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], columns: list[str], before: int, after: int, tile: int = 64, value: str = "z", edge: str = "mirror", placed: bool = False) -> DataFrame:
    """Runs a numpy kernel over tiles with a halo; (raster_id, r, c, columns) of all cells.

    kernel gets the padded values (NaN where missing; the border mirrored without its edge, or with edge="clamp"
    going on as its nearest cell) and which of them lie in the grid and have a value; it returns an array a
    column over the tile itself. With placed it also gets the rows and columns of the padded values, which may lie
    beyond the grid, and the grid's height and width. A cell is sent to the few tiles whose halo it is in; a task
    holds one tile at a time, whatever the raster's size.
    """
    t, halo = tile, max(before, after)
    sized = with_shape(cells.select(*KEYS, F.col(value).cast("double").alias("z")))
    low = lambda i: F.greatest(F.floor((F.col(i) - halo) / t), F.lit(0))
    high = lambda i, n: F.least(F.floor((F.col(i) + halo) / t), F.floor((F.col(n) - 1) / t))
    sent = sized.withColumn("tr", F.explode(F.sequence(low("r"), high("r", "height")))).withColumn("tc", F.explode(F.sequence(low("c"), high("c", "width"))))

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        height, width = int(part["height"].iloc[0]), int(part["width"].iloc[0])
        r0, c0 = int(key[1]) * t, int(key[2]) * t
        r1, c1 = min(r0 + t, height), min(c0 + t, width)
        lr, lc = max(0, r0 - halo), max(0, c0 - halo)
        own = np.full((min(height, r1 + halo) - lr, min(width, c1 + halo) - lc), np.nan)
        own[part["r"].to_numpy() - lr, part["c"].to_numpy() - lc] = part["z"].to_numpy(float)
        rows, cols = np.arange(r0 - before, r1 + after), np.arange(c0 - before, c1 + after)
        beyond = reflect if edge == "mirror" else lambda i, n: np.clip(i, 0, n - 1)
        values = own[np.ix_(beyond(rows, height) - lr, beyond(cols, width) - lc)]
        inside = ((rows >= 0) & (rows < height))[:, None] & ((cols >= 0) & (cols < width))[None, :]
        found = kernel(values, inside & ~np.isnan(values), *((rows, cols, height, width) if placed else ()))
        rr, cc = np.meshgrid(np.arange(r0, r1), np.arange(c0, c1), indexing="ij")
        out = {"raster_id": key[0], "r": rr.reshape(-1).astype(np.int32), "c": cc.reshape(-1).astype(np.int32)}
        # NaN stands for a missing number inside the kernels only
        return pd.DataFrame(out | {k: found[k].reshape(-1) for k in columns})

    form = "raster_id string, r int, c int, " + ", ".join(f"`{k}` double" for k in columns)
    out = sent.groupBy("raster_id", "tr", "tc").applyInPandas(run, form)
    return out.select(*KEYS, *[F.when(~F.isnan(k), F.col(k)).alias(k) for k in columns])


def windowed(cells: DataFrame, size: int, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], columns: list[str], value: str = "z", tile: int = 64, edge: str = "none") -> DataFrame:
    """Runs a numpy kernel over the size x size windows of all cells, a window a row, in row order.

    Values that are missing or beyond the grid are NaN; with edge="clamp" the grid goes on beyond its border as its
    nearest cell. A kernel gets a strip of windows at a time.
    """
    h, strip = size // 2, 1 << 20

    def run(values, valid):
        view = np.lib.stride_tricks.sliding_window_view(np.where(valid, values, np.nan) if edge == "none" else values, (size, size))
        rows, cols = view.shape[:2]
        step = max(1, strip // (cols * size * size))
        parts = [kernel(view[i : i + step].reshape(-1, size * size)) for i in range(0, rows, step)]
        return {k: np.concatenate([p[k] for p in parts]).reshape(rows, cols) for k in columns}

    return tiled(cells, run, columns, h, h, tile, value, "mirror" if edge == "none" else edge)
