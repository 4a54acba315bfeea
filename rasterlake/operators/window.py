"""Moving-window statistics. Windows use what values they have; the cell itself may have none."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from rasterlake.functions import moving, tiled, windowed
from rasterlake.grid import KEYS


def basic_stats(cells: DataFrame, size: int = 5) -> DataFrame:
    """mean, stddev (population), min, max and valid_count."""
    return moving(cells, size, powers=2).select(*KEYS, F.col("w_mean").alias("mean"), F.col("w_std").alias("stddev"), F.col("w_min").alias("min"), F.col("w_max").alias("max"), F.col("w_n").alias("valid_count"))


def higher_order_stats(cells: DataFrame, size: int = 5) -> DataFrame:
    """Biased skewness (of 3 values at least) and excess kurtosis (of 4); NULL for equal values."""
    return moving(cells, size).select(*KEYS, F.col("w_skew").alias("skewness"), F.col("w_kurt").alias("kurtosis"))


def moments(cells: DataFrame, size: int = 5) -> DataFrame:
    """What basic_stats and higher_order_stats give, from one pass."""
    names = {"mean": "w_mean", "stddev": "w_std", "min": "w_min", "max": "w_max", "valid_count": "w_n", "skewness": "w_skew", "kurtosis": "w_kurt"}
    return moving(cells, size).select(*KEYS, *[F.col(c).alias(n) for n, c in names.items()])


def _binned_entropy(v: np.ndarray, bins: np.ndarray, last: bool) -> np.ndarray:
    """Of each window, the entropy in bits over equal bins from its least to its greatest value; NaN below two values.

    bins holds the number for each window. The greatest value has a bin of its own, or with last belongs to the last.
    """
    there = ~np.isnan(v)
    n = there.sum(axis=1)
    lo = np.where(there, v, np.inf).min(axis=1, keepdims=True)
    hi = np.where(there, v, -np.inf).max(axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        at = np.where(hi == lo, 0.0, np.floor((v - lo) / (hi - lo) * bins[:, None]))
    at = np.minimum(at, (bins - 1)[:, None]) if last else at
    width = int(bins.max(initial=1)) + 1
    row = np.broadcast_to(np.arange(len(v))[:, None], v.shape)[there]
    counts = np.bincount(row * width + at[there].astype(np.int64), minlength=len(v) * width).reshape(len(v), width)
    p = counts / np.maximum(n, 1)[:, None]
    found = -(p * np.log2(np.where(p > 0, p, 1.0))).sum(axis=1)
    return np.where(n >= 2, found, np.nan)


def entropy(cells: DataFrame, size: int = 5, bins: int = 10) -> DataFrame:
    """Shannon entropy in bits of the window's values in bins + 1 bins, the last for the maximum alone; no row below two values."""
    kernel = lambda v: {"entropy": _binned_entropy(v, np.full(len(v), bins), False)}
    return windowed(cells, size, kernel, ["entropy"]).where("entropy is not null")


def box_dimension(n: int, size: int) -> float | None:
    """Slope of box counts by scale, which depend only on how many values fill the square of side floor(sqrt(n))."""
    side = math.isqrt(n)
    powers = range(int(math.log2(side))) if n >= size and side else range(0)
    if len(powers) < 2:
        return None
    x, y = [math.log(1 / 2**p) for p in powers], [math.log(math.ceil(side / 2**p) ** 2) for p in powers]
    mx, my = sum(x) / len(x), sum(y) / len(y)
    return min(2.0, max(1.0, sum((a - mx) * (b - my) for a, b in zip(x, y)) / sum((a - mx) ** 2 for a in x)))


def fractal_dimension(cells: DataFrame, size: int = 9) -> DataFrame:
    """Box-counting dimension over windows of at least 9 x 9; 1 where all values are equal."""
    size = max(9, size)
    value: Column = F.lit(None).cast("double")
    for n in range(size * size, 0, -1):
        d = box_dimension(n, size)
        if d is not None:
            value = F.when(F.col("w_n") == n, d).otherwise(value)
    equal = (F.col("w_n") >= size) & (F.col("w_min") == F.col("w_max"))
    return moving(cells, size, powers=2).select(*KEYS, F.when(equal, 1.0).otherwise(value).alias("fractal_dimension"))


def fractal_variation(cells: DataFrame, size: int = 9) -> DataFrame:
    """Dimension from the variances of every, every second and every fourth value of the window in row order.

    NULL below 8 values, and where a variance is 0.
    """
    ln2 = math.log(2)

    def spread(v, used):
        k = used.sum(axis=1)
        x = np.where(used, v, 0.0)
        m = x.sum(axis=1) / np.maximum(k, 1)
        return (np.where(used, v - m[:, None], 0.0) ** 2).sum(axis=1) / np.maximum(k, 1)

    def kernel(v):
        there = ~np.isnan(v)
        n, place = there.sum(axis=1), there.cumsum(axis=1) - 1
        with np.errstate(divide="ignore", invalid="ignore"):
            one, two, four = (np.log(spread(v, there & (place % s == 0))) for s in (1, 2, 4))
            slope = np.where(n >= 16, (four - one) / (2 * ln2), (two - one) / ln2)
        d = np.clip(2 - slope / 2, 1.0, 2.0)
        return {"fractal_dimension": np.where((n >= 8) & np.isfinite(slope), d, np.nan)}

    return windowed(cells, size, kernel, ["fractal_dimension"])


def order_stats(cells: DataFrame, size: int = 5) -> DataFrame:
    """median, variance, range, quartiles' range and z-score of the cell within its window; no row for a window without values."""
    names = ["median", "variance", "value_range", "iqr", "mean"]

    def kernel(v):
        n = (~np.isnan(v)).sum(axis=1)
        s = np.sort(v, axis=1)  # what is missing comes last
        rows = np.arange(len(v))

        def at(q):
            place = q * np.maximum(n - 1, 0)
            low = np.floor(place).astype(int)
            high = np.minimum(low + 1, np.maximum(n - 1, 0))
            return s[rows, low] + (s[rows, high] - s[rows, low]) * (place - low)

        m = np.nansum(v, axis=1) / np.maximum(n, 1)
        d = np.where(np.isnan(v), 0.0, v - m[:, None])
        out = (at(0.5), (d * d).sum(axis=1) / np.maximum(n, 1), s[rows, np.maximum(n - 1, 0)] - s[:, 0], at(0.75) - at(0.25), m)
        return {k: np.where(n > 0, x, np.nan) for k, x in zip(names, out)}

    got = windowed(cells, size, kernel, names).where("median is not null").join(cells.select(*KEYS, "z"), list(KEYS))
    return got.select(*KEYS, "median", "variance", "value_range", "iqr", F.when(F.col("variance") > 1e-12, (F.col("z") - F.col("mean")) / F.sqrt("variance")).alias("z_score"))


def sqrt_bin_entropy(cells: DataFrame, size: int = 5) -> DataFrame:
    """Entropy in as many bins as the root of the number of values, 32 at most; no row below two values."""

    def kernel(v):
        n = (~np.isnan(v)).sum(axis=1)
        return {"entropy": _binned_entropy(v, np.clip(np.floor(np.sqrt(n)), 1, 32).astype(int), True)}

    return windowed(cells, size, kernel, ["entropy"]).where("entropy is not null")


def transect(cells: DataFrame, length: int, angle: float) -> DataFrame:
    """(raster_id, r, c, i, z): values at round(r + i sin), round(c + i cos) for i from -length/2 to length/2."""
    h, a = length // 2, math.radians(angle)
    offsets = [(i, round(i * math.sin(a)), round(i * math.cos(a))) for i in range(-h, h + 1)]
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(y).alias("y"), F.lit(x).alias("x")) for i, y, x in offsets]))
    sent = cells.where("z is not null").withColumn("o", steps).select("raster_id", (F.col("r") - F.col("o.y")).alias("r"), (F.col("c") - F.col("o.x")).alias("c"), F.col("o.i").alias("i"), "z")
    return sent.join(cells.select(*KEYS), list(KEYS), "left_semi")


def multi_resolution(cells: DataFrame, sizes: tuple[int, ...] = (3, 5, 9)) -> DataFrame:
    """Mean and deviation for several window sizes side by side."""
    out = cells.select(*KEYS)
    for s in sizes:
        out = out.join(moving(cells, s, powers=2).select(*KEYS, F.col("w_mean").alias(f"mean_{s}"), F.col("w_std").alias(f"stddev_{s}")), list(KEYS))
    return out


def apply_window(cells: DataFrame, kernel, columns: list[str], size: int, tile: int = 64) -> DataFrame:
    """A numpy kernel of one's own over odd windows; see functions.tiled for what it gets."""
    return tiled(cells, kernel, columns, size // 2, size // 2, tile)
