"""The plain extractor: missing cells count as 0, and the grid goes on beyond its border as its nearest cell."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from rasterlake.functions import stencil, windowed
from rasterlake.grid import KEYS


def basic_features(cells: DataFrame, size: int = 5) -> DataFrame:
    """basic_slope, _aspect, _tri, _tpi, _roughness, _range, _std, _mean, _median, _laplacian; 0 where the cell has no value."""
    filled = cells.select(*KEYS, F.col("z").isNotNull().alias("valid"), F.coalesce("z", F.lit(0.0)).alias("z"))
    names = ["tri", "tpi", "span", "std", "mean", "median"]

    def kernel(v):
        own, mean, order = v[:, v.shape[1] // 2], v.mean(axis=1), np.sort(v, axis=1)
        out = (np.abs(v - own[:, None]).mean(axis=1), own - mean, order[:, -1] - order[:, 0], np.sqrt(((v - mean[:, None]) ** 2).mean(axis=1)), mean, order[:, v.shape[1] // 2])
        return dict(zip(names, out))

    got = windowed(filled, 2 * (size // 2) + 1, kernel, names, edge="clamp")
    dx = (F.col("z3") + 2 * F.col("z6") + F.col("z9")) - (F.col("z1") + 2 * F.col("z4") + F.col("z7"))
    dy = (F.col("z7") + 2 * F.col("z8") + F.col("z9")) - (F.col("z1") + 2 * F.col("z2") + F.col("z3"))
    both = stencil(filled, "clamp").join(got, list(KEYS))
    values = {
        "slope": F.sqrt(dx * dx + dy * dy), "aspect": F.atan2(dy, dx), "tri": F.col("tri"), "tpi": F.col("tpi"), "roughness": F.col("span"),
        "range": F.col("span"), "std": F.col("std"), "mean": F.col("mean"), "median": F.col("median"), "laplacian": F.col("z2") + F.col("z4") + F.col("z6") + F.col("z8") - 4 * F.col("z5"),
    }
    return both.select(*KEYS, *[F.when(F.col("valid"), v).otherwise(0.0).alias(f"basic_{k}") for k, v in values.items()])
