"""Texture: grey-level co-occurrence, local binary patterns, keypoint density."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterlake.functions import moving_sum, neighbourhood, stencil, tiled, windowed
from rasterlake.grid import KEYS, normalize

DISTANCES, ANGLES = (1, 2, 3), (0, 45, 90, 135)


def quantise(cells: DataFrame, levels: int = 32, missing: int | None = 0) -> DataFrame:
    """q = the normalised value times levels - 1, halves to even; cells without a value get missing."""
    q = F.rint(F.col("norm") * (levels - 1)).cast("int")
    return normalize(cells).select(*KEYS, "z", q.alias("q") if missing is None else F.coalesce(q, F.lit(missing)).alias("q"))


def glcm(cells: DataFrame, levels: int = 32, distances=DISTANCES, angles=ANGLES) -> DataFrame:
    """(raster_id, d, a, i, j, n): symmetric counts of level pairs at each distance and angle in degrees.

    Each cell sees the levels around it, so pairs are counted where they are, without a join.
    """
    h = max(distances)
    steps = [(d, a, round(d * math.sin(math.radians(a))), round(d * math.cos(math.radians(a)))) for d in distances for a in angles]
    near = neighbourhood(quantise(cells, levels).select(*KEYS, "q"), h, "q")
    pairs = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(a).alias("a"), F.col("near")[(y + h) * (2 * h + 1) + x + h].alias("j")) for d, a, y, x in steps])
    one = near.select("raster_id", F.col("q").alias("i"), F.explode(pairs).alias("p")).where("p.j is not null")
    one = one.groupBy("raster_id", "p.d", "p.a", "i", "p.j").agg(F.count("*").alias("n"))
    back = one.select("raster_id", "d", "a", F.col("j").alias("i"), F.col("i").alias("j"), "n")
    return one.unionByName(back).groupBy("raster_id", "d", "a", "i", "j").agg(F.sum("n").alias("n"))


def glcm_properties(counts: DataFrame, by: tuple[str, ...] = ("raster_id",)) -> DataFrame:
    """contrast, dissimilarity, homogeneity, energy, correlation: of each distance and angle, then their mean."""
    key = [*by, "d", "a"]
    total = counts.groupBy(*key).agg(F.sum("n").alias("t"), (F.sum(F.col("i") * F.col("n")) / F.sum("n")).alias("m"), F.sum(F.col("i") * F.col("i") * F.col("n")).alias("s2"))
    p, gap, m = F.col("n") / F.col("t"), F.col("i") - F.col("j"), F.col("m")
    one = counts.join(total, key).groupBy(*key).agg(
        F.sum(p * gap * gap).alias("contrast"), F.sum(p * F.abs(gap)).alias("dissimilarity"), F.sum(p / (1 + gap * gap)).alias("homogeneity"),
        F.sqrt(F.sum(p * p)).alias("energy"), F.sum(p * (F.col("i") - m) * (F.col("j") - m)).alias("cov"), F.first(F.col("s2") / F.col("t") - m * m).alias("var"),
    )
    one = one.withColumn("correlation", F.when(F.col("var") < 1e-15, 1.0).otherwise(F.col("cov") / F.col("var")))
    return one.groupBy(*by).agg(*[F.avg(x).alias(f"glcm_{x}") for x in ("contrast", "dissimilarity", "homogeneity", "energy", "correlation")])


# What stands in for a property that is 0, and the range that each localised column is kept in.
TYPICAL = {"contrast": 0.5, "dissimilarity": 0.3, "homogeneity": 0.8, "energy": 0.2, "correlation": 0.6}
RANGES = {"contrast": (0, 5), "dissimilarity": (0, 5), "homogeneity": (0, 1), "energy": (0, 1), "correlation": (-1, 1)}


def localised_glcm(cells: DataFrame, size: int = 15, levels: int = 32) -> DataFrame:
    """glcm_*: a raster's property plus half of it times the steepness along the rows around the cell; 0 without a value.

    Steepness is weighted over size x size cells (odd): contrast and dissimilarity sum it, the cell itself five times;
    homogeneity and energy take its mean; correlation a mean with the weights exp(-x*x - y*y), x and y from -1 to 1. The
    grid goes on beyond its border as its nearest cell. Measures only: nothing random is added.
    """
    if size % 2 == 0:
        raise ValueError("size must be odd")
    column = Window.partitionBy("raster_id", "c").orderBy("r")
    up, down = F.lag("_f").over(column), F.lead("_f").over(column)
    filled = cells.withColumn("_f", F.struct(F.col("z").alias("z")))  # a struct tells a missing value from no cell
    slope = F.when(up.isNull(), down["z"] - F.col("z")).when(down.isNull(), F.col("z") - up["z"]).otherwise((down["z"] - up["z"]) / 2)
    steep = filled.select(*KEYS, F.coalesce(F.abs(slope), F.lit(0.0)).alias("g"))
    x = np.linspace(-1, 1, size) if size > 1 else np.zeros(1)
    bell = np.exp(-(x[:, None] ** 2 + x**2)).reshape(-1)
    kernels = {"sharp": np.ones(size * size), "mean": np.full(size * size, 1 / size**2), "bell": bell / bell.sum()}
    kernels["sharp"][size * size // 2] = 5.0
    near = windowed(steep, size, lambda v: {k: v @ w for k, w in kernels.items()}, list(kernels), "g", edge="clamp")
    kind = {"contrast": "sharp", "dissimilarity": "sharp", "homogeneity": "mean", "energy": "mean", "correlation": "bell"}
    whole = glcm_properties(glcm(cells, levels))
    out = near.join(F.broadcast(whole), "raster_id", "left").join(cells.select(*KEYS, "z"), list(KEYS))
    avg = {k: F.when(F.coalesce(f"glcm_{k}", F.lit(0.0)) == 0, v).otherwise(F.col(f"glcm_{k}")) for k, v in TYPICAL.items()}
    value = {k: F.least(F.lit(float(RANGES[k][1])), F.greatest(F.lit(float(RANGES[k][0])), avg[k] + 0.5 * avg[k] * F.col(kind[k]))) for k in TYPICAL}
    return out.select(*KEYS, *[F.when(F.col("z").isNotNull(), v).otherwise(0.0).alias(f"glcm_{k}") for k, v in value.items()])


def local_glcm(cells: DataFrame, size: int = 7, levels: int = 16, tile: int = 32) -> DataFrame:
    """The properties within each window that has 4 values, at distance 1; missing cells are level 0."""
    steps = [(round(math.sin(math.radians(a))), round(math.cos(math.radians(a)))) for a in ANGLES]
    names = ["contrast", "dissimilarity", "homogeneity", "energy", "correlation"]

    def kernel(values, valid):
        h, w = values.shape[0] - size + 1, values.shape[1] - size + 1
        q = np.where(valid, np.nan_to_num(values), 0).astype(int)
        seen = np.lib.stride_tricks.sliding_window_view(valid, (size, size)).sum(axis=(2, 3))
        view = np.lib.stride_tricks.sliding_window_view(q, (size, size)).reshape(h * w, size, size)
        out = {k: np.zeros(h * w) for k in names}
        for y, x in steps:
            rows, cols = slice(0, size - y), slice(max(0, -x), size - max(0, x))
            a = view[:, rows, cols].reshape(h * w, -1)
            b = view[:, y:, max(0, x) : size + min(0, x)].reshape(h * w, -1)
            n = a.shape[1]
            gap = (a - b).astype(float)
            out["contrast"] += (gap**2).mean(axis=1)
            out["dissimilarity"] += np.abs(gap).mean(axis=1)
            out["homogeneity"] += (1 / (1 + gap**2)).mean(axis=1)
            pair = np.sort(np.concatenate([a * levels + b, b * levels + a], axis=1) + np.arange(h * w)[:, None] * levels * levels, axis=1)
            _, at, k = np.unique(pair.reshape(-1), return_index=True, return_counts=True)
            out["energy"] += np.sqrt(np.bincount(at // (2 * n), (k / (2 * n)) ** 2, h * w))
            m = (a.mean(axis=1) + b.mean(axis=1)) / 2
            var = ((a**2).mean(axis=1) + (b**2).mean(axis=1)) / 2 - m * m
            cov = (a * b).mean(axis=1) - m * m
            out["correlation"] += np.where(var < 1e-15, 1.0, cov / np.maximum(var, 1e-15))
        return {f"local_glcm_{k}": np.where(seen.reshape(-1) >= 4, v / 4, np.nan).reshape(h, w) for k, v in out.items()}

    q = quantise(cells, levels, None).select(*KEYS, F.col("q").cast("double").alias("z"))
    return tiled(q, kernel, [f"local_glcm_{k}" for k in names], size // 2, size // 2, tile)


def _code(bits: list) -> Column:
    """Uniform pattern code: the number of ones if the circle changes twice at most, else one more than the points."""
    ones = sum(bits[1:], bits[0])
    changes = sum((F.when(a != b, 1).otherwise(0) for a, b in zip(bits, bits[1:] + bits[:1])), F.lit(0))
    return F.when(changes <= 2, ones).otherwise(len(bits) + 1)


def lbp_r1(cells: DataFrame) -> DataFrame:
    """Uniform local binary pattern of the eight neighbours on the 8-bit image, missing cells and the outside being 0."""
    img = normalize(cells).select(*KEYS, F.col("z"), F.coalesce(F.floor(F.col("norm") * 255), F.lit(0)).cast("int").alias("img"))
    near = stencil(img, value="img")
    ring = [F.when(F.coalesce(F.col(f"z{i}"), F.lit(0)) >= F.col("z5"), 1).otherwise(0) for i in (6, 3, 2, 1, 4, 7, 8, 9)]
    return near.select(*KEYS, F.when(F.col("z").isNotNull(), _code(ring)).alias("lbp"))


def lbp(cells: DataFrame, radius: int = 3, points: int = 8, tile: int = 64) -> DataFrame:
    """Uniform local binary pattern of points on a circle, whose values are bilinear between pixels."""
    places = [(-radius * math.sin(2 * math.pi * i / points), radius * math.cos(2 * math.pi * i / points)) for i in range(points)]

    def kernel(values, valid):
        img = np.where(valid, np.nan_to_num(values), 0.0)
        h, w, p = values.shape[0] - 2 * radius - 2, values.shape[1] - 2 * radius - 2, radius + 1
        here = img[p : p + h, p : p + w]
        bits = []
        for y, x in places:
            y, x = round(y, 5), round(x, 5)
            y0, x0 = math.floor(y), math.floor(x)
            fy, fx = y - y0, x - x0
            at = lambda i, j: img[p + y0 + i : p + y0 + i + h, p + x0 + j : p + x0 + j + w]  # noqa: E731,B023
            v = (1 - fy) * ((1 - fx) * at(0, 0) + fx * at(0, 1)) + fy * ((1 - fx) * at(1, 0) + fx * at(1, 1))
            bits.append((v - here > -1e-9).astype(int))
        ones = sum(bits)
        changes = sum(abs(a - b) for a, b in zip(bits, bits[1:] + bits[:1]))
        return {"lbp": np.where(changes <= 2, ones, points + 1).astype(float)}

    img = normalize(cells).select(*KEYS, "z", F.coalesce(F.floor(F.col("norm") * 255), F.lit(0)).cast("double").alias("img"))
    out = tiled(img, kernel, ["lbp"], radius + 1, radius + 1, tile, value="img")
    return out.join(img.select(*KEYS, "z"), list(KEYS)).select(*KEYS, F.when(F.col("z").isNotNull(), F.col("lbp")).alias("lbp"))


def lbp_histogram(cells: DataFrame, size: int = 5, bins: int = 10) -> DataFrame:
    """Mean, variance and skewness over the bins of the window's normalised histogram of radius-1 patterns."""
    names = ["lbp_hist_mean", "lbp_hist_var", "lbp_hist_skew"]

    def kernel(v):
        there = ~np.isnan(v)
        n = there.sum(axis=1)
        inside = there & (v < bins)
        row = np.broadcast_to(np.arange(len(v))[:, None], v.shape)[inside]
        p = np.bincount(row * bins + v[inside].astype(np.int64), minlength=len(v) * bins).reshape(len(v), bins) / np.maximum(n, 1)[:, None] - 1 / bins
        var, third = (p**2).sum(axis=1) / bins, (p**3).sum(axis=1) / bins
        out = (np.full(len(v), 1 / bins), var, np.where(var > 0, third / np.where(var > 0, var, 1.0) ** 1.5, 0.0))
        return {k: np.where(n >= size, x, np.nan) for k, x in zip(names, out)}

    patterns = lbp_r1(cells).select(*KEYS, F.col("lbp").cast("double").alias("lbp"))
    return windowed(patterns, size, kernel, names, "lbp").where("lbp_hist_mean is not null")


def keypoint_density(points: DataFrame, size: int = 21) -> DataFrame:
    """How many points (key = 1, else 0 or NULL) each window of a dense grid holds."""
    return moving_sum(points.withColumn("_k", F.coalesce(F.col("key").cast("double"), F.lit(0.0))), size, "_k", "density").select(*KEYS, "density")


def corners(cells: DataFrame, k: float = 0.04, threshold: float = 0.01) -> DataFrame:
    """Keypoints by the Harris measure over 3 x 3 sums: key = 1 where it is above a share of the raster's greatest."""
    near = stencil(cells)
    products = near.select(*KEYS, ((F.col("z6") - F.col("z4")) / 2).alias("x"), ((F.col("z8") - F.col("z2")) / 2).alias("y"))
    products = products.select(*KEYS, (F.col("x") * F.col("x")).alias("xx"), (F.col("x") * F.col("y")).alias("xy"), (F.col("y") * F.col("y")).alias("yy"))
    for c in ("xx", "xy", "yy"):
        products = moving_sum(products, 3, c, f"s{c}")
    trace = F.col("sxx") + F.col("syy")
    got = products.select(*KEYS, (F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy") - k * trace * trace).alias("m"))
    top = got.groupBy("raster_id").agg(F.max("m").alias("top"))
    return got.join(top, "raster_id").select(*KEYS, F.when(F.col("m") > threshold * F.col("top"), 1).otherwise(0).alias("key"))
