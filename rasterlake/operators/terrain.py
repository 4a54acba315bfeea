"""Terrain derivatives. Results are NULL where the cell or what its formula reads has no value."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from rasterlake.functions import moving, neighbourhood, stencil, tiled
from rasterlake.grid import KEYS, with_shape

FLAT = 1e-4


def _z() -> list[Column]:
    return [F.col(f"z{i}") for i in range(1, 10)]


def gradient(method: str, cell: float) -> tuple[Column, Column]:
    """dz/dx and dz/dy by the method of Horn, of Zevenbergen and Thorne, or with Sobel weights that sum to one."""
    a, b, c, d, _, f, g, h, i = _z()
    if method == "zevenbergen":
        return (f - d) / (2 * cell), (h - b) / (2 * cell)
    x, y = (c + 2 * f + i) - (a + 2 * d + g), (g + 2 * h + i) - (a + 2 * b + c)
    scale = 32 * cell if method == "simple" else 8 * cell
    return x / scale, y / scale


def _valid(x: Column) -> Column:
    return F.when(F.col("z").isNotNull(), x)


def _slope(method: str, cell: float) -> Column:
    dx, dy = gradient(method, cell)
    return _valid(F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))))


def slope(cells: DataFrame, cell: float = 1.0, method: str = "horn") -> DataFrame:
    """Degrees; method horn, zevenbergen, simple (borders clamped) or sobel (the exported column, borders clamped)."""
    return stencil(cells, "clamp" if method in ("simple", "sobel") else "null").select(*KEYS, _slope(method, cell).alias("slope"))


def _turn(dx: Column, dy: Column, flat: float) -> Column:
    level = (F.abs(dx) < FLAT) & (F.abs(dy) < FLAT)
    turn = F.degrees(F.atan2(dy, -dx))
    return F.when(level, F.lit(flat)).otherwise(F.when(turn < 0, turn + 360).otherwise(turn))


def _aspect(method: str, cell: float) -> Column:
    dx, dy = gradient(method, cell)
    return _valid(F.when(dx.isNotNull() & dy.isNotNull(), _turn(dx, dy, 0.0 if method == "sobel" else -1.0)))


def aspect(cells: DataFrame, cell: float = 1.0, method: str = "horn") -> DataFrame:
    """Degrees from 0 to 360; -1 where flat, or 0 with method sobel (the exported column, borders clamped)."""
    return stencil(cells, "clamp" if method == "sobel" else "null").select(*KEYS, _aspect(method, cell).alias("aspect"))


def _hillshade(method: str, cell: float, azimuth: float, altitude: float) -> Column:
    dx, dy = gradient(method, cell)
    tilt = F.atan(F.sqrt(dx * dx + dy * dy))
    if method == "sobel":
        turn, sun = F.radians(_turn(dx, dy, 0.0)), F.radians(F.lit(azimuth))
    else:
        turn, sun = F.atan2(dy, -dx), F.radians(F.lit(360.0 - azimuth + 90.0))
    high = F.radians(F.lit(altitude))
    shade = 255.0 * (F.cos(high) * F.sin(tilt) * F.cos(turn - sun) + F.sin(high) * F.cos(tilt))
    whole = dx.isNotNull() & dy.isNotNull()
    return _valid(F.when(whole, F.greatest(F.lit(0.0), F.least(F.lit(255.0), shade))))


def hillshade(cells: DataFrame, cell: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0, method: str = "horn") -> DataFrame:
    """0 to 255. Method horn turns the azimuth into a mathematical angle; sobel, the exported column, takes it as it is."""
    return stencil(cells, "clamp" if method == "sobel" else "null").select(*KEYS, _hillshade(method, cell, azimuth, altitude).alias("hillshade"))


def curvature(cells: DataFrame, cell: float = 1.0, kind: str = "total", diagonal: bool = True) -> DataFrame:
    """Total, profile or planform; second differences along the diagonals, or with diagonal=False along the axes."""
    a, b, c, d, e, f, g, h, i = _z()
    area = cell * cell
    xx = (c - 2 * e + g) / area if diagonal else (d - 2 * e + f) / area
    yy = (a - 2 * e + i) / area if diagonal else (b - 2 * e + h) / area
    xy = (c + g - a - i) / (4 * area)
    dx, dy = (f - d) / (2 * cell), (h - b) / (2 * cell)
    p = F.greatest(dx * dx + dy * dy, F.lit(1e-4))
    x, y = dx / F.sqrt(p), dy / F.sqrt(p)
    v = {"total": -(xx + yy), "profile": -(xx * x * x + 2 * xy * x * y + yy * y * y), "planform": -(xx * y * y - 2 * xy * x * y + yy * x * x)}[kind]
    whole = [q.isNotNull() for q in _z()]
    return stencil(cells).select(*KEYS, F.when(F.forall(F.array(*whole), lambda q: q), v).alias("curvature"))


def curvature_sobel(cells: DataFrame, cell: float = 1.0) -> DataFrame:
    """The exported column: each axis' Sobel filter twice, borders clamped."""
    x, y = gradient("horn", 0.125)
    once = stencil(cells, "clamp").select(*KEYS, "z", x.alias("x"), y.alias("y"))
    twice_x = stencil(once, "clamp", "x").select(*KEYS, "z", "y", x.alias("xx"))
    twice = stencil(twice_x, "clamp", "y").select(*KEYS, "z", "xx", y.alias("yy"))
    return twice.select(*KEYS, _valid(-(F.col("xx") + F.col("yy")) / (4 * cell * cell)).alias("curvature"))


def roughness(cells: DataFrame, size: int = 3) -> DataFrame:
    return moving(cells, size, powers=2).select(*KEYS, F.col("w_std").alias("roughness"))


def tpi(cells: DataFrame, size: int = 3) -> DataFrame:
    """The cell less the mean of its window, itself included."""
    return moving(cells, size, powers=2).select(*KEYS, (F.col("z") - F.col("w_mean")).alias("tpi"))


def tri(cells: DataFrame, size: int = 3) -> DataFrame:
    """Mean of the window's differences to the cell that are not zero; NULL if there is none."""
    return neighbourhood(cells.select(*KEYS, "z"), size // 2).where("z is not null").select(*KEYS, _tri(size).alias("tri"))


def _tri(size: int) -> Column:
    gaps = [F.nullif(F.abs(F.col("near")[i] - F.col("z")), F.lit(0.0)) for i in range((2 * (size // 2) + 1) ** 2)]
    n = sum((F.when(g.isNotNull(), 1).otherwise(0) for g in gaps), F.lit(0))
    total = sum((F.coalesce(g, F.lit(0.0)) for g in gaps), F.lit(0.0))
    return F.when(F.col("z").isNotNull(), total / F.nullif(n, F.lit(0)))


def max_slope(cells: DataFrame, cell: float = 1.0, size: int = 3) -> DataFrame:
    """Greatest Horn slope in the window; slopes on the border of the grid count as 0."""
    s = slope(cells, cell).withColumnRenamed("slope", "s")
    edge = (F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == F.col("height") - 1) | (F.col("c") == F.col("width") - 1)
    s = with_shape(s).select(*KEYS, F.when(edge, F.lit(0.0)).otherwise(F.col("s")).alias("s"))
    return moving(s, size, "s", powers=2).select(*KEYS, F.col("w_max").alias("max_slope_angle"))


def exported(cells: DataFrame, cell: float = 1.0, size: int = 5, tile: int = 128) -> DataFrame:
    """slope, aspect, hillshade, curvature, roughness, TPI, TRI and max_slope_angle as they are exported, on tiles.

    The same as the operators one by one, for one exchange instead of their fourteen.
    """
    h, halo = size // 2, max(2, size // 2 + 1)
    names = ["slope", "aspect", "hillshade", "curvature", "roughness", "TPI", "TRI", "max_slope_angle"]
    sun, high = np.radians(315.0), np.radians(45.0)

    def sobel(a):
        out = []
        for b in (a, a.T):
            side = b[:-2] + 2 * b[1:-1] + b[2:]
            found = np.full(b.shape, np.nan)
            found[1:-1, 1:-1] = side[:, 2:] - side[:, :-2]
            out.append(found if b is a else found.T)
        return out

    def kernel(values, valid, rows, cols, height, width):
        own = np.ix_(np.clip(rows, 0, height - 1) - rows[0], np.clip(cols, 0, width - 1) - cols[0])
        core = np.s_[halo:-halo, halo:-halo]
        z = values[core]
        x, y = sobel(values)
        dx, dy = x[core] / (8 * cell), y[core] / (8 * cell)
        angle = np.degrees(np.arctan(np.sqrt(x * x + y * y) / (8 * cell)))
        turn = np.degrees(np.arctan2(dy, -dx))
        aspect = np.where((np.abs(dx) < FLAT) & (np.abs(dy) < FLAT), 0.0, np.where(turn < 0, turn + 360, turn))
        tilt = np.arctan(np.sqrt(dx * dx + dy * dy))
        shade = 255.0 * (np.cos(high) * np.sin(tilt) * np.cos(np.radians(aspect) - sun) + np.sin(high) * np.cos(tilt))
        twice = sobel(x[own])[0] + sobel(y[own])[1]
        border = ((rows == 0) | (rows == height - 1))[:, None] | ((cols == 0) | (cols == width - 1))[None, :]
        inside = ((rows >= 0) & (rows < height))[:, None] & ((cols >= 0) & (cols < width))[None, :]
        steep = np.where(inside, np.where(border, 0.0, np.where(valid, angle, np.nan)), np.nan)
        out = {"slope": angle[core], "aspect": aspect, "hillshade": np.clip(shade, 0, 255), "curvature": -twice[core] / (4 * cell * cell)}
        out = {k: np.where(valid[core], v, np.nan) for k, v in out.items()}
        known, trim = np.where(valid, values, np.nan), np.s_[halo - h : values.shape[0] - halo + h, halo - h : values.shape[1] - halo + h]
        windows = [np.lib.stride_tricks.sliding_window_view(a[trim], (size, size)) for a in (known, steep)]
        for k in names[4:]:
            out[k] = np.full(z.shape, np.nan)
        for i in range(0, z.shape[0], 16):
            v, s = (w[i : i + 16].reshape(-1, size * size) for w in windows)
            n, mine = (~np.isnan(v)).sum(axis=1), v[:, size * size // 2]
            mean = np.nansum(v, axis=1) / np.where(n > 0, n, np.nan)
            gap = np.abs(v - mine[:, None])
            differ = gap > 0
            found = {
                "roughness": np.sqrt(np.nansum((v - mean[:, None]) ** 2, axis=1) / np.where(n > 0, n, np.nan)), "TPI": mine - mean,
                "TRI": np.where(differ, gap, 0.0).sum(axis=1) / np.where(differ.any(axis=1), differ.sum(axis=1), np.nan),
                "max_slope_angle": np.where(np.isnan(s).all(axis=1), np.nan, np.where(np.isnan(s), -np.inf, s).max(axis=1)),
            }
            for k, v in found.items():
                out[k][i : i + 16] = v.reshape(-1, z.shape[1])
        return out

    return tiled(cells.select(*KEYS, "z"), kernel, names, halo, halo, tile, edge="clamp", placed=True)
