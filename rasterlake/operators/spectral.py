"""Spectral measures of local windows and of the whole grid."""

from __future__ import annotations

from math import comb

import numpy as np
from pyspark.sql import DataFrame, functions as F

from rasterlake.functions import moving, stencil, tiled, windowed
from rasterlake.grid import KEYS, shape
from rasterlake.operators.tables import percentile_stretch
from rasterlake.plans import cut


def _views(a: np.ndarray, size: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(a, (size, size))


def _hann(size: int) -> np.ndarray:
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size - 1))
    return w[:, None] * w


def _row_entropy(values: np.ndarray) -> np.ndarray:
    """Of each row, the entropy in bits of how often its distinct values occur."""
    s = np.sort(values, axis=1)
    n = s.shape[1]
    new = np.concatenate([np.ones((len(s), 1), bool), s[:, 1:] != s[:, :-1]], axis=1)
    at = np.flatnonzero(new.reshape(-1))
    k = np.diff(np.append(at, s.size)) / n
    return np.bincount(at // n, -k * np.log2(k), len(s))


def fft_local(cells: DataFrame, size: int = 16, tile: int = 32) -> DataFrame:
    """Of each Hann-weighted window with size values at least: place of the greatest magnitude, mean magnitude, entropy of its distinct values."""
    size = 1 << (size - 1).bit_length()
    weight, centre = _hann(size), size // 2
    far = np.hypot(*(np.indices((size, size)) - centre)).reshape(-1)

    def kernel(values, valid):
        view = _views(np.where(np.isnan(values), 0, values), size)[:-1, :-1]
        seen = _views(valid, size)[:-1, :-1].sum(axis=(2, 3))
        out = [np.empty(view.shape[:2]) for _ in range(3)]
        for i in range(view.shape[0]):
            mag = np.abs(np.fft.fftshift(np.fft.fft2(view[i] * weight), axes=(1, 2))).reshape(view.shape[1], -1) / size**2
            total = mag.sum(axis=1, keepdims=True)
            out[0][i], out[1][i] = far[mag.argmax(axis=1)] / np.hypot(centre, centre), mag.mean(axis=1)
            out[2][i] = _row_entropy(np.round(mag / np.where(total > 0, total, 1), 15))
        return {k: np.where(seen >= size, v, np.nan) for k, v in zip(("fft_peak", "fft_mean", "fft_entropy"), out)}

    got = tiled(cells, kernel, ["fft_peak", "fft_mean", "fft_entropy"], size // 2, size // 2, tile)
    return _masked(got, cells, ["fft_peak", "fft_mean", "fft_entropy"])


def fft_power(cells: DataFrame, size: int = 16, tile: int = 32) -> DataFrame:
    """Of each window half of whose cells have a value: the peak without the mean, the mean frequency, and the power entropy, all from 0 to 1."""
    weight, centre = _hann(size), size // 2
    far = np.hypot(*(np.indices((size, size)) - centre)).reshape(-1)
    names = ["spectral_fft_peak", "spectral_fft_mean", "spectral_fft_entropy"]

    def kernel(values, valid):
        view = _views(np.where(np.isnan(values), 0, values), size)[:-1, :-1]
        seen = _views(valid, size)[:-1, :-1].sum(axis=(2, 3))
        out = [np.empty(view.shape[:2]) for _ in range(3)]
        for i in range(view.shape[0]):
            mag = np.abs(np.fft.fftshift(np.fft.fft2(view[i] * weight), axes=(1, 2))).reshape(view.shape[1], -1)
            total = np.maximum(mag.sum(axis=1, keepdims=True), 1e-300)
            p = mag / total
            out[1][i] = (p * far).sum(axis=1) / far.max()
            out[2][i] = -(p * np.log2(p + 1e-10)).sum(axis=1) / np.log2(mag.shape[1])
            mag[:, centre * size + centre] = 0
            out[0][i] = far[mag.argmax(axis=1)] / far.max()
        return {k: np.where(2 * seen >= size * size, v, np.nan) for k, v in zip(names, out)}

    return _masked(tiled(cells, kernel, names, size // 2, size // 2, tile), cells, names)


def _masked(got: DataFrame, cells: DataFrame, names: list[str]) -> DataFrame:
    return got.join(cells.select(*KEYS, "z"), list(KEYS)).select(*KEYS, *[F.when(F.col("z").isNotNull(), F.col(n)).alias(n) for n in names])


def multiscale_entropy(cells: DataFrame, scales: tuple[int, ...] = (2, 4, 8), size: int = 32, tile: int = 32) -> DataFrame:
    """Entropy of the window's distinct values, of its block means at each scale under half the window, and its slope over ln(scale)."""
    used = [1, *[s for s in scales if s < size / 2]]
    names = [f"mse_{s}" for s in used] + ["mse_slope"]
    x = np.log(used) - np.mean(np.log(used))

    def kernel(values, valid):
        view = _views(np.where(np.isnan(values), 0, values), size)[:-1, :-1]
        seen = _views(valid, size)[:-1, :-1].sum(axis=(2, 3))
        out = np.empty((len(names), *view.shape[:2]))
        for i in range(view.shape[0]):
            for k, s in enumerate(used):
                n = size // s
                blocks = view[i, :, : n * s, : n * s].reshape(-1, n, s, n, s).mean(axis=(2, 4))
                out[k, i] = _row_entropy(np.round(blocks.reshape(len(blocks), -1), 9))
        out[-1] = np.tensordot(x, out[:-1] - out[:-1].mean(axis=0), 1) / (x @ x) if len(used) > 1 else 0
        return {k: np.where(seen >= size, v, np.nan) for k, v in zip(names, out)}

    return _masked(tiled(cells, kernel, names, size // 2, size // 2, tile), cells, names)


def spectral_basic(cells: DataFrame) -> DataFrame:
    """Deviation, central differences, Laplacian of windows with 13 values of 25, and the ratio of 3 to 9 deviations; 0 where undefined."""
    near = stencil(moving(moving(moving(cells, 5, prefix="f_"), 3, prefix="t_"), 9, prefix="n_"))
    ok = F.col("z").isNotNull() & (F.col("f_n") >= 13)
    x, y = (F.col("z6") - F.col("z4")) / 2, (F.col("z8") - F.col("z2")) / 2
    x, y = F.coalesce(F.when(ok, x), F.lit(0.0)), F.coalesce(F.when(ok, y), F.lit(0.0))
    lap = F.col("z2") + F.col("z4") + F.col("z6") + F.col("z8") - 4 * F.col("z5")
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    ratio = F.when(F.col("z").isNotNull() & (F.col("n_std") > 0), F.col("t_std") / F.col("n_std"))
    return near.select(*KEYS, zero(F.when(ok, F.col("f_std")), "std"), x.alias("grad_x"), y.alias("grad_y"), F.sqrt(x * x + y * y).alias("grad_mag"), zero(F.when(ok, lap), "laplacian"), zero(ratio, "freq_ratio"))


def spectral_sobel(cells: DataFrame) -> DataFrame:
    """grad_mag_sobel, the size of the unscaled Sobel gradient, and entropy, that of the distinct values of 5 x 5 cells.

    Missing cells count as 0, and so does the outside for the entropy; the gradient's border is clamped. 0 where the cell
    has no value.
    """
    filled = cells.select(*KEYS, F.col("z").isNotNull().alias("there"), F.coalesce("z", F.lit(0.0)).alias("z"))
    a, b, c, d, _, f, g, h, i = (F.col(f"z{n}") for n in range(1, 10))
    x, y = (c + 2 * f + i) - (a + 2 * d + g), (g + 2 * h + i) - (a + 2 * b + c)
    near = stencil(filled, "clamp").select(*KEYS, "there", F.sqrt(x * x + y * y).alias("grad_mag_sobel"))
    spread = windowed(filled.select(*KEYS, "z"), 5, lambda v: {"entropy": _row_entropy(np.nan_to_num(v))}, ["entropy"])
    return near.join(spread, list(KEYS)).select(*KEYS, *[F.when(F.col("there"), F.col(v)).otherwise(0.0).alias(v) for v in ("grad_mag_sobel", "entropy")])


def _entropy_of_known(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the entropy in bits of how often its distinct numbers occur, and how many numbers there are."""
    s = np.sort(values, axis=1)  # NaN last
    n = (~np.isnan(s)).sum(axis=1)
    new = np.concatenate([np.ones((len(s), 1), bool), s[:, 1:] != s[:, :-1]], axis=1)
    at = np.flatnonzero(new.reshape(-1))
    row, k = at // s.shape[1], np.diff(np.append(at, s.size))
    known = ~np.isnan(s.reshape(-1)[at])
    p = k[known] / n[row[known]]
    return np.bincount(row[known], -p * np.log2(p), len(s)), n


def scale_entropy(cells: DataFrame, scales: tuple[int, ...] = (1, 2, 4, 8), size: int = 32, tile: int = 32) -> DataFrame:
    """spectral_entropy_scale{s}: entropy of the distinct values among the sliding means over s x s cells in each window.

    A mean is missing where its cells are not all there. Windows of even size reach one cell further up and left. NULL
    where a window has fewer than half its side of means, and where the cell has no value.
    """
    names = [f"spectral_entropy_scale{s}" for s in scales]
    before, after = size // 2 + max(scales) // 2, size - size // 2 - 1 + max(scales)

    def kernel(values, valid):
        z = np.where(valid, values, np.nan)
        height, width = z.shape[0] - before - after, z.shape[1] - before - after
        out = {}
        for name, s in zip(names, scales):
            means = np.round(_views(z, s).mean(axis=(2, 3)), 9) if s > 1 else z
            first = before - size // 2 - s // 2  # the mean at index i is that of the cells from i on
            view = _views(means[first : first + height + size - 1, first : first + width + size - 1], size)
            got = np.empty((height, width))
            for i in range(height):
                e, n = _entropy_of_known(view[i].reshape(width, -1))
                got[i] = np.where(n >= max(size // 2, 1), e, np.nan)
            out[name] = got
        return out

    return _masked(tiled(cells, kernel, names, before, after, tile), cells, names)


def entropy_ratios(cells: DataFrame, scales: tuple[int, ...] = (2, 4, 8), size: int = 32, tile: int = 32) -> DataFrame:
    """mse_local_base, the entropy of the values themselves, and mse_ratio_{a}_{b} of successive scales; 0 where undefined."""
    got = scale_entropy(cells, (1, *scales), size, tile).join(cells.select(*KEYS, "z"), list(KEYS))
    at = {s: F.col(f"spectral_entropy_scale{s}") for s in (1, *scales)}
    ratio = lambda a, b: F.when(F.col("z").isNotNull(), F.coalesce(F.when(at[b] > 0, at[a] / at[b]), F.lit(0.0)))
    return got.select(*KEYS, at[1].alias("mse_local_base"), *[ratio(a, b).alias(f"mse_ratio_{a}_{b}") for a, b in zip(scales, scales[1:])])


# ---------------------------------------------------------------- wavelets


def daubechies(n: int) -> np.ndarray:
    """The 2n low-pass decomposition taps with n vanishing moments: a spectral factor of the half-band polynomial."""
    y = np.roots([comb(n - 1 + k, k) for k in range(n - 1, -1, -1)])
    roots = []
    for v in y:
        r = np.roots([1, -2 + 4 * v, 1])
        roots.append(r[np.argmin(np.abs(r))])
    taps = np.real(np.poly([-1] * n + roots))
    return taps / taps.sum() * np.sqrt(2)


def dwt(x: np.ndarray, taps: np.ndarray, axis: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Low and high half of one level, half-sample symmetric at the ends; floor((n + taps - 1) / 2) coefficients each."""
    n, m = x.shape[axis], len(taps)
    low = taps[::-1]
    high = taps * (-1) ** np.arange(1, m + 1)
    k = np.arange((n + m - 1) // 2)
    at = (2 * k[:, None] + 1 - np.arange(m)) % (2 * n)
    v = np.moveaxis(x, axis, -1)[..., np.where(at < n, at, 2 * n - 1 - at)]
    return np.moveaxis(v @ low, -1, axis), np.moveaxis(v @ high, -1, axis)


def dwt2(x: np.ndarray, taps: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    low, high = dwt(x, taps, -2)
    (ll, lh), (hl, hh) = dwt(low, taps, -1), dwt(high, taps, -1)
    return ll, (hl, lh, hh)


def _axis_dwt(cells: DataFrame, taps: np.ndarray, axis: str, value: str) -> DataFrame:
    """One level along r or c as a grouped sum: a cell is sent to the coefficients that its mirror images reach."""
    m, n = len(taps), F.col("size")
    i = F.col(axis)
    images = F.array_distinct(F.array(i, -1 - i, 2 * n - 1 - i))
    sent = cells.join(shape(cells).select("raster_id", F.col("height" if axis == "r" else "width").alias("size")), "raster_id").withColumn("_e", F.explode(images))
    sent = sent.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("_k2", F.col("_e") + F.col("_j") - 1).where("_k2 % 2 = 0 and _k2 >= 0")
    sent = sent.withColumn("_k", F.expr("cast(_k2 div 2 as int)")).where(f"_k < cast((size + {m - 1}) div 2 as int)")
    low = F.array(*[F.lit(float(t)) for t in taps[::-1]])
    high = F.array(*[F.lit(float(t)) for t in taps * (-1) ** np.arange(1, m + 1)])
    other = "c" if axis == "r" else "r"
    v = F.coalesce(F.col(value), F.lit(0.0))
    got = sent.groupBy("raster_id", other, F.col("_k").alias("k")).agg(F.sum(v * low[F.col("_j")]).alias("low"), F.sum(v * high[F.col("_j")]).alias("high"))
    return got.withColumnRenamed("k", axis)


def wavelet_bands(cells: DataFrame, levels: int = 3, taps: np.ndarray | None = None) -> DataFrame:
    """(raster_id, band, level, r, c, w): a whole-grid transform; level 1 is the coarsest, band a, h, v or d."""
    taps = daubechies(4) if taps is None else taps
    out, left = None, cells.select(*KEYS, "z")
    for level in range(levels, 0, -1):
        rows = cut(_axis_dwt(left, taps, "r", "z"))
        a = _axis_dwt(rows, taps, "c", "low").select(*KEYS, F.col("low").alias("a"), F.col("high").alias("v"))
        b = _axis_dwt(rows, taps, "c", "high").select(*KEYS, F.col("low").alias("h"), F.col("high").alias("d"))
        both = cut(a.join(b, list(KEYS)))
        bands = both.select(*KEYS, F.explode(F.array(*[F.struct(F.lit(x).alias("band"), F.col(x).alias("w")) for x in ("h", "v", "d")])).alias("s")).select("raster_id", "s.band", F.lit(level).alias("level"), "r", "c", "s.w")
        out = bands if out is None else out.unionByName(bands)
        left = both.select(*KEYS, F.col("a").alias("z"))
    return out.unionByName(left.select("raster_id", F.lit("a").alias("band"), F.lit(0).alias("level"), "r", "c", F.col("z").alias("w")))


def wavelet_global(cells: DataFrame, levels: int = 3, taps: np.ndarray | None = None) -> DataFrame:
    """(raster_id, part, energy, share): energy by level of detail and of the approximation (level 0)."""
    bands = wavelet_bands(cells, levels, taps).groupBy("raster_id", "level").agg(F.sum(F.col("w") * F.col("w")).alias("energy"))
    total = bands.groupBy("raster_id").agg(F.sum("energy").alias("total"))
    return bands.join(total, "raster_id").select("raster_id", "level", "energy", F.when(F.col("total") > 0, F.col("energy") / F.col("total")).otherwise(0.0).alias("share"))


def wavelet_metrics(cells: DataFrame, levels: int = 3, mode: str = "energy", taps: np.ndarray | None = None) -> DataFrame:
    """(raster_id, wavelet_{mode}, wavelet_approx_ratio, wavelet_detail_ratio, wavelet_detail_{k}_ratio): of a whole raster.

    mode energy sums the squares of the coefficients, variance and entropy (of the distinct coefficients) take the mean over
    the three directions of a level; wavelet_{mode} is the sum over the approximation and the levels, level 1 the coarsest.
    """
    bands = wavelet_bands(cells, levels, taps)
    if mode == "energy":
        parts = bands.groupBy("raster_id", "level").agg(F.sum(F.col("w") * F.col("w")).alias("v"))
    elif mode == "variance":
        parts = bands.groupBy("raster_id", "level", "band").agg(F.var_pop("w").alias("v")).groupBy("raster_id", "level").agg(F.avg("v").alias("v"))
    elif mode == "entropy":
        counts = bands.groupBy("raster_id", "level", "band", F.round("w", 9).alias("w")).agg(F.count("*").alias("k"))
        # -sum k/n log2(k/n) = log2(n) - sum(k log2 k) / n, so that one grouping does
        parts = counts.groupBy("raster_id", "level", "band").agg((F.log2(F.sum("k")) - F.sum(F.col("k") * F.log2("k")) / F.sum("k")).alias("v")).groupBy("raster_id", "level").agg(F.avg("v").alias("v"))
    else:
        raise ValueError(f"no such mode: {mode}")
    by_level = [F.coalesce(F.sum(F.when(F.col("level") == k, F.col("v"))), F.lit(0.0)).alias(f"_{k}") for k in range(levels + 1)]
    got = parts.groupBy("raster_id").agg(F.sum("v").alias("_total"), *by_level)
    share = lambda v: F.when(F.col("_total") > 0, v / F.col("_total")).otherwise(0.0)
    return got.select("raster_id", F.col("_total").alias(f"wavelet_{mode}"), share(F.col("_0")).alias("wavelet_approx_ratio"), share(F.col("_total") - F.col("_0")).alias("wavelet_detail_ratio"), *[share(F.col(f"_{k}")).alias(f"wavelet_detail_{k}_ratio") for k in range(1, levels + 1)])


DIRECTIONS = {"h": "horizontal", "v": "vertical", "d": "diagonal"}


def _spread(cells: DataFrame, bands: DataFrame, levels: int) -> DataFrame:
    """raster_id, r, c, z and w_a, w_h1 ...: of each band the coefficient whose block of cells holds the cell."""
    out = cells.select(*KEYS, "z")
    for level in range(levels + 1):
        f = 2 ** (levels if level == 0 else levels - level + 1)
        own = bands.where(F.col("level") == level).groupBy("raster_id", F.col("r").alias("_r"), F.col("c").alias("_c"))
        kinds = ["a"] if level == 0 else list(DIRECTIONS)
        own = own.agg(*[F.max(F.when(F.col("band") == b, F.col("w"))).alias(f"w_{b}{level or ''}") for b in kinds])
        out = out.withColumns({"_r": F.expr(f"cast(r div {f} as int)"), "_c": F.expr(f"cast(c div {f} as int)")}).join(own, ["raster_id", "_r", "_c"], "left").drop("_r", "_c")
    return out


def wavelet_coefficients(cells: DataFrame, levels: int = 3, taps: np.ndarray | None = None) -> DataFrame:
    """wavelet_approx_coef and wavelet_{h,v,d}_detail_{k} at every cell, k = 1 the coarsest; NULL where the cell has no value."""
    got = _spread(cells, cut(wavelet_bands(cells, levels, taps)), levels)
    names = {"w_a": "wavelet_approx_coef"} | {f"w_{b}{k}": f"wavelet_{b}_detail_{k}" for k in range(1, levels + 1) for b in DIRECTIONS}
    return got.select(*KEYS, *[F.when(F.col("z").isNotNull(), F.col(c)).alias(n) for c, n in names.items()])


def wavelet_maps(cells: DataFrame, levels: int = 3, taps: np.ndarray | None = None, energy: bool = True, directions: bool = True) -> DataFrame:
    """wavelet_approximation, _details, _ratio, _level{k} and _{direction}_level{k} at every cell; 0 where it has no value.

    Of values from 0 to 1, the 99th percentile and what is above being 1. Details are squares of coefficients, or
    with energy=False their sizes; each cell has those of the block that it lies in.
    """
    scaled = percentile_stretch(cells, "z", 0.0, 0.99, "raster_id").select(*KEYS, F.col("stretched").alias("z"))
    got = _spread(scaled, cut(wavelet_bands(scaled, levels, taps)), levels)
    strength = lambda c: F.coalesce(F.col(c) * F.col(c) if energy else F.abs(F.col(c)), F.lit(0.0))
    of_level = {k: sum((strength(f"w_{b}{k}") for b in DIRECTIONS), F.lit(0.0)) for k in range(1, levels + 1)}
    details, low = sum(of_level.values(), F.lit(0.0)), F.coalesce("w_a", F.lit(0.0))
    out = {"wavelet_approximation": low, "wavelet_details": details, "wavelet_ratio": F.when(low != 0, details / low).otherwise(0.0)}
    out |= {f"wavelet_level{k}": v for k, v in of_level.items()}
    out |= {f"wavelet_{name}_level{k}": strength(f"w_{b}{k}") for k in of_level for b, name in DIRECTIONS.items()} if directions else {}
    return got.select(*KEYS, *[F.when(F.col("z").isNotNull(), v).otherwise(0.0).alias(n) for n, v in out.items()])


def local_wavelet(cells: DataFrame, size: int = 32, levels: int = 2, mode: str = "energy", tile: int = 32, n: int = 4) -> DataFrame:
    """local_wavelet_{mode}, _approx_ratio, _detail_ratio, _detail_{k}_ratio: the measures of wavelet_metrics in each window.

    Missing cells are 0; NULL where the cell has no value or the window fewer than half its side.
    """
    if mode not in ("energy", "entropy", "variance"):
        raise ValueError(f"no such mode: {mode}")
    taps = daubechies(n)
    names = [f"local_wavelet_{mode}", "local_wavelet_approx_ratio", "local_wavelet_detail_ratio"] + [f"local_wavelet_detail_{k}_ratio" for k in range(1, levels + 1)]

    def measure(w):
        flat = w.reshape(len(w), -1)
        return (flat**2).sum(axis=1) if mode == "energy" else flat.var(axis=1) if mode == "variance" else _row_entropy(np.round(flat, 9))

    def kernel(values, valid):
        view = _views(np.where(np.isnan(values), 0, values), size)[:-1, :-1]
        seen = _views(valid, size)[:-1, :-1].sum(axis=(2, 3))
        out = np.empty((len(names), *view.shape[:2]))
        for i in range(view.shape[0]):
            left, parts = view[i].astype(float), []
            for _ in range(levels):
                left, details = dwt2(left, taps)
                own = [measure(d) for d in details]
                parts.insert(0, sum(own) if mode == "energy" else sum(own) / 3)
            low = measure(left)
            total = low + sum(parts)
            share = lambda v: np.where(total > 0, v / np.where(total > 0, total, 1.0), 0.0)  # noqa: E731,B023
            out[:, i] = [total, share(low), share(sum(parts)), *map(share, parts)]
        return {k: np.where(seen >= size // 2, v, np.nan) for k, v in zip(names, out)}

    return _masked(tiled(cells, kernel, names, size // 2, size // 2, tile), cells, names)


def wavelet_local(cells: DataFrame, size: int = 32, levels: int = 2, tile: int = 32, n: int = 4) -> DataFrame:
    """Of each window with 16 values: entropy over band energies, normalised, and detail over approximation energy."""
    taps, names = daubechies(n), ["wavelet_local_entropy", "wavelet_local_energy_ratio"]

    def kernel(values, valid):
        view = _views(np.where(np.isnan(values), 0, values), size)[:-1, :-1]
        seen = _views(valid, size)[:-1, :-1].sum(axis=(2, 3))
        out = np.empty((2, *view.shape[:2]))
        for i in range(view.shape[0]):
            left, energy = view[i].astype(float), []
            for _ in range(levels):
                left, details = dwt2(left, taps)
                energy += [(d**2).sum(axis=(1, 2)) for d in details]
            e, rest = np.stack(energy), (left**2).sum(axis=(1, 2))
            p = e / np.maximum(e.sum(axis=0), 1e-300)
            out[0, i] = -(p * np.log2(p + 1e-12)).sum(axis=0) / np.log2(len(e))
            out[1, i] = e.sum(axis=0) / np.maximum(rest, 1e-12)
        return {k: np.where(seen >= 16, v, np.nan) for k, v in zip(names, out)}

    return _masked(tiled(cells, kernel, names, size // 2, size // 2, tile), cells, names)
