"""From a grid to a feature table by groups of features, in Python or on the command line.

    python -m rasterlake.extract INPUT OUTPUT --features terrain,stats --window 5 --metadata META
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterlake import grid as G, sources
from rasterlake.operators import basic, hydrology, ml, spatial, spectral, terrain, texture, window
from rasterlake.plans import cut


@dataclass(frozen=True)
class Settings:
    """What the operators of a group are called with."""

    window: int = 5
    cell: float = 1.0
    neighbours: str = "queen"
    fft_window: int = 16
    entropy_scales: tuple[int, ...] = (2, 4, 8)
    entropy_window: int = 32
    patch: int = 7
    components: int = 2
    clusters: int = 3
    drainage_threshold: float = 100.0
    wavelet_levels: int = 3
    wavelet_mode: str = "energy"
    #: Columns that take long or are many: windowed co-occurrence and wavelets, coefficient maps, the autoencoder.
    local_glcm: bool = False
    local_wavelets: bool = False
    export_intermediate: bool = False
    autoencoder: bool = False


def _join(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, list(G.KEYS), "left")
    return out


def _named(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*G.KEYS, *[F.col(old).alias(new) for new, old in names.items()])


def terrain_group(g: DataFrame, s: Settings) -> DataFrame:
    return terrain.exported(g, s.cell, s.window)


def stats_group(g: DataFrame, s: Settings) -> DataFrame:
    return _join([window.moments(g, s.window), window.entropy(g, s.window), window.fractal_dimension(g, s.window)])


def spatial_group(g: DataFrame, s: Settings) -> DataFrame:
    return _named(spatial.spatial_features(g, s.neighbours), morans_I="morans_i", gearys_C="gearys_c", local_moran_mean="local_moran", getis_ord_G_star="getis_ord", spatial_lag="spatial_lag")


def texture_group(g: DataFrame, s: Settings) -> DataFrame:
    properties = texture.glcm_properties(texture.glcm(g))
    parts = [g.select(*G.KEYS).join(properties, "raster_id"), texture.lbp(g), texture.lbp_histogram(g, s.window), _named(texture.keypoint_density(texture.corners(g)), corner_keypoints="density")]
    return _join([*parts, texture.local_glcm(g)] if s.local_glcm else parts)


def spectral_group(g: DataFrame, s: Settings) -> DataFrame:
    basics = spectral.spectral_basic(g).join(spectral.spectral_sobel(g), list(G.KEYS))
    parts = [
        spectral.fft_local(g, s.fft_window), spectral.fft_power(g, s.fft_window), spectral.multiscale_entropy(g, s.entropy_scales, s.entropy_window),
        spectral.scale_entropy(g, (1, *s.entropy_scales), s.entropy_window), spectral.entropy_ratios(g, s.entropy_scales, s.entropy_window),
        spectral.wavelet_local(g, s.entropy_window), g.select(*G.KEYS).join(spectral.wavelet_metrics(g, s.wavelet_levels, s.wavelet_mode), "raster_id"),
        basics.select(*G.KEYS, *[F.col(c).alias(f"spectral_basic_{c}") for c in basics.columns if c not in G.KEYS]),
    ]
    if s.local_wavelets:
        parts.append(spectral.local_wavelet(g, s.entropy_window, mode=s.wavelet_mode))
    if s.export_intermediate:
        parts += [spectral.wavelet_coefficients(g, s.wavelet_levels), spectral.wavelet_maps(g, s.wavelet_levels)]
    return _join(parts)


def hydrology_group(g: DataFrame, s: Settings) -> DataFrame:
    directions = hydrology.flow_direction(g)
    accumulation = hydrology.flow_accumulation(directions)
    network = hydrology.thin(hydrology.drainage_network(accumulation, s.drainage_threshold), g)
    metrics = hydrology.graph_metrics(network, hydrology.drainage_edges(network, directions))
    metrics = _named(metrics, betweenness_centrality="betweenness", upstream_degree="upstream_degree", downstream_degree="downstream_degree", drainage_connectivity="density").withColumn("drainage_network", F.lit(1.0))
    return _join([directions, accumulation, _named(hydrology.edge_detection(g), edge_detection="edge"), metrics])


def ml_group(g: DataFrame, s: Settings) -> DataFrame:
    patches = ml.patches(g, s.patch)
    parts = [g.select(*G.KEYS), ml.pca(patches, s.components)[0], ml.clusters(patches, s.clusters)]
    return _join([*parts, ml.autoencoder(patches)] if s.autoencoder else parts)


#: The groups in the order in which their columns appear; basic is the plain extractor, and not among all.
GROUPS: dict[str, Callable[[DataFrame, Settings], DataFrame]] = {
    "terrain": terrain_group, "stats": stats_group, "spatial": spatial_group, "texture": texture_group,
    "spectral": spectral_group, "hydrology": hydrology_group, "ml": ml_group, "basic": lambda g, s: basic.basic_features(g, s.window),
}
ALL = tuple(k for k in GROUPS if k != "basic")


def extract(cells: DataFrame, groups: tuple[str, ...] = ALL, settings: Settings = Settings(), transform: G.Transform | DataFrame = G.Transform(), nan_policy: str = "null", more: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """id, x, y, elevation and the groups' columns of the valid cells; more holds operators of one's own by name.

    Each group is checkpointed once, so that the last join is over finished columns.
    """
    unknown = set(groups) - set(GROUPS)
    if unknown:
        raise ValueError(f"no such groups: {sorted(unknown)}")
    cells = cut(cells)
    parts = [cut(GROUPS[k](cells, settings)) for k in GROUPS if k in groups] + [f(cells) for f in (more or {}).values()]
    # a column that two groups have comes from the first
    seen = set(G.KEYS)
    parts = [p.select(*G.KEYS, *[c for c in p.columns if c not in seen and not seen.add(c)]) for p in parts]
    features = [c for p in parts for c in p.columns if c not in G.KEYS]
    return G.feature_table(_join([cells.select(*G.KEYS, "z"), *parts]), features, transform, nan_policy)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="rasterlake.extract")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--features", default="all")
    p.add_argument("--window", type=int, default=5)
    p.add_argument("--cell", type=float, help="cell size that slopes are worked out with; the headers' own, if they agree")
    p.add_argument("--metadata")
    p.add_argument("--gzip", action="store_true")
    a = p.parse_args(argv)
    groups = ALL if a.features == "all" else tuple(x for x in a.features.split(",") if x)
    spark = SparkSession.builder.appName("rasterlake.extract").getOrCreate()
    cells, heads = sources.read_ascii_grid(spark, a.input)
    cell = a.cell
    if cell is None:
        sizes = [r.cellsize for r in heads.select("cellsize").distinct().limit(2).collect()]
        if len(sizes) > 1:
            p.error("the rasters have several cell sizes: extract them apart, or give --cell")
        cell = sizes[0] if sizes else 1.0
    places = G.transforms(heads)
    table = extract(cells, groups, Settings(window=a.window, cell=cell), places)
    sources.write_features(table, a.output, a.gzip)
    if a.metadata:
        names = [c for c in table.columns if c not in ("raster_id", "id", "x", "y", "elevation")]
        sources.write_json(sources.metadata(cells, table, names, list(groups), places), a.metadata)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
