"""Small grids against numpy, properties, and what odd grids give."""

import json
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake import functions as fn, grid as G, sources, streaming
from rasterlake.operators import hydrology, ml, spatial, spectral, tables, terrain, texture, window
from rasterlake.plans import successor_graph


def cells(spark, a, raster_id="t"):
    a = np.asarray(a, float)
    data = [(raster_id, i, j, None if np.isnan(a[i, j]) else float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])]
    return spark.createDataFrame(data, "raster_id string, r int, c int, z double")


def array(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.r, r.c] = np.nan if r[name] is None else r[name]
    return out


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(11)
    a = np.round(rng.normal(size=(23, 19)).cumsum(0).cumsum(1), 2)
    a[rng.random(a.shape) < 0.08] = np.nan
    return a


def test_constant_and_plane(spark):
    flat = cells(spark, np.full((7, 7), 5.0))
    assert np.nanmax(array(terrain.slope(flat), "slope", (7, 7))) == 0
    assert np.nanmax(array(window.basic_stats(flat), "stddev", (7, 7))) == 0
    assert np.nanmax(array(window.entropy(flat), "entropy", (7, 7))) == 0
    assert spatial.moran_global(flat).first().morans_i == 0 and spatial.geary_global(flat).first().gearys_c == 0
    s = array(terrain.slope(cells(spark, np.tile(np.arange(7.0), (7, 1)))), "slope", (7, 7))
    assert np.allclose(s[1:-1, 1:-1], 45) and np.isnan(s[0]).all()
    assert spatial.moran_global(cells(spark, np.indices((8, 8)).sum(0) % 2), "rook").first().morans_i == pytest.approx(-1)


@pytest.mark.parametrize("a", [[[1.0]], [[1.0, 2.0, 4.0]], [[1.0], [2.0], [3.0]], [[np.nan, np.nan], [np.nan, np.nan]]])
def test_odd_shapes(spark, a):
    g = cells(spark, a)
    n = np.size(a)
    for df in (terrain.slope(g), terrain.slope(g, method="sobel"), terrain.curvature(g), window.basic_stats(g), hydrology.flow_direction(g), texture.lbp_r1(g), spectral.fft_local(g), texture.lbp(g), G.normalize(g), spectral.spectral_basic(g), tables.gaussian_smooth(g)):
        assert df.count() == n
    valid = int(np.isfinite(a).sum())
    assert spatial.spatial_features(g).count() == hydrology.flow_accumulation(hydrology.flow_direction(g)).count() == valid
    assert G.feature_table(g.withColumn("f", F.col("z")), ["f"]).count() == valid


def test_empty_grid(spark):
    g = spark.createDataFrame([], "raster_id string, r int, c int, z double")
    for df in (terrain.slope(g), window.entropy(g), spatial.moran_local(g), texture.glcm(g), spectral.fft_power(g), hydrology.flow_accumulation(hydrology.flow_direction(g)), G.densify(g)):
        assert df.count() == 0


def test_rasters_do_not_touch(spark, sample):
    both = cells(spark, sample, "a").unionByName(cells(spark, sample[::-1], "b"))
    alone = array(window.basic_stats(cells(spark, sample)), "mean", sample.shape)
    got = window.basic_stats(both).where("raster_id = 'a'")
    assert np.allclose(array(got, "mean", sample.shape), alone, equal_nan=True)


def brute_fft(a, size):
    z, valid, h = np.nan_to_num(a), np.isfinite(a), size // 2
    p, m = np.pad(z, h, mode="reflect"), np.pad(valid, h)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size - 1))
    out = np.full(a.shape, np.nan)
    for i, j in np.argwhere(valid):
        if m[i : i + size, j : j + size].sum() >= size:
            out[i, j] = np.abs(np.fft.fft2(p[i : i + size, j : j + size] * np.outer(w, w))).mean() / size**2
    return out


def test_tiles_do_not_matter(spark, sample):
    g = cells(spark, sample)
    expected = brute_fft(sample, 8)
    for tile in (4, 9, 64):
        assert np.allclose(array(spectral.fft_local(g, 8, tile), "fft_mean", sample.shape), expected, equal_nan=True)
    assert np.allclose(array(texture.lbp(g, 2, tile=5), "lbp", sample.shape), array(texture.lbp(g, 2), "lbp", sample.shape), equal_nan=True)
    mean = fn.tiled(g, lambda v, ok: {"m": np.nanmean(np.lib.stride_tricks.sliding_window_view(np.where(ok, v, np.nan), (3, 3)), axis=(2, 3))}, ["m"], 1, 1, 6)
    assert np.allclose(array(mean, "m", sample.shape), array(window.basic_stats(g, 3), "mean", sample.shape), equal_nan=True)


def test_local_patterns_on_axes(spark, sample):
    """At radius 1 the four points on the axes are pixels; all eight agree with the stencil where the image is flat."""
    flat = cells(spark, np.full((6, 6), 3.0))
    assert np.array_equal(array(texture.lbp(flat, 1), "lbp", (6, 6))[1:-1, 1:-1], array(texture.lbp_r1(flat), "lbp", (6, 6))[1:-1, 1:-1])


def test_local_glcm(spark, sample):
    got = texture.local_glcm(cells(spark, sample), 5, 8, 7)
    norm = (sample - np.nanmin(sample)) / (np.nanmax(sample) - np.nanmin(sample))
    q = np.where(np.isfinite(sample), np.rint(np.nan_to_num(norm) * 7), 0).astype(int)
    contrast = array(got, "local_glcm_contrast", sample.shape)
    energy = array(got, "local_glcm_energy", sample.shape)
    for i, j in ((2, 2), (10, 9), (20, 16)):
        w, c, e = q[i - 2 : i + 3, j - 2 : j + 3], [], []
        for y, x in ((0, 1), (1, 1), (1, 0), (1, -1)):
            pairs = [(w[r, k], w[r + y, k + x]) for r in range(5 - y) for k in range(5) if 0 <= k + x < 5]
            m = np.zeros((8, 8))
            for a, b in pairs:
                m[a, b] += 1
                m[b, a] += 1
            m /= m.sum()
            c.append(sum(m[a, b] * (a - b) ** 2 for a in range(8) for b in range(8)))
            e.append(np.sqrt((m**2).sum()))
        assert contrast[i, j] == pytest.approx(np.mean(c)) and energy[i, j] == pytest.approx(np.mean(e))


def test_successor_graph(spark):
    rng = np.random.default_rng(5)
    for n in (1, 40, 200):
        nxt = {i: int(rng.integers(n)) for i in range(n) if rng.random() < 0.9}
        nxt |= {i: i + 1 for i in range(0, n - 1) if i % 3 == 0}
        got = {r.node: r for r in successor_graph(spark.createDataFrame([(i,) for i in range(n)], "node int"), spark.createDataFrame(list(nxt.items()), "node int, next int")).collect()}
        ring = {}
        for i in range(n):
            seen, at = [], i
            while at is not None and at not in seen:
                seen.append(at)
                at = nxt.get(at)
            ring[i] = seen[seen.index(at) :] if at is not None else []
        on = {i for i in range(n) if i in ring[i]}
        count = defaultdict(int)
        for i in range(n):
            at = i
            while at is not None:
                count[at] += 1
                if at in on:
                    break
                at = nxt.get(at)
        for i, r in got.items():
            assert r.on_cycle == (i in on) and r.upstream == count[i]
            assert r.cycle == (min(ring[i]) if ring[i] else None) and r.length == (len(ring[i]) or None)


def test_betweenness_against_walks(spark):
    rng = np.random.default_rng(7)
    for _ in range(3):
        g = cells(spark, np.round(rng.random((9, 8)) * 50))
        directions = hydrology.flow_direction(g)
        edges = hydrology.flow_edges(directions)
        nodes = directions.select(*G.KEYS)
        nxt = {(e.r, e.c): (e.nr, e.nc) for e in edges.collect()}
        between, up, down = defaultdict(int), defaultdict(int), defaultdict(int)
        for s in [(r.r, r.c) for r in nodes.collect()]:
            path, at = [], nxt.get(s)
            while at is not None and at != s and at not in path:
                path.append(at)
                at = nxt.get(at)
            down[s] = len(path)
            for k, v in enumerate(path):
                up[v] += 1
                between[v] += len(path) - 1 - k
        for r in hydrology.graph_metrics(nodes, edges).collect():
            v = (r.r, r.c)
            assert (r.upstream_degree, r.downstream_degree) == (up[v], down[v])
            assert r.betweenness == pytest.approx(between[v] / (71 * 70))
            assert r.density == pytest.approx(len(nxt) / (72 * 71))


def test_thinning(spark):
    block = np.zeros((9, 12))
    block[2:7, 2:10] = 1
    g = cells(spark, block)
    got = hydrology.thin(g.where("z = 1").select(*G.KEYS), g)
    thin = {(r.r, r.c) for r in got.collect()}
    assert 0 < len(thin) < 12 and all(block[p] for p in thin)


def test_wavelets(spark, sample):
    assert np.allclose(spectral.daubechies(1), [2**-0.5] * 2) and np.allclose(spectral.daubechies(2), np.array([1 - 3**0.5, 3 - 3**0.5, 3 + 3**0.5, 1 + 3**0.5])[::-1] / (4 * 2**0.5)) or np.allclose(spectral.daubechies(2)[::-1], np.array([1 - 3**0.5, 3 - 3**0.5, 3 + 3**0.5, 1 + 3**0.5])[::-1] / (4 * 2**0.5))
    taps = spectral.daubechies(4)
    assert len(taps) == 8 and taps.sum() == pytest.approx(2**0.5) and (taps**2).sum() == pytest.approx(1)
    x, left = np.nan_to_num(sample), {}
    low = x
    for level in (2, 1):
        low, (h, v, d) = spectral.dwt2(low, taps)
        left[level] = {"h": h, "v": v, "d": d}
    got = spectral.wavelet_bands(cells(spark, sample), 2).collect()
    for r in got:
        expected = low if r.band == "a" else left[r.level][r.band]
        assert r.w == pytest.approx(expected[r.r, r.c], abs=1e-6)
    assert len(got) == low.size + sum(b.size for v in left.values() for b in v.values())


def test_entropies_of_scales(spark, sample):
    got = spectral.multiscale_entropy(cells(spark, sample), (2,), 8, 6)
    z, m = np.pad(np.nan_to_num(sample), 4, mode="reflect"), np.pad(np.isfinite(sample), 4)
    a, b = array(got, "mse_1", sample.shape), array(got, "mse_2", sample.shape)

    def entropy(v):
        _, k = np.unique(np.round(v, 9), return_counts=True)
        return -(k / k.sum() * np.log2(k / k.sum())).sum()

    for i, j in np.argwhere(np.isfinite(sample))[::37]:
        if m[i : i + 8, j : j + 8].sum() >= 8:
            w = z[i : i + 8, j : j + 8]
            assert a[i, j] == pytest.approx(entropy(w)) and b[i, j] == pytest.approx(entropy(w.reshape(4, 2, 4, 2).mean(axis=(1, 3))))


def test_components_and_clusters(spark, sample):
    v = ml.patches(cells(spark, np.nan_to_num(sample)), 3)
    scores, share = ml.pca(v)
    x = np.array([r.patch for r in v.orderBy("r", "c").collect()])
    x = (x - x.mean(0)) / x.std(0)
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert share == pytest.approx((values / values.sum())[:2].tolist())
    assert np.var([r.pca_1 for r in scores.collect()], ddof=1) == pytest.approx(values[0])
    labels = {r.cluster_label for r in ml.clusters(v).collect()}
    assert labels == {0, 1, 2}
    assert ml.autoencoder(v, steps=20).count() == v.count() == ml.spectral_clusters(v).count()


def test_spectral_clusters_of_like_patches(spark, sample):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(0, 9, (40, 4)), rng.integers(0, 9, (40, 4)) + 500]).astype(float)
    v = spark.createDataFrame([("t", 7 * i, 0, p.tolist()) for i, p in enumerate(x)], "raster_id string, r int, c int, patch array<double>")
    got = defaultdict(dict)
    for r in ml.nearest(v.withColumn("id", F.col("r").cast("long")), 5, block=16).collect():
        got[r.src // 7][r.dst // 7] = r.gap
    for i in range(80):
        gap = ((x - x[i]) ** 2).sum(1)
        best = sorted((g, j) for j, g in enumerate(gap) if j != i)[:5]
        assert got[i] == {j: g for g, j in best}
    # no two are near in the grid, and yet each group is labelled
    labels = {r.r // 7: r.cluster_label for r in ml.spectral_clusters(v, k=2).collect()}
    assert len(labels) == 80
    assert ml.spectral_clusters(v.limit(1)).count() == 1 and ml.spectral_clusters(v.limit(0)).count() == 0


def test_spectral_clusters_query_has_all_rows(spark):
    from rasterlake.queries import QUERIES, emb

    base = "/root/testdata/sf0.001"
    got = QUERIES["spectral_clusters"](spark, base)
    box = emb(spark, base, False).agg(F.max("r").alias("r"), F.max("c").alias("c")).first()
    assert got.count() == (box.r - 1) * (box.c - 1)


def test_autoencoder_is_fitted_on_all_rows(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(5000, 3))
    a[:40] *= 50  # few rows that shape mean, deviation and axes
    v = spark.createDataFrame([("t", i, 0, p.tolist()) for i, p in enumerate(a)], "raster_id string, r int, c int, patch array<double>")
    got = {r.r: (r.autoencoder_latent_1, r.autoencoder_latent_2) for r in ml.autoencoder(v, hidden=4, steps=3).collect()}

    x, rng = (a - a.mean(axis=0)) / a.std(axis=0), np.random.default_rng(42)
    sizes = [3, 4, 2, 4, 3]
    w = [rng.normal(0, (2 / (p + q)) ** 0.5, (p, q)) for p, q in zip(sizes, sizes[1:])] + [np.zeros(q) for q in sizes[1:]]
    m, s = [[np.zeros_like(p) for p in w] for _ in range(2)]
    for t in range(1, 4):
        h1 = np.tanh(x @ w[0] + w[4])
        z = h1 @ w[1] + w[5]
        h2 = np.tanh(z @ w[2] + w[6])
        d3 = 2 * (h2 @ w[3] + w[7] - x) / x.size
        d2 = d3 @ w[3].T * (1 - h2**2)
        d1 = d2 @ w[2].T
        d0 = d1 @ w[1].T * (1 - h1**2)
        for j, g in enumerate((x.T @ d0, h1.T @ d1, z.T @ d2, h2.T @ d3, d0.sum(0), d1.sum(0), d2.sum(0), d3.sum(0))):
            m[j], s[j] = 0.9 * m[j] + 0.1 * g, 0.999 * s[j] + 0.001 * g * g
            w[j] = w[j] - 0.01 * (m[j] / (1 - 0.9**t)) / (np.sqrt(s[j] / (1 - 0.999**t)) + 1e-8)
    z = np.tanh(x @ w[0] + w[4]) @ w[1] + w[5]
    assert np.allclose([got[i] for i in range(5000)], z, atol=1e-9)


def test_transect_has_all_positions(spark):
    from rasterlake.queries import QUERIES

    got = QUERIES["transect_whole"](spark, "/root/testdata/sf0.001")
    assert {r.i for r in got.select("i").distinct().collect()} == set(range(-4, 5))


NAMED = {
    "slope": "Slope angle in degrees",
    "aspect": "Aspect angle in degrees (0-360, clockwise from north)",
    "hillshade": "Hillshade value (0-255)",
    "curvature": "Curvature (positive for convex, negative for concave)",
    "roughness": "Terrain roughness (standard deviation of elevation)",
    "TPI": "Topographic Position Index",
    "TRI": "Terrain Ruggedness Index",
    "max_slope_angle": "Maximum slope angle in local window",
    "mean": "Mean elevation in local window",
    "stddev": "Standard deviation of elevation in local window",
    "min": "Minimum elevation in local window",
    "max": "Maximum elevation in local window",
    "skewness": "Skewness of elevation in local window",
    "kurtosis": "Kurtosis of elevation in local window",
    "entropy": "Shannon entropy of elevation in local window",
    "valid_count": "Number of valid cells in local window",
    "fractal_dimension": "Fractal dimension (box-counting method)",
    "morans_I": "Moran's I spatial autocorrelation statistic",
    "gearys_C": "Geary's C spatial autocorrelation statistic",
    "local_moran_mean": "Local Moran's I statistic",
    "getis_ord_G_star": "Getis-Ord G* statistic",
    "spatial_lag": "Spatial lag (weighted average of neighboring values)",
    "glcm_contrast": "GLCM contrast (local intensity variations)",
    "glcm_dissimilarity": "GLCM dissimilarity (variation of grey level pairs)",
    "glcm_homogeneity": "GLCM homogeneity (closeness of element distribution)",
    "glcm_energy": "GLCM energy (sum of squared elements)",
    "glcm_correlation": "GLCM correlation (linear dependency of grey levels)",
    "lbp": "Local Binary Pattern texture descriptor",
    "lbp_hist_mean": "Mean of LBP histogram",
    "lbp_hist_var": "Variance of LBP histogram",
    "lbp_hist_skew": "Skewness of LBP histogram",
    "sift_keypoints": "SIFT keypoint density",
    "orb_keypoints": "ORB keypoint density",
    "fft_peak": "Peak frequency in FFT spectrum",
    "fft_mean": "Mean value of FFT spectrum",
    "fft_entropy": "Entropy of FFT spectrum",
    "wavelet_energy": "Wavelet energy",
    "wavelet_approx_ratio": "Ratio of approximation coefficients energy",
    "wavelet_detail_ratio": "Ratio of detail coefficients energy",
    "multiscale_entropy_1": "Entropy at original scale",
    "multiscale_entropy_slope": "Slope of entropy across scales",
    "flow_direction": "D8 flow direction (encoded as powers of 2)",
    "flow_accumulation": "Flow accumulation (number of cells flowing into each cell)",
    "flow_accumulation_log": "Log-transformed flow accumulation",
    "edge_detection": "Edge magnitude (using Sobel filter)",
    "drainage_network": "Drainage network (1 for network, 0 otherwise)",
    "betweenness_centrality": "Betweenness centrality in drainage network",
    "upstream_degree": "Number of upstream cells in drainage network",
    "downstream_degree": "Number of downstream cells in drainage network",
    "drainage_connectivity": "Connectivity index in drainage network",
    "pca_1": "First principal component",
    "pca_2": "Second principal component",
    "cluster_label": "Cluster label",
    "autoencoder_latent_1": "First latent dimension from autoencoder",
    "autoencoder_latent_2": "Second latent dimension from autoencoder",
}


def test_descriptions(spark):
    more = {"pca_7": "Principal component 7", "autoencoder_latent_3": "Autoencoder latent dimension 3", "wavelet_detail_3": "Ratio of detail coefficients energy at level 3", "multiscale_entropy_8": "Entropy at scale 8", "local_glcm_energy": "Local GLCM energy in window", "elevation": "Feature derived from elevation data"}
    names = spark.createDataFrame([(f,) for f in NAMED | more], "feature string")
    assert {r.feature: r.d for r in names.select("feature", tables.description(F.col("feature")).alias("d")).collect()} == NAMED | more and len(NAMED) == 55


def test_ascii_grid(spark, sample, tmp_path):
    lines = ["NCOLS 4", "nrows 3", "xllcenter 10", "nodata -1", "1 2 x 4", "", "5 -1 7"]
    (tmp_path / "a.asc").write_text("\n".join(lines))
    got, heads = sources.read_ascii_grid(spark, str(tmp_path / "a.asc"))
    assert np.array_equal(array(got, "z", (3, 4)), [[1, 2, np.nan, 4], [5, np.nan, 7, np.nan], [np.nan] * 4], equal_nan=True)
    h = heads.first()
    assert (h.xll, h.yll, h.cellsize, h.nodata) == (10, 0, 1, -1)
    sources.write_ascii_grid(cells(spark, sample), str(tmp_path / "out"))
    again, _ = sources.read_ascii_grid(spark, str(tmp_path / "out/*/*.txt"))
    assert np.allclose(array(again, "z", sample.shape), sample, equal_nan=True)


def test_sinks_and_reports(spark, sample, tmp_path):
    g = cells(spark, sample)
    table = G.feature_table(g.join(terrain.slope(g, method="sobel"), list(G.KEYS)), ["slope"], nan_policy="zero")
    sources.write_features(table, str(tmp_path / "x_terrain_features.csv"), gzip=True)
    back = sources.read_features(spark, str(tmp_path / "x_terrain_features.csv"))
    assert back.count() == np.isfinite(sample).sum() and back.first().file_category == "terrain"
    meta = json.loads(sources.metadata(g, table, ["slope"], ["terrain"]).first().json)
    assert meta["raster_info"]["stats"]["total"] == sample.size and meta["extraction_info"]["exported_rows"] == back.count() and "slope" in meta["feature_stats"]
    profile = tables.profile(table, ["elevation", "slope"])
    assert "slope" in sources.report_yaml(profile) and "<table>" in sources.report_html(profile, tables.strong_correlations(table, ["elevation", "slope"], 0.0))
    assert {r.category for r in tables.analyze(table, ["slope", "pca_9", "basic_x"]).collect()} == {"terrain", "ml", "other"}
    assert sources.synthetic_raster(spark, 20).where("z is null").count() > 5


def test_small_tables(spark):
    df = spark.createDataFrame([(1, "5", None), (2, "x", 2.0), (3, "7", 2.0)], "id int, a string, b double")
    assert {(r.feature, r.min, r.max) for r in tables.feature_ranges(df, ["a", "b"]).collect()} == {("a", 5.0, 7.0), ("b", 2.0, 2.0)}
    assert tables.complete_features(df, ["a", "b"]) == ["a"]
    assert tables.strong_correlations(df.withColumn("k", F.lit(1.0)), ["b", "k"], 0.1).count() == 0
    with pytest.raises(ValueError):
        tables.compare({"x": df}, {"x": "zz"})


def test_player(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.0, "a"), (2, 10.0, "b")], "id int, v double, s string")
    got = streaming.player_frames(rows, ["v", "s"], interval_ms=40).orderBy("k").collect()
    assert [(r.k, round(r.v, 6), r.s) for r in got] == [(0, 0.0, "a"), (1, 4.0, "a"), (2, 8.0, "a")]
    assert streaming.player_frames(rows.limit(1), ["v"], interval_ms=1).count() == 1
    play = streaming.player_stream(spark, streaming.player_frames(rows, ["v"], interval_ms=40), 50)
    q = play.writeStream.format("memory").queryName("played").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(60):
            q.processAllAvailable()
            if spark.table("played").count() >= 3:
                break
    finally:
        q.stop()
    assert spark.table("played").count() >= 3


def test_stream_to_cells(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:10:00", 1, 2, 4.0), ("2024-01-01 00:20:00", 1, 2, 6.0), ("2024-01-01 05:00:00", 3, 3, 1.0)], "ts string, u int, w int, v double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("ts timestamp, u int, w int, v double").parquet(str(tmp_path / "in"))
    q = streaming.windowed_cells(events, "ts", "u", "w", "v").writeStream.outputMode("complete").format("memory").queryName("cells").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {(r.r, r.c, r.n, r.z) for r in spark.table("cells").collect()} == {(1, 2, 2, 5.0), (3, 3, 1, 1.0)}


def test_extract(spark, sample, tmp_path):
    from rasterlake import extract

    g = cells(spark, np.nan_to_num(sample))
    s = extract.Settings(patch=3)
    table = extract.extract(g, ("terrain", "stats", "spatial", "ml"), s, more={"own": lambda c: c.select(*G.KEYS, (F.col("z") * 2).alias("twice"))})
    assert table.count() == g.count() and len(table.columns) == len(set(table.columns)) > 25
    row = table.orderBy("id").first()
    assert row.twice == 2 * row.elevation and {"slope", "entropy", "morans_I", "pca_1"} <= set(table.columns)
    with pytest.raises(ValueError):
        extract.extract(g, ("nothing",))
    sources.write_ascii_grid(cells(spark, sample, "x"), str(tmp_path / "in"))
    assert extract.main([str(tmp_path / "in/*/*.txt"), str(tmp_path / "out"), "--features", "stats,basic", "--metadata", str(tmp_path / "meta")]) == 0
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == np.isfinite(sample).sum()


# ---------------------------------------------------------------- steps in the values, headers, several rasters


@pytest.mark.parametrize("size", [3, 5, 9])
def test_moments_across_steps(spark, size):
    """Windows far from the raster's mean, with deviations a billionth of the step."""
    rng = np.random.default_rng(size)
    a = np.where(np.arange(24)[None, :] < 12, 0.0, 1e6) + rng.integers(-3, 4, (20, 24)) / 1000
    a[rng.random(a.shape) < 0.1] = np.nan
    got = window.basic_stats(cells(spark, a), size).join(window.higher_order_stats(cells(spark, a), size), list(G.KEYS))
    found = {k: array(got, k, a.shape) for k in ("mean", "stddev", "skewness", "kurtosis", "valid_count")}
    h = size // 2
    for r in range(a.shape[0]):
        for c in range(a.shape[1]):
            v = a[max(0, r - h) : r + h + 1, max(0, c - h) : c + h + 1]
            v = v[~np.isnan(v)]
            d = v - v.mean()
            m2 = (d**2).mean()
            assert found["valid_count"][r, c] == len(v) and found["mean"][r, c] == pytest.approx(v.mean(), rel=1e-12)
            assert found["stddev"][r, c] == pytest.approx(np.sqrt(m2), rel=1e-5)
            if len(v) >= 4 and m2 > 1e-9:
                assert found["skewness"][r, c] == pytest.approx((d**3).mean() / m2**1.5, rel=1e-3, abs=1e-3)
                assert found["kurtosis"][r, c] == pytest.approx((d**4).mean() / m2**2 - 3, rel=1e-3, abs=1e-3)


def test_ascii_headers_and_names(spark, tmp_path):
    """Body lines that look like headers, grids from centres, several files of one name, ranges of bytes, Windows line ends."""
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a/x.asc").write_text("ncols 2\nnrows 3\nxllcenter 10\nyllcenter 20\ncellsize 4\nnan 3\n1 2\nfoo 5\n")
    (tmp_path / "b/x.asc").write_text("NROWS 2\r\nNCOLS 3\r\n\r\nxllcorner 1\r\nyllcorner 2\r\n1 2 3 9\r\n4 -9999 6\r\n7 8 9\r\n")
    (tmp_path / "b/y.asc").write_text("1 2\n3 4\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16")
    try:
        got, heads = sources.read_ascii_grid(spark, str(tmp_path / "*/*.asc"))
        found = {r.raster_id.removeprefix(f"file:{tmp_path}/"): r for r in heads.collect()}
        assert set(found) == {"a/x.asc", "b/x.asc", "y.asc"}
        assert (found["a/x.asc"].x0, found["a/x.asc"].y0) == (8.0, 30.0) and (found["b/x.asc"].x0, found["b/x.asc"].y0) == (1.0, 4.0)
        values = {}
        for r in got.collect():
            values.setdefault(r.raster_id.removeprefix(f"file:{tmp_path}/"), {})[r.r, r.c] = r.z
        assert values["a/x.asc"] == {(0, 0): None, (0, 1): 3, (1, 0): 1, (1, 1): 2, (2, 0): None, (2, 1): 5}
        assert values["b/x.asc"] == {(0, 0): 1, (0, 1): 2, (0, 2): 3, (1, 0): 4, (1, 1): None, (1, 2): 6}
        assert values["y.asc"] == {(0, 0): 1, (0, 1): 2, (1, 0): 3, (1, 1): 4}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_several_rasters(spark, sample, tmp_path, monkeypatch):
    """Exports, metadata and sidecars keep rasters apart, each with its own place; large ones are written in parts."""
    from rasterlake import extract

    both = cells(spark, sample, "a").unionByName(cells(spark, np.nan_to_num(sample)[:5] * 2, "b"))
    places = spark.createDataFrame([("a", 100.0, 50.0, 2.0, -2.0, 0.0, 0.0), ("b", 0.0, 7.0, 2.0, -2.0, 0.0, 0.0)], "raster_id string, x0 double, y0 double, dx double, dy double, rot_x double, rot_y double")
    table = G.feature_table(both.withColumn("f", F.col("z") + 1).withColumn("g", F.lit(None).cast("double")), ["f", "g"], places, "zero", ("g",))
    assert table.select("raster_id", "id").distinct().count() == table.count() == np.isfinite(sample).sum() + 5 * sample.shape[1]
    first = table.where("raster_id = 'b' and id = 1").first()
    assert (first.x, first.y, first.g) == (2.0, 7.0, 0.0)
    assert G.gather(table, both.withColumn("twice", F.col("z") * 2), "twice").where("abs(twice - 2 * elevation) > 1e-9 or twice is null").count() == 0
    meta = sources.metadata(both, table, ["f"], ["own"], places)
    found = {r.raster_id: json.loads(r.json) for r in meta.collect()}
    assert found["b"]["extraction_info"]["exported_rows"] == 5 * sample.shape[1] and found["a"]["extraction_info"]["exported_rows"] == np.isfinite(sample).sum()
    assert found["b"]["feature_stats"]["f"]["max"] == pytest.approx(np.nan_to_num(sample)[:5].max() * 2 + 1) and found["b"]["raster_info"]["bounds"] == {"left": 0.0, "bottom": -3.0, "right": 2.0 * sample.shape[1], "top": 7.0}
    again = {r.raster_id: json.loads(r.json) for r in sources.with_feature_stats(meta, table).collect()}
    assert again["a"]["feature_stats"]["elevation"]["max"] == pytest.approx(np.nanmax(sample)) and again["a"]["raster_info"] == found["a"]["raster_info"]
    monkeypatch.setattr(sources, "FILE_ROWS", 4)
    sources.write_ascii_grid(both, str(tmp_path / "in"), places)
    back, heads = sources.read_ascii_grid(spark, str(tmp_path / "in/*/*.txt"))
    parts = {r.raster_id: r for r in heads.collect()}
    assert len(parts) == -(-sample.shape[0] // 4) + 2 and parts["b@4"].nrows == 1 and parts["b@4"].y0 == -1.0 and parts["b@0"].x0 == 0.0
    assert back.where("z is not null").count() == table.count()
    with pytest.raises(SystemExit):
        (tmp_path / "z.asc").write_text("cellsize 3\n1 2\n3 4\n")
        (tmp_path / "w.asc").write_text("cellsize 4\n1 2\n3 4\n")
        extract.main([str(tmp_path / "*.asc"), str(tmp_path / "no"), "--features", "basic"])
    assert extract.main([str(tmp_path / "z.asc"), str(tmp_path / "out"), "--features", "basic"]) == 0
    assert {(float(r.x), float(r.y)) for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()} == {(0.0, 6.0), (3.0, 6.0), (0.0, 3.0), (3.0, 3.0)}


def test_tables_about_features(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(300, 3)).round(1)
    df = spark.createDataFrame([(i, float(i % 5), "t", *map(float, row)) for i, row in enumerate(a)], "id long, x double, name string, p double, q double, s double").withColumn("k", F.lit(1.0))
    assert tables.feature_names(df) == ["p", "q", "s", "k"] and tables.feature_names(df, ("id",), False) == ["x", "name", "p", "q", "s", "k"]
    import pandas as pd

    frame = pd.DataFrame(a, columns=["p", "q", "s"])
    got = tables.correlation_matrix(df, ["p", "q", "s"], "spearman").toPandas().set_index("feature").loc[["p", "q", "s"], ["p", "q", "s"]]
    ranked = frame.rank().corr()
    assert np.allclose(got.to_numpy(), ranked.to_numpy())
    ranks = tables.value_ranks(tables.melt(df, ["p", "k"]))
    assert {r.feature: r.q for r in tables.exact_quantiles(ranks, (0.0, 0.1, 0.5, 1.0)).collect()} == {"p": pytest.approx(list(np.quantile(a[:, 0], [0, 0.1, 0.5, 1]))), "k": [1.0] * 4}
    info = {r.feature: r for r in tables.feature_metadata(df.withColumnRenamed("p", "slope"), ["slope", "k"]).collect()}
    assert info["slope"].category == "terrain" and info["slope"].dtype == "double" and info["slope"].median == pytest.approx(np.median(a[:, 0])) and info["k"].std == 0
    panel = tables.first_features(df, ["s", "p", "q"], 2).orderBy("place").collect()
    assert [(r.place, r.feature) for r in panel] == [(0, "s"), (1, "p")] and panel[0].max == a[:, 2].max()
    grid = spark.createDataFrame([("x", r, c, 1.0) for r in range(3) for c in range(4)], "raster_id string, r int, c int, z double")
    whole = grid.select("raster_id", "r", "c", F.col("z").alias("f"), F.lit(None).cast("double").alias("none"))
    found = {r.feature: r for r in tables.validate(whole, grid, ["f", "none"]).collect()}
    assert found["f"].ok and not found["f"].empty and found["none"].ok and found["none"].empty and found["none"].missing == 12
    assert not tables.validate(whole.where("r < 2"), grid, ["f"]).first().ok and not tables.validate(whole.unionByName(whole.where("r = 0")), grid, ["f"]).first().ok
    with pytest.raises(ValueError):
        tables.correlations(spark.range(200_000).select(F.col("id").alias("u"), F.col("id").alias("w")), ["u", "w"], "kendall")


# ---------------------------------------------------------------- kernels against plain numpy on every cell


def around(a, r, c, size, fill=np.nan):
    """The size x size values around a cell, one more up and left if size is even, fill beyond the grid."""
    out = np.full((size, size), fill)
    for i in range(size):
        for j in range(size):
            y, x = r + i - size // 2, c + j - size // 2
            if 0 <= y < a.shape[0] and 0 <= x < a.shape[1]:
                out[i, j] = a[y, x]
    return out


def shannon(v):
    _, k = np.unique(v, return_counts=True)
    p = k / k.sum()
    return float(-(p * np.log2(p)).sum())


def test_scale_entropy_on_every_cell(spark, sample):
    a = np.round(sample / 4)
    got = spectral.scale_entropy(cells(spark, a), (1, 2, 3, 4), 8, tile=7)
    ratios = spectral.entropy_ratios(cells(spark, a), (2, 3), 8)
    found = {s: array(got, f"spectral_entropy_scale{s}", a.shape) for s in (1, 2, 3, 4)}
    ratio, base = array(ratios, "mse_ratio_2_3", a.shape), array(ratios, "mse_local_base", a.shape)
    for s in found:
        means = np.full(a.shape, np.nan)
        for r in range(a.shape[0]):
            for c in range(a.shape[1]):
                means[r, c] = np.round(around(a, r, c, s).mean(), 9)
        for r in range(a.shape[0]):
            for c in range(a.shape[1]):
                v = around(means, r, c, 8).reshape(-1)
                v = v[~np.isnan(v)]
                expected = shannon(v) if len(v) >= 4 and not np.isnan(a[r, c]) else np.nan
                assert found[s][r, c] == pytest.approx(expected, nan_ok=True, abs=1e-9), (s, r, c)
    there = ~np.isnan(a)
    assert np.allclose(base, found[1], equal_nan=True) and np.isnan(ratio[~there]).all()
    with np.errstate(divide="ignore", invalid="ignore"):
        assert np.allclose(ratio[there], np.where(found[3] > 0, found[2] / found[3], 0.0)[there])


@pytest.mark.parametrize("mode", ["energy", "entropy", "variance"])
def test_local_wavelet_on_every_cell(spark, sample, mode):
    """Each window mirrored, transformed by filters as matrices, and measured."""
    a, size, levels = sample[:14, :13], 8, 2
    taps = spectral.daubechies(2)
    m = len(taps)

    def matrix(n, f):
        out = np.zeros(((n + m - 1) // 2, n))
        for k in range(len(out)):
            for j in range(m):
                e = (2 * k + 1 - j) % (2 * n)
                out[k, e if e < n else 2 * n - 1 - e] += f[j]
        return out

    low, high = taps[::-1], taps * (-1.0) ** np.arange(1, m + 1)
    measure = {"energy": lambda w: (w**2).sum(), "variance": np.var, "entropy": lambda w: shannon(np.round(w, 9))}[mode]
    got = spectral.local_wavelet(cells(spark, a), size, levels, mode, tile=5, n=2)
    names = [f"local_wavelet_{mode}", "local_wavelet_approx_ratio", "local_wavelet_detail_ratio", "local_wavelet_detail_1_ratio", "local_wavelet_detail_2_ratio"]
    found = {k: array(got, k, a.shape) for k in names}
    padded = np.pad(np.nan_to_num(a), size // 2, mode="reflect")
    seen = np.pad(~np.isnan(a), size // 2)
    for r in range(a.shape[0]):
        for c in range(a.shape[1]):
            if np.isnan(a[r, c]) or seen[r : r + size, c : c + size].sum() < size // 2:
                assert np.isnan(found[names[0]][r, c])
                continue
            w, parts = padded[r : r + size, c : c + size], []
            for _ in range(levels):
                lo, hi = matrix(len(w), low), matrix(len(w), high)
                own = [measure(x) for x in (lo @ w @ hi.T, hi @ w @ lo.T, hi @ w @ hi.T)]
                parts.insert(0, sum(own) if mode == "energy" else np.mean(own))
                w = lo @ w @ lo.T
            total = measure(w) + sum(parts)
            expected = [total, measure(w) / total, sum(parts) / total, *(p / total for p in parts)]
            assert [found[k][r, c] for k in names] == pytest.approx(expected, rel=1e-6, abs=1e-9)


def test_fft_power_on_every_cell(spark, sample):
    a, size = sample[:12, :11], 8
    got = spectral.fft_power(cells(spark, a), size, tile=5)
    names = ["spectral_fft_peak", "spectral_fft_mean", "spectral_fft_entropy"]
    found = {k: array(got, k, a.shape) for k in names}
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size - 1))
    basis = np.exp(-2j * np.pi * np.outer(np.arange(size) - size // 2, np.arange(size)) / size)
    far = np.hypot(*(np.indices((size, size)) - size // 2))
    padded, seen = np.pad(np.nan_to_num(a), size // 2, mode="reflect"), np.pad(~np.isnan(a), size // 2)
    for r in range(a.shape[0]):
        for c in range(a.shape[1]):
            if np.isnan(a[r, c]) or 2 * seen[r : r + size, c : c + size].sum() < size * size:
                assert np.isnan(found[names[1]][r, c])
                continue
            mag = np.abs(basis @ (padded[r : r + size, c : c + size] * np.outer(hann, hann)) @ basis.T)
            p = mag / mag.sum()
            assert found[names[1]][r, c] == pytest.approx((p * far).sum() / far.max()) and found[names[2]][r, c] == pytest.approx(-(p * np.log2(p + 1e-10)).sum() / np.log2(size * size))
            mag[size // 2, size // 2] = 0
            peaks = far[mag >= mag.max() * (1 - 1e-9)] / far.max()
            assert np.abs(peaks - found[names[0]][r, c]).min() < 1e-9


def test_patterns_and_corners_on_every_cell(spark, sample):
    lo, hi = np.nanmin(sample), np.nanmax(sample)
    image = np.nan_to_num(np.floor((sample - lo) / (hi - lo) * 255))
    padded = np.pad(image, 5)
    found = array(texture.lbp(cells(spark, sample), tile=9), "lbp", sample.shape)
    for r in range(sample.shape[0]):
        for c in range(sample.shape[1]):
            if np.isnan(sample[r, c]):
                assert np.isnan(found[r, c])
                continue
            bits = []
            for k in range(8):
                y, x = r + 5 - round(3 * np.sin(2 * np.pi * k / 8), 5), c + 5 + round(3 * np.cos(2 * np.pi * k / 8), 5)
                y0, x0 = int(np.floor(y)), int(np.floor(x))
                top = padded[y0, x0] * (1 - x + x0) + padded[y0, x0 + 1] * (x - x0)
                low = padded[y0 + 1, x0] * (1 - x + x0) + padded[y0 + 1, x0 + 1] * (x - x0)
                bits.append(int(top * (1 - y + y0) + low * (y - y0) - image[r, c] > -1e-9))
            turns = sum(a != b for a, b in zip(bits, bits[1:] + bits[:1]))
            assert found[r, c] == (sum(bits) if turns <= 2 else 9)
    z = np.pad(sample, 1, constant_values=np.nan)
    gx, gy = (z[1:-1, 2:] - z[1:-1, :-2]) / 2, (z[2:, 1:-1] - z[:-2, 1:-1]) / 2

    def box(v):
        p = np.pad(v, 1, constant_values=np.nan)
        w = np.lib.stride_tricks.sliding_window_view(p, (3, 3))
        return np.where(np.isnan(w).all(axis=(2, 3)), np.nan, np.nansum(w, axis=(2, 3)))

    xx, xy, yy = box(gx * gx), box(gx * gy), box(gy * gy)
    m = xx * yy - xy * xy - 0.04 * (xx + yy) ** 2
    key = array(texture.corners(cells(spark, sample)), "key", sample.shape)
    assert ((m > 0.01 * np.nanmax(m)) == (key == 1)).all() and key.sum() > 0


def test_thinning_is_thin_and_whole(spark):
    """What is left of blocks and bars is connected as before, inside, and has no square of four."""
    block = np.zeros((16, 20))
    block[2:7, 2:12] = 1
    block[5:14, 8:11] = 1
    block[10:12, 14:19] = 1
    g = cells(spark, block)
    got = hydrology.thin(g.where("z = 1").select(*G.KEYS), g)
    thin = np.zeros(block.shape, int)
    for r in got.collect():
        thin[r.r, r.c] = 1

    def parts(m):
        left, n = {tuple(p) for p in np.argwhere(m > 0)}, 0
        while left:
            todo, n = [left.pop()], n + 1
            while todo:
                r, c = todo.pop()
                near = {(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
                left -= near
                todo += near
        return n

    assert (thin <= block).all() and parts(thin) == parts(block) == 2
    assert not (thin[1:, 1:] & thin[1:, :-1] & thin[:-1, 1:] & thin[:-1, :-1]).any()


def test_player_over_ranges(spark):
    rows = spark.createDataFrame([(i, float(i * i), f"s{i}") for i in range(200)], "id int, v double, s string").repartition(5)
    got = {(r.id, r.k): (r.v, r.s) for r in streaming.player_frames(rows, ["v", "s"], interval_ms=32).collect()}
    assert got == {(i, k): (pytest.approx(i * i + ((i + 1) ** 2 - i * i) * k / 2), f"s{i}") for i in range(199) for k in (0, 1)}
    assert streaming.player_frames(rows.limit(0), ["v"], interval_ms=32).count() == 0


def test_player_files_and_scenes(spark, tmp_path):
    (tmp_path / "p.csv").write_text('id,v,name,mixed\n1,1.5,"a,7\n2,-2e1x,b,n/a\n3, .5,,3m\n')
    got = sources.read_player(spark, str(tmp_path / "p.csv"))
    assert got.dtypes == [("id", "double"), ("v", "double"), ("name", "string"), ("name_value", "double"), ("mixed", "string"), ("mixed_value", "double")]
    assert [(r.id, r.v, r.name, r.mixed, r.mixed_value) for r in got.orderBy("id").collect()] == [(1.0, 1.5, '"a', "7", 7.0), (2.0, -20.0, "b", "n/a", None), (3.0, 0.5, "", "3m", 3.0)]
    points = spark.range(1000).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"), F.when(F.col("id") % 2 == 0, F.col("id") * 1.0).alias("z"))
    scene = tables.scene_points(points, "z", 0.5, 3.0).collect()
    assert 150 < len(scene) < 350 and all(p.height == 3 * p.color == 3 * p.x for p in scene)


def test_exported_terrain_is_what_the_operators_give(spark, sample):
    g = cells(spark, sample)
    got = terrain.exported(g, 2.0, 5, tile=8).cache()
    single = {
        "slope": terrain.slope(g, 2.0, "sobel"), "aspect": terrain.aspect(g, 2.0, "sobel"), "hillshade": terrain.hillshade(g, 2.0, method="sobel"), "curvature": terrain.curvature_sobel(g, 2.0),
        "roughness": terrain.roughness(g, 5), "TPI": terrain.tpi(g, 5).withColumnRenamed("tpi", "TPI"), "TRI": terrain.tri(g, 5).withColumnRenamed("tri", "TRI"), "max_slope_angle": terrain.max_slope(g, 2.0, 5),
    }
    for k, df in single.items():
        assert np.allclose(array(got, k, sample.shape), array(df, k, sample.shape), equal_nan=True), k


def test_odd_shapes_of_the_newer_operators(spark):
    """A single cell, a row and cells without values, as rasters of one table; and no cell at all."""
    g = cells(spark, [[1.0]], "one").unionByName(cells(spark, [[1.0, 2.0, 4.0]], "row")).unionByName(cells(spark, [[np.nan, np.nan], [np.nan, np.nan]], "none")).repartition(2).cache()
    for df in (terrain.exported(g), window.moments(g), window.fractal_variation(g), texture.localised_glcm(g, 3), spectral.spectral_sobel(g), spectral.entropy_ratios(g, (2, 3), 4), spectral.local_wavelet(g, 8), spectral.wavelet_coefficients(g, 2), spectral.wavelet_maps(g, 2)):
        assert sorted((r.raster_id, r["n"]) for r in df.groupBy("raster_id").agg(F.count("*").alias("n")).collect()) == [("none", 4), ("one", 1), ("row", 3)]
    assert spectral.wavelet_metrics(g, 2, "entropy").count() == 3
    none = g.limit(0)
    for df in (terrain.exported(none), texture.localised_glcm(none, 3), spectral.spectral_sobel(none), spectral.wavelet_maps(none, 2), spectral.wavelet_metrics(none, 2), tables.raster_stats(none), tables.percentile_stretch(none, "z")):
        assert df.count() == 0


def test_principal_components_of_one_column(spark, sample):
    got, shares = ml.pca(ml.patches(cells(spark, sample), 1))
    z = (sample - np.nanmean(sample)) / np.nanstd(sample)
    assert np.allclose(array(got, "pca_1", sample.shape), z, equal_nan=True) and got.where("pca_2 is not null").count() == 0 and shares == pytest.approx([1.0])
    df = spark.createDataFrame([(i, float(i), float(2 * i), float(-i if i % 2 else i)) for i in range(40)] + [(99, None, 1.0, 2.0)], "id long, a double, b double, c double")
    found, shares = ml.feature_pca(df, ["a", "b", "c"])
    assert found.columns == ["id", "pca_1", "pca_2"] and found.count() == 40 and sum(shares) == pytest.approx(1.0)
