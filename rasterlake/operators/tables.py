"""Analytics over feature tables: profiles, correlations, histograms, gridding."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import exp

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from rasterlake.plans import cut

#: Rows that kendall takes at most.
KENDALL_ROWS = 100_000

# The categories, in the order in which they are tried, and their features.
CATEGORIES = {
    "terrain": ("slope", "aspect", "hillshade", "curvature", "roughness", "TPI", "TRI", "max_slope_angle"),
    "stats": ("mean", "stddev", "min", "max", "skewness", "kurtosis", "entropy", "valid_count", "fractal_dimension"),
    "spatial": ("morans_I", "gearys_C", "local_moran_mean", "getis_ord_G_star", "spatial_lag"),
    "texture": ("glcm_contrast", "glcm_dissimilarity", "glcm_homogeneity", "glcm_energy", "glcm_correlation", "lbp", "lbp_hist_mean", "lbp_hist_var", "lbp_hist_skew", "sift_keypoints", "orb_keypoints"),
    "spectral": ("fft_peak", "fft_mean", "fft_entropy", "wavelet_energy", "wavelet_approx_ratio", "wavelet_detail_ratio", "multiscale_entropy_1", "multiscale_entropy_slope"),
    "hydrology": ("flow_direction", "flow_accumulation", "flow_accumulation_log", "edge_detection", "drainage_network", "betweenness_centrality", "upstream_degree", "downstream_degree", "drainage_connectivity"),
    "ml": ("pca_1", "pca_2", "cluster_label", "autoencoder_latent_1", "autoencoder_latent_2"),
}
# Prefixes and suffixes that are tried after the names.
LATER = (("ml", "pca_", None), ("ml", "cluster_", None), ("ml", "autoencoder_", None), ("texture", "glcm_", None), ("texture", "lbp_", None), ("spectral", "wavelet_", None), ("spectral", "multiscale_", None), ("hydrology", "flow_", None), ("hydrology", None, "_degree"))
# What the features are called.
DESCRIPTIONS = {
    "slope": "Slope angle in degrees", "aspect": "Aspect angle in degrees (0-360, clockwise from north)", "hillshade": "Hillshade value (0-255)",
    "curvature": "Curvature (positive for convex, negative for concave)", "roughness": "Terrain roughness (standard deviation of elevation)",
    "TPI": "Topographic Position Index", "TRI": "Terrain Ruggedness Index", "max_slope_angle": "Maximum slope angle in local window",
    "mean": "Mean elevation in local window", "stddev": "Standard deviation of elevation in local window", "min": "Minimum elevation in local window",
    "max": "Maximum elevation in local window", "skewness": "Skewness of elevation in local window", "kurtosis": "Kurtosis of elevation in local window",
    "entropy": "Shannon entropy of elevation in local window", "valid_count": "Number of valid cells in local window",
    "fractal_dimension": "Fractal dimension (box-counting method)", "morans_I": "Moran's I spatial autocorrelation statistic",
    "gearys_C": "Geary's C spatial autocorrelation statistic", "spatial_lag": "Spatial lag (weighted average of neighboring values)",
    "lbp": "Local Binary Pattern texture descriptor", "flow_direction": "D8 flow direction (encoded as powers of 2)", "cluster_label": "Cluster label",
    "local_moran_mean": "Local Moran's I statistic", "getis_ord_G_star": "Getis-Ord G* statistic",
    "glcm_contrast": "GLCM contrast (local intensity variations)", "glcm_dissimilarity": "GLCM dissimilarity (variation of grey level pairs)",
    "glcm_homogeneity": "GLCM homogeneity (closeness of element distribution)", "glcm_energy": "GLCM energy (sum of squared elements)",
    "glcm_correlation": "GLCM correlation (linear dependency of grey levels)", "lbp_hist_mean": "Mean of LBP histogram",
    "lbp_hist_var": "Variance of LBP histogram", "lbp_hist_skew": "Skewness of LBP histogram",
    "sift_keypoints": "SIFT keypoint density", "orb_keypoints": "ORB keypoint density",
    "fft_peak": "Peak frequency in FFT spectrum", "fft_mean": "Mean value of FFT spectrum", "fft_entropy": "Entropy of FFT spectrum",
    "wavelet_energy": "Wavelet energy", "wavelet_approx_ratio": "Ratio of approximation coefficients energy",
    "wavelet_detail_ratio": "Ratio of detail coefficients energy", "multiscale_entropy_1": "Entropy at original scale",
    "multiscale_entropy_slope": "Slope of entropy across scales",
    "flow_accumulation": "Flow accumulation (number of cells flowing into each cell)", "flow_accumulation_log": "Log-transformed flow accumulation",
    "edge_detection": "Edge magnitude (using Sobel filter)", "drainage_network": "Drainage network (1 for network, 0 otherwise)",
    "betweenness_centrality": "Betweenness centrality in drainage network", "upstream_degree": "Number of upstream cells in drainage network",
    "downstream_degree": "Number of downstream cells in drainage network", "drainage_connectivity": "Connectivity index in drainage network",
    "pca_1": "First principal component", "pca_2": "Second principal component",
    "autoencoder_latent_1": "First latent dimension from autoencoder", "autoencoder_latent_2": "Second latent dimension from autoencoder",
}


def category(name: Column) -> Column:
    """The first category that has the name or, failing that within the category, a name it starts with; then later rules."""
    out = F
    for kind, features in CATEGORIES.items():
        fits = name.isin(*features)
        for f in features:
            fits = fits | name.startswith(f)
        out = out.when(fits, kind)
    for kind, head, tail in LATER:
        out = out.when(name.startswith(head) if head else name.endswith(tail), kind)
    return out.otherwise("other")


def description(name: Column) -> Column:
    out = F
    for known, text in DESCRIPTIONS.items():
        out = out.when(name == known, text)
    last = F.element_at(F.split(name, "_"), -1)
    out = out.when(name.startswith("pca_"), F.concat(F.lit("Principal component "), F.split(name, "_")[1]))
    out = out.when(name.startswith("autoencoder_latent_"), F.concat(F.lit("Autoencoder latent dimension "), last))
    out = out.when(name.startswith("wavelet_detail_"), F.concat(F.lit("Ratio of detail coefficients energy at level "), last))
    out = out.when(name.startswith("multiscale_entropy_") & last.rlike(r"^\d+$"), F.concat(F.lit("Entropy at scale "), last))
    out = out.when(name.startswith("local_glcm_"), F.concat(F.lit("Local GLCM "), F.replace(name, F.lit("local_glcm_"), F.lit("")), F.lit(" in window")))
    return out.otherwise("Feature derived from elevation data")


def melt(df: DataFrame, features: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features]))
    return df.select(*keep, pairs.alias("s")).select(*keep, "s.feature", "s.v")


def by_column(df: DataFrame, features: list[str], measures: dict[str, Callable[[Column], Column]], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, feature, measures): one aggregate over the columns, with a row a feature made of its few results."""
    got = df.groupBy(*by).agg(*[f(F.col(c).cast("double")).alias(f"{i}_{k}") for i, c in enumerate(features) for k, f in measures.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"{i}_{k}").alias(k) for k in measures]) for i, c in enumerate(features)]))
    return got.select(*by, rows.alias("s")).select(*by, "s.*")


def value_ranks(values: DataFrame, by: str = "feature", value: str = "v") -> DataFrame:
    """(by, value, n, before) for each distinct value that is not NULL: how often it occurs, and how many are less.

    Values are counted, then dealt out by ranges of (by, value); a running sum within each range follows on the sums of
    the ranges before, which are few. No group is ever gathered, so one column may hold all the rows.
    """
    parts = max(1, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = values.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    dealt = cut(counts.repartitionByRange(parts, by, value).withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy(by, "part").agg(F.sum("n").alias("total"))
    earlier = Window.partitionBy(by).orderBy("part")
    sums = sums.withColumn("base", F.sum("total").over(earlier) - F.col("total")).select(by, "part", "base")
    here = Window.partitionBy(by, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("own", F.coalesce(F.sum("n").over(here), F.lit(0)))
    return ranked.join(F.broadcast(sums), [by, "part"]).select(by, value, "n", (F.col("base") + F.col("own")).alias("before"))


def exact_quantiles(ranks: DataFrame, shares: tuple[float, ...], by: str = "feature", value: str = "v") -> DataFrame:
    """(by, q): linear quantiles, in the order of shares, from value_ranks."""
    sizes = ranks.groupBy(by).agg(F.sum("n").alias("size"))
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(shares)]))
    wanted = sizes.withColumn("a", asked).select(by, "a.i", (F.col("a.q") * (F.col("size") - 1)).alias("at")).withColumns({"lo": F.floor("at"), "hi": F.ceil("at")})
    inside = lambda k: (F.col("before") <= F.col(k)) & (F.col(k) < F.col("before") + F.col("n"))
    met = ranks.join(F.broadcast(wanted), by).where(inside("lo") | inside("hi"))
    ends = met.groupBy(by, "i", "at", "lo").agg(F.max(F.when(inside("lo"), F.col(value))).alias("x"), F.max(F.when(inside("hi"), F.col(value))).alias("y"))
    v = F.col("x") + (F.col("y") - F.col("x")) * (F.col("at") - F.col("lo"))
    return ends.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", v.alias("v")))), lambda s: s["v"]).alias("q"))


def profile(df: DataFrame, features: list[str]) -> DataFrame:
    """One row a feature: min, max, mean, median, std (sample), skew and kurtosis (corrected for bias), count, missing, n_unique."""
    plain = {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_samp, "g1": F.skewness, "g2": F.kurtosis, "count": F.count, "missing": lambda v: F.count_if(v.isNull())}
    ranks = cut(value_ranks(melt(df, features)))
    more = ranks.groupBy("feature").agg(F.count("*").alias("n_unique")).join(exact_quantiles(ranks, (0.5,)), "feature").select("feature", F.col("q")[0].alias("median"), "n_unique")
    got = by_column(df, features, plain).join(F.broadcast(more), "feature", "left")
    n = F.col("count").cast("double")
    skew = F.when(n >= 3, F.sqrt(n * (n - 1)) / (n - 2) * F.col("g1"))
    kurt = F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return got.select("feature", "min", "max", "mean", "median", "std", skew.alias("skew"), kurt.alias("kurtosis"), "count", "missing", F.coalesce("n_unique", F.lit(0)).alias("n_unique"))


def _corr(a: str, b: str) -> Column:
    """Pearson's coefficient over the rows that have both; NULL where either does not vary."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def correlations(df: DataFrame, features: list[str], method: str = "pearson") -> DataFrame:
    """(a, b, corr) for every pair of features; spearman ranks ties by their mean; kendall is tau-b.

    kendall compares every row with every other: tables of more than KENDALL_ROWS are refused.
    """
    pairs = list(combinations(sorted(features), 2))
    if method == "spearman":
        rows = df.select(*[F.col(f).cast("double").alias(f) for f in features])
        ranks = cut(value_ranks(melt(rows, features)))
        for f in features:
            own = ranks.where(F.col("feature") == f).select(F.col("v").alias(f), (F.col("before") + (F.col("n") + 1) / 2).alias(f"_r_{f}"))
            rows = rows.join(own, f, "left")
        got = rows.agg(*[_corr(f"_r_{a}", f"_r_{b}").alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    elif method == "kendall":
        rows = df.select(*[F.col(f).cast("double").alias(f) for f in features]).withColumn("_i", F.monotonically_increasing_id())
        if (n := rows.count()) > KENDALL_ROWS:
            raise ValueError(f"kendall compares all pairs of rows: {n} are more than {KENDALL_ROWS}")
        other = rows.select(F.col("_i").alias("_j"), *[F.col(f).alias(f"o_{f}") for f in features])
        both = rows.join(other, F.col("_i") < F.col("_j"))
        sign = {f: F.signum(F.col(f) - F.col(f"o_{f}")) for f in features}
        got = both.agg(*[(F.sum(sign[a] * sign[b]) / F.nullif(F.sqrt(F.sum(F.abs(sign[a])) * F.sum(F.abs(sign[b]))), F.lit(0.0))).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    else:
        got = df.agg(*[_corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return got.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("s")).select("s.*")


def strong_correlations(df: DataFrame, features: list[str], least: float = 0.7, method: str = "pearson") -> DataFrame:
    """Those of at least that size, strongest first; undefined ones are left out."""
    got = correlations(df, features, method).where(F.abs("corr") >= least)
    return got.orderBy(F.abs("corr").desc(), "a", "b")


def correlation_matrix(df: DataFrame, features: list[str], method: str = "pearson") -> DataFrame:
    """(feature, one column a feature): correlations both ways, 1 on the diagonal where a feature varies."""
    got = correlations(df, features, method)
    varies = by_column(df, features, {"v": F.var_pop}).select(F.col("feature").alias("a"), F.col("feature").alias("b"), F.when(F.col("v") > 0, 1.0).alias("corr"))
    every = got.unionByName(got.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr")).unionByName(varies)
    return every.groupBy(F.col("a").alias("feature")).pivot("b", sorted(features)).agg(F.first("corr"))


def feature_names(df: DataFrame, excluded: tuple[str, ...] = ("raster_id", "id", "x", "y"), numeric: bool = True) -> list[str]:
    """The columns that are features: all but the excluded ones, and with numeric only those that hold numbers."""
    return [f.name for f in df.schema.fields if f.name not in excluded and (not numeric or isinstance(f.dataType, T.NumericType))]


def analyze(df: DataFrame, features: list[str]) -> DataFrame:
    """(category, n, features) over the features' categories."""
    names = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return names.groupBy(category(F.col("feature")).alias("category")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("feature")).alias("features"))


def feature_metadata(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, category, description, dtype, min, max, mean, median, std, count, missing): what is known of each feature."""
    kinds = dict(df.dtypes)
    names = df.sparkSession.createDataFrame([(f, kinds[f]) for f in features], "feature string, dtype string")
    return names.join(profile(df, features), "feature").select("feature", category(F.col("feature")).alias("category"), description(F.col("feature")).alias("description"), "dtype", "min", "max", "mean", "median", "std", "count", "missing")


def validate(features: DataFrame, cells: DataFrame, names: list[str]) -> DataFrame:
    """(raster_id, feature, cells, missing, rows, ok, empty, min, max, mean, std) of columns beside the cells of each raster.

    ok: the feature has one row for each cell of the raster, no more and no less. empty: it has no value at all.
    """
    keys = ["raster_id", "r", "c"]
    grid = cells.groupBy("raster_id").agg(F.count("*").alias("cells"))
    per = features.select(*keys, *names).join(cells.select(*keys, F.lit(1).alias("_in")), keys, "left")
    places = per.groupBy(*keys).agg(F.count("*").alias("k"), F.max("_in").alias("inside")).groupBy("raster_id").agg(F.sum("k").alias("rows"), F.count("inside").alias("places"))
    one = by_column(per, names, {"missing": lambda v: F.count_if(v.isNull()), "min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_pop}, ("raster_id",))
    both = one.join(grid, "raster_id", "left").join(places, "raster_id", "left")
    ok = F.coalesce((F.col("rows") == F.col("cells")) & (F.col("places") == F.col("cells")), F.lit(False))
    return both.select("raster_id", "feature", "cells", "missing", "rows", ok.alias("ok"), (F.col("missing") == F.col("rows")).alias("empty"), "min", "max", "mean", "std")


def first_features(df: DataFrame, features: list[str], n: int = 9) -> DataFrame:
    """(place, feature, min, max, mean) of the first n features, as a panel of grids shows them."""
    chosen = features[:n]
    place = F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(chosen) for x in (f, i)]), F.col("feature"))
    return by_column(df, chosen, {"min": F.min, "max": F.max, "mean": F.avg}).select(place.alias("place"), "feature", "min", "max", "mean")


def feature_ranges(df: DataFrame, features: list[str], digits: int = 8, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, feature, min, max) of what can be read as a number."""
    text = df.select(*by, *[F.expr(f"try_cast(`{f}` as double)").alias(f) for f in features])
    return by_column(text, features, {"min": lambda v: F.round(F.min(v), digits), "max": lambda v: F.round(F.max(v), digits)}, by)


def top_variance(df: DataFrame, features: list[str], k: int = 20) -> DataFrame:
    got = by_column(df, features, {"variance": F.var_pop})
    return got.orderBy(F.desc("variance"), "feature").limit(k)


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, lo, n, density); the greatest value belongs to the last bin."""
    span = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"), F.count(column).alias("total"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(column) - F.col("lo")) / width), F.lit(bins - 1)))
    got = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(span)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.first("lo").alias("lo0"), F.first(width).alias("width"), F.first("total").alias("total"))
    return got.select("bin", (F.col("lo0") + F.col("bin") * F.col("width")).alias("lo"), "n", F.when(F.col("width") > 0, F.col("n") / F.col("total") / F.col("width")).alias("density"))


def percentile_stretch(df: DataFrame, column: str, lo: float = 0.01, hi: float = 0.99, by: str | None = None) -> DataFrame:
    """column scaled to 0..1 between two percentiles, over all rows or those of each by, as stretched."""
    key = F.lit(0) if by is None else F.col(by)
    q = exact_quantiles(value_ranks(df.select(key.alias("_by"), F.col(column).cast("double").alias("v")), "_by"), (lo, hi), "_by")
    low, high = F.col("q")[0], F.col("q")[1]
    v = F.when(low == high, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(column) - low) / (high - low))))
    return df.join(F.broadcast(q) if by is None else q, key == F.col("_by"), "left").withColumn("stretched", F.when(F.col(column).isNotNull(), v)).drop("q", "_by")


def points_to_grid(df: DataFrame, value: str, order: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """(r, c, z): dense indexes of the distinct y and x; of points in one place the last by order counts.

    The indexes come from the distinct coordinates alone, which are few beside the points.
    """
    ranks = lambda col, name: value_ranks(df.select(F.lit(0).alias("_by"), F.col(col)).distinct(), "_by", col).select(col, F.col("before").alias(name))
    got = df.groupBy(x, y).agg(F.max_by(value, order).alias("z"))
    return got.join(ranks(y, "r"), y).join(ranks(x, "c"), x).select("r", "c", "z")


def square_repair(df: DataFrame, value: str, order: str = "id", least: float = 0.1, most: float = 10.0) -> DataFrame:
    """(r, c, z): where the grid of x and y is far from square, its values in order fill a square of side floor(sqrt(n))."""
    sizes = df.agg(F.count_distinct("x").alias("nx"), F.count_distinct("y").alias("ny"), F.count(value).alias("n")).withColumn("side", F.floor(F.sqrt("n")))
    known = df.where(F.col(value).isNotNull()).select(F.lit(0).alias("_by"), F.col(order).alias("_o"), F.col(value).alias("z"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("_o").orderBy("z")) - 1
    rows = known.join(value_ranks(known, "_by", "_o").select("_o", "before"), "_o").withColumn("k", place).crossJoin(F.broadcast(sizes))
    bent = ~(F.col("nx") / F.col("ny")).between(least, most)
    return rows.where(bent & (F.col("k") < F.col("side") * F.col("side"))).select(F.expr("k div side").alias("r"), (F.col("k") % F.col("side")).alias("c"), "z")


def gaussian_smooth(cells: DataFrame, sigma: float = 1.0, radius: int | None = None) -> DataFrame:
    """Weighted mean over a separable Gaussian window, of the values there are."""
    radius = round(4 * sigma) if radius is None else radius
    w = [exp(-i * i / (2 * sigma * sigma)) for i in range(-radius, radius + 1)]
    out = cells.select("raster_id", "r", "c", "z", F.when(F.col("z").isNotNull(), 1.0).otherwise(0.0).alias("w"), F.coalesce("z", F.lit(0.0)).alias("s"))
    for axis, by in (("c", "r"), ("r", "c")):
        win = Window.partitionBy("raster_id", by).orderBy(axis)
        near = lambda col, i: F.coalesce(F.lag(col, -i).over(win), F.lit(0.0))  # noqa: E731,B023
        out = out.withColumns({col: sum((F.lit(w[i + radius]) * near(col, i) for i in range(-radius, radius + 1)), F.lit(0.0)) for col in ("w", "s")})
    return out.select("raster_id", "r", "c", F.when(F.col("w") > 0, F.col("s") / F.col("w")).alias("smooth"))


def density(df: DataFrame, column: str, by: str = "raster_id") -> DataFrame:
    return df.groupBy(by).agg(F.count(column).alias("valid"), F.count("*").alias("total"), (100.0 * F.count(column) / F.count("*")).alias("percent"))


def raster_stats(cells: DataFrame) -> DataFrame:
    """min, max, mean, std (population), median, count, total and valid share of each raster."""
    median = exact_quantiles(value_ranks(cells.select("raster_id", "z"), "raster_id", "z"), (0.5,), "raster_id", "z").select("raster_id", F.col("q")[0].alias("median"))
    got = cells.groupBy("raster_id").agg(F.min("z").alias("min"), F.max("z").alias("max"), F.avg("z").alias("mean"), F.stddev_pop("z").alias("std"), F.count("z").alias("count"), F.count("*").alias("total"), (100.0 * F.count("z") / F.count("*")).alias("valid_percentage"))
    return got.join(median, "raster_id", "left").select("raster_id", "min", "max", "mean", "std", "median", "count", "total", "valid_percentage")


def compare(tables: dict[str, DataFrame], columns: dict[str, str], key: str = "id") -> DataFrame:
    """One column of each table beside the others', joined by key; a column may be named by a unique part of its name."""
    out = None
    for name, df in tables.items():
        fits = [c for c in df.columns if c == columns[name]] or [c for c in df.columns if columns[name].lower() in c.lower()]
        if len(fits) != 1:
            raise ValueError(f"{name}: {columns[name]} names {len(fits)} columns")
        one = df.select(key, F.col(fits[0]).alias(name))
        out = one if out is None else out.join(one, key)
    return out


def sample_rows(df: DataFrame, fraction: float | None = None, n: int | None = None, seed: int = 42) -> DataFrame:
    """A share of the rows, or exactly n (or all, if fewer)."""
    return df.sample(fraction=fraction, seed=seed) if n is None else df.orderBy(F.rand(seed)).limit(n)


def scene_points(df: DataFrame, z: str, fraction: float = 0.1, exaggeration: float = 1.0, seed: int = 42, x: str = "x", y: str = "y") -> DataFrame:
    """(x, y, height, color): a share of the rows that have z, as points of a scene whose heights are exaggerated."""
    return df.where(F.col(z).isNotNull()).sample(fraction=fraction, seed=seed).select(F.col(x).alias("x"), F.col(y).alias("y"), (F.col(z) * exaggeration).alias("height"), F.col(z).alias("color"))


def complete_features(df: DataFrame, features: list[str]) -> list[str]:
    """Those features that have no missing value."""
    row = df.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in features]).first()
    return [f for f in features if row[f] == 0]


def file_category(path: Column) -> Column:
    """terrain of .../name_terrain_features.csv."""
    return F.nullif(F.regexp_extract(path, r"_(\w+)_features", 1), F.lit(""))
