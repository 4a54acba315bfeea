"""Quality classifier: a document's own evidence, combined with what its host and path have shown."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import blocks, buffers, carried, grouped_join, keyed_join, lean, prepare, text_column, word_keys, written

#: Labelled documents that the classifier is fitted on at most, picked by a hash of the id.
SAMPLE = 20_000
NAMES = ("one", "words", "word_bytes", "upper", "digit", "bar", "mark", "sign", "stop", "line", "other", "distinct", "repeat", "upper_words", "signed_words")

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CLASS = np.zeros(256, np.uint8)
for _i, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"|", b"!?", b"#$%&*+<=>@[]^_`{}~\\/", b".,;:", b"\n"), 1):
    _CLASS[list(_bytes)] = _i
_CLASS[128:] = 8


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Per text of a block, shares of its bytes and words of several kinds, on a scale that keeps small shares apart."""
    m, n = len(off) - 1, len(data)
    out = np.zeros((m, len(NAMES)))
    out[:, 0] = 1
    if not n:
        return out
    sizes = np.maximum(np.diff(off), 1)
    kind = _CLASS[data]
    doc = np.repeat(np.arange(m), np.diff(off))
    counts = np.bincount(doc * 9 + kind, minlength=m * 9).reshape(m, 9)
    word = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | cut[1:n]
    end[:-1] &= ~word[1:] | cut[1:n]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    of = doc[s]
    words = np.bincount(of, minlength=m)
    some = np.maximum(words, 1)
    h = word_keys(data, s, e) if len(s) else np.zeros(0, np.uint64)
    order = np.lexsort((h, of))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][new], minlength=m)
    again = np.bincount(of[1:][(h[1:] == h[:-1]) & (of[1:] == of[:-1])], minlength=m)
    first_two = (kind[s] == 1) & (e - s > 1) & (kind[np.minimum(s + 1, n - 1)] == 1)
    signed = (kind[e - 1] == 5) | (kind[e - 1] == 4)
    share = lambda x, of_: np.log1p(100 * x / of_)
    out[:, 1] = np.log1p(words)
    out[:, 2] = sizes / some / 10
    for j, c in enumerate((1, 2, 3, 4, 5, 6, 7, 8), 3):
        out[:, j] = share(counts[:, c], sizes)
    out[:, 11], out[:, 12] = distinct / some, share(again, some)
    out[:, 13], out[:, 14] = share(np.bincount(of, first_two, m), some), share(np.bincount(of, signed, m), some)
    out[:, 2] = np.minimum(out[:, 2], 10)
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps with a ridge on all but the first column; y is 0 or 1."""
    w = np.zeros(x.shape[1])
    if not len(y):
        return w
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _scored(weights: np.ndarray | None):
    """Adds the score (weights given) or the features (none) of the texts; the text goes."""

    def run(batches):
        for batch in batches:
            data, off = buffers(text_column(batch, "text"))
            names = [c for c in batch.schema.names if c != "text"]
            for i, j in blocks(off):
                x = features(data[off[i] : off[j]], off[i : j + 1] - off[i])
                new = pa.array(list(x), pa.list_(pa.float64())) if weights is None else pa.array(x @ weights)
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(i, j - i) for c in names), new], names=[*names, "score"])

    return lean(run)


def _known(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, y), one row an id that is labelled 0 or 1."""
    return labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("int").alias("y")).where("id is not null")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights fitted on at most sample labelled documents, those of the least hashes of their ids.

    Labels other than 0 and 1 are left out; an id labelled more than once counts once, with its least
    label. Without two classes only the intercept is more than a guess: a text is then as good as all.
    Of rows that share an id one counts; null ids have no label; null texts are texts without words, and
    long ones are read whole. Empty tables give weights of 0.
    """
    known = written(_known(labels, id_col, label_col).orderBy(F.xxhash64(F.lit(11), "id"), "id").limit(sample), "sample")
    rows = keyed_join(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), known, "id", "inner")
    rows = rows.select("id", "y", "text").mapInArrow(_scored(None), "id long, y int, score array<double>").dropDuplicates(["id"]).orderBy("id").limit(sample).collect()
    return fit(np.array([r.score for r in rows]).reshape(len(rows), len(NAMES)), np.array([r.y for r in rows], float))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _shrunk(groups: DataFrame, keys: tuple[str, ...], prior: str, name: str) -> DataFrame:
    """groups with name: their share s / n of good rows, shrunk towards the column prior.

    The prior is worth as many rows as a beta distribution with the spread between the groups' shares that sampling
    alone does not explain (method of moments), 2 to 10000; one without such spread is worth 10000. n may be 0.
    """
    p = F.col(prior)
    spread = F.sum(F.when(F.col("n") > 0, F.col("n") * (F.col("s") / F.col("n") - p) ** 2)) / F.sum("n")
    by_chance = F.sum(F.when(F.col("n") > 0, p * (1 - p))) / F.sum("n")
    base = F.sum(F.col("n") * p * (1 - p)) / F.sum("n")
    worth = F.least(F.greatest(base / F.greatest(spread - by_chance, F.lit(1e-9)) - 1, F.lit(2.0)), F.lit(10000.0))
    k = F.coalesce(F.col("k"), F.lit(10000.0))
    return groups.crossJoin(F.broadcast(groups.agg(worth.alias("k")))).withColumn(name, (F.col("s") + k * p) / (F.col("n") + k)).select(*keys, "s", "n", "rows", prior, name)


def posteriors(rows: DataFrame) -> DataFrame:
    """(host, path, rows, prior, host_posterior, path_posterior) for each host and path of rows (host, path, s, n).

    A row counts n, of which s is good. The share over all (0.5 if none counts) is the prior of the hosts, and
    a host's posterior that of its paths. Rows are only ever summed, so no host or path is too large.
    """
    zero = F.lit(0.0)
    paths = written(rows.groupBy("host", "path").agg(F.coalesce(F.sum("s"), zero).alias("s"), F.coalesce(F.sum("n"), zero).alias("n"), F.count("*").alias("rows")), "path-sums")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    total = hosts.agg(F.coalesce(F.sum("s") / F.nullif(F.sum("n"), zero), F.lit(0.5)).alias("prior"))
    hosts = _shrunk(hosts.crossJoin(F.broadcast(total)), ("host", ), "prior", "host_posterior")
    hosts = written(hosts.select(F.col("host").alias("_host"), "prior", "host_posterior"), "hosts")
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("_host")))
    found = _shrunk(paths, ("host", "path", "prior"), "host_posterior", "path_posterior")
    return written(found.select("host", "path", "rows", "prior", "host_posterior", "path_posterior"), "paths")


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def classify_quality(
    docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang",
    threshold: float = 0.5, carry: tuple[str, ...] = (), labels: DataFrame | None = None, label_col: str = "quality",
) -> DataFrame:
    """(id, carried columns, evidence, host_posterior, path_posterior, quality, keep) for every row of docs.

    evidence is the document's own log odds, of its text alone. Hosts and paths are judged by what is labelled in
    them: a beta-binomial posterior of the share of good rows, a host's shrunk towards the share over all and a
    path's towards its host's (see posteriors). quality is the probability that has the path's posterior in
    the place of the share over all, which the evidence holds: logit(quality) = evidence +
    logit(path_posterior) - logit(share over all). Without labels a row counts as good by the probability of its own
    evidence.

    Null and empty texts are scored as texts without words; long ones are read whole. Null hosts and paths are
    groups of their own. Null ids and repeated rows keep their rows, and rows that share a labelled id each count;
    a quality at the threshold is kept. An empty table gives an empty result. A carried column whose name
    the result has itself comes out with carried_ before it; other columns are not read.
    """
    prepare(docs.sparkSession)
    names = carried(tuple(c for c in carry if c != id_col), ("id", "evidence", "host_posterior", "path_posterior", "quality", "keep"))
    kinds = dict(docs.dtypes)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(host_col).cast("string").alias("_host"), F.col(path_col).cast("string").alias("_path"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(names)], F.col(text_col).alias("text"))
    form = "".join(f", _c{i} {kinds[c]}" for i, c in enumerate(names))
    scored = written(src.mapInArrow(_scored(weights), f"id long, _host string, _path string{form}, score double"), "scores")
    if labels is None:
        told = scored.select(F.col("_host").alias("host"), F.col("_path").alias("path"), (1 / (1 + F.exp(-F.col("score")))).alias("s"), F.lit(1.0).alias("n"))
    else:
        known = written(_known(labels, id_col, label_col), "labels")
        told = keyed_join(scored.select("id", F.col("_host").alias("host"), F.col("_path").alias("path")), known, "id", "left").select("host", "path", F.col("y").cast("double").alias("s"), F.col("y").isNotNull().cast("double").alias("n"))
    groups = posteriors(told)
    on = F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path"))
    quality = 1 / (1 + F.exp(-(F.col("score") + _logit(F.col("path_posterior")) - _logit(F.col("prior")))))
    out = grouped_join(scored, groups, on, "rows")
    return out.select("id", *[F.col(f"_c{i}").alias(n) for i, n in enumerate(names.values())], F.col("score").alias("evidence"), "host_posterior", "path_posterior", quality.alias("quality"), (quality >= threshold).alias("keep"))
