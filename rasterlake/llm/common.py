"""What the operators share: the shared scratch folder, size-checked joins, components, numpy text kernels."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows of at most a few dozen bytes that a broadcast may hold; larger sides are shuffled.
BROADCAST_ROWS = 200_000
#: Bytes of text that a numpy kernel works on at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 19

_scratch: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a new temporary one, but in local mode alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='rasterlake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def prepare(spark: SparkSession) -> None:
    """Keeps the Arrow batches of this session small, since texts may be long.

    The settings stay: results are worked out when they are read, and need them then.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def planned_bytes(df: DataFrame) -> int:
    """What Spark's plan says that df reads, for files their size; 0 where it does not know."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once into the shared folder: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def release(*tables: DataFrame) -> None:
    """Deletes written tables that nothing still to be read was made from."""
    for table in tables:
        drop_scratch(table.sparkSession, [table.scratch])
        _scratch.remove(table.scratch)


def drop_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Deletes these folders and empties the list. Only for callers that hold no unread result over them."""
    jvm = spark.sparkContext._jvm
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _clear() -> None:
    """Deletes what is left when the program ends and nothing can read it any more."""
    with contextlib.suppress(Exception):  # the engine may be gone already
        jvm = SparkContext._jvm
        for path in map(jvm.org.apache.hadoop.fs.Path, _scratch):
            path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


def keyed_join(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int | None = None) -> DataFrame:
    """Equi-join whose right side is broadcast if its counted rows are few, and shuffled otherwise."""
    n = right.count() if rows is None else rows
    return left.join(F.broadcast(right) if n <= BROADCAST_ROWS else right.hint("merge"), on, how)


#: Groups that hold more than one in HEAVY of all rows: at most HEAVY of them, so their side is always broadcast.
HEAVY = 5000


def grouped_join(rows: DataFrame, groups: DataFrame, on: Column, count_col: str) -> DataFrame:
    """Inner equi-join of rows with the groups they belong to, one row of groups each, of which count_col rows are.

    The groups that hold most rows, HEAVY at most, are broadcast; rows of the others meet theirs by a shuffle, in
    which no key has more than one in HEAVY of them. groups must be a written table.
    """
    n, total = groups.agg(F.count("*"), F.sum(count_col)).first()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), on, "inner")
    heavy = F.col(count_col) > total / HEAVY
    few, many = F.broadcast(groups.where(heavy)), groups.where(~heavy)
    return rows.join(few, on, "inner").unionByName(rows.join(few, on, "left_anti").join(many.hint("merge"), on, "inner"))


def carried(carry: tuple[str, ...], own: tuple[str, ...]) -> dict[str, str]:
    """The names that carried columns come out under: their own, with carried_ before one that the result has itself."""
    return {c: f"carried_{c}" if c.lower() in own else c for c in carry}


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of edges (src, dst); component is the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): each is a grouped minimum
    and an equi-join, so no node's neighbours are ever gathered, and stars of any size stay cheap.
    Null ends are ignored; an edge of a node to itself only says that the node exists.
    """
    edges = written(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), name)
    links = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    links = written(links, name)
    while True:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        links = written(small, name)
        # done once every node has one link to a node that has none: its component's least, since links go downwards
        ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty():
            break
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


# ---------------------------------------------------------------- texts in Arrow batches


def lean(run):
    """A task's function that gives memory back at its end: Spark keeps the worker, and the next stage needs the room."""

    @functools.wraps(run)
    def wrapped(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD: what is large goes back as soon as it is free
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every platform has it
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as large strings without nulls; null texts are empty."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()).fill_null("")


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a large string or binary array without nulls."""
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold limit bytes at most, or one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


# ---------------------------------------------------------------- hashes

_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_RANDOM = np.random.Generator(np.random.PCG64(20240607)).integers(1, _MASK, 256, np.uint64, endpoint=True)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of an odd base modulo 2**64, and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for key, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[key] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 running sums; (sums[j] - sums[i]) * down[i] depends on bytes i to j alone."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_RANDOM[data] * up[: len(data)], out=sums[1:])
    return sums


def word_keys(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word data[s:e], from BLAKE2 of its bytes: unlike sums of powers, no text can be made to collide."""
    off = np.empty(2 * len(s), np.int64)
    off[::2], off[1::2] = s, e
    every = pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(data)])
    words = every.take(pa.array(np.arange(0, len(off) - 1, 2))).dictionary_encode()
    keys = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in words.dictionary.to_pylist()), np.uint64)
    return keys[words.indices.to_numpy()]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a block of texts, the sorted distinct k-word shingles of each as 64-bit hashes, and their counts.

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D, with A-Z lower-cased. A text of fewer than
    k words has one shingle of all its words, and none without words.
    """
    m, n = len(off) - 1, len(data)
    counts = np.zeros(m, np.int64)
    if not n:
        return np.zeros(0, np.uint64), counts
    low = _LOWER[data]
    word = ~_SPACE[low]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | cut[1:n]
    end[:-1] &= ~word[1:] | cut[1:n]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    if not len(s):
        return np.zeros(0, np.uint64), counts
    words = word_keys(low, s, e)
    doc = np.searchsorted(off, s, "right") - 1
    per = np.bincount(doc, minlength=m)
    last = np.cumsum(per)
    at = np.flatnonzero(np.arange(len(s)) + k <= last[doc])
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h = mix(h * np.uint64(_P) + words[at + j])
    few = np.flatnonzero((per > 0) & (per < k))
    if len(few):
        own = np.zeros(len(few), np.uint64)
        for j, d in enumerate(few):
            x = np.uint64(per[d])
            for w in words[last[d] - per[d] : last[d]]:
                x = mix(np.array([w], np.uint64) + mix(np.array([x], np.uint64)))[0]
            own[j] = x
        h, who = np.concatenate([h, own]), np.concatenate([doc[at], few])
    else:
        who = doc[at]
    order = np.lexsort((h, who))
    h, who = h[order], who[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    return h[new], np.bincount(who[new], minlength=m)
