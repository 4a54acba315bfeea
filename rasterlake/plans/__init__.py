"""Plans that need more than one pass: lineage cuts and graphs whose nodes have one successor."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession, functions as F

_written: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which driver and executors share."""
    _written.append(f"{_shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def _shared(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='rasterlake-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, **options: str) -> DataFrame:
    """df as a table written into the shared folder: the lineage ends there, and its size is known to the next plan."""
    path = scratch_path(df.sparkSession, "cut")
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python gets so many rows at a time in what is run meanwhile, for rows that are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@atexit.register
def _clear() -> None:
    """Deletes what was written, when the program ends and nothing can read it any more."""
    with contextlib.suppress(Exception):  # the engine may be gone already
        jvm = SparkContext._jvm
        for path in _written:
            path = jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


def successor_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of nodes (node) and edges (node, next), one at most from each node: (node, next, on_cycle, upstream, cycle, length, steps).

    on_cycle: the node meets itself again. upstream: 1 plus the nodes off cycles whose walk meets the node
    before it is on a cycle. cycle: least node of the cycle that the walk ends on, NULL if it ends
    at a node without successor; length: nodes on that cycle. steps: to its first node, or to the end.

    All by pointer doubling: a number of joins that grows with the logarithm of the longest walk. After 2**k
    steps only nodes on cycles are reached once the set of nodes reached no longer shrinks.
    """
    base = cut(nodes.join(edges, "node", "left").select("node", "next"))
    jump = base.where("next is not null")
    before = None
    while True:
        reached = jump.select(F.col("next").alias("node")).distinct()
        now = reached.count()
        if now == before:
            break
        before = now
        jump = cut(jump.join(jump.select(F.col("node").alias("next"), F.col("next").alias("after")), "next").select("node", F.col("after").alias("next")))
    cycles = cut(reached.withColumn("on_cycle", F.lit(True)))
    base = cut(base.join(cycles, "node", "left").withColumn("on_cycle", F.coalesce("on_cycle", F.lit(False))))

    # Along cycles: their least node, and how far it is.
    ring = base.where("on_cycle").select("node", "next", F.least("node", "next").alias("low"), F.lit(1).cast("long").alias("span"))
    size = cycles.count()
    reach = 1
    while reach < size:
        ahead = ring.select(F.col("node").alias("next"), F.col("next").alias("after"), F.col("low").alias("low2"))
        new = cut(ring.join(ahead, "next").select("node", F.col("after").alias("next"), F.least("low", "low2").alias("low"), "span"))
        same = new.join(ring.select("node", F.col("low").alias("old")), "node").where("low <> old").limit(1).count() == 0
        ring, reach = new, reach * 2
        if same:
            break
    named = ring.select("node", F.col("low").alias("cycle"))
    named = cut(named.join(named.groupBy("cycle").agg(F.count("*").alias("length")), "cycle"))

    # Up the trees: cut the cycles open and count, and find each tree's root and how far it is.
    tree = base.select("node", F.when(~F.col("on_cycle"), F.col("next")).alias("next"), F.lit(1).cast("long").alias("upstream"), F.when(~F.col("on_cycle") & F.col("next").isNotNull(), 1).otherwise(0).cast("long").alias("steps"), F.coalesce(F.when(~F.col("on_cycle"), F.col("next")), "node").alias("root"))
    tree = cut(tree)
    while tree.where("next is not null").limit(1).count():
        gain = tree.where("next is not null").groupBy(F.col("next").alias("node")).agg(F.sum("upstream").alias("gain"))
        ahead = tree.select(F.col("node").alias("next"), F.col("next").alias("after"), F.col("steps").alias("more"), F.col("root").alias("root2"))
        tree = tree.join(gain, "node", "left").join(ahead, "next", "left")
        tree = cut(tree.select("node", F.col("after").alias("next"), (F.col("upstream") + F.coalesce("gain", F.lit(0))).alias("upstream"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("root2", "root").alias("root")))
    out = base.join(tree.select("node", "upstream", "steps", "root"), "node").join(named.withColumnRenamed("node", "root"), "root", "left")
    return out.select("node", "next", "on_cycle", "upstream", "cycle", "length", "steps")
