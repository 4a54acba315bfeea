"""Approximate nearest neighbours: a permutation index over pivots, kept as inverted files, with reranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import keyed_join, prepare, written

#: Vectors that the pivots are chosen from at most, those of the least hashes of their ids.
SAMPLE = 4096
#: Vectors in a shard and queries in a block; one task handles a shard and a block at a time.
SHARD, QUERIES = 8192, 1024
#: Blocks of queries that may be broadcast to the shards, each some hundred KB; more are joined by a shuffle.
BLOCKS = 32


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Spread-out members of the sample: each next one is the farthest from those chosen, from the first on."""
    if not len(sample):
        return sample
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(count, len(sample)):
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        if not far.max() > 0:
            break
        chosen.append(int(far.argmax()))
    return sample[chosen]


def permutations(x: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The depth nearest pivots of each vector, nearest first; ties go to the smaller number."""
    distance = (x * x).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(axis=1)
    return np.argsort(distance, axis=1, kind="stable")[:, :depth].astype(np.int32)


class Shard:
    """Pivot inverted files over some vectors: of each pivot, who has it among the nearest, and at which place."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, perm: np.ndarray, n_pivots: int):
        self.ids, self.x, self.depth = ids, x, perm.shape[1]
        flat = perm.reshape(-1)
        order = np.argsort(flat, kind="stable")
        self.edges = np.searchsorted(flat[order], np.arange(n_pivots + 1))
        self.who, self.place = (order // self.depth).astype(np.int32), (order % self.depth).astype(np.int32)

    def footrule(self, perm: np.ndarray) -> np.ndarray:
        """Spearman's footrule distance of a query's permutation to all, a missing pivot counting as place depth."""
        gain = np.zeros(len(self.ids), np.int32)
        for at, pivot in enumerate(perm.tolist()):
            own = slice(self.edges[pivot], self.edges[pivot + 1])
            place = self.place[own]
            gain[self.who[own]] += (self.depth - at) + (self.depth - place) - np.abs(place - at)
        return self.depth * (self.depth + 1) - gain

    def search(self, query: np.ndarray, perm: np.ndarray, own: int, k: int, candidates: int) -> tuple[np.ndarray, np.ndarray]:
        rule = self.footrule(perm)
        near = np.flatnonzero(rule <= np.partition(rule, candidates - 1)[candidates - 1]) if candidates < len(rule) else np.arange(len(rule))
        near = near[self.ids[near] != own]
        score = np.sqrt(((self.x[near] - query) ** 2).sum(axis=1))
        best = np.lexsort((self.ids[near], score))[:k]
        return self.ids[near[best]], score[best]


def nearest_neighbours(vectors: DataFrame, k: int = 10, every: int = 100, pivots: int = 256, depth: int = 32, share: float = 0.25, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each row whose id is divisible by every, its k nearest others found.

    Pivots come from a bounded sample; every vector is indexed by its depth nearest pivots in order. The rows
    are dealt into shards by a hash of the id, each with its own inverted files, and the queries into blocks;
    a task ranks one shard by footrule for one block and reranks the share of it that is nearest by the exact
    distance, in double precision. Ties go to the smaller id. Only k rows a query and shard are merged.

    Vectors that are null, zero, or hold null or non-finite values take no part, nor do rows with a null id. Of
    rows that share an id, the one with the least vector counts. Vectors of another length than the most common
    one take no part either. Fewer than k others: all of them.
    """
    prepare(vectors.sparkSession)
    spark = vectors.sparkSession
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    ok = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(ok).groupBy("id").agg(F.min("v").alias("v"))
    rows = written(rows, "vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = sizes
    rows = rows.where(F.size("v") == d)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    chosen = choose_pivots(np.array([r.v for r in sample]), pivots)
    shards, cuts = -(-n // SHARD), max(1, -(-rows.where(F.col("id") % every == 0).count() // QUERIES))
    keep = min(depth, len(chosen))

    def pack(key, group):
        order = np.argsort(group["id"].to_numpy())
        ids = group["id"].to_numpy()[order]
        x = group["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), d)[order]
        return pa.table({"cut": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([ids.tobytes()]), "x": pa.array([x.tobytes()]), "perm": pa.array([permutations(x, chosen, keep).tobytes()])})

    def dealt(df: DataFrame, parts: int) -> DataFrame:
        return df.withColumn("cut", F.pmod(F.xxhash64("id"), F.lit(parts))).groupBy("cut").applyInArrow(pack, "cut long, ids binary, x binary, perm binary")

    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, x, perm = (np.frombuffer(row[c], t) for c, t in (("ids", np.int64), ("x", np.float64), ("perm", np.int32)))
                shard = Shard(ids, x.reshape(-1, d), perm.reshape(-1, keep), len(chosen))
                own, q, p = (np.frombuffer(row[c], t) for c, t in (("q_ids", np.int64), ("q_x", np.float64), ("q_perm", np.int32)))
                found = [shard.search(a, b, c, k, max(4 * k, int(share * len(ids)))) for a, b, c in zip(q.reshape(-1, d), p.reshape(-1, keep), own)]
                each = [len(f[0]) for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, each)), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], names=["query_id", "vec_id", "score"])

    index = written(dealt(rows, shards), "shards")
    asked = written(dealt(rows.where(F.col("id") % every == 0), cuts).select(F.col("cut").alias("block"), F.col("ids").alias("q_ids"), F.col("x").alias("q_x"), F.col("perm").alias("q_perm")), "queries")
    # one row for each shard and block of queries: the stated query set against all rows, in blocks
    shard_and_block = index.repartition(shards, "cut").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cuts - 1).cast("long"))))
    pairs = keyed_join(shard_and_block, asked, "block", "inner", cuts if cuts <= BLOCKS else 1 << 62)
    found = pairs.select("ids", "x", "perm", "q_ids", "q_x", "q_perm").mapInArrow(search, "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
