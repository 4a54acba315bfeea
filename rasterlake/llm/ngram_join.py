"""Jaccard join on word shingles: frequency-ordered, token-combination prefixes, then verification."""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import blocks, buffers, connected_components, keyed_join, lean, lists, mix, prepare, release, shingle_sets, text_column, written

#: A shingle of up to RARE sets is indexed alone; up to RARE * RARE in pairs; beyond in triples.
RARE = 64
#: Members of a bucket that are put in order together.
BUCKET = 4096
#: Members of a bucket that are compared with one another, or with as many others, at once.
PART = 1024
#: Hash bins whose counts bound what two sets may share.
BINS = 256


def _sets(k: int, id_col: str, text_col: str, share: int, full: bool):
    """Per text: id, set size, both halves of the set's 128-bit key and, of its shingles, all or one share of the hash range."""

    def run(batches):
        for batch in batches:
            col, ids = text_column(batch, text_col), batch.column(batch.schema.get_field_index(id_col))
            data, off = buffers(col)
            for i, j in blocks(off):
                h, n = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
                ends = np.cumsum(n)
                keys = np.frombuffer(b"".join(hashlib.blake2b(h[b - c : b].tobytes(), digest_size=16).digest() for b, c in zip(ends, n)), np.int64).reshape(-1, 2)
                some = np.ones(len(h), bool) if full else h % np.uint64(share) == 0
                before = np.concatenate([[0], np.cumsum(some)])
                out = {"id": ids.slice(i, j - i), "n": pa.array(n), "key": pa.array(keys[:, 0].copy()), "key2": pa.array(keys[:, 1].copy()), "tokens": lists(h[some].view(np.int64), before[ends] - before[ends - n], pa.int64())}
                if full:
                    out["bins"] = pa.array([np.minimum(np.bincount(h[b - c : b] >> np.uint64(56), minlength=BINS), 255).astype(np.uint8).tobytes() for b, c in zip(ends, n)], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    return lean(run)


def _told_apart(sets: DataFrame, twins: DataFrame | None) -> DataFrame:
    """sets with one key: of the first half's twins, which name more than one set, it is made anew from both halves."""
    if twins is None:
        return sets.drop("key2")
    marked = sets.join(twins.withColumn("twin", F.lit(True)), "key", "left")
    return marked.withColumn("key", F.when(F.col("twin"), F.xxhash64("key", "key2")).otherwise(F.col("key"))).select(*[c for c in sets.columns if c != "key2"])


def _signatures(num: int, den: int):
    """The prefix signatures of each set, from its shingles with their set counts.

    Shingles are ordered by rarity. At most d = n - ceil(n * num / den) of a set's shingles may be missing
    from a partner. A prefix covers a partner for certain once it holds more than d shingles counted as
    follows: a rare one counts 1; of a sub-class whose members are indexed as k-combinations, all but the
    first k - 1 count. Sub-classes are cut by hash, in number proportional to the set's size band, so that
    combinations stay linear in the size; a set is indexed in every band that a partner of its may lie in. In bands of
    sets so small that the uncounted shingles could use up what two partners share, each shingle is indexed alone. A set
    too small for any partner but its equal is left out.
    """

    def singly(b):
        return -(-(1 << (b - 1)) * num // den) <= 3 * max(1, (1 << b) // 64)

    def run(batches):
        for batch in batches:
            key, n = batch["key"].to_numpy(), batch["n"].to_numpy()
            lo, out = batch["tokens"].offsets.to_numpy(), ([], [], [], [])
            flat = batch["tokens"].values
            df, tok = flat.field("df").to_numpy(), flat.field("token").to_numpy().view(np.uint64)
            for r in range(len(batch)):
                f, t = df[lo[r] : lo[r + 1]], tok[lo[r] : lo[r + 1]]
                single = int(n[r]) - len(t)
                d = int(n[r]) + (-int(n[r]) * num // den)
                if single > d or int(n[r]) * den < num * (int(n[r]) + 1):
                    continue
                order = np.lexsort((t, f))
                f, t = f[order], t[order]
                for b in range((-(-int(n[r]) * num // den)).bit_length(), int(n[r]).bit_length() + 1):
                    cuts = max(1, (1 << b) // 64)
                    cover, held, found = single, {}, []
                    for x, c in zip(t, f):
                        if cover > d:
                            break
                        k = 1 if c <= RARE or singly(b) else 2 if c <= RARE * RARE else 3
                        if k == 1:
                            found.append(x)
                            cover += 1
                            continue
                        own = held.setdefault((k, int(x) % cuts), [])
                        found += [mix(np.array([sum(map(int, (*z, x))) * 0x9E3779B97F4A7C15 + k & (1 << 64) - 1], np.uint64))[0] for z in combinations(own, k - 1)]
                        own.append(x)
                        cover += len(own) >= k
                    out[0].append(np.unique(mix(np.array(found, np.uint64) + np.uint64(b))))
                    for c, v in zip(out[1:], (key[r], n[r], single)):
                        c.append(np.full(len(out[0][-1]), v, np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in out], names=["sig", "key", "n", "single"])

    return lean(run)


def _bucket_pairs(num: int, den: int):
    """Pairs of different components, in buckets that arrive whole and in order, that no bound rules out.

    Two sets share at most the shingles that occur in more than one set, and at most the sum over hash
    bins of the lesser count of each. Few pairs below the threshold pass the second bound unless both
    sets are far larger than the bins are many.
    """

    def coarse(c):
        return c["bins"].reshape(len(c["bins"]), 32, BINS // 32).sum(axis=2, dtype=np.int32)

    def pairs(a, b, same):
        sums = coarse(a), coarse(b)
        for i in range(len(a["key"])):
            both = np.minimum(a["n"][i] - a["single"][i], b["n"] - b["single"])
            ok = (den * both >= num * (a["n"][i] + b["n"] - both)) & (b["comp"] != a["comp"][i])
            if same:
                ok[: i + 1] = False
            at = np.flatnonzero(ok)
            for left, right in ((sums[0][i], sums[1]), (a["bins"][i].astype(np.int32), b["bins"])):
                size = a["n"][i] + b["n"][at]
                both = (size - np.abs(right[at] - left).sum(axis=1)) // 2
                at = at[den * both >= num * (size - both)]
                if not len(at):
                    break
            if len(at):
                yield a["key"][i], b["key"][at]

    def flush(held):
        c = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        one, two = (c, c) if c["lo"][0] == c["hi"][0] else ({k: v[c["side"] == s] for k, v in c.items()} for s in (0, 1))
        new = [(min(int(x), y), max(int(x), y)) for x, ys in pairs(one, two, one is two) for y in ys.tolist()]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in new], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def run(batches):
        held, at = [], None
        for batch in batches:
            if not len(batch):
                continue
            c = {k: batch[k].to_numpy(zero_copy_only=False) for k in ("joint", "bucket", "lo", "hi", "side", "key", "n", "single", "comp")}
            c["bins"] = np.frombuffer(b"".join(batch["bins"].to_pylist()), np.uint8).reshape(len(batch), BINS)
            own = [c[k] for k in ("joint", "bucket", "lo", "hi")]
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in own], axis=0)) + 1
            for i, j in zip([0, *change], [*change, len(batch)]):
                now = tuple(x[i] for x in own)
                if held and now != at:
                    yield flush(held)
                    held = []
                held.append({k: v[i:j] for k, v in c.items()})
                at = now
        if held:
            yield flush(held)

    return lean(run)


def _verify(num: int, den: int):
    def run(batches):
        for batch in batches:
            keep = []
            x, y = batch["x"], batch["y"]
            xo, yo, xv, yv = x.offsets.to_numpy(), y.offsets.to_numpy(), x.values.to_numpy(), y.values.to_numpy()
            for r in range(len(batch)):
                a, b = xv[xo[r] : xo[r + 1]], yv[yo[r] : yo[r + 1]]
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(den * both >= num * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return lean(run)


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", share: int = 4) -> DataFrame:
    """(id, n_shingles, component_id) for every row: components of the links Jaccard >= num / den.

    1. Equal sets form a class, known by a 128-bit fingerprint of the set; only classes go on. Their key is its
       first half, but where two sets share that, a hash of both halves.
    2. A class is out if more than d of its shingles occur in no other class, d being the most that a
       partner may lack. First this is tried on a fixed share of the hash range for all classes, then on
       all shingles of the classes left, whose counts also give the order of the prefixes.
    3. The classes left are indexed by their prefix signatures (see _signatures).
    4. Neighbours by size in each bucket are verified and joined first; a large bucket is dealt into parts for that,
       whose first members are neighbours in turn. What remains are pairs of different components that share a
       bucket; every one that sizes allow is verified. Links inside a component found before add nothing to the
       result, so none is lost that does. Buckets with the same least member that hold much the same sets are
       compared as one, where that takes fewer comparisons; any bucket of more than PART is cut into parts
       that meet in pairs, each in a group of its own.

    num / den must be over 0.1. Texts are read whole, however long. An empty table gives an empty result.

    Null text and text without words: n_shingles 0, linked with nothing. A null id keeps its row, may
    link others, and gets the smallest id of its component (null if there is none). Rows repeated, or
    sharing an id, each keep a row. Ties cannot arise. Columns of docs other than the two are not read.
    """
    if not 0.1 < num / den <= 1:
        raise ValueError("num / den must be over 0.1 and at most 1")
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    form = "id long, n long, key long, key2 long, tokens array<long>"
    sets = written(src.mapInArrow(_sets(k, "id", "text", share, False), form), "sets")
    twins = written(sets.groupBy("key").agg(F.min("key2").alias("x"), F.max("key2").alias("y")).where("x <> y").select("key"), "twins")
    twins = None if twins.isEmpty() else twins
    sets = _told_apart(sets, twins)
    classes = sets.where("n > 0").groupBy("key").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("members"))
    most = F.expr(f"n - (n * {num} + {den - 1}) div {den}")

    owner = sets.where("n > 0").select("key", F.explode("tokens").alias("token")).groupBy("token").agg(F.min("key").alias("key"), F.max("key").alias("other"))
    alone = owner.where("key = other").groupBy("key").agg(F.count("*").alias("alone"))
    alive = written(classes.join(alone, "key", "left").where(F.coalesce("alone", F.lit(0)) <= most).select("key", "n"), "alive")
    n_alive = alive.count()

    # One text of each class left; its id and key pick it out, so a class of null ids is found as well.
    first = sets.where("n > 0").groupBy("key").agg(F.min("id").alias("id")).join(alive, "key")
    texts = keyed_join(src.where("id is not null"), first.select("id").where("id is not null").distinct(), "id", "left_semi", n_alive)
    again = _told_apart(texts.unionByName(src.where("id is null")).mapInArrow(_sets(k, "id", "text", 1, True), f"{form}, bins binary"), twins)
    full = written(keyed_join(again, alive.select("key"), "key", "left_semi", n_alive).dropDuplicates(["key"]).select("key", "n", "tokens", "bins"), "full")

    tokens = full.select("key", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = tokens.join(counts, "token").groupBy("key").agg(F.collect_list(F.struct("df", "token")).alias("tokens"))
    index = full.select("key", "n").join(shared, "key").mapInArrow(_signatures(num, den), "sig long, key long, n long, single long")
    signatures = written(index, "index")
    sizes = signatures.groupBy("sig").agg(F.count("*").alias("size")).where("size > 1")
    index = written(signatures.join(sizes, "sig"), "buckets")
    release(signatures)

    def verified(pairs: DataFrame) -> DataFrame:
        named = pairs.join(full.select(F.col("key").alias("a"), F.col("tokens").alias("x")), "a").join(full.select(F.col("key").alias("b"), F.col("tokens").alias("y")), "b")
        return written(named.select("a", "b", "x", "y").mapInArrow(_verify(num, den), "src long, dst long"), "links")

    fits = F.expr(f"{den} * least(na - sa, n - single) >= {num} * (na + n - least(na - sa, n - single))")

    def neighbours(rows: DataFrame, *parts: str) -> DataFrame:
        by_size = Window.partitionBy(*parts).orderBy("n", "key")
        beside = rows.withColumns({c: F.lag(f).over(by_size) for c, f in (("a", "key"), ("na", "n"), ("sa", "single"))}).where("a is not null")
        return beside.where(fits).select(F.least("a", "key").alias("a"), F.greatest("a", "key").alias("b"))

    dealt = index.withColumn("part", F.when(F.col("size") > BUCKET, F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / BUCKET))).otherwise(0))
    heads = dealt.where(F.col("size") > BUCKET).groupBy("sig", "part").agg(F.min(F.struct("n", "key", "single")).alias("m")).select("sig", "m.*")
    near = neighbours(dealt, "sig", "part").union(neighbours(heads, "sig")).distinct()
    links = verified(near)
    comp = written(connected_components(links), "comp")

    at = index.join(comp.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("component", "key")).drop("component")
    mixed = at.groupBy("sig").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("key").alias("head")).where("x <> y").select("sig", "head")
    at = written(at.join(mixed, "sig"), "mixed")
    release(index)
    # Buckets with the same least member: what they cost one by one, and as one.
    singly = at.select("head", "sig", "size").distinct().groupBy("head").agg(F.count("*").alias("buckets"), F.sum(F.col("size") * F.col("size")).alias("cost"))
    jointly = at.select("head", "key").distinct().groupBy("head").agg(F.count("*").alias("members"))
    jointly = singly.join(jointly, "head").where("buckets > 1 and members * members <= cost").select("head", "members")
    rows = keyed_join(at, written(jointly, "jointly"), "head", "left").select(F.col("members").isNotNull().alias("joint"), F.when(F.col("members").isNotNull(), F.col("head")).otherwise(F.col("sig")).alias("bucket"), F.coalesce("members", "size").alias("size"), "key", "n", "single", "comp").distinct()
    cuts = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("size") / PART, F.lit(1.0))))).cast("int")
    own = F.pmod(F.xxhash64("key"), cuts).cast("int")
    rows = rows.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), cuts - 1))).join(full.select("key", "bins"), "key")
    rows = rows.select("joint", "bucket", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), F.when(F.col("own") <= F.col("with"), 0).otherwise(1).alias("side"), "key", "n", "single", "comp", "bins")
    rows = rows.repartition("joint", "bucket", "lo", "hi").sortWithinPartitions("joint", "bucket", "lo", "hi")
    rest = verified(rows.mapInArrow(_bucket_pairs(num, den), "a long, b long").distinct())
    release(at, full)
    comp = connected_components(links.union(rest))

    named = classes.select("key", "rep").join(comp.withColumnRenamed("node", "key"), "key").groupBy("component").agg(F.min("rep").alias("least"))
    label = comp.join(named, "component").select(F.col("node").alias("key"), "least")
    every = sets.select("id", "n", "key").join(classes.select("key", "rep"), "key", "left").join(label, "key", "left")
    return every.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("least", "rep")).alias("component_id"))
