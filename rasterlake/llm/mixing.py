"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import keyed_join, prepare, written

#: Documents of one source that one flight phase balances; what it leaves goes to the next level.
BLOCK = 4000
#: Documents of a source that are settled together at the end.
LAND = 14


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, total: float = 1.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, take the weights in turn and share total times the sum of all sizes.
    A target stops at most times its source's size; the excess is reshared by weight until none is above.
    That ends with min(cap, level * weight) for one level, which is where the sources, in the order of
    cap / weight, stop reaching their caps.
    """
    every = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(every) - 1) % len(weights)
    rows = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    rows = rows.withColumns({"full": F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "rest": F.sum("w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)), "all": F.sum("source_size").over(Window.partitionBy()) * F.lit(float(total))})
    rows = rows.withColumn("level", (F.col("all") - F.col("full")) / F.col("rest"))
    reach = F.struct((F.col("cap") / F.col("w")).alias("at"), F.col("level").alias("level"))
    level = F.min(F.when(F.col("level") <= reach["at"], reach)).over(Window.partitionBy())["level"]
    return rows.withColumn("level", level).select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w"))).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, keep: int = 2) -> np.ndarray:
    """Moves inclusion probabilities to 0 or 1 along directions that keep the sums of p and of p * size.

    Two constraints leave a direction among any three units; where two sizes are equal, two units do. Each step
    settles one unit at least, so that at most two are left between 0 and 1, or keep if that is more.
    """
    p = p.astype(float).copy()
    open_ = [i for i in range(len(p)) if 1e-12 < p[i] < 1 - 1e-12]
    draw = iter(rng.random(3 * len(open_) + 8).tolist())
    hand: list[int] = []
    queue, ahead = iter(open_), len(open_)
    while len(hand) + ahead > keep:
        while len(hand) < 3 and (i := next(queue, None)) is not None:
            hand.append(i)
            ahead -= 1
        same = next(((a, b) for x, a in enumerate(hand) for b in hand[x + 1 :] if size[a] == size[b]), None)
        if same:
            unit, move = list(same), [1.0, -1.0]
        elif len(hand) == 3:
            a, b, c = (float(size[i]) for i in hand)
            unit, move = hand[:], [b - c, c - a, a - b]
        else:
            break
        up = min((1 - p[i]) / m if m > 0 else -p[i] / m for i, m in zip(unit, move) if m)
        down = min(p[i] / m if m > 0 else (p[i] - 1) / m for i, m in zip(unit, move) if m)
        step = up if next(draw) * (up + down) < down else -down
        for i, m in zip(unit, move):
            p[i] += step * m
            if p[i] < 1e-9 or p[i] > 1 - 1e-9:
                p[i] = round(p[i])
                if i in hand:
                    hand.remove(i)
    return p


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settles the LAND units left at most: of all choices, the one whose size is nearest to the expected, then whose count is."""
    left = np.flatnonzero((p > 0) & (p < 1))
    choice = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    off = np.abs(choice @ size[left] - float(np.dot(p[left], size[left])))
    out = p.copy()
    out[left] = choice[np.lexsort((np.abs(choice.sum(axis=1) - p[left].sum()), off))[0]]
    return out


def _settle(seed: int, level: int, last: bool):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        # the largest last: together they make up nearly every difference that is left to settle
        rows = rows.sort_values(["size", "u", "id"], kind="stable").reset_index(drop=True)
        rng = np.random.Generator(np.random.PCG64([seed, level, int(key[0]), int(key[1])]))
        p = flight(rows["p"].to_numpy(), rows["size"].to_numpy(), rng, LAND if last else 2)
        rows["p"] = landing(p, rows["size"].to_numpy()) if last else p
        return rows.drop(columns="block")

    return run


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: int = 7, total: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for every row of docs.

    size counts the words of the text, runs of characters other than 0x20 and 0x09 to 0x0D. A document is
    taken whole, as often as its source's target goes into the source's size, and once more with the
    probability that is left over, drawn by the cube method: first in blocks of a source, then over what the
    blocks leave, until a source is one block, whose last LAND documents are settled together.
    Draws depend on seed, ids and sizes only, so reruns agree.

    Null and empty texts have size 0 and are never taken. A null source is a source. Null ids and repeated
    rows are documents of their own; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    base = written(docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), words.alias("size")), "mix-sizes")
    targets = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most, total)
    targets = written(targets.withColumn("no", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))), "mix-targets")
    n_sources = targets.count()
    named = targets.select(F.col("source").alias("_s"), "source_size", "target", "no")
    rows = base.join(F.broadcast(named) if n_sources <= 100_000 else named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + F.lit(1e-12))
    u = F.xxhash64(F.lit(seed), "id", "size")
    form = "id long, source string, size long, source_size long, target double, no int, whole long, p double, u long"
    rows = rows.select("id", F.col("source").cast("string").alias("source"), "size", "source_size", "target", F.col("no").cast("int").alias("no"), whole.cast("long").alias("whole"), F.when(F.col("size") > 0, F.greatest(ratio - whole, F.lit(0.0))).otherwise(0.0).alias("p"), u.alias("u"))
    rows = written(rows, "mix-units")
    is_open = (F.col("p") > 1e-12) & (F.col("p") < 1 - 1e-12)
    done, left, level = rows.where(~is_open), rows.where(is_open), 0
    while True:
        counts = left.groupBy("no").agg(F.count("*").alias("n"))
        blocks = written(counts.select("no", F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("cuts")), "mix-blocks")
        last = (blocks.agg(F.max("cuts")).first()[0] or 1) == 1
        dealt = keyed_join(left, blocks, "no", "inner").withColumn("block", F.pmod(F.xxhash64("u", F.lit(level)), F.col("cuts"))).drop("cuts")
        out = written(dealt.groupBy("no", "block").applyInPandas(_settle(seed, level, last), form), "mix-level")
        if last:
            done = done.unionByName(out)
            break
        done, left, level = done.unionByName(out.where(~is_open)), out.where(is_open), level + 1
    copies = F.when(F.col("size") > 0, F.col("whole") + F.round("p").cast("long")).otherwise(0)
    return done.select("id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
