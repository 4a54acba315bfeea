"""The row player, in batch and as a stream, and grids that fill from a stream."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window, functions as F

from rasterlake.plans import cut

TICK_MS = 16


def _in_ranges(rows: DataFrame, *order: str) -> DataFrame:
    """rows in ranges of the order, each with the number of its range (part) and its place there (own), from 0 on."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    return dealt.withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1)


def player_frames(rows: DataFrame, columns: list[str], order: str = "id", interval_ms: int = 500) -> DataFrame:
    """(order, k, columns): every tick between a row and the next, numbers interpolated, other values held.

    A ramp ends before the next row is reached, so the last row is never shown; a lone row repeats. Rows are dealt
    out by ranges of their order; the last one of a range finds its next among the firsts of the ranges.
    """
    interval = max(1, interval_ms)
    ticks = ceil(interval / TICK_MS)
    kinds = dict(rows.dtypes)
    numbers = [c for c in columns if kinds[c] in ("int", "bigint", "double", "float", "smallint", "tinyint")]
    placed = _in_ranges(rows.select(order, *columns), order)
    by = Window.partitionBy("part").orderBy("own")
    goes_on = F.struct(F.col(order).alias("_next"), *[F.col(c).alias(f"_{c}") for c in numbers])
    firsts = placed.where("own = 0").select("part", goes_on.alias("first"))
    firsts = firsts.select((F.lag("part").over(Window.orderBy("part"))).alias("part"), F.lit(True).alias("ends"), "first").where("part is not null")
    pairs = placed.select("part", order, *columns, F.lead(goes_on).over(by).alias("near")).join(F.broadcast(firsts), "part", "left")
    pairs = pairs.withColumn("to", F.coalesce("near", "first"))
    lone = rows.limit(2).count() == 1
    pairs = pairs.select(order, *columns, *[F.col("to")[f"_{c}"].alias(f"_{c}") for c in numbers], F.col("to").isNotNull().alias("_on"))
    frames = (pairs if lone else pairs.where("_on")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(ticks - 1))))
    f = F.col("k") * TICK_MS / interval
    value = lambda c: (F.col(c) + (F.coalesce(f"_{c}", c) - F.col(c)) * f) if c in numbers else F.col(c)
    return frames.select(order, "k", *[value(c).alias(c) for c in columns])


def player_stream(spark, frames: DataFrame, rows_per_second: int = 1000 // TICK_MS) -> DataFrame:
    """Plays frames (order, k, ...) over and over, a tick each, from a rate source joined to their numbers."""
    order = frames.columns[0]
    placed = _in_ranges(frames, order, "k")
    sizes = placed.groupBy("part").agg(F.count("*").alias("rows"))
    sizes = sizes.withColumn("base", F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).select("part", "base")
    numbered = cut(placed.join(F.broadcast(sizes), "part").withColumn("tick", F.col("base") + F.col("own")).drop("part", "own", "base"))
    n = numbered.count()
    clock = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return clock.withColumn("tick", F.col("value") % max(n, 1)).join(numbered, "tick")


def windowed_cells(events: DataFrame, ts: str, row: str, column: str, value: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, r, c, n, z) of an event stream: mean value of each cell and time window, with a watermark for late events."""
    seen = events.withWatermark(ts, late)
    return seen.groupBy(F.window(ts, window).alias("window"), F.col(row).alias("r"), F.col(column).alias("c")).agg(F.count("*").alias("n"), F.avg(value).alias("z"))
