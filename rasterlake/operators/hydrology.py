"""Flow over a grid: directions, accumulation, drainage networks and their graph measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterlake.functions import stencil
from rasterlake.grid import KEYS
from rasterlake.plans import cut, successor_graph

# Code, row step, column step and neighbour of the stencil, in the order in which ties are settled.
D8 = ((1, 0, 1, 6), (2, 1, 1, 9), (4, 1, 0, 8), (8, 1, -1, 7), (16, 0, -1, 4), (32, -1, -1, 1), (64, -1, 0, 2), (128, -1, 1, 3))
DIAGONAL = 1.414


def slope_aspect(cells: DataFrame, cell: float = 1.0) -> DataFrame:
    """Gradient magnitude and its angle in radians, borders clamped."""
    dx = ((F.col("z3") + 2 * F.col("z6") + F.col("z9")) - (F.col("z1") + 2 * F.col("z4") + F.col("z7"))) / (8 * cell)
    dy = ((F.col("z7") + 2 * F.col("z8") + F.col("z9")) - (F.col("z1") + 2 * F.col("z2") + F.col("z3"))) / (8 * cell)
    v = F.col("z").isNotNull()
    return stencil(cells, "clamp").select(*KEYS, F.when(v, F.sqrt(dx * dx + dy * dy)).alias("slope"), F.when(v, F.atan2(F.lit(0.0) - dy, F.lit(0.0) - dx)).alias("aspect"))


def flow_direction(cells: DataFrame, pit_to_zero: bool = False) -> DataFrame:
    """Code of the steepest neighbour; pits flow to the least rise unless pit_to_zero; 0 without a neighbour, NULL without a value."""
    drops = F.array(*[F.struct(((F.col("z5") - F.col(f"z{z}")) / (1.0 if 0 in (dr, dc) else DIAGONAL)).alias("drop"), F.lit(-i).alias("turn"), F.lit(code).alias("code")) for i, (code, dr, dc, z) in enumerate(D8)])
    best = F.array_max(F.filter(drops, lambda x: x["drop"].isNotNull()))
    code = F.coalesce(F.when(F.lit(pit_to_zero) & (best["drop"] <= 0), F.lit(0)).otherwise(best["code"]), F.lit(0))
    return stencil(cells).select(*KEYS, F.when(F.col("z").isNotNull(), code).alias("flow_direction"))


def flow_edges(directions: DataFrame) -> DataFrame:
    """(raster_id, r, c, nr, nc) along the directions that lead to a cell with a value."""
    step = lambda i: sum((F.when(F.col("flow_direction") == d[0], d[i]).otherwise(0) for d in D8), F.lit(0))
    out = directions.where("flow_direction > 0").select(*KEYS, (F.col("r") + step(1)).alias("nr"), (F.col("c") + step(2)).alias("nc"))
    valid = directions.where("flow_direction is not null").select("raster_id", F.col("r").alias("nr"), F.col("c").alias("nc"))
    return out.join(valid, ["raster_id", "nr", "nc"], "left_semi").select(*KEYS, "nr", "nc")


#: Rows and columns of a raster are below 2**21, so that a number holds a raster's number, a row and a column.
SIDE = 21


def _graph(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """raster_id, r, c of every cell with what successor_graph tells of it; node and next are numbers there."""
    rasters = cut(cells.select("raster_id").distinct().withColumn("_no", F.row_number().over(Window.orderBy("raster_id")).cast("long")))
    number = lambda r, c: F.shiftleft("_no", 2 * SIDE) + F.shiftleft(F.col(r).cast("long"), SIDE) + F.col(c)
    nodes = cells.join(F.broadcast(rasters), "raster_id").select(number("r", "c").alias("node"))
    arcs = edges.join(F.broadcast(rasters), "raster_id").select(number("r", "c").alias("node"), number("nr", "nc").alias("next"))
    mask = (1 << SIDE) - 1
    got = successor_graph(nodes, arcs).withColumns({"_no": F.shiftright("node", 2 * SIDE), "r": F.shiftright("node", SIDE).bitwiseAND(mask).cast("int"), "c": F.col("node").bitwiseAND(mask).cast("int")})
    return got.join(F.broadcast(rasters), "_no").drop("_no")


def flow_accumulation(directions: DataFrame) -> DataFrame:
    """1 plus the cells upstream; a cell on a cycle gets what comes in from outside and passes nothing on."""
    got = _graph(directions.where("flow_direction is not null"), flow_edges(directions))
    return got.select(*KEYS, F.col("upstream").alias("flow_accumulation"), F.log1p(F.col("upstream").cast("double")).alias("flow_accumulation_log"))


def edge_detection(cells: DataFrame, method: str = "sobel") -> DataFrame:
    """Gradient magnitude by Sobel, Prewitt or Scharr weights, borders clamped; 0 where the cell or a neighbour has no value."""
    side, middle = {"sobel": (1, 2), "prewitt": (1, 1), "scharr": (3, 10)}[method]
    z = [None, *[F.col(f"z{i}") for i in range(1, 10)]]
    dx = side * (z[3] - z[1]) + middle * (z[6] - z[4]) + side * (z[9] - z[7])
    dy = side * (z[7] - z[1]) + middle * (z[8] - z[2]) + side * (z[9] - z[3])
    return stencil(cells, "clamp").select(*KEYS, F.when(F.col("z").isNotNull(), F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))).otherwise(0.0).alias("edge"))


def drainage_network(accumulation: DataFrame, threshold: float = 100.0) -> DataFrame:
    return accumulation.where(F.col("flow_accumulation") > threshold).select(*KEYS)


def thin(network: DataFrame, grid: DataFrame) -> DataFrame:
    """Thins a network to lines one cell wide by the alternating deletions of Zhang and Suen (1984), until none is left."""
    cells = cut(grid.select(*KEYS).join(network.select(*KEYS, F.lit(1).alias("on")), list(KEYS), "left").select(*KEYS, F.coalesce("on", F.lit(0)).alias("on")))
    while True:
        before = cells.agg(F.sum("on")).first()[0]
        for corner in (0, 1):
            near = stencil(cells, value="on")
            p = [F.coalesce(F.col(f"z{i}"), F.lit(0)) for i in (2, 3, 6, 9, 8, 7, 4, 1)]
            n = sum(p[1:], p[0])
            turns = sum((F.when((a == 0) & (b == 1), 1).otherwise(0) for a, b in zip(p, p[1:] + p[:1])), F.lit(0))
            a, b = ((p[0] * p[2] * p[4], p[2] * p[4] * p[6]), (p[0] * p[2] * p[6], p[0] * p[4] * p[6]))[corner]
            gone = (F.col("on") == 1) & n.between(2, 6) & (turns == 1) & (a == 0) & (b == 0)
            cells = cut(near.select(*KEYS, F.when(gone, 0).otherwise(F.col("on")).alias("on")))
        if cells.agg(F.sum("on")).first()[0] == before:
            return cells.where("on = 1").select(*KEYS)


def drainage_edges(network: DataFrame, directions: DataFrame) -> DataFrame:
    """The flow edges with both ends in the network."""
    edges = flow_edges(directions).join(network.select(*KEYS), list(KEYS), "left_semi")
    return edges.join(network.select("raster_id", F.col("r").alias("nr"), F.col("c").alias("nc")), ["raster_id", "nr", "nc"], "left_semi").select(*KEYS, "nr", "nc")


def graph_metrics(network: DataFrame, edges: DataFrame) -> DataFrame:
    """upstream_degree, downstream_degree, betweenness and density (edges over possible edges) of a network's cells.

    Walks are unique, so betweenness counts, for each cell, the pairs of an ancestor and a descendant; on a
    cycle, a walk from a cell j steps before meets length - 1 - j further cells until it is back.
    """
    g = cut(_graph(network, edges))
    # How far each node of a cycle is from its least node, by pointer doubling along the cycle cut open there.
    away = F.col("next") != F.col("cycle")
    ring = cut(g.where("on_cycle").select("cycle", "length", "node", F.col("upstream").alias("own"), F.when((F.col("node") != F.col("cycle")) & away, F.col("next")).alias("ahead"), F.when(F.col("node") == F.col("cycle"), 0).otherwise(1).cast("long").alias("far")))
    while not ring.where("ahead is not null").isEmpty():
        hop = ring.select(F.col("node").alias("ahead"), F.col("ahead").alias("after"), F.col("far").alias("more"))
        ring = cut(ring.join(hop, "ahead", "left").select("cycle", "length", "node", "own", F.col("after").alias("ahead"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far")))
    ring = ring.withColumn("at", F.pmod(F.col("length") - F.col("far"), F.col("length")))
    # What enters at u passes the node at its place less u's, mod the length, steps on: sums over the cycle and up to the node say it all.
    every, so_far = Window.partitionBy("cycle"), Window.partitionBy("cycle").orderBy("at")
    whole, later = F.sum("own").over(every), F.sum("own").over(every) - F.sum("own").over(so_far)
    steps = F.col("at") * whole - F.sum(F.col("own") * F.col("at")).over(every) + F.col("length") * later
    through = ring.select("node", ((F.col("length") - 1) * whole - steps - (F.col("length") - 1)).alias("pairs"), whole.alias("whole"))
    size = network.groupBy("raster_id").agg(F.count("*").alias("n"))
    size = size.join(edges.groupBy("raster_id").agg(F.count("*").alias("m")), "raster_id", "left")
    rows = g.join(through, "node", "left").join(size, "raster_id")
    up = F.when(F.col("on_cycle"), F.col("whole") - 1).otherwise(F.col("upstream") - 1)
    down = F.when(F.col("on_cycle"), F.col("length") - 1).otherwise(F.col("steps") + F.coalesce(F.col("length") - 1, F.lit(0)))
    down = F.when(~F.col("on_cycle") & F.col("length").isNotNull(), F.col("steps") + F.col("length") - 1).otherwise(down)
    pairs = F.when(F.col("on_cycle"), F.col("pairs")).otherwise(up * down)
    n = F.col("n")
    between = F.when(n > 2, pairs / ((n - 1) * (n - 2))).otherwise(0.0)
    density = F.when(n > 1, F.coalesce("m", F.lit(0)) / (n * (n - 1))).otherwise(0.0)
    return rows.select(*KEYS, up.cast("long").alias("upstream_degree"), down.cast("long").alias("downstream_degree"), between.cast("double").alias("betweenness"), density.cast("double").alias("density"))
