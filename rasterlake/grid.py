"""The grid: a dense DataFrame of cells (raster_id, r, c, z) whose z is NULL where a cell has no value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

KEYS = ("raster_id", "r", "c")


@dataclass(frozen=True)
class Transform:
    """x = x0 + dx * c + rot_x * r and y = y0 + rot_y * c + dy * r."""

    x0: float = 0.0
    y0: float = 0.0
    dx: float = 1.0
    dy: float = -1.0
    rot_x: float = 0.0
    rot_y: float = 0.0

    @property
    def cell_size(self) -> float:
        return abs(self.dx) or 1.0

    @classmethod
    def from_bounds(cls, left: float, bottom: float, right: float, top: float, width: int, height: int) -> Transform:
        """The grid of width x height cells that fills the bounds."""
        return cls(left, top, (right - left) / width, -(top - bottom) / height)


TRANSFORM = ("x0", "y0", "dx", "dy", "rot_x", "rot_y")


def grid(df: DataFrame, z: str = "z", nodata: float | None = None, raster_id: str | None = None) -> DataFrame:
    """Cells of df as a grid; NaN and nodata become NULL. df must already hold every cell."""
    v = F.col(z).cast("double")
    missing = F.isnan(v) if nodata is None else F.isnan(v) | (v == nodata)
    name = F.lit(raster_id) if raster_id is not None else F.col("raster_id")
    return df.select(name.alias("raster_id"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.when(~missing, v).alias("z"))


def densify(df: DataFrame) -> DataFrame:
    """Adds the cells that df lacks, with a NULL z, between the least and greatest row and column of each raster."""
    box = df.groupBy("raster_id").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    rows = box.select("raster_id", F.explode(F.sequence("r0", "r1")).alias("r"), "c0", "c1")
    # rows go to many tasks before they become cells: one task would hold all the cells that come of one row of box
    rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "raster_id", "r")
    cells = rows.select("raster_id", "r", F.explode(F.sequence("c0", "c1")).alias("c"))
    return cells.hint("merge").join(df, list(KEYS), "left")  # they look as small as box to the planner, which else broadcasts them


def shape(cells: DataFrame) -> DataFrame:
    return cells.groupBy("raster_id").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"))


def with_shape(cells: DataFrame) -> DataFrame:
    """Height and width beside each cell; there is one row a raster, so the side that is joined is small or sorted."""
    return cells.join(shape(cells), "raster_id")


def coordinates(cells: DataFrame, t: Transform | DataFrame = Transform()) -> DataFrame:
    """id (row-major), x and y of every cell; t is one transform, or a table of them with a row a raster (see transforms)."""
    return _located(cells.select(*KEYS, "z"), t).select(*KEYS, "z", F.col("_id").alias("id"), F.col("_x").alias("x"), F.col("_y").alias("y"))


def _located(cells: DataFrame, t: Transform | DataFrame) -> DataFrame:
    """cells with _id, _x and _y; only what has one row a raster is joined."""
    own = cells.join(shape(cells).select("raster_id", F.col("width").alias("_width")), "raster_id")
    if isinstance(t, Transform):
        at = {f: F.lit(float(getattr(t, f))) for f in TRANSFORM}
    else:
        own, at = own.join(t.select("raster_id", *[F.col(f).alias(f"_{f}") for f in TRANSFORM]), "raster_id"), {f: F.col(f"_{f}") for f in TRANSFORM}
    x = at["x0"] + at["dx"] * F.col("c") + at["rot_x"] * F.col("r")
    y = at["y0"] + at["rot_y"] * F.col("c") + at["dy"] * F.col("r")
    return own.withColumns({"_id": F.col("r").cast("long") * F.col("_width") + F.col("c"), "_x": x, "_y": y})


def transforms(heads: DataFrame) -> DataFrame:
    """(raster_id, x0, y0, dx, dy, rot_x, rot_y) from headers that have x0, y0 and cellsize."""
    cell = F.col("cellsize").cast("double")
    return heads.select("raster_id", "x0", "y0", cell.alias("dx"), (-cell).alias("dy"), F.lit(0.0).alias("rot_x"), F.lit(0.0).alias("rot_y"))


def feature_table(cells: DataFrame, features: list[str], t: Transform | DataFrame = Transform(), nan_policy: str = "null", zeroed: tuple[str, ...] | None = None) -> DataFrame:
    """raster_id, id, x, y, elevation and the features of the valid cells.

    nan_policy zero turns NULLs into 0, in all features or in those of zeroed. An id is the cell's within its raster.
    """
    zero = set(features if zeroed is None else zeroed) if nan_policy == "zero" else set()
    v = [F.coalesce(F.col(f), F.lit(0.0)).alias(f) if f in zero else F.col(f) for f in features]
    located = _located(cells, t).where("z is not null")
    return located.select("raster_id", F.col("_id").alias("id"), F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("z").alias("elevation"), *v)


def gather(features: DataFrame, cells: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """features with a column of cells looked up by raster_id and id."""
    at = with_shape(cells).select("raster_id", (F.col("r").cast("long") * F.col("width") + F.col("c")).alias("id"), F.col(column).alias(out or column))
    return features.join(at, ["raster_id", "id"], "left")


def downsample(cells: DataFrame, k: int) -> DataFrame:
    """Every k-th row and column."""
    return cells.where((F.col("r") % k == 0) & (F.col("c") % k == 0)).withColumns({"r": F.expr(f"cast(r div {k} as int)"), "c": F.expr(f"cast(c div {k} as int)")})


def upsample_nearest(small: DataFrame, target: DataFrame) -> DataFrame:
    """z of small at every cell of target: the source index is round(i / (n - 1) * (m - 1)), halves to even."""
    sizes = shape(small).select("raster_id", F.col("height").alias("h"), F.col("width").alias("w"))
    src = lambda i, n, m: F.least(F.greatest(F.when(n > 1, F.rint(i / (n - 1) * (m - 1))).otherwise(0.0), F.lit(0.0)), m - 1.0).cast("int")
    at = with_shape(target.select(*KEYS)).join(sizes, "raster_id")
    at = at.select(*KEYS, src(F.col("r"), F.col("height"), F.col("h")).alias("sr"), src(F.col("c"), F.col("width"), F.col("w")).alias("sc"))
    source = small.select("raster_id", F.col("r").alias("sr"), F.col("c").alias("sc"), "z")
    return at.join(source, ["raster_id", "sr", "sc"], "left").select(*KEYS, "z")


def normalize(cells: DataFrame, clip: bool = True, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """norm = (z - lo) / (hi - lo) with the raster's own bounds by default; 0 where they are equal."""
    bounds = cells.groupBy("raster_id").agg(F.coalesce(F.lit(lo), F.min("z")).alias("lo"), F.coalesce(F.lit(hi), F.max("z")).alias("hi"))
    v: Column = F.when(F.col("hi") == F.col("lo"), F.when(F.col("z").isNotNull(), 0.0)).otherwise((F.col("z") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    v = F.when(F.col("z").isNotNull(), F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0))) if clip else v
    return cells.join(bounds, "raster_id").withColumn("norm", v).drop("lo", "hi")
