"""Levels, extents and sources of tile metadata (``id, source_name, width, height, px, py, min_x, min_y, max_x, max_y``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOPMOST = "TopMost"
#: Levels of more tiles are searched with strict bounds, others with inclusive ones.
STRICT_OVER = 500


def real_tiles(meta: DataFrame) -> DataFrame:
    """Without the placeholder rows that have no pixel size."""
    return meta.where((F.col("px") > 0) & (F.col("py") > 0))


def extent(meta: DataFrame, px: float | None = None, py: float | None = None) -> DataFrame:
    """One row ``min_x, min_y, max_x, max_y``: of everything or of one level; nulls without tiles."""
    rows = meta if px is None else meta.where((F.col("px") == px) & (F.col("py") == py))
    return rows.agg(*[f(c).alias(c) for c, f in (("min_x", F.min), ("min_y", F.min), ("max_x", F.max), ("max_y", F.max))])


def source_extents(meta: DataFrame) -> DataFrame:
    return meta.groupBy("source_name").agg(*[f(c).alias(c) for c, f in (("min_x", F.min), ("min_y", F.min), ("max_x", F.max), ("max_y", F.max))])


def base_and_top(meta: DataFrame) -> DataFrame:
    """One row: the finest sizes of all real tiles, and the coarsest outside the top-most levels; x and y apart."""
    real = (F.col("px") > 0) & (F.col("py") > 0)
    own = real & (F.col("source_name") != TOPMOST)
    return meta.agg(
        F.min(F.when(real, F.col("px"))).alias("base_px"), F.min(F.when(real, F.col("py"))).alias("base_py"), F.max(F.when(own, F.col("px"))).alias("top_px"), F.max(F.when(own, F.col("py"))).alias("top_py")
    )


def levels(meta: DataFrame) -> DataFrame:
    """Rows ``level, px, py, tile_count``; level 0 is the coarsest. A few rows, whatever the number of tiles."""
    counted = real_tiles(meta).groupBy("px", "py").agg(F.count("*").cast("int").alias("tile_count"))
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("px"), F.desc("py"))
    return counted.select((F.row_number().over(order) - 1).alias("level"), "px", "py", "tile_count")


def sources(meta: DataFrame) -> DataFrame:
    return real_tiles(meta).groupBy("source_name").agg(F.count("*").alias("tile_count")).orderBy("source_name")


def above(px: float | Column, py: float | Column) -> Column:
    return (F.col("px") > px) & (F.col("py") > py)


def purge(tiles: DataFrame, meta: DataFrame, px: float, py: float) -> DataFrame:
    """The rows of ``tiles`` (by ``id``) without those whose metadata lies above a level: what stays before a pyramid is built anew."""
    return tiles.join(meta.where(above(px, py)).select("id"), "id", "left_anti")


def nearest_level(level_rows: DataFrame, px: Column) -> DataFrame:
    """``level_rows`` ordered by how near their x size is to ``px``; the coarser one first on ties."""
    return level_rows.withColumn("distance", F.abs(px - F.col("px"))).orderBy("distance", F.desc("px"))


def nearest_levels(requests: DataFrame, level_rows: DataFrame, px: str = "req") -> DataFrame:
    """``requests`` with ``px, py, tile_count, strict`` of the level nearest to each; the coarser one on ties. The levels, a few rows by definition, go along as one array."""
    found = F.array_min(F.transform("__levels", lambda v: F.struct(F.abs(F.col(px) - v["px"]).alias("distance"), (-v["px"]).alias("coarse"), v.alias("v"))))["v"]
    levels = level_rows.agg(F.collect_list(F.struct("px", "py", "tile_count")).alias("__levels")).withColumn("__one", F.lit(1))
    rows = requests.withColumn("__one", F.lit(1)).join(F.broadcast(levels), "__one").withColumn("__found", found)
    return rows.select(*requests.columns, "__found.px", "__found.py", "__found.tile_count", (F.col("__found.tile_count") > STRICT_OVER).alias("strict"))


def overlaps(box: tuple[float, float, float, float], strict: bool) -> Column:
    """Whether a tile overlaps ``min_x, min_y, max_x, max_y``: plain comparisons, so that the scan prunes by statistics."""
    x1, y1, x2, y2 = box
    if strict:
        return (F.col("min_x") < x2) & (F.col("max_x") > x1) & (F.col("min_y") < y2) & (F.col("max_y") > y1)
    return (F.col("min_x") <= x2) & (F.col("max_x") >= x1) & (F.col("min_y") <= y2) & (F.col("max_y") >= y1)


def color_space_fold(hits: DataFrame, by: str, order: str = "id", space: str = "color_space") -> DataFrame:
    """The colour space of tiles painted in ``order``, for each ``by``: monochrome ones before the first other don't count, one
    kind alone stays, anything mixed is RGB (4)."""
    mono = F.col(space) == 1
    a = hits.groupBy(by).agg(
        F.min(F.when(~mono, F.col(order))).alias("first"), F.max(F.when(mono, F.col(order))).alias("mono"), F.min(F.when(~mono, F.col(space))).alias("low"), F.max(F.when(~mono, F.col(space))).alias("high")
    )
    mixed = (F.col("low") != F.col("high")) | F.coalesce(F.col("mono") > F.col("first"), F.lit(False))
    return a.select(by, F.when(F.col("first").isNull(), 1).when(mixed, 4).otherwise(F.col("low")).cast("int").alias(space))
