"""Raster tables made from the driver's test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXEL_W, PIXEL_H = 64, 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile metadata: 40 columns of tiles in four sources of 10, one level of 0.25."""
    k = F.col("p_partkey")
    col, row = k % 40, F.expr("p_partkey div 40")
    x, y = -180 + col * 64, 90 - row * 64
    return table(spark, sf_dir, "part").select(
        (k + 1).alias("id"),
        F.concat(F.lit("src"), F.floor(col / 10).cast("string")).alias("source_name"),
        col.cast("int").alias("tcol"),
        row.cast("int").alias("trow"),
        F.lit(256).alias("width"),
        F.lit(256).alias("height"),
        F.lit(0.25).alias("px"),
        F.lit(0.25).alias("py"),
        x.cast("double").alias("min_x"),
        (y - 64).cast("double").alias("min_y"),
        (x + 64).cast("double").alias("max_x"),
        y.cast("double").alias("max_y"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image 64 pixels wide, in tiles of 50 rows; ``y`` counts over the image, ``ty`` in the tile."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("x", "v"))
    return e.select(
        F.col("vec_id").alias("y"),
        "x",
        F.expr("int(vec_id div 50)").alias("tile"),
        F.expr("int(vec_id % 50)").alias("ty"),
        F.expr("int(abs(double(v)) * 1000) % 256").alias("r"),
        F.expr("int((vec_id * 7 + x * 13) % 256)").alias("g"),
        F.expr("int((label * 25) % 256)").alias("b"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of :func:`pixels` by ``tile`` and ``ty``, with ``n``, their pixels. The last tile may have fewer lines than the others."""
    return table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 50").alias("tile"), F.expr("int(vec_id % 50)").alias("ty"), F.size("embedding").alias("n"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevations, 100 columns; -9999 is no data."""
    return table(spark, sf_dir, "orders").select(
        F.expr("int(o_orderkey div 100)").alias("row_no"),
        F.expr("int(o_orderkey % 100)").alias("col_no"),
        F.expr("case when o_orderkey % 97 = 0 then float(-9999.0) else float(o_totalprice / 10000.0) end").alias("z"),
    )


def color_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touching value ranges over 0 to 50."""
    return table(spark, sf_dir, "nation").select(
        F.expr("double(2 * n_nationkey)").alias("mn"),
        F.expr("double(2 * n_nationkey + 2)").alias("mx"),
        F.expr("(n_nationkey * 10) % 256").alias("r"),
        F.expr("255 - n_nationkey * 10").alias("g"),
        F.expr("(n_nationkey * 37) % 256").alias("b"),
    )


# The same tables in DuckDB's SQL.
TILES_SQL = """tiles as (
  select p_partkey + 1 id, 'src' || ((p_partkey % 40) // 10)::varchar source_name, (p_partkey % 40)::int tcol, (p_partkey // 40)::int trow,
    256 width, 256 height, 0.25::double px, 0.25::double py,
    (-180 + (p_partkey % 40) * 64)::double min_x, (90 - (p_partkey // 40) * 64 - 64)::double min_y,
    (-180 + (p_partkey % 40) * 64 + 64)::double max_x, (90 - (p_partkey // 40) * 64)::double max_y
  from part
)"""
PIXELS_SQL = """pixels as (
  select vec_id y, x::int x, (vec_id // 50)::int tile, (vec_id % 50)::int ty,
    trunc(abs(v::double) * 1000)::int % 256 r, ((vec_id * 7 + x * 13) % 256)::int g, ((label * 25) % 256)::int b
  from (select vec_id, label, unnest(embedding) v, generate_subscripts(embedding, 1) - 1 x from embeddings)
)"""
GRID_SQL = """grid as (
  select (o_orderkey // 100)::int row_no, (o_orderkey % 100)::int col_no,
    case when o_orderkey % 97 = 0 then -9999.0::float else (o_totalprice / 10000.0)::float end z
  from orders
)"""
COLORS_SQL = """colors as (
  select (2 * n_nationkey)::double mn, (2 * n_nationkey + 2)::double mx, (n_nationkey * 10) % 256 r, 255 - n_nationkey * 10 g, (n_nationkey * 37) % 256 b
  from nation
)"""
