"""Elevation grids (ASCII, and FLOAT with a header) and colour tables, read by Spark."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadmosaic.functions.colors import tile_size, unpack
from quadmosaic.functions.geometry import tile_grid
from quadmosaic.lineage import settled
from quadmosaic.operators.terrain import georeference
from quadmosaic.sources.images import encode_tiles

# The header lines of a grid, in order.
HEADER = ("ncols", "nrows", "xllcorner", "yllcorner", "cellsize", "NODATA_value")
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"


@dataclass(frozen=True)
class GridHeader:
    ncols: int
    nrows: int
    xll: float
    yll: float
    cell: float
    nodata: float
    big_endian: bool = False


def _header(lines: list[str], extra: tuple[str, ...] = ()) -> GridHeader:
    values = []
    for name, line in zip(HEADER + extra, lines):
        if not line.startswith(f"{name} "):
            raise ValueError(f"a grid's header needs the line {name}")
        value = line.split()[1] if len(line.split()) > 1 else ""
        if name != "byteorder" and not re.fullmatch(_NUMBER, value):
            raise ValueError(f"{name}: {value!r} is no number")
        values.append(value)
    if len(values) < len(HEADER + extra):
        raise ValueError("a grid's header is short")
    return GridHeader(int(float(values[0])), int(float(values[1])), *map(float, values[2:6]), big_endian=extra != () and values[6] == "MSBFIRST")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines ``line_no, value`` of a text file, read in splits: a line's number is its place in its split plus the lines of the splits before."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    splits = settled(lines.groupBy("start").agg(F.count("*").alias("n"), F.min("at").alias("first_at")))
    before = F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    firsts = splits.select("start", "first_at", before.alias("before"))  # a row for each split of the file
    return lines.join(firsts, "start").select((F.col("before") + F.col("at") - F.col("first_at")).alias("line_no"), F.regexp_replace("value", "\r", "").alias("value"))


def read_ascii(spark: SparkSession, path: str) -> tuple[GridHeader, DataFrame]:
    """The header and the cells ``row_no, col_no, z`` of an ASCII grid. The last value of a line counts with or without a blank after it; a line of another number of values is an error."""
    n = len(HEADER)
    lines = numbered_lines(spark, path)
    head = _header([r.value for r in lines.where(F.col("line_no") < n).orderBy("line_no").collect()])
    rows = lines.where((F.col("line_no") >= n) & (F.col("line_no") < n + head.nrows)).select((F.col("line_no") - n).cast("int").alias("row_no"), "value")
    cells = rows.select("row_no", F.array_remove(F.split("value", "[ \t]+"), "").alias("values"))
    wrong = F.col("row_no").between(0, head.nrows - 1) & (F.size("values") != head.ncols)  # the optimizer may look at lines before it drops them
    checked = cells.select("row_no", F.when(wrong, F.raise_error(F.concat(F.lit("wrong number of columns in row "), F.col("row_no").cast("string")))).otherwise(F.col("values")).alias("values"))
    return head, checked.select("row_no", F.posexplode("values").alias("col_no", "z")).select("row_no", "col_no", F.col("z").cast("float").alias("z"))


def read_float(spark: SparkSession, path: str) -> tuple[GridHeader, DataFrame]:
    """A FLOAT grid: ``path`` without its ``.hdr`` and ``.flt``. Rows of the grid are records of equal length, read in splits and exploded by Spark; other lengths are an error."""
    lines = [r.value.replace("\r", "") for r in numbered_lines(spark, f"{path}.hdr").where(F.col("line_no") < len(HEADER) + 1).orderBy("line_no").collect()]
    head = _header(lines, ("byteorder",))
    kind = ">f4" if head.big_endian else "<f4"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"row_no": pdf["row_no"].astype("int32"), "values": [np.frombuffer(x, kind).astype("f4") for x in pdf["record"]]})

    records = spark.sparkContext.binaryRecords(f"{path}.flt", 4 * head.ncols).zipWithIndex().map(lambda x: (x[1], bytearray(x[0])))
    numbered = spark.createDataFrame(records, "row_no long, record binary").where(F.col("row_no") < head.nrows)
    rows = numbered.mapInPandas(run, "row_no int, values array<float>")
    return head, rows.select("row_no", F.posexplode("values").alias("col_no", "z"))


def grid_tiles(cells: DataFrame, head: GridHeader, source_name: str, srid: int = -1, shaded: bool = False, size: int | None = None, kind: str = "PNG") -> DataFrame:
    """The image of a grid as tiles, ready for :func:`quadmosaic.sources.catalog.append_tiles`; with kind GEOTIFF every tile is a GeoTIFF of its own.

    ``cells`` are ``row_no, col_no, rgb``. A shaded grid has lost its edge cells: its rows and columns are counted from 1, and the rest is stretched over the grid.
    """
    cut = 2 * shaded
    width, height = head.ncols - cut, head.nrows - cut
    left, top, cell = georeference(head.ncols, head.nrows, head.xll, head.yll, head.cell, shaded)
    sections, tw, th = tile_grid(width, height, tile_size(size))
    x, y = F.col("col_no") - int(shaded), F.col("row_no") - int(shaded)
    r, g, b = unpack(F.col("rgb"))
    pixels = cells.select(x.alias("px"), y.alias("py"), r.alias("r"), g.alias("g"), b.alias("b")).select(
        F.expr(f"bigint(py div {th}) * {sections} + px div {tw}").alias("tile"), F.expr(f"int(py % {th})").alias("ty"), F.expr(f"int(px % {tw})").alias("x"), "r", "g", "b"
    )
    layout = cells.sparkSession.range(sections * sections).select(F.col("id").alias("tile"), (F.col("id") % sections * tw).alias("at_x"), F.expr(f"id div {sections} * {th}").alias("at_y"))
    layout = layout.withColumns({"width": F.least(F.lit(tw), width - F.col("at_x")).cast("int"), "height": F.least(F.lit(th), height - F.col("at_y")).cast("int")}).where("width > 0 and height > 0")
    edge = lambda c, step, first: F.lit(float(first)) + c * F.lit(float(step))
    placed = layout.select(
        "tile", "width", "height", F.lit(float(cell)).alias("px"), F.lit(float(cell)).alias("py"), edge(F.col("at_x"), cell, left).alias("left"), edge(F.col("at_y"), -cell, top).alias("top"),
        edge(F.col("at_x") + F.col("width"), cell, left).alias("right"), edge(F.col("at_y") + F.col("height"), -cell, top).alias("bottom"), F.lit(srid).alias("srid"),
    )
    blobs = encode_tiles(pixels, placed, kind, fit=True)
    return placed.join(blobs, placed["tile"] == blobs["id"]).select(
        F.lit(source_name).alias("source_name"), F.col("tile").cast("int").alias("tile_id"), "width", "height", "px", "py", F.col("left").alias("min_x"), F.col("bottom").alias("min_y"), F.col("right").alias("max_x"), F.col("top").alias("max_y"), "srid", "raster"
    )


def read_colors(spark: SparkSession, path: str) -> DataFrame:
    """``mn, mx, r, g, b`` from lines ``min max 0xRRGGBB``, in order. A bad or blank line is an error for the whole file; a missing last newline is not."""
    fields = F.split(F.regexp_replace("value", "\r", ""), "[ \t]+")
    rows = spark.read.text(path).select(fields.alias("f"))
    bad = (F.size("f") != 3) | ~F.get("f", 0).rlike(_NUMBER) | ~F.get("f", 1).rlike(_NUMBER) | ~F.get("f", 2).rlike("^.[xX][0-9A-Fa-f]{6}$")
    checked = rows.select(F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("a bad line in the colour table"))).otherwise(F.col("f")).alias("f"))
    part = lambda at: F.conv(F.substring(F.col("f")[2], at, 2), 16, 10).cast("int")
    return checked.select(F.col("f")[0].cast("double").alias("mn"), F.col("f")[1].cast("double").alias("mx"), part(3).alias("r"), part(5).alias("g"), part(7).alias("b")).orderBy("mn", "mx")
