"""Window queries: the level nearest to a requested pixel size, the tiles that the window meets, and their painted pixels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadmosaic.functions import codecs
from quadmosaic.functions.colors import BACKGROUND_DEFAULT, TRANSPARENT_NONE, ColorSpace
from quadmosaic.functions.geometry import Window, placement, stored_near
from quadmosaic.operators.canvas import paint_blobs
from quadmosaic.operators.levels import STRICT_OVER, color_space_fold, nearest_level, overlaps
from quadmosaic.operators.pixels import composite
from quadmosaic.sources.images import blob_spaces

#: Side of the blocks that a window is painted in.
BLOCK = 1024


@dataclass(frozen=True)
class Access:
    """A level, and whether its tiles are searched with strict bounds."""

    px: float
    py: float
    strict: bool


def best_access(levels: DataFrame, px: float, strategy: str = "auto") -> Access:
    """The level of ``levels`` (a few rows) nearest to ``px``. ``strategy`` is auto, strict or inclusive."""
    best = nearest_level(levels, F.lit(float(px))).first()
    if best is None:
        raise ValueError("the data source has no level")
    return Access(best.px, best.py, best.tile_count > STRICT_OVER if strategy == "auto" else strategy == "strict")


def window_tiles(meta: DataFrame, access: Access, window: Window) -> DataFrame:
    """The metadata of the tiles that a window meets, with their place on its canvas; tiles paint in the order of ``id``."""
    hits = meta.where((F.col("px") == access.px) & (F.col("py") == access.py) & overlaps(window.bounds, access.strict))
    return hits.withColumns(placement(window))


def read_window(meta: DataFrame, rasters: DataFrame, access: Access, window: Window) -> DataFrame:
    """:func:`window_tiles` with each tile's blob from ``rasters`` (``id, raster``).

    Stored tables have their level and square as columns: these cut both scans to the folders and row groups near the window before tiles and blobs are joined.
    """
    near = stored_near(access.px, access.py, window.bounds)
    cut = lambda df: df.where(near) if {"level", "band", "block"} <= set(df.columns) else df
    return window_tiles(cut(meta), access, window).join(cut(rasters).select("id", "raster"), "id")


def paint(pixels: DataFrame, hits: DataFrame, window: Window, transparent: int = TRANSPARENT_NONE, background: int = BACKGROUND_DEFAULT) -> DataFrame:
    """The window's pixels ``cy, cx, rgb`` from decoded ones (``tile`` is the ``id`` of ``hits``, as :func:`window_tiles` gives them)."""
    placed = hits.withColumns({"tile": F.col("id"), "order": F.col("id")})
    columns = ("tile", "order", "width", "height", "new_w", "new_h", "at_x", "at_y", "boxed")
    return composite(pixels, placed.select(*columns), window.width, window.height, transparent, background)


def window_blocks(hits: DataFrame, window: Window, kind: str = "PNG", transparent: int = TRANSPARENT_NONE, background: int = BACKGROUND_DEFAULT, block: int = BLOCK) -> DataFrame:
    """The window as blobs of blocks: ``brow, bcol, width, height, n_painted, raster, error``, from ``hits`` with their blobs. Blocks are painted side by side; each has all its pixels."""
    last_row, last_col = (window.height - 1) // block, (window.width - 1) // block
    side = lambda at, size, last: F.sequence(F.greatest(F.floor(F.col(at) / block), F.lit(0)), F.least(F.floor((F.col(at) + F.col(size) - 1) / block), F.lit(last)))
    on = hits.where(f"at_x < {window.width} and at_y < {window.height} and at_x + new_w > 0 and at_y + new_h > 0")
    tiles = on.withColumn("brow", F.explode(side("at_y", "new_h", last_row))).withColumn("bcol", F.explode(side("at_x", "new_w", last_col)))
    tiles = tiles.select("brow", "bcol", F.col("id").alias("order"), (F.col("at_x") - F.col("bcol") * block).alias("at_x"), (F.col("at_y") - F.col("brow") * block).alias("at_y"), "new_w", "new_h", "boxed", "raster")
    every = hits.sparkSession.range((last_row + 1) * (last_col + 1)).select(F.expr(f"id div {last_col + 1}").alias("brow"), (F.col("id") % (last_col + 1)).alias("bcol"))
    bare = every.select("brow", "bcol", *[F.lit(None).cast(t).alias(c) for c, t in (("order", "long"), ("at_x", "long"), ("at_y", "long"), ("new_w", "long"), ("new_h", "long"), ("boxed", "boolean"), ("raster", "binary"))])
    rest = lambda b, size: F.least(F.lit(block), size - F.col(b) * block).cast("int")
    placed = tiles.unionByName(bare).withColumns({"canvas_w": rest("bcol", window.width), "canvas_h": rest("brow", window.height)})
    placed = placed.withColumns({"out_w": F.col("canvas_w"), "out_h": F.col("canvas_h")})
    return paint_blobs(placed, ("brow", "bcol"), kind, transparent, background, fold=True).drop("color_space")


def window_space(hits: DataFrame) -> DataFrame:
    """One row ``color_space``: how the window of ``hits`` (with blobs) may be stored. Resized tiles count as RGB, boxes not at all."""
    plain = hits.where("not boxed")
    spaces = blob_spaces(plain.select("id", "raster")).where("color_space is not null")
    resized = (F.col("new_w") != F.col("width")) | (F.col("new_h") != F.col("height"))
    rows = plain.select("id", resized.alias("resized")).join(spaces, "id").select("id", F.lit(0).alias("window"), F.when(F.col("resized"), int(ColorSpace.RGB)).otherwise(F.col("color_space")).alias("color_space"))
    return color_space_fold(rows, "window").select("color_space")


def window_image(hits: DataFrame, window: Window, kind: str = "PNG", transparent: int = TRANSPARENT_NONE, background: int = BACKGROUND_DEFAULT, srid: int = -1, block: int = BLOCK) -> DataFrame:
    """One row ``width, height, color_space, raster``: the window as one blob of ``kind`` PNG, TIFF, GEOTIFF or a raw format.

    It is stored gray, by palette or as RGB by the tiles' colour spaces. Blocks are painted by many tasks; one puts them together, so it
    holds one window, which is bounded by the window's size. For a very large window take :func:`window_blocks`.
    """
    spaces = [r.color_space for r in window_space(hits).collect()]  # one row, or none without tiles
    space = spaces[0] if spaces else int(ColorSpace.MONOCHROME)
    x1, _, _, y2 = window.bounds
    geo, w, h = (x1, y2, window.px, window.py, srid), window.width, window.height

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        image = np.zeros((h, w, 3), np.uint8)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                image[r.brow * block : r.brow * block + r.height, r.bcol * block : r.bcol * block + r.width] = codecs.from_raw(r.raster, "RGB", r.width, r.height)
        palette = space == ColorSpace.PALETTE and codecs.fitting_space(image, "PNG") == ColorSpace.RGB
        as_space = int(ColorSpace.RGB) if palette else space
        yield pd.DataFrame({"width": [w], "height": [h], "color_space": [as_space], "raster": [codecs.encode(image, kind, as_space, geo, transparent)]})

    blocks = window_blocks(hits, window, "RGB", transparent, background, block)
    return blocks.select("brow", "bcol", "width", "height", "raster").repartition(1).mapInPandas(run, "width int, height int, color_space int, raster binary")
