"""Many windows in one job: a spatial join of a table of requests with tiles.

Each request takes the level nearest to its pixel size and is dealt to the squares of that level that it lies on, as stored tiles are; the two meet by square. A square that very many
requests ask for is split by request, its tiles going to each part. Windows are then painted block by block, each block in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadmosaic.functions.colors import BACKGROUND_DEFAULT, TRANSPARENT_NONE
from quadmosaic.functions.geometry import BLOCK_PX, level_name, placement_on, storage_keys, window_bounds
from quadmosaic.lineage import settled
from quadmosaic.operators.canvas import paint_blobs
from quadmosaic.operators.levels import nearest_levels
from quadmosaic.operators.window import BLOCK

#: ``request_id``, centre, pixel size and size of each window; ids are distinct.
REQUEST = "request_id long, cx double, cy double, px double, py double, width int, height int"
#: Requests of one square from which it is split, so many to a part.
HOT = 1000
#: Folders (levels and bands) up to which a scan is told which to read.
FOLDERS = 10_000

SQUARE = ("level", "band", "block")


def checked_requests(requests: DataFrame) -> DataFrame:
    """``requests`` as ``request_id, cx, cy, req_px, req_py, win_w, win_h`` and bounds; one that can't be a window is an error at run time."""
    size = F.col("width").between(64, 32768) & F.col("height").between(64, 32768) & (F.col("px") > 0) & (F.col("py") > 0) & F.col("cx").isNotNull() & F.col("cy").isNotNull()
    wrong = F.raise_error(F.concat(F.lit("not a window: request "), F.coalesce(F.col("request_id").cast("string"), F.lit("without an id"))))
    rows = requests.withColumn("px", F.when(F.coalesce(size, F.lit(False)), F.col("px").cast("double")).otherwise(wrong))
    bounds = window_bounds(F.col("cx"), F.col("cy"), F.col("req_px"), F.col("req_py"), F.col("win_w"), F.col("win_h"))
    rows = rows.select("request_id", F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"), F.col("px").alias("req_px"), F.col("py").cast("double").alias("req_py"), F.col("width").alias("win_w"), F.col("height").alias("win_h"))
    return rows.withColumns(bounds)


def _squares(requests: DataFrame) -> DataFrame:
    """``requests`` with their level, once for each square that may have tiles which meet them: those they lie on, and one more to the left and above."""

    def along(low: Column, high: Column, size: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / (size * BLOCK_PX)) - 1, F.floor(high / (size * BLOCK_PX))))

    rows = requests.withColumn("level", level_name(F.col("px"), F.col("py")))
    rows = rows.withColumn("band", along(-F.col("win_max_y"), -F.col("win_min_y"), F.col("py"))).withColumn("block", along(F.col("win_min_x"), F.col("win_max_x"), F.col("px")))
    return rows.withColumns({c: F.col(c).cast("int") for c in ("band", "block")})


def _cut(tiles: DataFrame, folders: list | None) -> DataFrame:
    """The folders of a stored table that are asked for; one that isn't stored so is read whole."""
    if folders is None or not {"level", "band"} <= set(tiles.columns):
        return tiles
    bands: dict[str, list[int]] = {}
    for r in folders:
        bands.setdefault(r.level, []).append(r.band)
    inside = F.lit(False)
    for level, own in sorted(bands.items()):
        inside = inside | ((F.col("level") == level) & F.col("band").isin(sorted(own)))
    return tiles.where(inside)


def _folders(rows: DataFrame) -> list | None:
    found = rows.select("level", "band").distinct().limit(FOLDERS + 1).collect()
    return found if len(found) <= FOLDERS else None


def windows_tiles(meta: DataFrame, levels: DataFrame, requests: DataFrame, strategy: str = "auto", hot: int = HOT) -> DataFrame:
    """The tiles that each window meets: ``request_id``, the tile's ``id`` and square, its place on the window's canvas, and the canvas's size ``win_w, win_h``.

    ``levels`` has ``px, py, tile_count``; ``strategy`` is auto, strict or inclusive, as for one window. Each pair stands once; a window without tiles has no rows. An
    empty table of requests gives none.
    """
    found = nearest_levels(checked_requests(requests), levels, "req_px").drop("tile_count")
    if strategy != "auto":
        found = found.withColumn("strict", F.lit(strategy == "strict"))
    asked = settled(_squares(found))
    crowded = settled(asked.groupBy(*SQUARE).count().where(F.col("count") > hot).select(*SQUARE, F.ceil(F.col("count") / hot).cast("int").alias("parts")))  # one in ``hot`` rows of ``asked`` at most
    parts = F.coalesce(F.col("parts"), F.lit(1))
    dealt = asked.join(F.broadcast(crowded), [*SQUARE], "left").withColumn("part", F.pmod(F.xxhash64("request_id"), parts).cast("int")).drop("parts")
    names = ["id", "width", "height", "px", "py", "min_x", "min_y", "max_x", "max_y"]
    tiles = _cut(meta, _folders(asked))
    tiles = (tiles if set(SQUARE) <= set(tiles.columns) else tiles.withColumns(storage_keys())).select(*names, *SQUARE)
    copies = tiles.join(F.broadcast(crowded), [*SQUARE], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    rows = copies.join(dealt.drop("px", "py"), [*SQUARE, "part"])
    x1, y1, x2, y2 = (F.col(f"win_{c}") for c in ("min_x", "min_y", "max_x", "max_y"))
    tx1, ty1, tx2, ty2 = (F.col(c) for c in ("min_x", "min_y", "max_x", "max_y"))
    touch = (tx1 <= x2) & (tx2 >= x1) & (ty1 <= y2) & (ty2 >= y1)
    meet = (tx1 < x2) & (tx2 > x1) & (ty1 < y2) & (ty2 > y1)
    place = placement_on(x1, y1, F.col("req_px"), F.col("req_py"), F.col("win_h").cast("double"))
    return rows.where(F.when(F.col("strict"), meet).otherwise(touch)).select("request_id", "id", "level", "band", *[c.alias(n) for n, c in place.items()], "win_w", "win_h")


def windows_blocks(hits: DataFrame, requests: DataFrame, kind: str = "PNG", transparent: int = TRANSPARENT_NONE, background: int = BACKGROUND_DEFAULT, block: int = BLOCK) -> DataFrame:
    """Every window of ``requests`` as blobs of blocks: ``request_id, brow, bcol, width, height, n_painted, raster, error``, from its tiles (:func:`windows_tiles`) with their ``raster``.

    Windows of up to ``block`` pixels a side are one block. One without tiles is background.
    """
    rest = lambda b, size: F.least(F.lit(block), F.col(size) - F.col(b) * block).cast("int")
    canvas = {"canvas_w": rest("bcol", "win_w"), "canvas_h": rest("brow", "win_h"), "out_w": rest("bcol", "win_w"), "out_h": rest("brow", "win_h")}
    side = lambda at, new, size: F.explode(F.sequence(F.greatest(F.floor(F.col(at) / block), F.lit(0)), F.least(F.floor((F.col(at) + F.col(new) - 1) / block), F.floor((F.col(size) - 1) / block))))
    on = hits.where("at_x < win_w and at_y < win_h and at_x + new_w > 0 and at_y + new_h > 0")
    tiles = on.withColumn("brow", side("at_y", "new_h", "win_h")).withColumn("bcol", side("at_x", "new_w", "win_w"))
    names = ["request_id", "brow", "bcol", "order", "at_x", "at_y", "new_w", "new_h", "boxed", "raster", "win_w", "win_h"]
    tiles = tiles.withColumns({"order": F.col("id"), "at_x": F.col("at_x") - F.col("bcol") * block, "at_y": F.col("at_y") - F.col("brow") * block}).select(*names)
    every = checked_requests(requests).withColumn("brow", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("win_h") - 1) / block)))).withColumn("bcol", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("win_w") - 1) / block))))
    bare = every.select(*[F.col(n) if n in every.columns else F.lit(None).cast(tiles.schema[n].dataType).alias(n) for n in names])
    return paint_blobs(tiles.unionByName(bare).withColumns(canvas), ("request_id", "brow", "bcol"), kind, transparent, background, fold=True).drop("color_space")


def read_windows(meta: DataFrame, rasters: DataFrame, levels: DataFrame, requests: DataFrame, kind: str = "PNG", transparent: int = TRANSPARENT_NONE, background: int = BACKGROUND_DEFAULT, strategy: str = "auto", block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """:func:`windows_blocks` of stored tables: only the folders of the squares that some window meets are read."""
    hits = settled(windows_tiles(meta, levels, requests, strategy, hot))
    blobs = _cut(rasters, _folders(hits)).select("id", "raster")
    return windows_blocks(hits.join(blobs, "id"), requests, kind, transparent, background, block)
