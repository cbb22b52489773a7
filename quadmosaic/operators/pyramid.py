"""Pyramid levels: four tiles of one level make one of the next, within a source or across sources.

Tiles are placed by their edges, counted in whole pixels of the source's base level. On each axis, tiles whose edges meet make a run; a gap or an
overlap starts a new run. Squares of two by two places are taken inside runs, so only tiles that meet are joined and every tile is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadmosaic.functions.colors import BACKGROUND_DEFAULT, TRANSPARENT_NONE, pack, unpack
from quadmosaic.functions.geometry import half_up, tile_grid
from quadmosaic.lineage import settled
from quadmosaic.operators.canvas import paint_blobs
from quadmosaic.operators.levels import TOPMOST
from quadmosaic.operators.pixels import thumbnail

#: The places of a square that may have tiles, as bits 1 upper left, 2 upper right, 4 lower left, 8 lower right: those that make a rectangle.
PATTERNS = (15, 5, 10, 3, 12, 1, 2, 4, 8)
PLACED = ("source_name", "run_x", "run_y", "row", "col", "n_levels", "width", "height", "px", "py", "min_x", "min_y", "max_x", "max_y", "ux", "ux2", "uy", "uy2")


class PyramidError(ValueError):
    """Tiles that don't make squares."""


def _axis(edges: DataFrame, low: str, high: str, run: str, rank: str) -> DataFrame:
    """The distinct places of tiles on one axis with their run, their rank in it and the levels that the run needs. These are rows and columns of tiles, not tiles."""
    cells = edges.groupBy("source_name", low).agg(F.max(high).alias("high"))
    order = W.partitionBy("source_name").orderBy(low)
    starts = F.coalesce(F.lag("high").over(order) != F.col(low), F.lit(True))
    runs = cells.withColumn(run, F.sum(starts.cast("int")).over(order) - 1)
    inside = W.partitionBy("source_name", run)
    return runs.select(
        "source_name", low, run, (F.row_number().over(inside.orderBy(low)) - 1).cast("long").alias(rank), F.ceil(F.log2(F.count("*").over(inside).cast("double"))).cast("int").alias(f"levels_{rank}")
    )


def grid_index(meta: DataFrame) -> DataFrame:
    """``meta`` with the place of each tile: ``run_x, run_y`` (the run it is in), ``col, row`` in the run, and ``n_levels``, how often its source can be halved."""
    corner = meta.groupBy("source_name").agg(F.min("min_x").alias("left"), F.max("max_y").alias("top"), F.min("px").alias("upx"), F.min("py").alias("upy"))
    unit = lambda v, size: half_up(v / F.col(size))
    units = settled(
        meta.join(corner, "source_name").withColumns(
            {
                "ux": unit(F.col("min_x") - F.col("left"), "upx"),
                "ux2": unit(F.col("max_x") - F.col("left"), "upx"),
                "uy": unit(F.col("top") - F.col("max_y"), "upy"),
                "uy2": unit(F.col("top") - F.col("min_y"), "upy"),
            }
        ).drop("left", "top", "upx", "upy")
    )
    cols, rows = settled(_axis(units, "ux", "ux2", "run_x", "col")), settled(_axis(units, "uy", "uy2", "run_y", "row"))
    most = cols.groupBy("source_name").agg(F.max("levels_col").alias("n")).unionAll(rows.groupBy("source_name").agg(F.max("levels_row").alias("n"))).groupBy("source_name").agg(F.max("n").alias("n_levels"))
    # tiles meet the columns' and rows' places by source and edge, so no source is one key
    return units.join(cols.join(most, "source_name").drop("levels_col"), ["source_name", "ux"]).join(rows.drop("levels_row"), ["source_name", "uy"])


SQUARE = ("source_name", "run_x", "run_y", "row", "col")


def squares_of(indexed: DataFrame) -> DataFrame:
    """``indexed`` with the tile's ``place`` in its square, 0 to 3, and ``row`` and ``col`` of the square."""
    place = (F.col("row") % 2 * 2 + F.col("col") % 2).cast("int")
    return indexed.withColumn("place", place).withColumns({"row": F.expr("row div 2"), "col": F.expr("col div 2")})


def assemble(indexed: DataFrame) -> DataFrame:
    """One row for each square of four places: its pattern, whether its tiles fit together, the mosaic's and the thumbnail's size, and its footprint."""
    at = lambda k, c: F.expr(f"max(case when place = {k} then {c} end)")
    sides = {"w": "width", "h": "height", "l": "ux", "r": "ux2", "t": "uy", "b": "uy2"}
    low, high = ("ux", "uy", "min_x", "min_y"), ("n_levels", "px", "py", "ux2", "uy2", "max_x", "max_y")
    squares = squares_of(indexed).groupBy(*SQUARE).agg(
        F.expr("int(bit_or(shiftleft(1, place)))").alias("pattern"),
        F.count("*").alias("n_tiles"),
        *[at(k, c).alias(f"{s}{k}") for k in range(4) for s, c in sides.items()],
        *[f(c).alias(c) for f, names in ((F.min, low), (F.max, high)) for c in names],
    )
    pairs = lambda *names: " and ".join(f"coalesce({a} = {b}, true)" for a, b in map(str.split, names))
    shape = F.col("pattern").isin(*PATTERNS) & F.expr("n_tiles = bit_count(pattern)")
    sizes, meet = pairs("w0 w2", "w1 w3", "h0 h1", "h2 h3"), pairs("r0 l1", "r2 l3", "b0 t2", "b1 t3", "t0 t1", "l0 l2")
    sized = squares.withColumns({"fits": shape & F.expr(sizes) & F.expr(meet), "left_w": F.expr("coalesce(w0, w2, 0)"), "top_h": F.expr("coalesce(h0, h1, 0)")})
    sized = sized.withColumns({"mosaic_w": F.expr("left_w + coalesce(w1, w3, 0)"), "mosaic_h": F.expr("top_h + coalesce(h2, h3, 0)")})
    half = lambda c: F.expr(f"greatest(int({c} div 2), 1)")
    return sized.withColumns({"width": half("mosaic_w"), "height": half("mosaic_h")}).drop(*[f"{s}{k}" for k in range(4) for s in sides])


def checked(squares: DataFrame) -> DataFrame:
    """``squares``, settled; a :class:`PyramidError` names a source whose tiles don't make squares. No source is left out silently."""
    squares = settled(squares)
    bad = squares.where("not fits").select("source_name", "pattern", "min_x", "max_y").first()
    if bad:
        raise PyramidError(f"source {bad.source_name}: tiles that don't make a square at {bad.min_x}, {bad.max_y} (pattern {bad.pattern})")
    return squares


def next_level(indexed: DataFrame) -> DataFrame:
    """The next level's metadata, indexed; pixel sizes double."""
    return checked(assemble(indexed)).withColumns({"px": F.col("px") * 2, "py": F.col("py") * 2}).select(*PLACED)


def numbered(tiles: DataFrame, by: tuple[str, ...] = ("source_name",)) -> DataFrame:
    """``tiles`` with ``col`` and ``row`` counted over the whole source and ``tile_id`` from these, row by row, for each of ``by``. Only the distinct places of each axis are ranked."""

    def places(run: str, at: str) -> DataFrame:
        ranked = tiles.select(*by, run, at).distinct().withColumn(f"own_{at}", (F.row_number().over(W.partitionBy(*by).orderBy(run, at)) - 1).cast("long"))
        return ranked.withColumn(f"n_{at}", F.count("*").over(W.partitionBy(*by)))

    placed = tiles.join(places("run_x", "col"), [*by, "run_x", "col"]).join(places("run_y", "row").drop("n_row"), [*by, "run_y", "row"])
    placed = placed.withColumns({"row": F.col("own_row"), "col": F.col("own_col"), "tile_id": F.col("own_row") * F.col("n_col") + F.col("own_col")})
    return placed.drop("own_row", "own_col", "n_col", "run_x", "run_y", "n_levels", "ux", "ux2", "uy", "uy2")


def pyramid(meta: DataFrame, levels: int | None = None) -> DataFrame:
    """``level, source_name, tile_id, row, col, width, height, px, py`` and footprint for the base (level 0) and the levels over it.

    Of each source, levels go on until none of its tiles meets another (one tile, for a source without gaps), or up to ``levels``. ``row`` and ``col``
    count the rows and columns that have tiles; ``tile_id`` counts their places row by row.
    """
    current = settled(grid_index(meta).select(*PLACED))
    top = current.agg(F.max("n_levels")).first()[0] or 0
    out = current.withColumn("level", F.lit(0))
    for k in range(1, (top if levels is None else min(top, levels)) + 1):
        current = next_level(current.where(F.col("n_levels") >= k))
        out = out.unionByName(current.withColumn("level", F.lit(k)))
    return numbered(out, ("level", "source_name"))


def next_images(pixels: DataFrame, indexed: DataFrame) -> DataFrame:
    """The next level's pixels ``source_name, run_x, run_y, row, col, ty, x, r, g, b`` from those of a level (``tile`` is the ``id`` in ``indexed``).

    Each pixel goes to its place in the square's mosaic, which is then halved; only metadata is joined to the pixels.
    """
    sizes = checked(assemble(indexed)).select(*SQUARE, "left_w", "top_h", "mosaic_w", "mosaic_h", F.col("width").alias("nw"), F.col("height").alias("nh"))
    placed = squares_of(indexed).select("id", "place", *SQUARE).join(sizes, [*SQUARE])
    right, low = F.col("place") % 2 == 1, F.col("place") >= 2
    rows = pixels.join(placed.withColumnRenamed("id", "tile"), "tile").select(
        *SQUARE, "mosaic_w", "mosaic_h", "nw", "nh", (F.col("ty") + F.when(low, F.col("top_h")).otherwise(0)).alias("ty"), (F.col("x") + F.when(right, F.col("left_w")).otherwise(0)).alias("x"), "r", "g", "b"
    )
    halved = thumbnail(rows, F.col("mosaic_w"), F.col("mosaic_h"), F.col("nw"), F.col("nh"), (*SQUARE, "mosaic_w", "mosaic_h", "nw", "nh"))
    return halved.withColumnsRenamed({"out_y": "ty", "out_x": "x"}).drop("mosaic_w", "mosaic_h", "nw", "nh")


def signed(indexed: DataFrame) -> DataFrame:
    """The ``sign`` of each square: a digest of the signs of its tiles and of their places, so squares of one sign are made from the same originals in the same way."""
    told = F.array_sort(F.collect_list(F.concat_ws(":", "place", "sign")))  # four at most
    return squares_of(indexed).groupBy(*SQUARE).agg(F.sha2(F.concat_ws(",", told), 256).alias("sign"))


def next_blobs(indexed: DataFrame, rasters: DataFrame, kind: str = "PNG", squares: DataFrame | None = None) -> DataFrame:
    """The next level, indexed, with ``raster`` and ``error``: of each square the blobs (``id, raster``) are decoded, joined, halved and encoded in one task.

    ``squares`` are those to be made, with their ``sign`` where they have one; all of them by default.
    """
    squares = checked(assemble(indexed)) if squares is None else squares
    placed = squares_of(indexed).select("id", "place", *SQUARE, F.col("width").alias("new_w"), F.col("height").alias("new_h")).join(squares.select(*SQUARE, "left_w", "top_h", "mosaic_w", "mosaic_h", "width", "height"), [*SQUARE])
    right, low = F.col("place") % 2 == 1, F.col("place") >= 2
    rows = placed.join(rasters.select("id", "raster"), "id").select(
        *SQUARE, F.col("mosaic_w").cast("int").alias("canvas_w"), F.col("mosaic_h").cast("int").alias("canvas_h"), F.col("width").alias("out_w"), F.col("height").alias("out_h"), F.col("id").alias("order"),
        F.when(right, F.col("left_w")).otherwise(0).cast("long").alias("at_x"), F.when(low, F.col("top_h")).otherwise(0).cast("long").alias("at_y"),
        F.col("new_w").cast("long").alias("new_w"), F.col("new_h").cast("long").alias("new_h"), F.lit(False).alias("boxed"), "raster",
    )
    blobs = paint_blobs(rows, SQUARE, kind).select(*SQUARE, "raster", "error")
    own = [*PLACED, "sign"] if "sign" in squares.columns else PLACED
    return squares.withColumns({"px": F.col("px") * 2, "py": F.col("py") * 2}).select(*own).join(blobs, [*SQUARE])


def topmost_grid(box: tuple[float, float, float, float], px: float, py: float, size: int = 512) -> dict:
    """The cells of a top-most level over an extent, as numbers: the canvas, sections of an axis and a cell's size. Cells are cut from the top at twice ``size``."""
    min_x, min_y, max_x, max_y = box
    width, height = int((max_x - min_x) / px), int((max_y - min_y) / py)
    width, height = width + (width * px < max_x - min_x), height + (height * py < max_y - min_y)
    sections, tw, th = tile_grid(width, height, 2 * size)
    return {"left": min_x, "bottom": min_y, "right": max_x, "top": max_y, "px": px, "py": py, "width": width, "height": height, "sections": sections, "tw": tw, "th": th}


def topmost_layout(spark: SparkSession, box: tuple[float, float, float, float], px: float, py: float, size: int = 512) -> DataFrame:
    """The cells of a top-most level: ``row, col, width, height`` on the canvas, thumbnail size (the rounded-up half), and footprint. Empty ones are left out."""
    g = topmost_grid(box, px, py, size)
    cells = spark.range(g["sections"] ** 2).select(F.expr(f"int(id div {g['sections']})").alias("row"), (F.col("id") % g["sections"]).cast("int").alias("col"))
    cells = cells.withColumns(
        {"width": F.least(F.lit(g["tw"]), g["width"] - F.col("col").cast("long") * g["tw"]).cast("int"), "height": F.least(F.lit(g["th"]), g["height"] - F.col("row").cast("long") * g["th"]).cast("int")}
    ).where("width > 0 and height > 0")
    left, top = g["left"] + F.col("col").cast("long") * g["tw"] * F.lit(float(px)), g["top"] - F.col("row").cast("long") * g["th"] * F.lit(float(py))
    half = lambda c: F.expr(f"int(({c} + 1) div 2)")
    return cells.select(
        "row", "col", "width", "height", half("width").alias("thumb_w"), half("height").alias("thumb_h"),
        left.alias("cell_min_x"), F.greatest(top - F.col("height") * F.lit(float(py)), F.lit(float(g["bottom"]))).alias("cell_min_y"),
        F.least(left + F.col("width") * F.lit(float(px)), F.lit(float(g["right"]))).alias("cell_max_x"), top.alias("cell_max_y"),
    )


def _meeting(tiles: DataFrame, cells: DataFrame) -> DataFrame:
    """Each tile beside every cell that it strictly overlaps. Cells are equal but for the last row and column, so a tile finds its own by arithmetic and no tile meets every cell."""
    s = cells.agg(F.max("width").alias("w"), F.max("height").alias("h"), F.max("row").alias("r"), F.max("col").alias("c"), F.min("cell_min_x").alias("x"), F.max("cell_max_y").alias("y")).first()
    along = lambda v, step, last: F.least(F.greatest(F.floor(v / step), F.lit(0)), F.lit(last)).cast("int")
    if s.w is None:
        s = (1, 1, 0, 0, 0.0, 0.0)
    w, h, last_row, last_col, left, top = s
    across = F.sequence(along(F.col("min_x") - left, w * F.col("px"), last_col), along(F.col("max_x") - left, w * F.col("px"), last_col))
    down = F.sequence(along(top - F.col("max_y"), h * F.col("py"), last_row), along(top - F.col("min_y"), h * F.col("py"), last_row))
    names = [c for c in ("id", "width", "height", "px", "py", "min_x", "min_y", "max_x", "max_y") if c in tiles.columns]
    found = tiles.select(*names).withColumnsRenamed({"width": "tile_w", "height": "tile_h"}).withColumn("col", F.explode(across)).withColumn("row", F.explode(down))
    inside: Column = (F.col("min_x") < F.col("cell_max_x")) & (F.col("max_x") > F.col("cell_min_x")) & (F.col("min_y") < F.col("cell_max_y")) & (F.col("max_y") > F.col("cell_min_y"))
    return found.join(cells, ["row", "col"]).where(inside)


def _at(box_left: str, box_top: str) -> tuple[Column, Column]:
    return half_up((F.col("min_x") - F.col(box_left)) / F.col("px")), half_up((F.col(box_top) - F.col("max_y")) / F.col("py"))


def topmost(tiles: DataFrame, box: tuple[float, float, float, float], px: float, py: float, size: int = 512) -> DataFrame:
    """The cells of :func:`topmost_layout` with ``n_tiles``, the tiles of the level that strictly overlap each; cells without any are left out."""
    cells = topmost_layout(tiles.sparkSession, box, px, py, size)
    level = tiles.where((F.col("px") == px) & (F.col("py") == py))
    return _meeting(level, cells).groupBy(*cells.columns).agg(F.count("*").alias("n_tiles"))


def topmost_blobs(meta: DataFrame, rasters: DataFrame, box: tuple[float, float, float, float], px: float, py: float, size: int = 512, kind: str = "PNG", transparent: int = TRANSPARENT_NONE, background: int = BACKGROUND_DEFAULT) -> DataFrame:
    """The next top-most level as tiles with ``raster`` and ``error``: all sources' tiles of a level painted at their own size into cells, which are then halved. A cell whose tiles can't be decoded has its error."""
    cells = topmost_layout(meta.sparkSession, box, px, py, size)
    level = meta.where((F.col("px") == px) & (F.col("py") == py))
    dx, dy = _at("cell_min_x", "cell_max_y")
    rows = _meeting(level, cells).join(rasters.select("id", "raster"), "id").select(
        "row", "col", F.col("width").alias("canvas_w"), F.col("height").alias("canvas_h"), F.col("thumb_w").alias("out_w"), F.col("thumb_h").alias("out_h"), F.col("id").alias("order"),
        dx.alias("at_x"), dy.alias("at_y"), F.col("tile_w").cast("long").alias("new_w"), F.col("tile_h").cast("long").alias("new_h"), F.lit(False).alias("boxed"), "raster",
    )
    blobs = paint_blobs(rows, ("row", "col"), kind, transparent, background).where("raster is not null or error is not null").select("row", "col", "raster", "error")
    sections = topmost_grid(box, px, py, size)["sections"]
    return cells.join(blobs, ["row", "col"]).select(
        F.lit(TOPMOST).alias("source_name"), (F.col("row").cast("long") * sections + F.col("col")).cast("int").alias("tile_id"), F.col("thumb_w").alias("width"), F.col("thumb_h").alias("height"), F.lit(2.0 * px).alias("px"), F.lit(2.0 * py).alias("py"),
        F.col("cell_min_x").alias("min_x"), F.col("cell_min_y").alias("min_y"), F.col("cell_max_x").alias("max_x"), F.col("cell_max_y").alias("max_y"), "raster", "error",
    )


def topmost_images(pixels: DataFrame, tiles: DataFrame, cells: DataFrame, transparent: int = -1, background: int = 0) -> DataFrame:
    """The pixels ``row, col, ty, x, r, g, b`` of top-most thumbnails: tiles of one level painted at their own size into each of ``cells``, then halved.

    ``cells`` are those of :func:`topmost`; the highest tile ``id`` wins, and transparent pixels don't paint.
    """
    dx, dy = _at("cell_min_x", "cell_max_y")
    at = _meeting(tiles, cells).select(F.col("id").alias("tile"), "row", "col", F.col("width").alias("cw"), F.col("height").alias("ch"), "thumb_w", "thumb_h", dx.alias("dx"), dy.alias("dy"))
    keys = ("row", "col", "cw", "ch", "thumb_w", "thumb_h")
    rgb = pack(F.col("r"), F.col("g"), F.col("b"))
    drawn = pixels.join(at, "tile").select(*keys, "tile", (F.col("ty") + F.col("dy")).alias("ty"), (F.col("x") + F.col("dx")).alias("x"), rgb.alias("rgb"))
    drawn = drawn.where((F.col("ty") >= 0) & (F.col("x") >= 0) & (F.col("ty") < F.col("ch")) & (F.col("x") < F.col("cw")) & (F.col("rgb") != transparent))
    painted = drawn.groupBy(*keys, "ty", "x").agg(F.max_by("rgb", "tile").alias("rgb"))
    canvas = cells.select("row", "col", F.col("width").alias("cw"), F.col("height").alias("ch"), "thumb_w", "thumb_h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height").cast("long") - 1)).alias("ty"))
    canvas = canvas.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cw").cast("long") - 1)))
    r, g, b = unpack(F.coalesce(F.col("rgb"), F.lit(background)))
    whole = canvas.join(painted, [*keys, "ty", "x"], "left").select(*keys, "ty", "x", r.alias("r"), g.alias("g"), b.alias("b"))
    halved = thumbnail(whole, F.col("cw"), F.col("ch"), F.col("thumb_w"), F.col("thumb_h"), keys)
    return halved.select("row", "col", F.col("out_y").alias("ty"), F.col("out_x").alias("x"), "r", "g", "b")
