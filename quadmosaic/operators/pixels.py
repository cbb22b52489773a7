"""Operators over pixels as rows: ``tile, ty, x, r, g, b`` (row and column in the tile)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadmosaic.functions.colors import pack


def _targets(source: Column, old: Column, new: Column) -> Column:
    """The positions of the new axis that take a position of the old one: those j with (j * step) >> 16 = source, step = (old << 16) div new."""
    step = F.floor(old * 65536 / new)
    low = F.ceil(source * 65536 / step)
    high = F.least(F.ceil((source + 1) * 65536 / step) - 1, new.cast("long") - 1)
    return F.when(low <= high, F.sequence(low.cast("long"), high.cast("long"))).otherwise(F.array().cast("array<long>"))


def resample(pixels: DataFrame, width: Column, height: Column, new_w: Column, new_h: Column) -> DataFrame:
    """Nearest-neighbour resize by fixed-point steps. Each pixel goes to where it is taken, so nothing is joined or shuffled."""
    rows = pixels.withColumn("out_y", F.explode(_targets(F.col("ty"), height, new_h)))
    return rows.withColumn("out_x", F.explode(_targets(F.col("x"), width, new_w)))


def thumbnail(pixels: DataFrame, width: int | Column, height: int | Column, new_w: int | Column, new_h: int | Column, by: tuple[str, ...] = ("tile",)) -> DataFrame:
    """Area-weighted means, truncated. Overlaps are counted in whole parts of ``1 / new_w`` and ``1 / new_h`` pixels, so sums are exact. Sizes may be columns."""

    def spread(rows: DataFrame, source: str, old: int | Column, new: int | Column, out: str, weight: str) -> DataFrame:
        old, new = (c.cast("long") if isinstance(c, Column) else F.lit(c).cast("long") for c in (old, new))
        i = F.col(source).cast("long")
        rows = rows.withColumn(out, F.explode(F.sequence(F.floor(i * new / old), F.floor(((i + 1) * new - 1) / old))))
        o = F.col(out)
        return rows.withColumn(weight, F.least((i + 1) * new, (o + 1) * old) - F.greatest(i * new, o * old))

    rows = spread(spread(pixels, "ty", height, new_h, "out_y", "wy"), "x", width, new_w, "out_x", "wx")
    w = F.col("wx") * F.col("wy")
    sums = rows.groupBy(*by, "out_y", "out_x").agg(F.sum(w).alias("w"), *[F.sum(w * F.col(c)).alias(f"s{c}") for c in "rgb"])
    return sums.select(*by, "out_y", "out_x", *[F.least(F.expr(f"s{c} div w"), F.lit(255)).cast("int").alias(c) for c in "rgb"])


def box_mean(pixels: DataFrame, factor: int, by: tuple[str, ...] = ("tile",)) -> DataFrame:
    """Truncated means over squares of ``factor`` pixels; edge squares may be smaller."""
    cells = pixels.groupBy(*by, F.expr(f"ty div {factor}").cast("int").alias("out_y"), F.expr(f"x div {factor}").cast("int").alias("out_x"))
    return cells.agg(*[F.expr(f"int(sum({c}) div count(*))").alias(c) for c in "rgb"])


def histogram(pixels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts over 128 by 128 by 128 bins."""
    return pixels.groupBy(*by, *[F.shiftright(F.col(c), 1).alias(f"{c}_bin") for c in "rgb"]).agg(F.count("*").alias("n"))


def centroids(bins: DataFrame, box: Column) -> DataFrame:
    """The rounded mean colour of each box of histogram bins."""
    sums = bins.groupBy(box.alias("box")).agg(F.sum("n").alias("n"), *[F.sum((2 * F.col(f"{c}_bin") + 1) * F.col("n")).alias(f"s{c}") for c in "rgb"])
    return sums.select("box", "n", *[F.expr(f"int((s{c} + n div 2) div n)").alias(c) for c in "rgb"])


def classify(pixels: DataFrame, by: tuple[str, ...] = ("tile",)) -> DataFrame:
    """For each image whether it is monochrome (all 0 or white), grayscale, or of at most 256 colours."""
    rgb = pack(F.col("r"), F.col("g"), F.col("b"))
    colors = pixels.groupBy(*by, rgb.alias("rgb")).agg(F.first("r").alias("r"), F.first("g").alias("g"), F.first("b").alias("b"))
    return colors.groupBy(*by).agg(
        F.bool_and(F.col("rgb").isin(0, 0xFFFFFF)).alias("is_mono"), F.bool_and((F.col("r") == F.col("g")) & (F.col("g") == F.col("b"))).alias("is_gray"), (F.count("*") <= 256).alias("is_palette"), F.count("*").alias("n_colors")
    )


def palette(pixels: DataFrame, width: int, by: tuple[str, ...] = ("tile",)) -> DataFrame:
    """The colours of each image by first appearance; those after the 256th get index 0. Pixels are reduced to colours before they are ranked."""
    seen = pixels.groupBy(*by, pack(F.col("r"), F.col("g"), F.col("b")).alias("rgb")).agg(F.min(F.col("ty") * width + F.col("x")).alias("first_at"))
    rank = F.row_number().over(W.partitionBy(*by).orderBy("first_at")) - 1
    return seen.select(*by, "rgb", "first_at", F.when(rank < 256, rank).otherwise(0).alias("palette_index"))


def composite(pixels: DataFrame, placed: DataFrame, width: int, height: int, transparent: int = -1, background: int = 0) -> DataFrame:
    """Paints tiles onto a canvas: rows ``cy, cx, rgb`` for each canvas pixel; the highest ``order`` wins, transparent pixels don't paint.

    ``placed`` has ``tile, order, width, height, new_w, new_h, at_x, at_y, boxed`` for the tiles of the window. A boxed tile is a gray box, 192 at its border and 240 inside.
    """
    plain = pixels.join(placed.where("not boxed"), "tile")
    rows = resample(plain, F.col("width"), F.col("height"), F.col("new_w"), F.col("new_h"))
    inside = lambda d: d.where(F.col("cx").between(0, width - 1) & F.col("cy").between(0, height - 1))
    drawn = inside(rows.select((F.col("at_y") + F.col("out_y")).alias("cy"), (F.col("at_x") + F.col("out_x")).alias("cx"), "order", pack(F.col("r"), F.col("g"), F.col("b")).alias("rgb")))
    span = lambda at, size, limit: F.sequence(F.greatest(F.col(at), F.lit(0)), F.least(F.col(at) + F.col(size), F.lit(limit)) - 1)
    some = "boxed and at_x < {w} and at_y < {h} and at_x + new_w > 0 and at_y + new_h > 0".format(w=width, h=height)
    boxes = placed.where(some).withColumn("cy", F.explode(span("at_y", "new_h", height))).withColumn("cx", F.explode(span("at_x", "new_w", width)))
    edge = (F.col("cx") == F.col("at_x")) | (F.col("cy") == F.col("at_y")) | (F.col("cx") == F.col("at_x") + F.col("new_w") - 1) | (F.col("cy") == F.col("at_y") + F.col("new_h") - 1)
    boxes = boxes.select("cy", "cx", "order", F.when(edge, 192 * 0x010101).otherwise(240 * 0x010101).alias("rgb"))
    painted = drawn.unionAll(boxes).where(F.col("rgb") != transparent).groupBy("cy", "cx").agg(F.max_by("rgb", "order").alias("rgb"))
    canvas = pixels.sparkSession.range(width * height).select(F.expr(f"id div {width}").alias("cy"), (F.col("id") % width).alias("cx"))
    return canvas.join(painted, ["cy", "cx"], "left").select("cy", "cx", F.coalesce("rgb", F.lit(background)).alias("rgb"))
