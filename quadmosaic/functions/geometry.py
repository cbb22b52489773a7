"""Windows, tile placement and tile grids."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A tile drawn more than so many times its size is drawn as a gray box.
MAX_ZOOM = 16
#: Side, in pixels of the level, of the squares that stored tiles are sorted by. No tile may be larger.
BLOCK_PX = 16384


@dataclass(frozen=True)
class Window:
    """``width`` by ``height`` pixels of size ``px`` by ``py`` around a centre."""

    cx: float
    cy: float
    px: float
    py: float
    width: int
    height: int

    def __post_init__(self):
        if not (64 <= self.width <= 32768 and 64 <= self.height <= 32768):
            raise ValueError("invalid raster dims")
        if not (self.px > 0 and self.py > 0):
            raise ValueError("a pixel size must be positive")

    @classmethod
    def of_rect(cls, x1: float, y1: float, x2: float, y2: float, px: float, py: float, width: int, height: int) -> Window:
        x1, x2, y1, y2 = min(x1, x2), max(x1, x2), min(y1, y2), max(y1, y2)
        return cls(x1 + (x2 - x1) / 2, y1 + (y2 - y1) / 2, px, py, width, height)

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        w, h = self.width * self.px / 2, self.height * self.py / 2
        return self.cx - w, self.cy - h, self.cx + w, self.cy + h


def half_up(v: Column) -> Column:
    """Rounds halves towards plus infinity."""
    low = F.floor(v)
    return F.when(v - low < 0.5, low).otherwise(low + 1).cast("long")


def window_bounds(cx: Column, cy: Column, px: Column, py: Column, width: Column, height: Column) -> dict[str, Column]:
    w, h = width * px / 2, height * py / 2
    return {"win_min_x": cx - w, "win_min_y": cy - h, "win_max_x": cx + w, "win_max_y": cy + h}


def rect_center(a: Column, b: Column) -> Column:
    """The middle of two coordinates given in any order."""
    return F.least(a, b) + (F.greatest(a, b) - F.least(a, b)) / 2


def placement(w: Window) -> dict[str, Column]:
    """Where a tile (``width, height, px, py, min_x, max_y``) goes on the canvas of ``w``: size, corner, and whether it is drawn as a box."""
    min_x, min_y, _, _ = w.bounds
    return placement_on(F.lit(min_x), F.lit(min_y), F.lit(float(w.px)), F.lit(float(w.py)), F.lit(float(w.height)))


def placement_on(min_x: Column, min_y: Column, px: Column, py: Column, height: Column) -> dict[str, Column]:
    """:func:`placement` on a canvas whose lower left corner, pixel size and height are columns."""
    nw = half_up(F.col("width") * F.col("px") / px) + 1
    nh = half_up(F.col("height") * F.col("py") / py) + 1
    return {
        "new_w": nw,
        "new_h": nh,
        "at_x": half_up((F.col("min_x") - min_x) / px),
        "at_y": half_up(height - (F.col("max_y") - min_y) / py),
        "boxed": (nw > MAX_ZOOM * F.col("width")) | (nh > MAX_ZOOM * F.col("height")),
    }


def tile_grid(width: int, height: int, size: int) -> tuple[int, int, int]:
    """Sections per axis and tile width and height: the fewest sections whose truncated size fits, plus one where that falls short."""
    sections = 1
    while width // sections > size or height // sections > size:
        sections += 1
    return sections, width // sections + (width // sections * sections < width), height // sections + (height // sections * sections < height)


def level_name(px: Column, py: Column) -> Column:
    return F.concat_ws("x", px.cast("string"), py.cast("string"))


def storage_keys() -> dict[str, Column]:
    """Where a tile is stored: its level, and the square of its upper left corner (``band`` down, ``block`` across)."""
    return {
        "level": level_name(F.col("px"), F.col("py")),
        "band": F.floor(-F.col("max_y") / (F.col("py") * BLOCK_PX)).cast("int"),
        "block": F.floor(F.col("min_x") / (F.col("px") * BLOCK_PX)).cast("int"),
    }


def stored_near(px: float, py: float, box: tuple[float, float, float, float]) -> Column:
    """The squares of a level that may have tiles which meet a box: those it lies on, and one more to the left and above."""
    x1, y1, x2, y2 = box
    down = F.col("band").between(math.floor(-y2 / (py * BLOCK_PX)) - 1, math.floor(-y1 / (py * BLOCK_PX)))
    across = F.col("block").between(math.floor(x1 / (px * BLOCK_PX)) - 1, math.floor(x2 / (px * BLOCK_PX)))
    return (F.col("level") == level_name(F.lit(float(px)), F.lit(float(py)))) & down & across
