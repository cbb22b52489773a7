"""Painting tile blobs onto canvases and encoding these: what windows, pyramid levels and top-most levels share.

A row says where one blob goes on one canvas. Rows are dealt by canvas and sorted by painting order in Spark; a task goes through
its rows once and holds one canvas at a time, however many tiles paint on it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quadmosaic.functions import codecs
from quadmosaic.functions.colors import BACKGROUND_DEFAULT, TRANSPARENT_NONE, ColorSpace

#: Columns of a placement beside the canvas's keys. A null blob paints nothing, so a canvas without tiles is one row with nulls.
PLACEMENT = "canvas_w int, canvas_h int, out_w int, out_h int, order long, at_x long, at_y long, new_w long, new_h long, boxed boolean, raster binary"
# A tile drawn as a box has this border and this inside.
BOX_EDGE, BOX_FILL = 192, 240


@dataclass
class Canvas:
    """A canvas in a task. ``space`` is the colour space of what has been painted: monochrome until something else comes, then that, RGB once kinds mix."""

    width: int
    height: int
    background: int

    def __post_init__(self):
        self.pixels = np.empty((self.height, self.width, 3), np.uint8)
        self.pixels[:] = [self.background >> 16 & 255, self.background >> 8 & 255, self.background & 255]
        self.space = int(ColorSpace.MONOCHROME)

    def fold(self, space: int) -> None:
        mono, rgb = int(ColorSpace.MONOCHROME), int(ColorSpace.RGB)
        self.space = space if self.space == mono else self.space if self.space == space else rgb

    def _span(self, at: int, size: int, limit: int) -> tuple[int, int]:
        return max(at, 0), min(at + size, limit)

    def box(self, x: int, y: int, w: int, h: int) -> None:
        (a, b), (c, d) = self._span(y, h, self.height), self._span(x, w, self.width)
        if a < b and c < d:
            part = self.pixels[a:b, c:d]
            part[:] = BOX_FILL
            rows, cols = np.arange(a, b), np.arange(c, d)
            part[(rows == y) | (rows == y + h - 1)] = BOX_EDGE
            part[:, (cols == x) | (cols == x + w - 1)] = BOX_EDGE

    def draw(self, image: np.ndarray, x: int, y: int, w: int, h: int, transparent: int) -> None:
        """Paints ``image`` stretched to (w, h) by fixed-point steps; only what falls on the canvas is computed."""
        (a, b), (c, d) = self._span(y, h, self.height), self._span(x, w, self.width)
        if a >= b or c >= d:
            return
        ih, iw = image.shape[:2]
        rows, cols = (np.arange(a - y, b - y) * ((ih << 16) // h)) >> 16, (np.arange(c - x, d - x) * ((iw << 16) // w)) >> 16
        part = image[rows[:, None], cols]
        if transparent < 0:
            self.pixels[a:b, c:d] = part
        else:
            seen = codecs.packed(part) != transparent
            self.pixels[a:b, c:d][seen] = part[seen]


def paint_blobs(
    placed: DataFrame, keys: tuple[str, ...], kind: str = "PNG", transparent: int = TRANSPARENT_NONE, background: int = BACKGROUND_DEFAULT, fold: bool = False
) -> DataFrame:
    """Rows of ``keys``, ``width, height, color_space, n_painted, raster, error``: one blob of ``kind`` for each canvas.

    ``placed`` has ``keys`` and the columns of ``PLACEMENT``. Higher ``order`` paints over lower; the canvas is then shrunk to ``out_w`` by ``out_h``.
    With ``fold`` the blob is stored by the colour space of what was painted, else as RGB. Tiles that can't be decoded paint nothing; ``error`` names the first.
    ``raster`` is null for a canvas on which nothing was painted unless ``fold`` asks for it.
    """
    names = [c.split()[0] for c in PLACEMENT.split(", ")]
    schema = StructType([*(placed.schema[k] for k in keys), *StructType.fromDDL("width int, height int, color_space int, n_painted long, raster binary, error string").fields])

    def finish(key: tuple, head, canvas: Canvas, n: int, error: str | None) -> dict:
        image = codecs.shrunk(canvas.pixels, head.out_w, head.out_h)
        space = canvas.space if fold else int(ColorSpace.RGB)
        if fold and space == ColorSpace.PALETTE and codecs.fitting_space(image, "PNG") == ColorSpace.RGB:
            space = int(ColorSpace.RGB)  # palettes of different tiles together
        blob = codecs.encode(image, kind, space, transparent=transparent) if n or fold else None
        return dict(zip(keys, key)) | {"width": head.out_w, "height": head.out_h, "color_space": space, "n_painted": n, "raster": blob, "error": error}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = head = canvas = error = None
        n = 0
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                now = tuple(getattr(row, k) for k in keys)
                if now != key:
                    if canvas is not None:
                        out.append(finish(key, head, canvas, n, error))
                    key, head, canvas, n, error = now, row, Canvas(row.canvas_w, row.canvas_h, background), 0, None
                if row.raster is None:
                    continue
                if row.boxed:
                    canvas.box(int(row.at_x), int(row.at_y), int(row.new_w), int(row.new_h))
                    n += 1
                    continue
                image, space, wrong = codecs.decode_or_error(row.raster)
                if image is None:
                    error = error or f"tile {int(row.order)}: {wrong}"
                    continue
                w, h = int(row.new_w), int(row.new_h)
                canvas.draw(image, int(row.at_x), int(row.at_y), w, h, transparent)
                canvas.fold(int(space) if (h, w) == image.shape[:2] else int(ColorSpace.RGB))
                n += 1
            if out:
                yield pd.DataFrame(out, columns=schema.names)
        if canvas is not None:
            yield pd.DataFrame([finish(key, head, canvas, n, error)], columns=schema.names)

    # blobs are large: few to a batch keeps a task's memory small
    rows = placed.select(*keys, *names).repartition(*keys).sortWithinPartitions(*keys, F.col("order").asc_nulls_first())
    return rows.mapInPandas(run, schema)
