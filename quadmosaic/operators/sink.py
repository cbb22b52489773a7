"""A window as one file, written by many tasks.

The window is painted in blocks, each by one task. Blocks are encoded as tiles of a TIFF, rows of blocks as parts of a PNG's stream; a running total of their sizes says
where each goes, tasks write their own there, and a small head comes last. The file is put into its place when it is whole. Raw formats have their places known
beforehand. Files are on a mount that driver and executors share, as those that are read strip by strip.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadmosaic.functions import codecs
from quadmosaic.functions.colors import BACKGROUND_DEFAULT, RAW_FORMATS, TRANSPARENT_NONE, ColorSpace
from quadmosaic.functions.geometry import Window
from quadmosaic.lineage import settled
from quadmosaic.operators.quantize import bin_of, inverse_table
from quadmosaic.operators.window import window_blocks, window_space

#: Side of the tiles of a file, a multiple of 16 as TIFF asks.
TILE = 512
#: Bytes from which a file needs offsets of eight bytes.
BIG = (1 << 32) - (1 << 20)
#: Different colours that a palette holds; one more tells that there are too many.
COLORS = 256


@dataclass(frozen=True)
class Written:
    """What a file was written as."""

    space: int
    n_tiles: int
    size: int
    big: bool


def shared_path(path: str) -> str:
    """A path of a mount, without the scheme that Spark may put before it."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: windows are written in place, which needs a shared mount")
    return path


def distinct_colors(blocks: DataFrame, most: int = COLORS) -> np.ndarray:
    """The different colours of painted blocks (raw RGB), ascending, or ``most`` + 1 of them if there are more. No block and no task sends on more than that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                if len(seen) <= most:
                    image = np.frombuffer(raw.as_buffer(), np.uint8).reshape(-1, 3).astype(np.int64)
                    seen = np.union1d(seen, image[:, 0] << 16 | image[:, 1] << 8 | image[:, 2])[: most + 1]
        yield pa.RecordBatch.from_arrays([pa.array(seen)], names=["rgb"])

    rows = blocks.select("raster").mapInArrow(run, "rgb long").distinct().orderBy("rgb").limit(most + 1).collect()
    return np.array([r.rgb for r in rows], np.int64)


def block_histogram(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The bins of all painted blocks, ascending, and how many pixels are in each: added up in the tasks, two million at most in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 21, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                found, n = np.unique(bin_of(np.frombuffer(raw.as_buffer(), np.uint8).reshape(-1, 3)), return_counts=True)
                total[found] += n
        bins = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(total[bins])], names=["bin", "n"])

    rows = blocks.select("raster").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").toArrow()
    return rows["bin"].to_numpy(), rows["n"].to_numpy()


def _samples(image: np.ndarray, space: int, colors: np.ndarray | None, table: np.ndarray | None) -> np.ndarray:
    """What a file stores of pixels: all channels, one, or the palette's indexes."""
    if space == ColorSpace.RGB:
        return image
    if space == ColorSpace.PALETTE:
        return table[bin_of(image)] if table is not None else np.searchsorted(colors, codecs.packed(image).astype(np.int64)).astype(np.uint8)
    return image[:, :, 0]


def _painted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    for batch in batches:
        for brow, bcol, w, h, raw in zip(*batch.columns):
            yield brow.as_py(), bcol.as_py(), np.frombuffer(raw.as_buffer(), np.uint8).reshape(h.as_py(), w.as_py(), 3)


def _tiles(blocks: DataFrame, space: int, tile: int, across: int, colors: np.ndarray | None, table: np.ndarray | None) -> DataFrame:
    """Rows ``k, size, data``: each block as the deflated tile number ``k``, filled up at the right and below."""
    shared = blocks.sparkSession.sparkContext.broadcast((colors, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for brow, bcol, image in _painted(batches):
            samples = _samples(image, space, *shared.value)
            whole = np.zeros((tile, tile, *samples.shape[2:]), np.uint8)
            whole[: len(image), : image.shape[1]] = samples
            data = zlib.compress(whole.tobytes(), 6)
            yield pa.RecordBatch.from_arrays([pa.array([brow * across + bcol]), pa.array([len(data)]), pa.array([data])], names=["k", "size", "data"])

    return blocks.select("brow", "bcol", "width", "height", "raster").mapInArrow(run, "k long, size long, data binary")


def _strips(blocks: DataFrame, space: int, tile: int, window: Window, colors: np.ndarray | None, table: np.ndarray | None) -> DataFrame:
    """Rows ``k, size, adler, n, data``: each row of blocks as the part number ``k`` of a PNG. A task holds one row of blocks."""
    shared, last = blocks.sparkSession.sparkContext.broadcast((colors, table)), (window.height - 1) // tile

    def finish(k: int, strip: np.ndarray) -> pa.RecordBatch:
        data, adler, n = codecs.png_part(_samples(strip, space, *shared.value), k == last)
        return pa.RecordBatch.from_arrays([pa.array([k]), pa.array([len(data)]), pa.array([adler]), pa.array([n]), pa.array([data])], names=["k", "size", "adler", "n", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, strip = None, None
        for brow, bcol, image in _painted(batches):
            if brow != now:
                if strip is not None:
                    yield finish(now, strip)
                now, strip = brow, np.zeros((len(image), window.width, 3), np.uint8)
            strip[:, bcol * tile : bcol * tile + image.shape[1]] = image
        if strip is not None:
            yield finish(now, strip)

    rows = blocks.select("brow", "bcol", "width", "height", "raster").repartition("brow").sortWithinPartitions("brow", "bcol")
    return rows.mapInArrow(run, "k long, size long, adler long, n long, data binary")


def _put(pieces: DataFrame, path: str) -> int:
    """Writes pieces ``at, data`` to their places in a file that is there, and says how many bytes these were. A task that is run again writes the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        with open(path, "r+b") as f:
            for batch in batches:
                for at, data in zip(*batch.columns):
                    f.seek(at.as_py())
                    n += f.write(data.as_buffer())
            f.flush()
            os.fsync(f.fileno())
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    return pieces.select("at", "data").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def write_window(
    hits: DataFrame, window: Window, file: str, kind: str = "GEOTIFF", transparent: int = TRANSPARENT_NONE, background: int = BACKGROUND_DEFAULT, srid: int = -1, tile: int = TILE, quantized: bool = False, big: bool | None = None
) -> Written:
    """Writes the window of ``hits`` (tiles with their places and blobs) to one file of ``kind`` GEOTIFF, TIFF, PNG or a raw format; an old one is replaced once the new one is whole.

    An image is stored gray, by palette or as RGB like its tiles; a palette of more than 256 colours becomes RGB, or with ``quantized`` any RGB window is reduced to 256 colours by
    median cut. A TIFF has offsets of eight bytes where its tiles need them. No task holds more than a block, for a PNG a row of blocks, and nothing but their sizes comes to the driver.
    """
    if tile % 16 or tile <= 0:
        raise ValueError("a tile's side must be a multiple of 16")
    if kind not in ("GEOTIFF", "TIFF", "PNG", *RAW_FORMATS):
        raise ValueError(f"no parallel writer for {kind}")
    path = shared_path(file)
    aside = os.path.join(os.path.dirname(path) or ".", f".{os.path.basename(path)}.{uuid.uuid4().hex}")
    across, n_tiles = -(-window.width // tile), -(-window.width // tile) * -(-window.height // tile)
    hits = settled(hits)
    try:
        if kind in RAW_FORMATS:
            size = window.width * window.height * len(kind)
            _create(aside, size)
            lines = _raw_lines(window_blocks(hits, window, kind, transparent, background, tile), window.width, len(kind), tile)
            done = Written(int(ColorSpace.RGB), n_tiles, _put(lines, aside), False)
        else:
            spaces = [r.color_space for r in window_space(hits).collect()]  # one row, or none without tiles
            space = spaces[0] if spaces else int(ColorSpace.MONOCHROME)
            # each block is raw RGB of bounded size; encoding waits for what all of them need
            blocks = settled(window_blocks(hits, window, "RGB", transparent, background, tile))
            colors = table = palette = None
            if space in (ColorSpace.GRAYSCALE, ColorSpace.MONOCHROME) and len({background >> 16 & 255, background >> 8 & 255, background & 255}) > 1:
                space = int(ColorSpace.PALETTE)  # gray tiles before a coloured background
            if space == ColorSpace.PALETTE or (quantized and space == ColorSpace.RGB):
                colors, space = distinct_colors(blocks), int(ColorSpace.PALETTE)
                if len(colors) > COLORS and quantized:
                    palette, table = inverse_table(*block_histogram(blocks))
                elif len(colors) > COLORS:
                    space, colors = int(ColorSpace.RGB), None
                else:
                    palette = np.stack([colors >> 16, colors >> 8 & 255, colors & 255], axis=1)
            png = kind == "PNG"
            parts = settled(_strips(blocks, space, tile, window, colors, table) if png else _tiles(blocks, space, tile, across, colors, table))
            found = parts.drop("data").orderBy("k").collect()
            sizes = [r["size"] for r in found]
            if len(sizes) != (-(-window.height // tile) if png else n_tiles):
                raise RuntimeError(f"{len(sizes)} parts of {n_tiles} blocks")
            large = not png and (sum(sizes) >= BIG if big is None else big)
            geo = (window.bounds[0], window.bounds[3], window.px, window.py, srid) if kind == "GEOTIFF" else None

            def head(offsets: list[int]) -> bytes:
                return codecs.png_head(window.width, window.height, space, palette) if png else codecs.tiled_head(window.width, window.height, tile, space, palette, offsets, sizes, geo, large)

            tail = codecs.png_tail([(r.adler, r.n) for r in found]) if png else b""
            first = len(head([0] * n_tiles))
            *offsets, end = accumulate(sizes, initial=first)
            _create(aside, end + len(tail))
            _put(_placed(parts, hits.sparkSession.sparkContext.broadcast(np.array(offsets, np.int64))), aside)
            with open(aside, "r+b") as f:
                f.write(head(offsets))
                f.seek(end)
                f.write(tail)
                f.flush()
                os.fsync(f.fileno())
            done = Written(space, n_tiles, end + len(tail), large)
        os.replace(aside, path)
    finally:
        if os.path.exists(aside):
            os.remove(aside)
    return done


def _create(path: str, size: int) -> None:
    with open(path, "xb") as f:
        f.truncate(size)


def _placed(tiles: DataFrame, places) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(places.value[batch.column(0).to_numpy()]), batch.column(1)], names=["at", "data"])

    return tiles.select("k", "data").mapInArrow(run, "at long, data binary")


def _raw_lines(blocks: DataFrame, width: int, channels: int, tile: int) -> DataFrame:
    """Rows ``at, data``: the lines of raw blocks with their places in the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for brow, bcol, w, h, raw in zip(*batch.columns):
                line, data = w.as_py() * channels, raw.as_py()
                at = [((brow.as_py() * tile + y) * width + bcol.as_py() * tile) * channels for y in range(h.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([data[y * line : (y + 1) * line] for y in range(len(at))])], names=["at", "data"])

    return blocks.select("brow", "bcol", "width", "height", "raster").mapInArrow(run, "at long, data binary")
