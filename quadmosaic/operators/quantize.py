"""Reduction of an image to 256 colours by median cut over its histogram."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadmosaic.functions.colors import pack
from quadmosaic.operators.pixels import histogram

# How much a difference in red, green and blue counts.
WEIGHTS = np.array([2, 3, 1])


def median_cut(bins: np.ndarray, counts: np.ndarray, colors: int = 256) -> np.ndarray:
    """The palette of histogram bins: the box of the largest diagonal is cut in the middle of its longest side, green before red before blue on ties."""
    boxes = [np.arange(len(bins))]
    size = lambda rows: bins[rows].max(axis=0) - bins[rows].min(axis=0)
    volumes = [int((size(boxes[0]) ** 2).sum())]
    while len(boxes) < colors and max(volumes) > 0:
        k = int(np.argmax(volumes))
        rows, (r, g, b) = boxes[k], size(boxes[k])
        axis = 2 if b > max(g, r) else 0 if r > g else 1
        side = bins[rows, axis]
        low = side <= (side.min() + side.max()) // 2
        boxes[k] = rows[low]
        boxes.append(rows[~low])
        volumes[k] = int((size(boxes[k]) ** 2).sum())
        volumes.append(int((size(boxes[-1]) ** 2).sum()))
    out = []
    for rows in boxes:
        total = counts[rows].sum()
        out.append(((2 * bins[rows] + 1) * counts[rows, None]).sum(axis=0) + total // 2)
        out[-1] //= total
    return np.array(out)


def nearest(bins: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """For each histogram bin the index of the palette's nearest colour by weighted distance, the first one on ties."""
    parts = np.array_split(bins, len(bins) // 4096 + 1)
    return np.concatenate([(((2 * part + 1)[:, None, :] - palette[None]) * WEIGHTS).__pow__(2).sum(axis=2).argmin(axis=1) for part in parts])


def bin_of(image: np.ndarray) -> np.ndarray:
    """The histogram bin of each pixel as one number: seven bits of each channel."""
    half = image.astype(np.int64) >> 1
    return half[..., 0] << 14 | half[..., 1] << 7 | half[..., 2]


def inverse_table(bins: np.ndarray, counts: np.ndarray, colors: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """The palette of a histogram (numbers of :func:`bin_of`, ascending, and counts), and for each of all bins the palette's index, 0 for those that don't occur."""
    channels = np.stack([bins >> 14, bins >> 7 & 127, bins & 127], axis=1)
    palette = median_cut(channels, counts, colors)
    table = np.zeros(1 << 21, np.uint8)
    table[bins] = nearest(channels, palette)
    return palette, table


def quantize(pixels: DataFrame, colors: int = 256) -> DataFrame:
    """``pixels`` with ``palette_index`` and ``rgb`` of the palette. Each image is reduced to its histogram first; the cut works on these bins, and pixels join them by bin."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bins, counts = pdf[["r_bin", "g_bin", "b_bin"]].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        order = np.lexsort(bins.T[::-1])
        palette = median_cut(bins[order], counts[order], colors)
        index = nearest(bins, palette)
        r, g, b = palette[index].T
        return pdf[["tile", "r_bin", "g_bin", "b_bin"]].assign(palette_index=index.astype(np.int32), pr=r.astype(np.int32), pg=g.astype(np.int32), pb=b.astype(np.int32))

    table = histogram(pixels, ("tile",)).groupBy("tile").applyInPandas(run, "tile long, r_bin int, g_bin int, b_bin int, palette_index int, pr int, pg int, pb int")
    keyed = pixels.withColumns({f"{c}_bin": F.shiftright(F.col(c), 1) for c in "rgb"}).withColumn("tile", F.col("tile").cast("long"))
    return keyed.join(table, ["tile", "r_bin", "g_bin", "b_bin"]).select("tile", "ty", "x", "palette_index", pack(F.col("pr"), F.col("pg"), F.col("pb")).alias("rgb"))
