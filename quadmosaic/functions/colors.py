"""Colours as 0xRRGGBB integers, raw pixel formats and the choice of an encoding."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import Column
from pyspark.sql import functions as F


# The codes that stored tiles and callers use.
class ColorSpace(IntEnum):
    MONOCHROME, PALETTE, GRAYSCALE, RGB = 1, 2, 3, 4


RAW_FORMATS = {"RGB": 1001, "RGBA": 1002, "ARGB": 1003, "BGR": 1004, "BGRA": 1005}
TRANSPARENT_NONE, BACKGROUND_DEFAULT = -1, 0


def pack(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r.cast("int"), 16) + F.shiftleft(g.cast("int"), 8) + b.cast("int")


def unpack(rgb: Column) -> tuple[Column, Column, Column]:
    byte = lambda c: c.bitwiseAND(F.lit(255))
    return byte(F.shiftright(rgb, 16)), byte(F.shiftright(rgb, 8)), byte(rgb)


def parse_hex(text: Column) -> Column:
    """``0xRRGGBB`` as an integer, null for anything else. The first character may be any."""
    return F.when(text.rlike("^.[xX][0-9A-Fa-f]{6}$"), F.conv(F.substring(text, 3, 6), 16, 10).cast("int"))


def raw_hex(rgb: Column, layout: str, transparent: int = TRANSPARENT_NONE) -> Column:
    """A pixel's bytes as hex digits in one of ``RAW_FORMATS``; alpha is 0 only where the pixel is the transparent colour."""
    r, g, b = unpack(rgb)
    part = {"R": r, "G": g, "B": b, "A": F.when(rgb == transparent, 0).otherwise(255)}
    return F.concat(*[F.lpad(F.hex(part[c]), 2, "0") for c in layout])


def from_raw_hex(text: Column, layout: str) -> Column:
    """The colour of a pixel given by :func:`raw_hex`; alpha is left out."""
    channel = lambda c: F.conv(F.substring(text, 2 * layout.index(c) + 1, 2), 16, 10).cast("int")
    return pack(channel("R"), channel("G"), channel("B"))


def raw_encoding(container: str, mono: Column, gray: Column, palette: Column) -> Column:
    """How an image of known pixels is stored in a container."""
    if container == "JPEG":
        return F.when(gray, "JPEG_BW").otherwise("JPEG_RGB")
    if container == "PNG":
        return F.when(gray, "PNG_GRAYSCALE").when(palette, "PNG_PALETTE").otherwise("PNG_RGB")
    if container == "GIF":
        return F.when(palette, "GIF_PALETTE").otherwise("GIF_PALETTE_QUANTIZED")
    return F.when(mono, "TIFF_FAX4").when(gray, "TIFF_GRAYSCALE").when(palette, "TIFF_PALETTE").otherwise("TIFF_RGB")


def window_encoding(container: Column, space: Column) -> Column:
    """How a painted window is stored; a container that is not known is taken as JPEG. GIF needs other than RGB: null there."""
    flat = space.isin(int(ColorSpace.GRAYSCALE), int(ColorSpace.MONOCHROME))
    palette = space == int(ColorSpace.PALETTE)
    return (
        F.when(container == "TIFF", F.when(space == int(ColorSpace.MONOCHROME), "TIFF_FAX4").when(space == int(ColorSpace.GRAYSCALE), "TIFF_GRAYSCALE").when(palette, "TIFF_PALETTE").otherwise("TIFF_RGB"))
        .when(container == "PNG", F.when(flat, "PNG_GRAYSCALE").when(palette, "PNG_PALETTE").otherwise("PNG_RGB"))
        .when(container == "GIF", F.when(flat | palette, "GIF_PALETTE"))
        .otherwise(F.when(flat, "JPEG_BW").otherwise("JPEG_RGB"))
    )


def ingest_encoding(container: Column, bits: Column, samples: Column, palette: Column) -> Column:
    """How tiles cut from an image of a given layout are stored."""
    eight = (bits == 8) & (samples == 1)
    return (
        F.when((bits == 1) & (samples == 1), "TIFF_FAX4")
        .when(eight & palette, F.when(container == "TIFF", "TIFF_PALETTE").when(container == "PNG", "PNG_PALETTE").when(container == "GIF", "GIF_PALETTE").otherwise("JPEG_RGB"))
        .when(eight, F.when(container == "TIFF", "TIFF_GRAYSCALE").when(container == "PNG", "PNG_GRAYSCALE").otherwise("JPEG_BW"))
        .otherwise(F.when(container == "TIFF", "TIFF_RGB").when(container == "PNG", "PNG_RGB").otherwise("JPEG_RGB"))
    )


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    side = lambda x: ((255 - x) * (255 - k) / 255).cast("int")
    return pack(side(c), side(m), side(y))


def blob_type(blob: Column) -> Column:
    """What a stored blob is, by its magic number; null for anything else."""
    head = F.hex(F.substring(blob, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), F.when(head.substr(13, 8) == "45786966", "EXIF").otherwise("JPEG"))
        .when(head.startswith("89504E470D0A1A0A"), "PNG")
        .when(head.rlike("^4749463837|^4749463839"), "GIF")
        .when(head.startswith("49492A00") | head.startswith("4D4D002A"), "TIFF")
    )


def quality(value: int | None) -> int:
    return 75 if value is None or value < 0 else min(max(value, 10), 90)


def tile_size(value: int | None) -> int:
    return 512 if value is None else min(max(value, 128), 8192)
