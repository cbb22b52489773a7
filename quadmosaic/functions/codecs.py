"""Small helpers for one image blob at a time: PNG and TIFF, to and from arrays of (height, width, 3) bytes.

LZW, JPEG and FAX4 are not read; such blobs are errors that their callers report.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from quadmosaic.functions.colors import RAW_FORMATS, ColorSpace

# Magic numbers, samples of PNG colour types, element codes of TIFF field types.
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
TIFF_MAGICS = (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+")
PNG_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
TIFF_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
GEO_UNDEFINED = 32767


def packed(image: np.ndarray) -> np.ndarray:
    """0xRRGGBB for each pixel."""
    return (image[..., 0].astype(np.int32) << 16) | (image[..., 1].astype(np.int32) << 8) | image[..., 2]


def palette_of(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Colours by first appearance, and each pixel's index; a ValueError for more than 256."""
    flat = packed(image).ravel()
    colors, first, back = np.unique(flat, return_index=True, return_inverse=True)
    if len(colors) > 256:
        raise ValueError("more than 256 colours")
    order = np.argsort(first, kind="stable")
    rank = np.empty(len(order), np.uint8)
    rank[order] = np.arange(len(order))
    rgb = np.stack([colors[order] >> 16, colors[order] >> 8 & 255, colors[order] & 255], axis=1).astype(np.uint8)
    return rgb, rank[back].reshape(image.shape[:2])


def png_chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_head(width: int, height: int, space: int, colors: np.ndarray | None) -> bytes:
    """What stands before the data of a PNG of 8 bits whose lines come as parts of one deflate stream."""
    color = 2 if space == ColorSpace.RGB else 3 if space == ColorSpace.PALETTE else 0
    plte = png_chunk(b"PLTE", np.asarray(colors).astype(np.uint8).tobytes()) if color == 3 else b""
    return PNG_MAGIC + png_chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)) + plte + png_chunk(b"IDAT", b"\x78\x9c")


def png_part(samples: np.ndarray, last: bool) -> tuple[bytes, int, int]:
    """Some whole lines (height, width[, channels]) as a chunk, with the checksum and number of the bytes in it; the parts of an image, in order, are one stream."""
    h = len(samples)
    channels = samples.shape[2] if samples.ndim == 3 else 1
    lines = samples.reshape(h, -1)
    body = np.ones((h, lines.shape[1] + 1), np.uint8)  # each line has the difference to the pixel on the left
    body[:, 1 : 1 + channels] = lines[:, :channels]
    body[:, 1 + channels :] = lines[:, channels:] - lines[:, :-channels]
    data, deflate = body.tobytes(), zlib.compressobj(6, zlib.DEFLATED, -15)
    return png_chunk(b"IDAT", deflate.compress(data) + deflate.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)), zlib.adler32(data), len(data)


def png_tail(parts: list[tuple[int, int]]) -> bytes:
    """What stands behind the parts: the checksum of all, from that and the length of each."""
    low, high = 1, 0
    for adler, size in parts:
        a, b = adler & 0xFFFF, adler >> 16
        low, high = (low + a - 1) % 65521, (high + b + size * (low - 1)) % 65521
    return png_chunk(b"IDAT", struct.pack(">I", high << 16 | low)) + png_chunk(b"IEND", b"")


def png_encode(image: np.ndarray, space: int = ColorSpace.RGB) -> bytes:
    """A PNG: RGB, gray (8 bits, of the blue channel) or palette (1, 2, 4 or 8 bits by the number of colours)."""
    h, w = image.shape[:2]
    depth, color, extra = 8, 2, b""
    if space == ColorSpace.PALETTE:
        colors, index = palette_of(image)
        color, extra = 3, png_chunk(b"PLTE", colors.tobytes())
        depth = next(d for d in (1, 2, 4, 8) if len(colors) <= 1 << d)
        bits = np.unpackbits(index[:, :, None], axis=2)[:, :, 8 - depth :]
        body = np.packbits(bits.reshape(h, w * depth), axis=1)
    elif space in (ColorSpace.GRAYSCALE, ColorSpace.MONOCHROME):
        color, body = 0, image[:, :, 2]
    else:
        body = image.reshape(h, w * 3)
    lines = np.concatenate([np.zeros((h, 1), np.uint8), body], axis=1)
    return PNG_MAGIC + png_chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, 0)) + extra + png_chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + png_chunk(b"IEND", b"")


def unfiltered(kinds: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """PNG lines (height, steps, bytes of a step) without their filters. Diagonals of the image don't depend on themselves, so each is one array step."""
    h, w, n = raw.shape
    if kinds.max(initial=0) == 0:
        return raw
    out = np.zeros((h + 1, w + 1, n), np.int32)
    if kinds.max() <= 2:
        for y in range(h):
            line = raw[y].astype(np.int32)
            out[y + 1, 1:] = (line.cumsum(axis=0) if kinds[y] == 1 else line + out[y, 1:] if kinds[y] == 2 else line) & 255
        return out[1:, 1:].astype(np.uint8)
    kind = kinds.astype(np.intp)[:, None]
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        by_left, by_up, by_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((by_left <= by_up) & (by_left <= by_corner), left, np.where(by_up <= by_corner, up, corner))
        guess = np.choose(kind[y], [np.zeros_like(left), left, up, (left + up) >> 1, nearest])
        out[y + 1, x + 1] = (raw[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def png_parts(blob: bytes) -> tuple[tuple[int, int, int, int, int], bytes, np.ndarray | None]:
    """(width, height, depth, colour type, interlace), the compressed lines, and the palette."""
    at, data, colors, head = 8, [], None, None
    while at < len(blob):
        size, kind = struct.unpack(">I4s", blob[at : at + 8])
        body = blob[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR":
            w, h, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", body)
            head = (w, h, depth, color, interlace)
        elif kind == b"PLTE":
            colors = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
    if head is None:
        raise ValueError("a PNG without a header")
    return head, b"".join(data), colors


def png_decode(blob: bytes) -> np.ndarray:
    """The pixels of a PNG that is not interlaced: 1 to 16 bits (the high byte of 16), alpha dropped."""
    (w, h, depth, color, interlace), data, colors = png_parts(blob)
    if interlace:
        raise ValueError("an interlaced PNG")
    n = PNG_SAMPLES[color]
    step, line = max(1, n * depth // 8), -(-w * n * depth // 8)
    raw = np.frombuffer(zlib.decompress(data), np.uint8)[: h * (line + 1)].reshape(h, line + 1)
    out = unfiltered(raw[:, 0], raw[:, 1:].reshape(h, line // step, step)).reshape(h, line)
    if depth == 16:
        out = out[:, ::2]
    elif depth < 8:
        weights = 1 << np.arange(depth - 1, -1, -1)
        out = (np.unpackbits(out, axis=1)[:, : w * n * depth].reshape(h, w * n, depth) * weights).sum(axis=2).astype(np.uint8)
        out = out if color == 3 else out * np.uint8(255 // ((1 << depth) - 1))
    pixels = out.reshape(h, w, n)
    if color == 3:
        return colors[pixels[:, :, 0]]
    return np.repeat(pixels[:, :, :1], 3, axis=2) if n < 3 else pixels[:, :, :3]


def tiff_encode(image: np.ndarray, space: int = ColorSpace.RGB, geo: tuple[float, float, float, float, int] | None = None) -> bytes:
    """An uncompressed TIFF in strips of about 64 KB: RGB, gray or palette; with ``geo`` (left, top, px, py, EPSG code) a GeoTIFF."""
    h, w = image.shape[:2]
    tags: list[tuple[int, int, list]] = []
    if space == ColorSpace.PALETTE:
        colors, body = palette_of(image)
        table = np.zeros((256, 3), np.int64)
        table[: len(colors)] = colors
        n, photometric = 1, 3
        tags.append((320, 3, (table.T * 256).ravel().tolist()))
    elif space in (ColorSpace.GRAYSCALE, ColorSpace.MONOCHROME):
        body, n, photometric = image[:, :, 0], 1, 1
    else:
        body, n, photometric = image, 3, 2
    data, line = np.ascontiguousarray(body, np.uint8).tobytes(), w * n
    rows = max(1, min(h, 65536 // line))
    offsets = list(range(0, h * line, rows * line))
    sizes = [min(rows * line, h * line - a) for a in offsets]
    tags += [(256, 4, [w]), (257, 4, [h]), (258, 3, [8] * n), (259, 3, [1]), (262, 3, [photometric]), (273, 4, [8 + a for a in offsets]), (277, 3, [n]), (278, 4, [rows]), (279, 4, sizes)]
    tags += [(282, 5, [300, 1]), (283, 5, [300, 1]), (284, 3, [1])]
    if geo:
        tags += _geo_tags(geo)
    after = 8 + len(data) + len(data) % 2
    return b"II*\0" + struct.pack("<I", after) + data + b"\0" * (len(data) % 2) + _directory(tags, after)


def _geo_tags(geo: tuple[float, float, float, float, int]) -> list[tuple[int, int, list]]:
    left, top, px, py, srid = geo
    epsg = srid if 0 < srid < GEO_UNDEFINED else GEO_UNDEFINED
    geographic = 4000 <= epsg < 5000
    return [(33550, 12, [px, py, 0.0]), (33922, 12, [0.0, 0.0, 0.0, left, top, 0.0]), (34735, 3, [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg])]


def _directory(tags: list[tuple[int, int, list]], at: int, big: bool = False) -> bytes:
    """The directory of (tag, kind, values) that stands at an offset of the file, with what doesn't fit into its entries behind it. A big one has offsets of eight bytes."""
    count, entry, room = ("<Q", "<HHQ", 8) if big else ("<H", "<HHI", 4)
    offset = "<Q" if big else "<I"
    extra_at = at + struct.calcsize(count) + (struct.calcsize(entry) + room) * len(tags) + room
    extra, entries = b"", b""
    for tag, kind, values in sorted(tags):
        body = struct.pack(f"<{len(values)}{ {3: 'H', 4: 'I', 5: 'I', 12: 'd', 16: 'Q'}[kind] }", *values)
        entries += struct.pack(entry, tag, kind, len(values) // 2 if kind == 5 else len(values))
        if len(body) > room:
            entries += struct.pack(offset, extra_at + len(extra))
            extra += body
        else:
            entries += body.ljust(room, b"\0")
    return struct.pack(count, len(tags)) + entries + struct.pack(offset, 0) + extra


def tiled_head(width: int, height: int, tile: int, space: int, colors: np.ndarray | None, offsets: list[int], sizes: list[int], geo: tuple | None, big: bool) -> bytes:
    """What stands before the data of a TIFF of deflated tiles: its length depends on their number, not on ``offsets`` and ``sizes``. A big one may be of any size."""
    samples, photometric = (3, 2) if space == ColorSpace.RGB else (1, 3 if space == ColorSpace.PALETTE else 1)
    place = 16 if big else 4
    tags: list[tuple[int, int, list]] = [(256, 4, [width]), (257, 4, [height]), (258, 3, [8] * samples), (259, 3, [8]), (262, 3, [photometric]), (277, 3, [samples]), (284, 3, [1])]
    tags += [(322, 4, [tile]), (323, 4, [tile]), (324, place, offsets), (325, place, sizes)]
    if photometric == 3:
        table = np.zeros((256, 3), np.int64)
        table[: len(colors)] = colors
        tags.append((320, 3, (table.T * 256).ravel().tolist()))
    if geo:
        tags += _geo_tags(geo)
    start = b"II+\0" + struct.pack("<HHQ", 8, 0, 16) if big else b"II*\0" + struct.pack("<I", 8)
    return start + _directory(tags, len(start), big)


def tiff_tags(read) -> dict[int, tuple]:
    """The tags of a TIFF's first image; ``read`` gives the bytes at an offset: (offset, size)."""
    start = read(0, 16)
    if start[:4] not in TIFF_MAGICS:
        raise ValueError("no TIFF")
    end = "<" if start[:2] == b"II" else ">"
    big = 43 in start[2:4]
    room, word = (8, "Q") if big else (4, "I")
    at = struct.unpack(f"{end}{word}", start[8:16] if big else start[4:8])[0]
    first = 8 if big else 2
    count = struct.unpack(f"{end}{'Q' if big else 'H'}", read(at, first))[0]
    entry_size = 4 + 2 * room
    table, out = read(at + first, entry_size * count), {}
    for i in range(count):
        entry = table[entry_size * i : entry_size * (i + 1)]
        tag, kind, n = struct.unpack(f"{end}HH{word}", entry[: 4 + room])
        code = TIFF_TYPES.get(kind)
        if code is None:
            continue
        size = struct.calcsize(f"{end}{n}{code}")
        body = entry[4 + room : 4 + room + size] if size <= room else read(struct.unpack(f"{end}{word}", entry[4 + room :])[0], size)
        out[tag] = struct.unpack(f"{end}{n}{code}", body)
    return out


class Tiff:
    """A TIFF whose pixels are read piece by piece: strips or tiles, uncompressed or deflated, of 1 or 8 bits, interleaved.

    ``read`` gives the bytes at an offset, so that a part of an image needs only the strips or tiles that it meets.
    """

    def __init__(self, read):
        self.read, self.tags = read, tiff_tags(read)
        t = self.tags
        self.width, self.height, self.samples = t[256][0], t[257][0], t.get(277, (1,))[0]
        self.bits, self.photometric = t.get(258, (1,))[0], t[262][0]
        self.compression = t.get(259, (1,))[0]
        if self.compression not in (1, 8, 32946) or t.get(284, (1,))[0] != 1 or t.get(317, (1,))[0] != 1:
            raise ValueError("only TIFF that is uncompressed or deflated, interleaved and without a predictor")
        if set(t.get(258, (1,))) != {8} and not (self.bits == 1 and self.samples == 1):
            raise ValueError("only TIFF of 8 bits, or of 1 bit and 1 sample")
        if 322 in t:
            self.piece_w, self.piece_h, self.offsets, self.sizes = t[322][0], t[323][0], t[324], t[325]
        else:
            self.piece_w, self.piece_h, self.offsets, self.sizes = self.width, min(t.get(278, (self.height,))[0], self.height), t[273], t[279]
        self.across = -(-self.width // self.piece_w)

    @property
    def space(self) -> int:
        if self.bits == 1:
            return ColorSpace.MONOCHROME
        return ColorSpace.PALETTE if self.photometric == 3 else ColorSpace.GRAYSCALE if self.samples < 3 else ColorSpace.RGB

    def _piece(self, k: int, rows: int) -> np.ndarray:
        data = self.read(self.offsets[k], self.sizes[k])
        if self.compression != 1:
            data = zlib.decompress(data)
        line = -(-self.piece_w * self.samples * self.bits // 8)
        raw = np.frombuffer(data, np.uint8, rows * line).reshape(rows, line)
        if self.bits == 1:
            raw = np.unpackbits(raw, axis=1)[:, : self.piece_w] * np.uint8(255)
        return raw.reshape(rows, self.piece_w, self.samples)

    def part(self, x: int, y: int, w: int, h: int) -> np.ndarray:
        """The pixels of a rectangle that lies in the image."""
        out = np.empty((h, w, self.samples), np.uint8)
        for pr in range(y // self.piece_h, (y + h - 1) // self.piece_h + 1):
            top = pr * self.piece_h
            rows = self.piece_h if 322 in self.tags else min(self.piece_h, self.height - top)
            for pc in range(x // self.piece_w, (x + w - 1) // self.piece_w + 1):
                left = pc * self.piece_w
                piece = self._piece(pr * self.across + pc, rows)
                a, b, c, d = max(y, top), min(y + h, top + rows), max(x, left), min(x + w, left + self.piece_w)
                out[a - y : b - y, c - x : d - x] = piece[a - top : b - top, c - left : d - left]
        if self.photometric == 3:
            return (np.array(self.tags[320]).reshape(3, -1).T >> 8).astype(np.uint8)[out[:, :, 0]]
        if self.photometric == 0:
            out = 255 - out
        return np.repeat(out[:, :, :1], 3, axis=2) if self.samples < 3 else out[:, :, :3]

    def header(self) -> dict:
        """What a GeoTIFF says of itself: sizes, layout, upper left corner, pixel size and reference system (-1 where it names none)."""
        keys = self.tags.get(34735, ())
        keys = dict(zip(keys[4::4], keys[7::4]))
        px, py = self.tags[33550][:2]
        column, line, _, x, y = self.tags[33922][:5]
        codes = [c for c in (keys.get(3072), keys.get(2048)) if c and c != GEO_UNDEFINED]
        layout = {"width": self.width, "height": self.height, "bits": self.bits, "samples": self.samples, "photometric": self.photometric, "compression": self.compression}
        return layout | {"left": x - column * px, "top": y + line * py, "px": px, "py": py, "srid": codes[0] if codes else -1}


def reader_of(blob: bytes):
    return lambda at, size: blob[at : at + size]


def tiff_decode(blob: bytes) -> np.ndarray:
    t = Tiff(reader_of(blob))
    return t.part(0, 0, t.width, t.height)


def decode(blob: bytes | None) -> tuple[np.ndarray, int] | None:
    """(pixels, colour space) of a PNG or TIFF blob; None for null and for any other kind."""
    if blob is None:
        return None
    if blob[:8] == PNG_MAGIC:
        color = png_parts(blob)[0][3]
        return png_decode(blob), {0: ColorSpace.GRAYSCALE, 4: ColorSpace.GRAYSCALE, 3: ColorSpace.PALETTE}.get(color, ColorSpace.RGB)
    if blob[:4] in TIFF_MAGICS:
        t = Tiff(reader_of(blob))
        return t.part(0, 0, t.width, t.height), t.space
    return None


def decode_or_error(blob: bytes | None) -> tuple[np.ndarray | None, int, str | None]:
    """(pixels, colour space, None), or no pixels and why."""
    try:
        found = decode(blob)
    except Exception as e:  # noqa: BLE001  a blob that can't be read is reported, not fatal
        return None, 0, f"{type(e).__name__}: {e}"
    return (*found, None) if found else (None, 0, "no blob" if blob is None else "unknown kind of blob")


def raw_bytes(image: np.ndarray, layout: str, transparent: int = -1) -> bytes:
    """The pixels in one of ``RAW_FORMATS``; alpha is 0 only where a pixel is the transparent colour."""
    part = {"R": image[..., 0], "G": image[..., 1], "B": image[..., 2], "A": np.where(packed(image) == transparent, 0, 255).astype(np.uint8)}
    return np.stack([part[c] for c in layout], axis=-1).tobytes()


def from_raw(raw: bytes, layout: str, width: int, height: int) -> np.ndarray:
    """The pixels of :func:`raw_bytes`; alpha is left out."""
    data = np.frombuffer(raw, np.uint8).reshape(height, width, len(layout))
    return data[:, :, [layout.index(c) for c in "RGB"]]


def fitting_space(image: np.ndarray, container: str) -> int:
    """How an image of known pixels is stored: gray if it is, else by palette if it has at most 256 colours, else RGB."""
    r, g, b = image[..., 0], image[..., 1], image[..., 2]
    if (r == g).all() and (g == b).all():
        mono = container == "TIFF" and np.isin(r, (0, 255)).all()
        return ColorSpace.MONOCHROME if mono else ColorSpace.GRAYSCALE
    return ColorSpace.PALETTE if len(np.unique(packed(image))) <= 256 else ColorSpace.RGB


def encode(image: np.ndarray, kind: str, space: int = ColorSpace.RGB, geo: tuple | None = None, transparent: int = -1) -> bytes:
    """A blob of ``kind`` PNG, TIFF or GEOTIFF, or raw bytes in one of ``RAW_FORMATS``."""
    if kind == "PNG":
        return png_encode(image, space)
    if kind in ("TIFF", "GEOTIFF"):
        return tiff_encode(image, space, geo if kind == "GEOTIFF" else None)
    if kind in RAW_FORMATS:
        return raw_bytes(image, kind, transparent)
    raise ValueError(f"no encoder for {kind}")


def shrunk(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Area-weighted means, truncated; overlaps are counted in whole parts of ``1 / width`` and ``1 / height`` pixels."""
    h, w = image.shape[:2]
    if (h, w) == (height, width):
        return image
    if h == 2 * height and w == 2 * width:
        return (image.astype(np.uint16).reshape(height, 2, width, 2, 3).sum(axis=(1, 3)) >> 2).astype(np.uint8)

    def along(rows: np.ndarray, old: int, new: int) -> np.ndarray:
        """Sums of weighted rows: by running totals, a whole part at a time."""
        total = np.concatenate([np.zeros((1, *rows.shape[1:]), np.int64), np.cumsum(rows * new, axis=0)])
        edges = np.arange(new + 1) * old
        whole, rest = edges // new, edges % new
        more = np.concatenate([rows, rows[-1:]])[whole] * rest.reshape(-1, *[1] * (rows.ndim - 1))
        return np.diff(total[whole] + more, axis=0)

    sums = along(image.astype(np.int64), h, height)
    sums = along(sums.swapaxes(0, 1), w, width).swapaxes(0, 1)
    return np.minimum(sums // (h * w), 255).astype(np.uint8)
