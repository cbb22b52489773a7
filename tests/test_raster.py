"""Geometry, images, grids, the catalog and streamed ingest, on small made-up data."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadmosaic.functions.geometry import Window, tile_grid
from quadmosaic.operators.pixels import composite, thumbnail
from quadmosaic.functions import codecs, colors
from quadmosaic.operators.pyramid import PyramidError, grid_index, next_images, pyramid, topmost, topmost_images, topmost_layout
from quadmosaic.operators.quantize import median_cut, quantize
from quadmosaic.operators.terrain import colorize, georeference, hillshade, match_colors
from quadmosaic.sources import grids, images
from quadmosaic.sources.catalog import RasterError, RasterSource, append_tiles, prefixes_like, register
from quadmosaic.streaming import geotiff_files, ingest

META = "id long, source_name string, tile_id int, width int, height int, px double, py double, min_x double, min_y double, max_x double, max_y double, srid int"


def globe():
    """2000 x 1000 pixels at 0.18 degrees, in 16 tiles."""
    n, tw, th = tile_grid(2000, 1000, 512)
    rows = []
    for k in range(n * n):
        x, y = k % n * tw, k // n * th
        rows.append((k + 1, "globe", k, tw, th, 0.18, 0.18, -180 + x * 0.18, 90 - (y + th) * 0.18, -180 + (x + tw) * 0.18, 90 - y * 0.18, 4326))
    return rows


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5000), st.integers(1, 5000), st.integers(128, 2048))
def test_tile_grid_covers_the_image(w, h, size):
    n, tw, th = tile_grid(w, h, size)
    assert n * tw >= w and n * th >= h and tw <= size + 1 and th <= size + 1


def test_tile_grid_examples():
    assert tile_grid(2000, 1000, 512) == (4, 500, 250)
    assert tile_grid(1025, 1025, 512) == (2, 513, 513)


@pytest.mark.parametrize("dims", [(63, 63), (64, 63), (32769, 64), (1024, 32769)])
def test_window_limits(dims):
    with pytest.raises(ValueError):
        Window(0, 0, 1, 1, *dims)


def test_window_of_a_rectangle_in_any_order():
    assert Window.of_rect(10, 5, 0, 1, 1, 1, 64, 64) == Window.of_rect(0, 1, 10, 5, 1, 1, 64, 64) == Window(5, 3, 1, 1, 64, 64)


def test_globe_levels(spark):
    p = pyramid(spark.createDataFrame(globe(), META))
    assert [(r.level, r.n, r.px) for r in p.groupBy("level").agg(F.count("*").alias("n"), F.max("px").alias("px")).orderBy("level").collect()] == [(0, 16, 0.18), (1, 4, 0.36), (2, 1, 0.72)]
    assert {(r.width, r.height) for r in p.select("width", "height").collect()} == {(500, 250)}


def test_topmost_of_the_globe(spark):
    (cell,) = topmost_layout(spark, (-180.0, -90.0, 180.0, 90.0), 0.72, 0.72).collect()
    assert cell[2:6] == (500, 250, 250, 125)


def tile(k, x, y, w=10, h=10, source="s"):
    return (k, source, k, w, h, 1.0, 1.0, float(x), float(y - h), float(x + w), float(y), 0)


def levels_of(spark, rows):
    got = pyramid(spark.createDataFrame(rows, META)).collect()
    return sorted((r.level, r.width, r.height, r.px, r.min_x, r.max_x, r.max_y) for r in got)


def test_tiles_with_a_gap_are_not_joined(spark):
    """Each stays a tile of its own, and no level is made where no tile meets another."""
    rows = [tile(1, 0, 0), tile(2, 20, 0)]
    assert levels_of(spark, rows) == [(0, 10, 10, 1.0, 0.0, 10.0, 0.0), (0, 10, 10, 1.0, 20.0, 30.0, 0.0)]
    rows = [tile(k, x, 0) for k, x in enumerate((0, 10, 30, 40, 50))]
    up = [(n, w, lo, hi) for n, w, _, _, lo, hi, _ in levels_of(spark, rows) if n]
    assert up == [(1, 5, 50.0, 60.0), (1, 10, 0.0, 20.0), (1, 10, 30.0, 50.0), (2, 5, 0.0, 20.0), (2, 7, 30.0, 60.0)]


def test_shapes_of_squares(spark):
    assert [r[:3] for r in levels_of(spark, [tile(1, 0, 0), tile(2, 0, -10, h=6)]) if r[0]] == [(1, 5, 8)]  # two left ones
    assert [r[:3] for r in levels_of(spark, [tile(1, 0, 0), tile(2, 10, 0, w=7)]) if r[0]] == [(1, 8, 5)]  # two upper ones
    assert [r[:3] for r in levels_of(spark, [tile(1, 0, 0), tile(2, 6, 0)])] == [(0, 10, 10), (0, 10, 10)]  # they overlap


@pytest.mark.parametrize("rows", [[tile(1, 0, 0), tile(2, 10, 0), tile(3, 0, -10)], [tile(1, 0, 0), tile(2, 10, -10)], [tile(1, 0, 0), tile(2, 10, 0, h=9)], [tile(1, 0, 0), tile(2, 0, 0), tile(3, 10, 0)]])
def test_tiles_that_make_no_square_are_an_error(spark, rows):
    good = [tile(k, 10 * k, 0, source="good") for k in range(2)]
    with pytest.raises(PyramidError, match="source s:"):
        pyramid(spark.createDataFrame(good + rows, META))


def image_of(seed, kind):
    rng = np.random.default_rng(seed)
    h, w = (int(x) for x in rng.integers(1, 40, 2))
    image = rng.integers(0, 256, (h, w, 3), dtype=np.uint8)
    if kind == colors.ColorSpace.GRAYSCALE:
        image[:] = image[:, :, :1]
    elif kind == colors.ColorSpace.PALETTE:
        image = rng.integers(0, 256, (int(rng.integers(1, 40)), 3), dtype=np.uint8)[rng.integers(0, 1 << int(rng.integers(0, 5)), (h, w)) % 1]
        image = image if seed % 2 else rng.integers(0, 256, (17, 3), dtype=np.uint8)[rng.integers(0, 1 + seed % 17, (h, w))]
    return image


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from(["PNG", "TIFF"]), st.sampled_from([colors.ColorSpace.GRAYSCALE, colors.ColorSpace.PALETTE, colors.ColorSpace.RGB]))
def test_codecs_round_trip(seed, kind, space):
    image = image_of(seed, space)
    pixels, got = codecs.decode(codecs.encode(image, kind, space))
    assert (pixels == image).all() and got == space
    assert (codecs.tiff_decode(codecs.tiff_encode(image, space, (1.0, 2.0, 0.5, 0.5, 4326))) == image).all()
    for layout in colors.RAW_FORMATS:
        assert (codecs.from_raw(codecs.raw_bytes(image, layout), layout, image.shape[1], image.shape[0]) == image).all()


def filtered(image, kinds):
    """The lines of a PNG with a filter each, one byte after the other as the format defines it."""
    h, w, n = image.shape
    flat, out = image.reshape(h, w * n).astype(int), []
    for y in range(h):
        line = [kinds[y]]
        for i in range(w * n):
            a, b, c = flat[y, i - n] if i >= n else 0, flat[y - 1, i] if y else 0, flat[y - 1, i - n] if y and i >= n else 0
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            line.append((flat[y, i] - [0, a, b, (a + b) // 2, near][kinds[y]]) % 256)
        out.append(line)
    return np.array(out, np.uint8).tobytes()


@pytest.mark.parametrize("depth,color,n", [(8, 0, 1), (8, 2, 3), (8, 4, 2), (8, 6, 4), (16, 2, 6)])
def test_png_filters(depth, color, n):
    import struct
    import zlib

    rng = np.random.default_rng(depth + color)
    for size in ((1, 1), (7, 5), (12, 30)):
        image = rng.integers(0, 256, (*size, n), dtype=np.uint8)
        for kinds in (rng.integers(0, 5, size[0]).tolist(), [4] * size[0], [1] * size[0]):
            chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + b"crc_"
            blob = codecs.PNG_MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", size[1], size[0], depth, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(filtered(image, kinds))) + chunk(b"IEND", b"")
            got, samples = codecs.png_decode(blob), image[:, :, :: depth // 8]
            want = np.repeat(samples[:, :, :1], 3, axis=2) if samples.shape[2] < 3 else samples[:, :, :3]
            assert (got == want).all()


def test_image_files_through_the_image_source(spark, tmp_path):
    """A codec of its own writes and reads what ours reads and writes."""
    image = image_of(3, colors.ColorSpace.RGB)
    h, w = image.shape[:2]
    (tmp_path / "ours.png").write_bytes(codecs.png_encode(image))
    jvm = spark._jvm
    theirs = jvm.java.awt.image.BufferedImage(w, h, 1)
    for y in range(h):
        for x in range(w):
            theirs.setRGB(x, y, int(codecs.packed(image)[y, x]))
    for kind in ("png", "bmp", "jpg"):
        jvm.javax.imageio.ImageIO.write(theirs, kind, jvm.java.io.File(str(tmp_path / f"theirs.{kind}")))
    assert (codecs.png_decode((tmp_path / "theirs.png").read_bytes()) == image).all()
    got = images.read_images(spark, str(tmp_path)).collect()
    assert len(got) == 4 and sum((codecs.decode(r.raster)[0] == image).all() for r in got) >= 3
    assert {(r.width, r.height) for r in got} == {(w, h)}


def tiled_tiff(image, size, compress):
    """A TIFF in square tiles, the last of a row or column filled up."""
    import struct
    import zlib

    h, w = image.shape[:2]
    pieces = []
    for y in range(0, h, size):
        for x in range(0, w, size):
            piece = np.zeros((size, size, 3), np.uint8)
            part = image[y : y + size, x : x + size]
            piece[: part.shape[0], : part.shape[1]] = part
            pieces.append(zlib.compress(piece.tobytes()) if compress else piece.tobytes())
    tags = [(256, [w]), (257, [h]), (258, [8]), (259, [8 if compress else 1]), (262, [2]), (277, [3]), (322, [size]), (323, [size])]
    at, extra = 8 + 2 + 12 * 10 + 4, b""
    offsets_at, body_at = at, at + 8 * len(pieces)
    for p in pieces:
        extra += struct.pack(">I", body_at)
        body_at += len(p)
    extra += b"".join(struct.pack(">I", len(p)) for p in pieces) + b"".join(pieces)
    entries = b"".join(struct.pack(">HHII", t, 4, 1, *v) for t, v in tags)
    n = len(pieces)
    entries += struct.pack(">HHII", 324, 4, n, offsets_at) + struct.pack(">HHII", 325, 4, n, offsets_at + 4 * n)
    return b"MM\0*" + struct.pack(">I", 8) + struct.pack(">H", 10) + entries + struct.pack(">I", 0) + extra


@pytest.mark.parametrize("compress", [False, True])
def test_tiled_tiff(compress):
    image = np.random.default_rng(2).integers(0, 256, (70, 45, 3), dtype=np.uint8)
    t = codecs.Tiff(codecs.reader_of(tiled_tiff(image, 16, compress)))
    assert (t.part(0, 0, 45, 70) == image).all() and (t.part(17, 30, 20, 9) == image[30:39, 17:37]).all()


def test_shrunk_is_the_thumbnail(spark):
    image = image_of(5, colors.ColorSpace.RGB)
    h, w = image.shape[:2]
    rows = spark.createDataFrame([(0, y, x, *map(int, image[y, x])) for y in range(h) for x in range(w)], "tile int, ty int, x int, r int, g int, b int")
    for nh, nw in ((max(h // 2, 1), max(w // 2, 1)), ((h + 1) // 2, (w + 1) // 2), (max(h // 3, 1), w)):
        got = {(r.out_y, r.out_x): [r.r, r.g, r.b] for r in thumbnail(rows, w, h, nw, nh).collect()}
        want = codecs.shrunk(image, nw, nh)
        assert got == {(y, x): want[y, x].tolist() for y in range(nh) for x in range(nw)}


def test_normalised_settings(spark):
    assert [colors.quality(v) for v in (None, -1, 5, 40, 99)] == [75, 75, 10, 40, 90]
    assert [colors.tile_size(v) for v in (None, 1, 300, 9999)] == [512, 128, 300, 8192]
    parts = [F.lit(v) for v in (10, 200, 255, 51)]
    assert spark.range(1).select(colors.cmyk_to_rgb(*parts).alias("v")).first().v == (int(245 * 204 / 255) << 16) + (int(55 * 204 / 255) << 8)
    table = spark.createDataFrame([("globe",), ("GLOBE",), ("gl0be",), ("other",)], "table_prefix string")
    assert prefixes_like(table, "globe").count() == 2 and prefixes_like(table, "gl_be").count() == 3


def test_quantize_against_brute_force(spark):
    """Boxes cut one by one in plain Python, and the nearest palette colour for each bin."""
    rng = np.random.default_rng(6)
    image = rng.integers(0, 64, (40, 30, 3)) * 4
    rows = spark.createDataFrame([(7, y, x, *map(int, image[y, x])) for y in range(40) for x in range(30)], "tile int, ty int, x int, r int, g int, b int")
    bins = {}
    for p in image.reshape(-1, 3).tolist():
        bins[tuple(c >> 1 for c in p)] = bins.get(tuple(c >> 1 for c in p), 0) + 1
    boxes = [list(bins)]
    sides = lambda box: [max(p[k] for p in box) - min(p[k] for p in box) for k in range(3)]
    while len(boxes) < 16:
        volumes = [sum(s * s for s in sides(b)) for b in boxes]
        k = volumes.index(max(volumes))
        r, g, b = sides(boxes[k])
        axis = 2 if b > max(r, g) else 0 if r > g else 1
        middle = (min(p[axis] for p in boxes[k]) + max(p[axis] for p in boxes[k])) // 2
        boxes.append([p for p in boxes[k] if p[axis] > middle])
        boxes[k] = [p for p in boxes[k] if p[axis] <= middle]
    palette = [tuple((sum((2 * p[c] + 1) * bins[p] for p in box) + sum(bins[p] for p in box) // 2) // sum(bins[p] for p in box) for c in range(3)) for box in boxes]
    far = lambda p, q: sum((w * (2 * a + 1 - c)) ** 2 for w, a, c in zip((2, 3, 1), p, q))
    for r in quantize(rows, 16).collect():
        p = tuple(int(c) >> 1 for c in image[r.ty, r.x])
        best = min(range(16), key=lambda i: (far(p, palette[i]), i))
        assert r.palette_index == best and r.rgb == (palette[best][0] << 16) + (palette[best][1] << 8) + palette[best][2]


def test_thumbnail_against_numpy(spark):
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (7, 10, 3))
    rows = spark.createDataFrame([(0, y, x, *map(int, image[y, x])) for y in range(7) for x in range(10)], "tile int, ty int, x int, r int, g int, b int")
    wy, wx = (np.array([[max(0, min((i + 1) * new, (o + 1) * old) - max(i * new, o * old)) for i in range(old)] for o in range(new)]) for old, new in ((7, 3), (10, 4)))
    want = np.einsum("oi,pj,ijc->opc", wy, wx, image) // (wy.sum(1)[:, None] * wx.sum(1)[None])[:, :, None]
    got = {(r.out_y, r.out_x): [r.r, r.g, r.b] for r in thumbnail(rows, 10, 7, 4, 3).collect()}
    assert got == {(y, x): want[y, x].tolist() for y in range(3) for x in range(4)}


def test_canvas_without_tiles(spark):
    pixels = spark.createDataFrame([], "tile int, ty int, x int, r int, g int, b int")
    placed = spark.createDataFrame([], "tile int, order int, width int, height int, new_w long, new_h long, at_x long, at_y long, boxed boolean")
    assert composite(pixels, placed, 4, 3, background=7).select("rgb").distinct().collect() == [(7,)]


def test_median_cut_keeps_few_colours():
    bins = np.array([[0, 0, 0], [127, 0, 0], [0, 127, 0]])
    assert sorted(median_cut(bins, np.array([5, 1, 2])).tolist()) == [[1, 1, 1], [1, 255, 1], [255, 1, 1]]


def test_touching_ranges_take_the_lowest(spark):
    colors = spark.createDataFrame([(0.0, 10.0, 1, 0, 0), (10.0, 20.0, 2, 0, 0)], "mn double, mx double, r int, g int, b int")
    cells = spark.createDataFrame([(0.0,), (10.0,), (10.5,), (20.0,), (20.5,), (float("nan"),)], "z double")
    assert {str(r.z): r.rgb for r in match_colors(cells, colors).collect()} == {"0.0": 65536, "10.0": 65536, "10.5": 131072, "20.0": 131072, "20.5": None, "nan": None}


def test_grids(spark, tmp_path):
    head = "ncols 3\nnrows 2\nxllcorner 10.0\nyllcorner 40.0\ncellsize 0.5\nNODATA_value -9999\n"
    (tmp_path / "a.asc").write_text(head + "1 2 3 \n4 5 -9999\n")
    h, cells = grids.read_ascii(spark, str(tmp_path / "a.asc"))
    want = {(0, 0, 1.0), (0, 1, 2.0), (0, 2, 3.0), (1, 0, 4.0), (1, 1, 5.0), (1, 2, -9999.0)}
    assert (h.ncols, h.nrows, h.nodata) == (3, 2, -9999.0) and {tuple(r) for r in cells.collect()} == want
    for order, kind in (("LSBFIRST", "<f4"), ("MSBFIRST", ">f4")):
        (tmp_path / f"{order}.hdr").write_text(head + f"byteorder {order}\n")
        np.array([[1, 2, 3], [4, 5, -9999]], kind).tofile(tmp_path / f"{order}.flt")
        assert {tuple(r) for r in grids.read_float(spark, str(tmp_path / order))[1].collect()} == want
    (tmp_path / "bad.asc").write_text(head + "1 2 3 4\n4 5 6\n")
    with pytest.raises(Exception, match="columns"):
        grids.read_ascii(spark, str(tmp_path / "bad.asc"))[1].collect()
    assert georeference(4, 4, 10.0, 40.0, 0.5) == (10.0, 42.0, 0.5)


def test_color_table(spark, tmp_path):
    (tmp_path / "c.txt").write_text("10 20 0x00FF00\n0\t10 0xff0001")
    assert [tuple(r) for r in grids.read_colors(spark, str(tmp_path / "c.txt")).collect()] == [(0.0, 10.0, 255, 0, 1), (10.0, 20.0, 0, 255, 0)]
    (tmp_path / "bad.txt").write_text("0 10 0xff0001\n\n5 6 0x000000\n")
    with pytest.raises(Exception, match="bad line"):
        grids.read_colors(spark, str(tmp_path / "bad.txt")).collect()


@pytest.fixture
def geotiffs(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (300, 260, 3), dtype=np.uint8)
    (folder / "one.tif").write_bytes(images.tiff_encode(image, geo=(100.0, 50.0, 0.5, 0.5, 4326)))
    (folder / "broken.tif").write_bytes(b"II*\0nothing")
    return folder, image


def opened(spark, tmp_path, geotiffs, size=128):
    tiles, rejected = images.ingest_geotiff(spark.read.format("binaryFile").load(str(geotiffs[0])), size)
    assert [r.source_name for r in rejected.collect()] == ["broken"]
    assert append_tiles(tiles, str(tmp_path / "db"), "t") == 9
    return RasterSource(spark, str(tmp_path / "db"), "t")


def test_ingest_and_window(spark, tmp_path, geotiffs):
    _, image = geotiffs
    source = opened(spark, tmp_path, geotiffs)
    assert source.levels == [(0.5, 0.5, 9)] and source.srid == 4326 and source.resolution(0) == (0.5, 0.5, 9)
    assert source.extent == (100.0, -100.0, 230.0, 50.0)
    # a window at the tiles' own size: each tile is drawn one pixel larger than it is
    window = Window.of_rect(100.0, 18.0, 132.0, 50.0, 0.5, 0.5, 64, 64)
    got = {(r.cy, r.cx): r.rgb for r in source.pixels(window).collect()}
    assert len(got) == 64 * 64
    _, tw, th = tile_grid(260, 300, 128)
    at = lambda i, n: (i * ((n << 16) // (n + 1))) >> 16
    color = lambda p: (int(p[0]) << 16) + (int(p[1]) << 8) + int(p[2])
    assert all(got[y, x] == color(image[at(y, th), at(x, tw)]) for y in range(64) for x in range(64))
    with pytest.raises(RasterError):
        source.resolution(1)


def test_window_images(spark, tmp_path, geotiffs):
    """The window as one image is what its pixels are, in any kind and cut into any blocks."""
    source = opened(spark, tmp_path, geotiffs)
    source.background, source.transparent = 0x102030, int(codecs.packed(geotiffs[1])[5, 5])
    window = Window(120.0, 30.0, 0.7, 0.6, 150, 90)
    want = np.zeros((90, 150), int)
    for r in source.pixels(window).collect():
        want[r.cy, r.cx] = r.rgb
    assert (want == 0x102030).any()
    for kind in ("PNG", "TIFF", "GEOTIFF"):
        row = source.image(window, kind).first()
        assert (row.width, row.height, row.color_space) == (150, 90, 4) and (codecs.packed(codecs.decode(row.raster)[0]) == want).all()
    header = codecs.Tiff(codecs.reader_of(row.raster)).header()
    assert (header["srid"], header["px"], header["left"]) == (4326, 0.7, window.bounds[0])
    assert (codecs.packed(codecs.from_raw(source.image(window, "BGRA").first().raster, "BGRA", 150, 90)) == want).all()
    from quadmosaic.operators.window import window_blocks

    for b in window_blocks(source.tiles(window), window, "PNG", source.transparent, source.background, block=64).collect():
        assert (codecs.packed(codecs.decode(b.raster)[0]) == want[b.brow * 64 : b.brow * 64 + 64, b.bcol * 64 : b.bcol * 64 + 64]).all()
    source.write_image(window, str(tmp_path / "w.png"))
    assert (codecs.packed(codecs.png_decode((tmp_path / "w.png").read_bytes())) == want).all()
    empty = Window(1000.0, 1000.0, 0.5, 0.5, 64, 64)
    assert source.image(empty).first().color_space == 1


def test_window_reads_only_its_level_and_square(spark, tmp_path):
    """Both scans are cut to the level's folder and the band; the square is pushed to the row groups."""
    n = 40  # 40 x 40 tiles of 1024 pixels: several bands and squares
    rows = [("far", k, 1024, 1024, 1.0, 1.0, k % n * 1024.0, -(k // n + 1) * 1024.0, (k % n + 1) * 1024.0, -(k // n) * 1024.0, 0) for k in range(n * n)]
    tiles = spark.createDataFrame(rows, META.replace("id long, ", "", 1)).withColumn("raster", F.lit(b"blob"))
    append_tiles(tiles, str(tmp_path / "db"), "t")
    append_tiles(tiles.withColumns({"px": F.lit(2.0), "py": F.lit(2.0)}), str(tmp_path / "db"), "t")
    source = RasterSource(spark, str(tmp_path / "db"), "t")
    window = Window(33300.0, -40000.0, 1.0, 1.0, 512, 512)
    hits = source.tiles(window, "strict")
    assert sorted((r.min_x, r.max_y) for r in hits.select("min_x", "max_y").collect()) == [(32768.0, -39936.0), (32768.0, -38912.0)]
    plan = hits._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    for line in ("PartitionFilters: [isnotnull(level", "GreaterThanOrEqual(block,"):
        assert plan.count(line) == 2, line
    assert source.meta.select("id").distinct().count() == 2 * n * n


def test_bad_open(spark, tmp_path):
    with pytest.raises(RasterError):
        RasterSource(spark, str(tmp_path), "nothing")


def test_spatial_catalog(spark, tmp_path, geotiffs):
    db = str(tmp_path / "db")
    opened(spark, tmp_path, geotiffs)
    register(spark, db, "other", 4326, "epsg", 4326, "WGS 84", "+proj=longlat")
    with pytest.raises(RasterError, match="not in the spatial catalog"):
        RasterSource(spark, db, "t")
    register(spark, db, "T", 3003, "epsg", 3003, "Monte Mario", "+proj=tmerc")
    source = RasterSource(spark, db, "t")
    assert source.srid == 3003 and source.reference_system["ref_sys_name"] == "Monte Mario"


def test_pyramid_and_topmost_of_a_data_source(spark, tmp_path, geotiffs):
    """Each level is the one before halved; building again gives the same, and ids stay unique."""
    _, image = geotiffs
    source = opened(spark, tmp_path, geotiffs).build_pyramid()
    assert [(px, n) for px, _, n in source.levels] == [(2.0, 1), (1.0, 4), (0.5, 9)]
    again = source.build_pyramid()
    assert again.levels == source.levels and again.meta.select("id").distinct().count() == again.meta.count() == again.rasters.count() == 14
    _, tw, th = tile_grid(260, 300, 128)
    level = again.meta.where("px = 1").join(again.rasters, "id").collect()
    for r in level:
        x, y = int((r.min_x - 100) * 2), int((50 - r.max_y) * 2)
        part = image[y : y + 2 * th, x : x + 2 * tw]
        want = _halved(part, part.shape[0] // 2, part.shape[1] // 2)
        assert (codecs.decode(r.raster)[0] == want).all()
    top = again.build_topmost(128)
    assert [(px, n) for px, _, n in top.levels] == [(4.0, 1), (2.0, 1), (1.0, 4), (0.5, 9)]
    cell = top.meta.where("px = 4").join(top.rasters, "id").first()
    below = codecs.decode(top.meta.where("px = 2").join(top.rasters, "id").first().raster)[0]
    assert cell.source_name == "TopMost" and (cell.width, cell.height) == ((below.shape[1] + 1) // 2, (below.shape[0] + 1) // 2)
    assert [(px, n) for px, _, n in top.build_pyramid().levels] == [(2.0, 1), (1.0, 4), (0.5, 9)]


def test_streamed_ingest(spark, tmp_path, geotiffs):
    """A stream makes the data source that batch ingest makes, and its pyramid builds; files that can't be read are kept."""
    folder, image = geotiffs
    run = lambda: ingest(geotiff_files(spark, str(folder)), str(tmp_path / "out"), "t", str(tmp_path / "marks"), 128).awaitTermination(120)
    run()
    (folder / "two.tif").write_bytes(images.tiff_encode(image[:150], geo=(300.0, 50.0, 0.5, 0.5, 4326)))
    run()
    source = RasterSource(spark, str(tmp_path / "out"), "t")
    assert {(r.source_name, r.tile_count) for r in source.sources().collect()} == {("one", 9), ("two", 9)}
    assert source.meta.agg(F.countDistinct("id"), F.max("id")).first() == (18, 18)
    assert [r.source_name for r in spark.read.parquet(str(tmp_path / "out/t_rejected")).collect()] == ["broken"]
    assert [n for _, _, n in source.build_pyramid().levels] == [2, 8, 18]


def test_files_of_any_size_are_read_in_bands(spark, tmp_path, geotiffs):
    folder, _ = geotiffs
    whole = images.ingest_geotiff(spark.read.format("binaryFile").load(str(folder)), 128)
    bands = images.geotiff_tiles(spark, str(folder), 128, partition_bytes=100_000)
    for a, b in zip(whole, bands):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert bands[0].rdd.getNumPartitions() == 3 + 1
    heads = {r.path.rsplit("/", 1)[1]: r for r in images.geotiff_headers(spark.read.format("binaryFile").load(str(folder))).collect()}
    assert heads["broken.tif"].error and (heads["one.tif"].width, heads["one.tif"].srid, heads["one.tif"].left) == (260, 4326, 100.0)


def test_broken_blobs_are_named(spark):
    rows = spark.createDataFrame([(1, bytearray(codecs.png_encode(np.zeros((2, 3, 3), np.uint8)))), (2, bytearray(codecs.PNG_MAGIC + b"xx")), (3, None), (4, bytearray(b"jpeg?"))], "id long, raster binary")
    assert images.decoded_pixels(rows).count() == 6
    assert {r.id for r in images.blob_errors(rows).collect()} == {2, 3, 4}


def test_grid_to_shaded_source(spark, tmp_path):
    """An ASCII grid, shaded over its colour table, becomes a data source of tiles whose pixels are the shades."""
    rng = np.random.default_rng(4)
    z = rng.integers(0, 50, (150, 140))
    lines = "\n".join(" ".join(map(str, r)) + " " for r in z)
    (tmp_path / "g.asc").write_text(f"ncols 140\nnrows 150\nxllcorner 10.0\nyllcorner 40.0\ncellsize 0.5\nNODATA_value -9999\n{lines}\n")
    head, cells = grids.read_ascii(spark, str(tmp_path / "g.asc"))
    table = spark.createDataFrame([(0.0, 25.0, 200, 100, 0), (25.0, 50.0, 0, 100, 200)], "mn double, mx double, r int, g int, b int")
    shades = hillshade(cells, head.nodata, colors=table)
    want = {(r.row_no - 1, r.col_no - 1): r.rgb for r in shades.collect()}
    append_tiles(grids.grid_tiles(shades, head, "g", 4326, shaded=True, size=128, kind="GEOTIFF"), str(tmp_path / "db"), "t")
    source = RasterSource(spark, str(tmp_path / "db"), "t")
    n, tw, th = tile_grid(138, 148, 128)
    for r in source.meta.join(source.rasters, "id").collect():
        got = codecs.packed(codecs.decode(r.raster)[0])
        y0, x0 = r.tile_id // n * th, r.tile_id % n * tw
        assert got.shape == (r.height, r.width) and all(got[y, x] == want[y0 + y, x0 + x] for y in range(r.height) for x in range(r.width))
        head_of = codecs.Tiff(codecs.reader_of(r.raster)).header()
        assert (head_of["left"], head_of["top"], head_of["srid"]) == (r.min_x, r.max_y, 4326)
    x, y, cell = georeference(140, 150, 10.0, 40.0, 0.5, True)
    assert (source.extent[0], source.extent[3]) == (x, y) and abs(source.levels[0][0] - cell) < 1e-12
    plain = grids.grid_tiles(colorize(cells, table, head.nodata), head, "g", size=512).collect()
    assert [(r.width, r.height) for r in plain] == [(140, 150)]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    text = "".join(f"line {i} {'x' * (i % 50)}\n" for i in range(3000))
    (tmp_path / "t.txt").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 9000)
    try:
        lines = grids.numbered_lines(spark, str(tmp_path / "t.txt"))
        assert lines.rdd.getNumPartitions() > 4
        assert [r.value for r in lines.orderBy("line_no").collect()] == text.splitlines()
        assert lines.agg(F.min("line_no"), F.max("line_no"), F.countDistinct("line_no")).first() == (0, 2999, 3000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.fixture
def mosaic(spark):
    """A 14 x 10 image in tiles of 5 x 4: the last column and row are smaller."""
    image = np.random.default_rng(5).integers(0, 256, (10, 14, 3))
    meta, rows = [], []
    for k, (y, x) in enumerate((y, x) for y in range(0, 10, 4) for x in range(0, 14, 5)):
        part = image[y : y + 4, x : x + 5]
        h, w = part.shape[:2]
        meta.append((k + 1, "m", k, w, h, 1.0, 1.0, float(x), float(10 - y - h), float(x + w), float(10 - y), 0))
        rows += [(k + 1, i, j, *map(int, part[i, j])) for i in range(h) for j in range(w)]
    return image, spark.createDataFrame(meta, META), spark.createDataFrame(rows, "tile long, ty int, x int, r int, g int, b int")


def _halved(image, h, w):
    weights = lambda old, new: np.array([[max(0, min((i + 1) * new, (o + 1) * old) - max(i * new, o * old)) for i in range(old)] for o in range(new)])
    wy, wx = weights(image.shape[0], h), weights(image.shape[1], w)
    return np.einsum("oi,pj,ijc->opc", wy, wx, image) // (wy.sum(1)[:, None] * wx.sum(1)[None])[:, :, None]


def _images(rows):
    out = {}
    for r in rows.collect():
        out.setdefault((r.row, r.col), {})[r.ty, r.x] = [r.r, r.g, r.b]
    return out


def test_next_level_images(spark, mosaic):
    image, meta, pixels = mosaic
    got = _images(next_images(pixels, grid_index(meta)))
    assert set(got) == {(0, 0), (0, 1), (1, 0), (1, 1)}
    for (r, c), cells in got.items():
        part = image[8 * r : 8 * r + 8, 10 * c : 10 * c + 10]
        want = _halved(part, part.shape[0] // 2, part.shape[1] // 2)
        assert cells == {(y, x): want[y, x].tolist() for y in range(want.shape[0]) for x in range(want.shape[1])}


def test_topmost_images(spark, mosaic):
    image, meta, pixels = mosaic
    cells = topmost(meta, (0.0, 0.0, 14.0, 10.0), 1.0, 1.0, 4)
    got = _images(topmost_images(pixels, meta, cells))
    n, tw, th = tile_grid(14, 10, 8)
    assert set(got) == {(r, c) for r in range(n) for c in range(n)}
    for (r, c), out in got.items():
        part = image[th * r : th * r + th, tw * c : tw * c + tw]
        want = _halved(part, (part.shape[0] + 1) // 2, (part.shape[1] + 1) // 2)
        assert out == {(y, x): want[y, x].tolist() for y in range(want.shape[0]) for x in range(want.shape[1])}
