"""Windows written to one file by many tasks, read back by the readers."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadmosaic.functions import codecs
from quadmosaic.functions.colors import ColorSpace
from quadmosaic.functions.geometry import Window
from quadmosaic.operators.quantize import bin_of, inverse_table
from quadmosaic.operators.sink import distinct_colors, shared_path, write_window
from quadmosaic.sources import images
from quadmosaic.sources.catalog import RasterSource, append_tiles

META = "source_name string, tile_id int, width int, height int, px double, py double, min_x double, min_y double, max_x double, max_y double, srid int, raster binary"


def source(spark, tmp_path, paint, space=ColorSpace.RGB, n=3, side=100):
    """``n`` by ``n`` tiles whose pixels ``paint(tile)`` gives."""
    rows = []
    for k in range(n * n):
        x, y = k % n * side, -(k // n) * side
        rows.append(("s", k, side, side, 1.0, 1.0, float(x), float(y - side), float(x + side), float(y), 4326, bytearray(codecs.png_encode(paint(k), space))))
    append_tiles(spark.createDataFrame(rows, META), str(tmp_path / "db"), "t")
    return RasterSource(spark, str(tmp_path / "db"), "t")


def noise(k):
    return np.random.default_rng(k).integers(0, 256, (100, 100, 3), dtype=np.uint8)


def shown(source, window):
    out = np.zeros((window.height, window.width), int)
    for r in source.pixels(window).collect():
        out[r.cy, r.cx] = r.rgb
    return out


def back(spark, file):
    """The file's pixels by the reader that takes it row of tiles by row of tiles."""
    tiles, rejected = images.geotiff_tiles(spark, file, 128)
    assert rejected.count() == 0
    rows = tiles.collect()
    left, top = min(r.min_x for r in rows), max(r.max_y for r in rows)
    out = {}
    for r in rows:
        x, y = round((r.min_x - left) / r.px), round((top - r.max_y) / r.py)
        for (j, i), v in np.ndenumerate(codecs.packed(codecs.decode(r.raster)[0])):
            out[y + j, x + i] = int(v)
    h, w = max(k[0] for k in out) + 1, max(k[1] for k in out) + 1
    return np.array([[out[j, i] for i in range(w)] for j in range(h)]), rows[0]


@pytest.mark.parametrize("big", [None, True])
def test_a_geotiff_is_what_the_window_shows(spark, tmp_path, big):
    db = source(spark, tmp_path, noise)
    db.background, db.transparent = 0x102030, int(codecs.packed(noise(0))[5, 5])
    window = Window(140.0, -120.0, 1.0, 1.0, 330, 250)
    file = str(tmp_path / "w.tif")
    done = write_window(db.tiles(window), window, file, "GEOTIFF", db.transparent, db.background, 4326, tile=64, big=big)
    assert done.n_tiles == 6 * 4 and done.size == os.path.getsize(file) and done.big == bool(big) and done.space == ColorSpace.RGB
    pixels, tile = back(spark, file)
    assert (pixels == shown(db, window)).all()
    assert (tile.px, tile.srid, tile.min_x, tile.max_y) == (1.0, 4326, window.bounds[0], window.bounds[3])
    assert os.listdir(tmp_path) and not [x for x in os.listdir(tmp_path) if x.startswith(".w")]


def test_gray_and_palette_tiles_keep_their_kind(spark, tmp_path):
    gray = source(spark, tmp_path / "g", lambda k: np.repeat(noise(k)[:, :, :1], 3, axis=2), ColorSpace.GRAYSCALE)
    window = Window(150.0, -150.0, 1.0, 1.0, 298, 298)
    few = np.random.default_rng(7).integers(0, 256, (40, 3), dtype=np.uint8)
    palette = source(spark, tmp_path / "p", lambda k: few[np.random.default_rng(k).integers(0, 40, (100, 100))], ColorSpace.PALETTE)
    many = source(spark, tmp_path / "m", lambda k: np.random.default_rng(k).integers(0, 256, (250, 3), dtype=np.uint8)[np.random.default_rng(k).integers(0, 250, (100, 100))], ColorSpace.PALETTE)
    # tiles keep their kind only at their own size, which windows stretch by a pixel: place them as they are
    for db, want in ((gray, ColorSpace.GRAYSCALE), (palette, ColorSpace.PALETTE), (many, ColorSpace.RGB)):
        hits = db.tiles(window).withColumns({"new_w": F.col("width").cast("long"), "new_h": F.col("height").cast("long")})
        file = str(tmp_path / "w.tif")
        done = write_window(hits, window, file, "TIFF", tile=128)
        assert done.space == want
        read = codecs.tiff_decode(open(file, "rb").read())
        expected = np.zeros((298, 298), int)
        from quadmosaic.operators.window import window_blocks

        for b in window_blocks(hits, window, "RGB", block=128).collect():
            expected[b.brow * 128 : b.brow * 128 + b.height, b.bcol * 128 : b.bcol * 128 + b.width] = codecs.packed(codecs.from_raw(b.raster, "RGB", b.width, b.height))
        assert (codecs.packed(read) == expected).all()
        assert write_window(hits, window, file, "PNG", tile=128).space == want
        assert (codecs.packed(codecs.png_decode(open(file, "rb").read())) == expected).all()


def test_a_quantized_window_is_the_median_cut_of_all_its_pixels(spark, tmp_path):
    db = source(spark, tmp_path, noise)
    window = Window(150.0, -150.0, 1.0, 1.0, 280, 200)
    file = str(tmp_path / "q.tif")
    done = db.write_image(window, file, "GEOTIFF", quantized=True)
    want = shown(db, window)
    image = np.stack([want >> 16, want >> 8 & 255, want & 255], axis=2)
    bins, n = np.unique(bin_of(image), return_counts=True)
    palette, table = inverse_table(bins, n)
    pixels, _ = back(spark, file)
    chosen = palette[table[bin_of(image)]]
    assert done.space == ColorSpace.PALETTE and (pixels == (chosen[..., 0] << 16 | chosen[..., 1] << 8 | chosen[..., 2])).all()


@pytest.mark.parametrize("kind", ["RGB", "BGRA"])
def test_raw_files(spark, tmp_path, kind):
    db = source(spark, tmp_path, noise)
    window = Window(150.0, -150.0, 1.3, 1.1, 270, 190)
    file = str(tmp_path / "w.raw")
    db.write_image(window, file, kind)
    assert (codecs.packed(codecs.from_raw(open(file, "rb").read(), kind, 270, 190)) == shown(db, window)).all()


def test_a_failed_write_leaves_the_old_file(spark, tmp_path):
    db = source(spark, tmp_path, noise)
    window = Window(150.0, -150.0, 1.0, 1.0, 128, 128)
    (tmp_path / "w.tif").write_bytes(b"old")
    hits = db.tiles(window)
    with pytest.raises(Exception, match="no such luck"):
        write_window(hits.withColumn("raster", F.raise_error(F.lit("no such luck")).cast("binary")), window, str(tmp_path / "w.tif"))
    assert (tmp_path / "w.tif").read_bytes() == b"old" and sorted(os.listdir(tmp_path)) == ["db", "w.tif"]
    for wrong in ({"kind": "GIF"}, {"tile": 100}, {"file": "hdfs://x/w.tif"}):
        with pytest.raises(ValueError):
            write_window(**({"hits": hits, "window": window, "file": str(tmp_path / "w.tif")} | wrong))
    assert shared_path("file:///a/b") == "/a/b" == shared_path("/a/b")


def test_no_task_sends_more_colours_than_tell(spark, tmp_path):
    rng = np.random.default_rng(3)
    blocks = spark.createDataFrame([(bytearray(rng.integers(0, 256, 3 * 5000, dtype=np.uint8).tobytes()),) for _ in range(6)], "raster binary").repartition(3)
    assert len(distinct_colors(blocks)) == 257 and len(distinct_colors(blocks, 10)) == 11
    one = spark.createDataFrame([(bytearray(b"\x01\x02\x03" * 50),), (bytearray(b"\x00\x00\x09" * 5),)], "raster binary")
    assert distinct_colors(one).tolist() == [9, 0x010203]


def test_a_window_without_tiles(spark, tmp_path):
    db = source(spark, tmp_path, noise)
    window = Window(9000.0, 9000.0, 1.0, 1.0, 100, 64)
    db.background = 0x334455
    db.write_image(window, str(tmp_path / "e.tif"), "GEOTIFF")
    assert (codecs.packed(codecs.tiff_decode((tmp_path / "e.tif").read_bytes())) == 0x334455).all()


def test_a_png_of_many_tasks_is_one_stream(spark, tmp_path):
    """Parts of a deflate stream and their checksum, read by another reader too."""
    import io
    import zlib

    from quadmosaic.functions.codecs import png_part, png_tail

    rng = np.random.default_rng(2)
    parts = [png_part(rng.integers(0, 256, (h, 31, 3), dtype=np.uint8), h == 9) for h in (1, 300, 7, 9)]
    stream = b"\x78\x9c" + b"".join(p[0][8:-4] for p in parts) + png_tail([p[1:] for p in parts])[8:12]
    assert len(zlib.decompress(stream)) == sum(p[2] for p in parts)  # zlib compares the checksum
    db = source(spark, tmp_path, noise)
    window = Window(140.0, -120.0, 1.0, 1.0, 330, 250)
    file = str(tmp_path / "w.png")
    done = write_window(db.tiles(window), window, file, "PNG", tile=64)
    blob = open(file, "rb").read()
    assert done.size == len(blob) and (codecs.packed(codecs.png_decode(blob)) == shown(db, window)).all()
    read = spark.read.format("image").load(file).select("image.width", "image.height", "image.data").first()
    pixels = np.frombuffer(read.data, np.uint8).reshape(read.height, read.width, 3)[:, :, ::-1]
    assert io.BytesIO(blob).read(8) == codecs.PNG_MAGIC and (codecs.packed(pixels) == shown(db, window)).all()
