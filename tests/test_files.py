"""GeoTIFF files as a table with filters and as streams of names: what is not asked for is not read, and nothing is lost."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadmosaic.functions import codecs
from quadmosaic.sources import images
from quadmosaic.sources.catalog import RasterSource
from quadmosaic.streaming import geotiff_names, ingest


def picture(seed, height=600, width=300):
    return np.random.default_rng(seed).integers(0, 256, (height, width, 3), dtype=np.uint8)


def torn(blob, k):
    """``blob`` with a strip that is said to be where the file has ended."""
    tiff = codecs.Tiff(codecs.reader_of(blob))
    at = blob.index(struct.pack("<I", tiff.offsets[k]), tiff.offsets[-1] + tiff.sizes[-1])
    return blob[:at] + struct.pack("<I", len(blob)) + blob[at + 4 :]


@pytest.fixture
def folder(tmp_path):
    for name in ("x", "y"):
        (tmp_path / "in" / name).mkdir(parents=True)
    return tmp_path / "in"


def strips(blob):
    return len(codecs.Tiff(codecs.reader_of(blob)).offsets)


def test_a_box_reads_its_cells_alone(spark, folder):
    blob = images.tiff_encode(picture(1), geo=(100.0, 50.0, 1.0, 1.0, 4326))
    assert strips(blob) > 4
    (folder / "good.tif").write_bytes(blob)
    whole = images.geotiff_tiles(spark, str(folder / "good.tif"), 128)[0]
    everything = {r.tile_id: r for r in whole.collect()}
    box = lambda df: df.where("min_x < 220 and max_x > 150 and min_y < 20 and max_y > -60")
    expected = {k for k, r in everything.items() if r.min_x < 220 and r.max_x > 150 and r.min_y < 20 and r.max_y > -60}
    assert 0 < len(expected) < len(everything) / 2
    # the last strip can't be read: a box above it doesn't notice, and nothing is said of it
    (folder / "good.tif").write_bytes(torn(blob, strips(blob) - 1))
    rows = spark.read.format("geotiff_tiles").option("size", "128").load(str(folder / "good.tif"))
    assert {r.tile_id: r for r in box(rows).drop("error").collect()} == {k: everything[k] for k in expected}
    assert rows.where("error is not null").count() == 1
    assert box(rows).where("px > 1").count() == 0 and rows.where("px = 1 and tile_id in (0, 1)").count() == 2
    # files are told by name before they are planned
    (folder / "other.tif").write_bytes(blob)
    named = spark.read.format("geotiff_tiles").option("partitionBytes", "1").load(str(folder))
    assert named.rdd.getNumPartitions() == 2 * len(blob)
    assert named.where("source_name = 'none'").count() == 0


def test_filters_that_are_not_comparisons_are_left_to_spark(spark, folder):
    (folder / "a.tif").write_bytes(images.tiff_encode(picture(2, 200, 200), geo=(0.0, 50.0, 1.0, 1.0, 4326)))
    rows = spark.read.format("geotiff_tiles").option("size", "128").load(str(folder / "*.tif"))
    assert rows.count() == 4
    for text in ("tile_id = 0 or min_x > 50", "not (tile_id = 0)", "tile_id <=> 3", "source_name like 'a%' and tile_id > 1", "min_x > double('nan')", "min_x < double('nan') and tile_id = 2", "srid is null", "source_name = 'b'"):
        assert sorted(r.tile_id for r in rows.where(text).collect()) == sorted(r.tile_id for r in spark.createDataFrame(rows.collect(), rows.schema).where(text).collect())


def test_parts_are_the_rows_of_whole_files(spark, folder):
    for k, name in enumerate(("a.tif", "x/a.tif", "with blank & %20.tif")):
        (folder / name).write_bytes(images.tiff_encode(picture(k, 300 + k, 260), geo=(300.0 * k, 50.0, 1.0, 1.0, 4326)))
    (folder / "broken.tif").write_bytes(b"II*\0nothing")
    (folder / "empty.tif").write_bytes(b"")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(folder))
    plan = lambda df: df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "content" not in plan(files.select("path", "length")).split("ReadSchema")[1]
    shown = lambda df: sorted((r.path, -1 if r.tile_id is None else r.tile_id, bytes(r.raster or b"")) for r in df.collect())
    whole = shown(images.geotiff_rows(files, 128))
    for room in (50_000, 1 << 30):
        assert shown(images.geotiff_parts(files.select("path", "length"), 128, partition_bytes=room)) == whole
    assert images.geotiff_parts(files.where("false"), 128).count() == 0
    gone = spark.createDataFrame([(str(folder / "gone.tif"), 5)], "path string, length long")
    assert [(r.source_name, r.error.split(":")[0]) for r in images.geotiff_parts(gone, 128).collect()] == [("gone", "FileNotFoundError")]


def test_a_stream_of_names(spark, folder, tmp_path):
    """Files of any size by name: a stream that starts again goes on, and a file that can't be read to its end gives no tile."""
    db = str(tmp_path / "db")
    run = lambda: ingest(geotiff_names(spark, str(folder) + "/*"), db, "t", str(tmp_path / "marks"), 128, partition_bytes=50_000).awaitTermination(180)
    blob = images.tiff_encode(picture(1), geo=(0.0, 50.0, 1.0, 1.0, 4326))
    (folder / "y/sheet.tif").write_bytes(blob)
    (folder / "y/torn.tif").write_bytes(torn(blob, strips(blob) // 2))
    run()
    (folder / "x/sheet.tif").write_bytes(images.tiff_encode(picture(2), geo=(1000.0, 50.0, 1.0, 1.0, 4326)))
    run()
    run()
    source = RasterSource(spark, db, "t")
    assert sorted(n.tile_count for n in source.sources().collect()) == [25, 25]
    assert source.meta.agg(F.countDistinct("id")).first()[0] == 50 and source.meta.where("source_name like 'torn%'").count() == 0
    assert {r.source_name for r in spark.read.parquet(f"{db}/t_rejected").collect()} == {"torn"}
