"""Many windows in one job give what each gives by itself."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadmosaic.functions import codecs
from quadmosaic.functions.geometry import Window
from quadmosaic.operators import levels as lv
from quadmosaic.operators.windows import REQUEST, windows_blocks, windows_tiles
from quadmosaic.sources.catalog import RasterSource, append_tiles

META = "source_name string, tile_id int, width int, height int, px double, py double, min_x double, min_y double, max_x double, max_y double, srid int, raster binary"


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("db"))
    rows = []
    for k in range(64):
        x, y = k % 8 * 64.0 - 128, -(k // 8) * 64.0 + 100
        image = np.random.default_rng(k).integers(0, 256, (64, 64, 3), dtype=np.uint8)
        rows.append(("s", k, 64, 64, 1.0, 1.0, x, y - 64, x + 64, y, 4326, bytearray(codecs.png_encode(image))))
    append_tiles(spark.createDataFrame(rows, META), folder, "t")
    db = RasterSource(spark, folder, "t").build_pyramid()
    db.background = 0x203040
    return db


def requests_of(n, seed=1):
    rnd = random.Random(seed)
    return [(i, rnd.uniform(-200, 450), rnd.uniform(-450, 150), rnd.choice([0.5, 1.0, 1.5, 2.0, 5.0, 9.0]), rnd.choice([0.7, 1.0, 3.0]), rnd.randint(64, 150), rnd.randint(64, 150)) for i in range(n)]


def test_windows_are_painted_as_one_by_one(spark, source):
    asked = requests_of(12) + [(50, 9e5, 9e5, 1.0, 1.0, 64, 64), (51, 128.0, -156.0, 0.03, 0.03, 64, 64)]
    got = {r.request_id: r for r in source.windows(spark.createDataFrame(asked, REQUEST)).collect()}
    assert set(got) == {a[0] for a in asked}
    for i, *window in asked:
        alone = source.image(Window(*window)).first()
        assert (codecs.png_decode(bytes(got[i].raster)) == codecs.png_decode(bytes(alone.raster))).all() and got[i].error is None


@pytest.mark.parametrize("hot", [1, 7, 1000])
def test_blocks_and_crowded_squares(spark, source, hot):
    """However squares are split, each pair of a window and a tile stands once; blocks make up the window."""
    asked = requests_of(40, 2)
    requests = spark.createDataFrame(asked, REQUEST)
    levels = spark.createDataFrame(source.levels, "px double, py double, tile_count long")
    hits = [tuple(r) for r in windows_tiles(source.meta, levels, requests, hot=hot).select("request_id", "id", "at_x", "at_y", "new_w", "new_h", "boxed").collect()]
    assert len(hits) == len(set(hits))
    want = set()
    for i, *window in asked[:8]:
        for r in source.tiles(Window(*window)).select("id", "at_x", "at_y", "new_w", "new_h", "boxed").collect():
            want.add((i, *r))
    assert {h for h in hits if h[0] < 8} == want
    if hot == 7:
        part = source.windows(requests.where("request_id = 3")).first()
        whole = codecs.png_decode(bytes(part.raster))
        blocks = windows_blocks(windows_tiles(source.meta, levels, requests.where("request_id = 3")).join(source.rasters.select("id", "raster"), "id"), requests.where("request_id = 3"), background=source.background, block=50)
        for b in blocks.collect():
            assert (codecs.png_decode(bytes(b.raster)) == whole[b.brow * 50 : b.brow * 50 + 50, b.bcol * 50 : b.bcol * 50 + 50]).all()


def test_ten_thousand_requests(spark, source):
    asked = requests_of(10_000, 3)
    rows = windows_tiles(source.meta, spark.createDataFrame(source.levels, "px double, py double, tile_count long"), spark.createDataFrame(asked, REQUEST).repartition(8))
    got = {r.request_id: r.n for r in rows.groupBy("request_id").agg(F.count("*").alias("n")).collect()}
    tiles = [tuple(r) for r in source.meta.select("px", "min_x", "min_y", "max_x", "max_y").collect()]
    boxes = np.array(tiles)
    sizes = sorted({t[0] for t in tiles}, reverse=True)
    for i, cx, cy, px, py, w, h in asked:
        level = min(sizes, key=lambda s: (abs(px - s), -s))
        x1, x2, y1, y2 = cx - w * px / 2, cx + w * px / 2, cy - h * py / 2, cy + h * py / 2
        n = int(((boxes[:, 0] == level) & (boxes[:, 1] <= x2) & (boxes[:, 3] >= x1) & (boxes[:, 2] <= y2) & (boxes[:, 4] >= y1)).sum())
        assert got.get(i, 0) == n


def test_only_folders_in_question_are_read(spark, tmp_path):
    rows = [("far", k, 1024, 1024, 1.0, 1.0, k % 40 * 1024.0, -(k // 40 + 1) * 1024.0, (k % 40 + 1) * 1024.0, -(k // 40) * 1024.0, 0, bytearray(b"blob")) for k in range(1600)]
    append_tiles(spark.createDataFrame(rows, META), str(tmp_path / "db"), "t")
    db = RasterSource(spark, str(tmp_path / "db"), "t")
    requests = spark.createDataFrame([(1, 33300.0, -40000.0, 1.0, 1.0, 512, 512)], REQUEST)
    found = windows_tiles(db.meta, lv.levels(db.meta), requests)
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [" in plan and "band#" in plan.split("PartitionFilters: [")[1].split("\n")[0] and found.count() == 2


def test_bad_requests_are_named(spark, source):
    for bad in ((7, 0.0, 0.0, 1.0, 1.0, 63, 64), (7, 0.0, 0.0, 0.0, 1.0, 64, 64), (7, None, 0.0, 1.0, 1.0, 64, 64)):
        with pytest.raises(Exception, match="not a window: request 7"):
            source.windows(spark.createDataFrame([bad], REQUEST)).collect()
    assert source.windows(spark.createDataFrame([], REQUEST)).count() == 0
