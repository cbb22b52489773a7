"""A data source that grows and is rebuilt: no id twice, no tile lost, nothing half written."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadmosaic.functions import codecs
from quadmosaic.functions.geometry import Window
from quadmosaic.lineage import claimed, names_in
from quadmosaic.operators.pyramid import PyramidError
from quadmosaic.sources import images
from quadmosaic.sources.catalog import PYRAMID, RasterError, RasterSource, TileStore, append_tiles
from quadmosaic.streaming import geotiff_files, ingest

META = "source_name string, tile_id int, width int, height int, px double, py double, min_x double, min_y double, max_x double, max_y double, srid int, raster binary"
GRAY = bytearray(codecs.png_encode(np.full((64, 64, 3), 90, np.uint8)))


def sheet(value, left, px=1.0, size=(200, 150)):
    image = np.full((size[1], size[0], 3), value, np.uint8)
    return images.tiff_encode(image, geo=(left, 50.0, px, px, 4326))


def put(folder, name, blob):
    (folder / name).parent.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(blob)


def read(spark, *folders):
    return images.ingest_geotiff(spark.read.format("binaryFile").option("recursiveFileLookup", True).load([str(f) for f in folders]), 128)[0]


def square(name, left, n=2, px=1.0, raster=GRAY, first=0):
    """``n`` by ``n`` tiles of 64 pixels."""
    step = 64 * px
    return [(name, first + k, 64, 64, px, px, left + k % n * step, -(k // n + 1) * step, left + (k % n + 1) * step, -(k // n) * step, 4326, raster) for k in range(n * n)]


@pytest.fixture
def db(tmp_path):
    return str(tmp_path / "db")


def ids_of(source):
    return sorted(r.id for r in source.meta.select("id").collect())


def test_files_of_one_name_are_sources_of_their_own(spark, tmp_path, db):
    put(tmp_path, "in/x/sheet.tif", sheet(10, 0.0))
    put(tmp_path, "in/y/sheet.tif", sheet(200, 200.0))
    assert append_tiles(read(spark, tmp_path / "in"), db, "t") == 8
    source = RasterSource(spark, db, "t")
    assert len(set(ids_of(source))) == len(ids_of(source)) == 8 == source.rasters.select("id").distinct().count()
    names = {r.path.rsplit("/", 2)[1]: r.source_name for r in source.files().collect()}
    assert names["x"] == "sheet" and names["y"].startswith("sheet@")
    # each file shows where it lies
    for center, value in ((100.0, 10), (300.0, 200)):
        assert {r.rgb for r in source.pixels(Window(center, 0.0, 1.0, 1.0, 64, 64)).collect()} == {value * 0x010101}
    # one more later, and none of those that are there
    put(tmp_path, "more/z/sheet.tif", sheet(77, 400.0))
    with pytest.raises(RasterError, match="already there"):
        append_tiles(read(spark, tmp_path / "in", tmp_path / "more"), db, "t")
    assert append_tiles(read(spark, tmp_path / "in", tmp_path / "more"), db, "t", skip_known=True) == 4
    source = source.reopened()
    assert len(set(ids_of(source))) == len(ids_of(source)) == 12 and source.sources().count() == 3


def test_a_stream_takes_files_by_path(spark, tmp_path, db):
    run = lambda: ingest(geotiff_files(spark, str(tmp_path / "in/*")), db, "t", str(tmp_path / "marks"), 128).awaitTermination(120)
    put(tmp_path, "in/x/sheet.tif", sheet(10, 0.0))
    run()
    put(tmp_path, "in/y/sheet.tif", sheet(200, 200.0))
    run()
    source = RasterSource(spark, db, "t")
    assert len(set(ids_of(source))) == 8 and {r.tile_count for r in source.sources().collect()} == {4}
    # the same batches again: a lost checkpoint brings no tile twice
    ingest(geotiff_files(spark, str(tmp_path / "in/*")), db, "t", str(tmp_path / "others"), 128).awaitTermination(120)
    assert ids_of(source.reopened()) == ids_of(source)


def test_tile_numbers_stand_once(spark, db):
    rows = square("s", 0.0)
    with pytest.raises(RasterError, match="tile_id 2 stands 2 times"):
        append_tiles(spark.createDataFrame([*rows, rows[2]], META), db, "t")
    append_tiles(spark.createDataFrame(rows, META), db, "t")
    with pytest.raises(RasterError, match="has tiles 0 to 3"):
        append_tiles(spark.createDataFrame(rows[3:], META), db, "t")
    assert append_tiles(spark.createDataFrame(square("s", 128.0, first=4), META), db, "t") == 4
    source = RasterSource(spark, db, "t")
    assert source.levels == [(1.0, 1.0, 8)] and len(set(ids_of(source))) == 8
    assert TileStore(spark, db, "t").swept() == []


def test_originals_of_every_size_stay(spark, db):
    append_tiles(spark.createDataFrame(square("fine", 0.0) + square("coarse", 1000.0, px=2.0), META), db, "t")
    source = RasterSource(spark, db, "t").build_pyramid()
    base = source.meta.where("source_name = 'coarse' and px = 2.0")
    assert base.count() == 4 and base.join(source.rasters, "id").count() == 4
    assert {(r.source_name, r.px, r.n) for r in source.meta.groupBy("source_name", "px").agg(F.count("*").alias("n")).collect()} == {("fine", 1.0, 4), ("fine", 2.0, 1), ("coarse", 2.0, 4), ("coarse", 4.0, 1)}
    assert source.levels == [(4.0, 4.0, 1), (2.0, 2.0, 5), (1.0, 1.0, 4)]
    top = source.build_topmost(64)
    assert top.meta.where("source_name = 'coarse' and px = 2.0").count() == 4 and top.levels[-1] == (1.0, 1.0, 4)


def test_only_changed_sources_are_made_again(spark, db):
    append_tiles(spark.createDataFrame(square("a", 0.0) + square("b", 1000.0), META), db, "t")
    one = RasterSource(spark, db, "t").build_pyramid()
    levels = lambda source: {(r.source_name, r.id) for r in source.meta.where("px > 1").collect()}
    first = levels(one)
    assert levels(one.build_pyramid()) == first
    append_tiles(spark.createDataFrame(square("b", 1128.0, first=4) + square("c", 2000.0), META), db, "t")
    two = one.reopened().build_pyramid()
    second = levels(two)
    # the square that b had is under a new one, with c's and none of a's
    assert first <= second and len(second - first) == 3
    # the result is that of making everything, but for the ids
    append_tiles(spark.createDataFrame(square("a", 0.0) + square("b", 1000.0) + square("b", 1128.0, first=4) + square("c", 2000.0), META), db, "u")
    whole = RasterSource(spark, db, "u").build_pyramid()
    shown = lambda s: sorted((r.source_name, r.px, r.min_x, r.max_y, r.tile_id, bytes(r.raster)) for r in s.meta.join(s.rasters, "id").collect())
    assert shown(two) == shown(whole) and two.levels == whole.levels and two.extent == whole.extent
    assert levels(two.build_pyramid("TIFF")).isdisjoint(second)


def grid(name, columns, rows, first):
    """Tiles of a grid at some columns and rows, each with an image of its own."""
    out = []
    for k, (r, c) in enumerate((r, c) for r in rows for c in columns):
        blob = bytearray(codecs.png_encode(np.full((64, 64, 3), (7 * r + c * 13) % 256, np.uint8)))
        out.append((name, first + k, 64, 64, 1.0, 1.0, c * 64.0, -(r + 1) * 64.0, (c + 1) * 64.0, -r * 64.0, 4326, blob))
    return out


def shown(source):
    rows = source.meta.join(source.rasters, "id").collect()
    return sorted((r.source_name, r.px, r.min_x, r.max_y, r.tile_id, r.width, r.height, bytes(r.raster)) for r in rows)


def blobs_made(source):
    """Of the tiles of pyramid levels, those that the last run made, and all."""
    return tuple(source.summary.where(F.col("made") == PYRAMID).agg(F.sum("fresh"), F.sum("n")).first())


def test_only_squares_over_new_tiles_are_made_again(spark, db):
    """A source of 16 tiles grows by columns, then by a row; both times the tiles shown are those of a data source made at once, and squares without news keep their blobs and ids."""
    parts = [grid("g", range(4), range(4), 0), grid("g", range(4, 6), range(4), 16), grid("g", range(6), range(4, 5), 24)]
    append_tiles(spark.createDataFrame(parts[0], META), db, "t")
    source = RasterSource(spark, db, "t").build_pyramid()
    assert blobs_made(source) == (5, 5)
    for k, news in ((1, 2 + 1 + 1), (2, 3 + 2 + 1)):
        before = {r.id: bytes(r.raster) for r in source.meta.where("px > 1").join(source.rasters, "id").collect()}
        append_tiles(spark.createDataFrame(parts[k], META), db, "t")
        source = source.reopened().build_pyramid()
        made, there = blobs_made(source)
        append_tiles(spark.createDataFrame([t for p in parts[: k + 1] for t in p], META), db, f"w{k}")
        whole = RasterSource(spark, db, f"w{k}").build_pyramid()
        assert shown(source) == shown(whole) and source.levels == whole.levels and source.extent == whole.extent
        ids = ids_of(source)
        assert len(ids) == len(set(ids))
        after = {r.id: bytes(r.raster) for r in source.meta.where("px > 1").join(source.rasters, "id").collect()}
        assert len(after) == there and len(set(after) & set(before)) == there - made and made == news < there / 2
        assert all(after[i] == before[i] for i in set(after) & set(before))
        # a tile that is no more isn't found by its id, the others are, wherever they lie
        gone = sorted(set(before) - set(after))
        assert (gone or k == 1) and source.blobs(gone).count() == 0
        assert {r.id: bytes(r.raster) for r in source.blobs(sorted(after)).collect()} == after
        assert TileStore(spark, db, "t").swept() == []
    w = Window(192.0, -160.0, 2.0, 2.0, 192, 160)
    assert {tuple(r) for r in source.pixels(w).collect()} == {tuple(r) for r in whole.pixels(w).collect()}
    # top-most levels are painted from kept tiles and new ones alike
    assert [x[1:] for x in shown(source.build_topmost(64)) if x[0] != "g"] == [x[1:] for x in shown(whole.build_topmost(64)) if x[0] != "g"]
    # another kind: nothing is kept, and nothing held
    other = source.reopened().build_pyramid("TIFF")
    made, there = blobs_made(other)
    assert made == there and other.store.held() == [] and set(names_in(spark, f"{db}/t_rasters")) >= {f"batch={b}" for b in other.store.batches()}
    assert {x.removeprefix("batch=") for x in names_in(spark, f"{db}/t_rasters") if x.startswith("batch=")} == set(other.store.batches())


def test_squares_that_meet_otherwise_are_made_again(spark, db):
    """A column of tiles on the left shifts all squares: none may be kept, as each has other tiles."""
    append_tiles(spark.createDataFrame(grid("g", range(1, 5), range(4), 0), META), db, "t")
    RasterSource(spark, db, "t").build_pyramid()
    append_tiles(spark.createDataFrame(grid("g", range(1), range(4), 16), META), db, "t")
    source = RasterSource(spark, db, "t").build_pyramid()
    append_tiles(spark.createDataFrame(grid("g", range(1, 5), range(4), 0) + grid("g", range(1), range(4), 16), META), db, "u")
    made, there = blobs_made(source)
    assert made == there and source.store.held() == [] and shown(source) == shown(RasterSource(spark, db, "u").build_pyramid())


def test_a_failed_pyramid_keeps_what_others_hold(spark, db):
    append_tiles(spark.createDataFrame(grid("g", range(4), range(4), 0), META), db, "t")
    RasterSource(spark, db, "t").build_pyramid()
    append_tiles(spark.createDataFrame(grid("g", range(4, 6), range(4), 16), META), db, "t")
    source = RasterSource(spark, db, "t").build_pyramid()
    seen = shown(source)
    append_tiles(spark.createDataFrame([(*t[:-1], bytearray(b"none")) for t in grid("g", range(6, 8), range(4), 24)], META), db, "t")
    with pytest.raises(PyramidError, match="source g"):
        source.reopened().build_pyramid()
    assert TileStore(spark, db, "t").swept() == [] and source.store.held()
    assert [x for x in shown(source.reopened()) if x[1] > 1] == [x for x in seen if x[1] > 1]


def test_a_broken_blob_is_an_error_and_changes_nothing(spark, db):
    good, bad = square("good", 0.0), square("bad", 1000.0, n=1, raster=bytearray(b"\x89PNG\r\n\x1a\nxx"))
    append_tiles(spark.createDataFrame(good + bad, META), db, "t")
    source = RasterSource(spark, db, "t")
    with pytest.raises(PyramidError, match="tile"):
        source.build_topmost(64)
    append_tiles(spark.createDataFrame(square("worse", 3000.0)[:3] + square("worse", 3000.0, raster=bytearray(b"none"))[3:], META), db, "t")
    with pytest.raises(PyramidError, match="worse"):
        source.reopened().build_pyramid()
    assert source.reopened().levels == [(1.0, 1.0, 9)] and TileStore(spark, db, "t").swept() == []


def test_what_is_not_committed_is_not_there(spark, db):
    append_tiles(spark.createDataFrame(square("a", 0.0), META), db, "t")
    store = TileStore(spark, db, "t")
    batch, rows = store.stage(spark.createDataFrame(square("b", 500.0), META), "base")
    source = RasterSource(spark, db, "t")
    assert source.levels == [(1.0, 1.0, 4)] and source.meta.count() == source.rasters.count() == 4
    # others go on meanwhile, with ids of their own
    append_tiles(spark.createDataFrame(square("c", 900.0), META), db, "t")
    assert store.swept() == [batch] and names_in(spark, f"{db}/t_rasters") and RasterSource(spark, db, "t").meta.count() == 8
    batch, rows = store.stage(spark.createDataFrame(square("b", 500.0), META), "base")
    store.commit([rows])
    source = RasterSource(spark, db, "t")
    assert len(set(ids_of(source))) == source.rasters.count() == 12


def test_claims(spark, tmp_path):
    path = str(tmp_path / "c/1")
    assert claimed(spark, path, "9") and not claimed(spark, path, "5")
    store = TileStore(spark, str(tmp_path), "t")
    assert [store.reserve(10), store.reserve(5), store.reserve(1)] == [1, 11, 16]


def test_opening_reads_the_log_alone(spark, db):
    append_tiles(spark.createDataFrame(square("a", 0.0, 4), META), db, "t")
    source = RasterSource(spark, db, "t").build_pyramid()
    assert source.levels == [(4.0, 4.0, 1), (2.0, 2.0, 4), (1.0, 1.0, 16)] == [(r.px, r.py, r.tile_count) for r in __import__("quadmosaic.operators.levels", fromlist=["x"]).levels(source.meta).orderBy("level").collect()]
    for df in (source.summary, source.sources(), source.files()):
        plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert "t_metadata" not in plan and "t_log" in plan


def test_blobs_by_id_come_from_their_folders(spark, db):
    append_tiles(spark.createDataFrame(square("a", 0.0, 4), META), db, "t")
    append_tiles(spark.createDataFrame(square("b", 4000.0), META), db, "t")
    source = RasterSource(spark, db, "t").build_pyramid()
    ids = [r.id for r in source.meta.where("source_name = 'b' and px = 1").collect()] + [r.id for r in source.meta.where("px = 4").collect()]
    found = source.blobs([*ids, 10**12])
    assert sorted(r.id for r in found.collect()) == sorted(ids)
    files = {f.split("t_rasters/")[1].rsplit("/", 2)[0] for f in found.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert len(files) == 2 < len(source.store.batches())
    assert "PushedFilters: [In(id" in found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert source.blobs([]).count() == 0
    assert source.summary.where(F.col("made") == PYRAMID).count() == 3


def test_small_files_are_planned_together_and_not_opened(spark, tmp_path):
    """Thousands of files make few partitions; planning doesn't open them. Files of one name in folders that a pattern names stay apart."""
    blob = sheet(5, 0.0, size=(4, 4))
    for k in range(3000):
        put(tmp_path, f"in/{k % 3}/f{k}.tif", blob)
    put(tmp_path, "in/0/broken.tif", b"II*\0nothing")
    reader = images._BandReader({"path": str(tmp_path / "in/*"), "size": "128", "partitionBytes": str(1000 * len(blob))})
    real, images.codecs.Tiff = images.codecs.Tiff, None
    try:
        parts = reader.partitions()
    finally:
        images.codecs.Tiff = real
    assert len(parts) == 4 and sum(len(p.paths) for p in parts) == 3001
    tiles, rejected = images.geotiff_tiles(spark, str(tmp_path / "in/*"), 128)
    assert tiles.count() == 3000 and [r.source_name for r in rejected.collect()] == ["broken"]
    put(tmp_path, "big/x/sheet.tif", sheet(9, 0.0, size=(300, 400)))
    put(tmp_path, "big/y/sheet.tif", sheet(8, 900.0, size=(300, 400)))
    tiles, _ = images.geotiff_tiles(spark, str(tmp_path / "big/*"), 128, partition_bytes=50_000)
    assert tiles.rdd.getNumPartitions() == 2 * -(-len(sheet(9, 0.0, size=(300, 400))) // 50_000)
    assert append_tiles(tiles, str(tmp_path / "db"), "t") == 2 * 16
    source = RasterSource(spark, str(tmp_path / "db"), "t")
    assert len(set(ids_of(source))) == 32 and {r.tile_count for r in source.sources().collect()} == {16}
