"""A raster data source: two Parquet tables of one prefix, the log of what belongs to them, and what can be asked of and done to them.

Tiles are written in batches, each in a folder of its own in both tables. A batch is part of the data source once the log says so: a commit is one folder of
the log, renamed into place, so a write that ends early leaves nothing to be seen. The log has one row for each source and level of a batch, with its tiles'
number, extent and range of ids. Opening folds the log and reads no tile metadata.

A tile of a pyramid has a sign, which tells the originals it was made from. A batch that makes a source's levels again takes over the tiles whose signs stay: it has their
metadata, their blobs stay where they are, and the log says which batches it holds blobs of.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quadmosaic import __version__
from quadmosaic.functions.colors import BACKGROUND_DEFAULT, TRANSPARENT_NONE
from quadmosaic.functions.geometry import BLOCK_PX, Window, level_name, storage_keys
from quadmosaic.lineage import claimed, exists, moved, names_in, removed, settled, text_of
from quadmosaic.operators import levels as lv
from quadmosaic.operators import pyramid as pyr
from quadmosaic.operators.sink import Written, write_window
from quadmosaic.operators.window import Access, best_access, paint, read_window, window_blocks, window_image
from quadmosaic.operators.windows import read_windows
from quadmosaic.sources.images import blob_errors, decoded_pixels

META_COLUMNS = ("id", "source_name", "tile_id", "width", "height", "px", "py", "min_x", "min_y", "max_x", "max_y", "srid")
RASTER_COLUMNS = ("id", "raster")
SRS_COLUMNS = ("srid", "auth_name", "auth_srid", "ref_sys_name", "proj4text")
#: What tiles were made as: originals, which nothing here ever deletes, and levels that can be made again.
BASE, PYRAMID, TOP = "base", "pyramid", "topmost"
LOG = (
    "op string, batch string, made string, origin string, path string, source_name string, px double, py double, n long, first_id long, last_id long, first_tile int, last_tile int, "
    "min_x double, min_y double, max_x double, max_y double, srid int, other_srid int, "
    "held string, fresh long"
)
_LOG_COLUMNS = tuple(c.split()[0] for c in LOG.split(", "))


#: Dropped sources up to which these go to every task.
BROADCAST_STALE = 100_000


class RasterError(ValueError):
    """A data source that can't be opened, asked or added to."""


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def _lay_out(tiles: DataFrame) -> DataFrame:
    """Tiles sorted by level and place, so that files and their row groups hold neighbours."""
    large = (F.col("width") > BLOCK_PX) | (F.col("height") > BLOCK_PX)
    keyed = tiles.withColumns(storage_keys()).withColumn("level", F.when(large, F.raise_error(F.lit(f"a tile of more than {BLOCK_PX} pixels"))).otherwise(F.col("level")))
    return keyed.repartition("level", "band", "block").sortWithinPartitions("level", "band", "block", "id")


def _stored_at(tiles: DataFrame) -> Column:
    """Where blobs of ``tiles`` are stored: of each level the bands (folders) and blocks (row groups) from the first to the last."""
    ends = tiles.withColumns(storage_keys()).groupBy("level").agg(*[f(c).alias(f"{n}_{c}") for c in ("band", "block") for n, f in (("first", F.min), ("last", F.max))])
    inside = F.lit(False)
    for e in ends.orderBy("level").collect():
        inside = inside | ((F.col("level") == e.level) & F.col("band").between(e.first_band, e.last_band) & F.col("block").between(e.first_block, e.last_block))
    return inside


class TileStore:
    """The tables ``<prefix>_metadata`` and ``<prefix>_rasters`` of a folder with their log ``<prefix>_log``, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str, prefix: str):
        self.spark, self.path, self.prefix = spark, path, prefix

    def place(self, name: str) -> str:
        return f"{self.path}/{self.prefix}_{name}"

    def summary(self) -> DataFrame | None:
        """One row for each batch, source and level that belongs to the data source; None where there is no log."""
        if not exists(self.spark, self.place("log")):
            return None
        log = self.spark.read.schema(LOG).option("recursiveFileLookup", True).parquet(self.place("log"))
        gone = log.where("op = 'drop'").select("batch", "source_name")
        return log.where("op = 'add'").join(gone, ["batch", "source_name"], "left_anti")

    def batches(self) -> list[str]:
        state = self.summary()
        return [] if state is None else [r.batch for r in state.select("batch").distinct().orderBy("batch").collect()]

    def stale(self) -> DataFrame | None:
        """Sources that were dropped out of batches which are still there for others; None if there are none."""
        log = self.spark.read.schema(LOG).option("recursiveFileLookup", True).parquet(self.place("log"))
        here = log.where("op = 'add'").select("batch", "source_name").join(log.where("op = 'drop'").select("batch", "source_name"), ["batch", "source_name"], "left_semi")
        left = settled(here.join(self.summary().select("batch").distinct(), "batch", "left_semi").distinct())
        return None if left.isEmpty() else left

    def holds(self) -> DataFrame:
        """Rows ``batch, source_name, px, py, held, first_id, last_id``: the batches that have blobs of tiles of other batches."""
        log = self.spark.read.schema(LOG).option("recursiveFileLookup", True).parquet(self.place("log"))
        return log.where("op = 'hold'").join(log.where("op = 'drop'").select("batch", "source_name"), ["batch", "source_name"], "left_anti")

    def held(self, batches: list[str] | None = None) -> list[str]:
        """The batches that have blobs of tiles of ``batches``, or of any."""
        if not exists(self.spark, self.place("log")):
            return []
        rows = self.holds() if batches is None else self.holds().where(F.col("batch").isin(batches))
        return [r.held for r in rows.select("held").distinct().orderBy("held").collect()]

    def blobs_of(self, batches: list[str]) -> DataFrame | None:
        """The blobs of the tiles of some batches, wherever they are; tiles that were made again since may have theirs among them, under ids that no tile has."""
        return self.read("rasters", sorted({*batches, *self.held(batches)}))

    def read(self, name: str, batches: list[str] | None = None) -> DataFrame | None:
        """The table ``name`` as far as the log has it, or some batches of it; one without a log is read whole."""
        if batches is None and not exists(self.spark, self.place("log")):
            return read_table(self.spark, self.place(name))
        folders = [f"{self.place(name)}/batch={b}" for b in (self.batches() if batches is None else batches)]
        return self.spark.read.option("basePath", self.place(name)).parquet(*folders) if folders else None

    def reserve(self, n: int) -> int:
        """The first of ``n`` ids that nobody else gets: a claim is a file named by its first id, which one writer alone can create, and says its last."""
        while True:
            held = sorted(names_in(self.spark, self.place("claims")))
            first = int(text_of(self.spark, f"{self.place('claims')}/{held[-1]}")) + 1 if held else 1
            if claimed(self.spark, f"{self.place('claims')}/{first:020d}", str(first + n - 1)):
                return first

    def stage(self, tiles: DataFrame, made: str, origin: DataFrame | None = None) -> tuple[str | None, DataFrame | None]:
        """Writes tiles (metadata without ``id``, ``path`` or null, and ``raster``) as a batch that nobody sees yet: its name, and its rows for the log. None without tiles.

        Tiles with signs (``sign, id, home``) are either new, ``id`` and ``home`` being null, or have their blob in the batch ``home`` under that ``id``, where it stays.

        Ids are reserved, in the order of level, source and ``tile_id``. Only levels and sources are ranked: a tile's own number follows from its ``tile_id``. A ``tile_id``
        that stands twice in a level of a source is an error.
        """
        if "path" not in tiles.columns:
            tiles = tiles.withColumn("path", F.lit(None).cast("string"))
        signs = "sign" in tiles.columns
        if not signs:
            tiles = tiles.withColumns({"sign": F.lit(None).cast("string"), "id": F.lit(None).cast("long"), "home": F.lit(None).cast("string")})
        rows = settled(tiles.select(*META_COLUMNS[1:], "path", "raster", "sign", "id", "home"))
        group = ["px", "py", "source_name"]
        sizes = settled(rows.groupBy(*group).agg(F.count("*").alias("n"), F.min("tile_id").alias("first_tile"), F.max("tile_id").alias("last_tile"), F.count_if(F.col("home").isNull()).alias("fresh")))
        n, ids = sizes.agg(F.sum("n"), F.sum(F.col("last_tile").cast("long") + 1)).first()
        if not n:
            return None, None
        twice = rows.groupBy(*group, "tile_id").count().where("count > 1 or tile_id is null or tile_id < 0").first()
        if twice:
            raise RasterError(f"source {twice.source_name}: tile_id {twice.tile_id} stands {twice['count']} times at {twice.px} x {twice.py}")
        before = F.coalesce(F.sum(F.col("last_tile").cast("long") + 1).over(W.partitionBy(F.lit(0)).orderBy(*group).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        first = settled(sizes.withColumn("first", before + self.reserve(ids)))
        placed = rows.join(first.select(*group, "first"), group).withColumn("id", F.coalesce("id", F.col("first") + F.col("tile_id")))
        batch = f"b{uuid.uuid4().hex}"
        _lay_out(placed.where("home is null")).select("level", "band", "block", "id", "raster").write.partitionBy("level", "band").parquet(f"{self.place('rasters')}/batch={batch}")
        _lay_out(placed.select(*META_COLUMNS, "path")).write.partitionBy("level", "band").parquet(f"{self.place('metadata')}/batch={batch}")
        if signs:
            placed.select("id", "source_name", "px", "py", "sign", F.coalesce("home", F.lit(batch)).alias("home")).write.parquet(f"{self.place('signs')}/batch={batch}")
        box = [f(c).alias(c) for c, f in (("min_x", F.min), ("min_y", F.min), ("max_x", F.max), ("max_y", F.max))]
        own = rows.groupBy(*group).agg(*box, F.min("path").alias("path"), F.min("srid").alias("srid"), F.max("srid").alias("other_srid")).join(first, group)
        own = own.withColumns({"op": F.lit("add"), "batch": F.lit(batch), "made": F.lit(made), "first_id": F.col("first") + F.col("first_tile"), "last_id": F.col("first") + F.col("last_tile")})
        own = own.join(origin, "source_name", "left") if origin is not None else own.withColumn("origin", F.lit(None).cast("string"))
        held = placed.where("home is not null").groupBy(*group, F.col("home").alias("held")).agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("n"))
        held = held.withColumns({"op": F.lit("hold"), "batch": F.lit(batch), "made": F.lit(made)})
        return batch, settled(own.withColumn("held", F.lit(None).cast("string")).select(*_LOG_COLUMNS).unionByName(held, allowMissingColumns=True))

    def commit(self, added: list[DataFrame], dropped: DataFrame | None = None) -> None:
        """Makes staged batches part of the data source and takes others out (rows ``batch, source_name``), in one step."""
        parts = list(added)
        if dropped is not None:
            nulls = [F.lit(None).alias(c) if c not in ("op", "batch", "source_name") else F.lit("drop").alias(c) if c == "op" else F.col(c) for c in _LOG_COLUMNS]
            parts.append(dropped.select(*nulls))
        rows = self.spark.createDataFrame([], LOG)
        for p in parts:
            rows = rows.unionByName(p.select(*_LOG_COLUMNS))
        name = uuid.uuid4().hex
        aside = f"{self.place('aside')}/{name}"
        rows.coalesce(1).write.parquet(aside)
        moved(self.spark, aside, f"{self.place('log')}/{name}")

    def discard(self, batches: list[str]) -> None:
        """Deletes the files of batches that the log doesn't have, metadata first, but for blobs that others hold."""
        held = set(self.held())
        for batch in batches:
            for name in ("metadata", "signs", *(() if batch in held else ("rasters",))):
                removed(self.spark, f"{self.place(name)}/batch={batch}")

    def swept(self) -> list[str]:
        """Deletes batches that no commit has, left by writes that ended early, and returns their names. Not to be called while somebody writes."""
        there, held = set(self.batches()), set(self.held())
        have = {name: {x.removeprefix("batch=") for x in names_in(self.spark, self.place(name)) if x.startswith("batch=")} for name in ("metadata", "signs", "rasters")}
        rest = sorted((have["metadata"] | have["signs"]) - there | have["rasters"] - there - held)
        self.discard(rest)
        return rest


def _named(tiles: DataFrame, old: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """``tiles`` with a source name for each file, and the files (``path, source_name``) that the data source has already, whose tiles are left out.

    A file has the name of its stem; of several files with one stem the first, an old one before all others, has it alone and the others get a hash of their path behind it.
    """
    files = settled(tiles.where("path is not null").select("path", F.col("source_name").alias("stem")).distinct())
    had = (old.where("path is not null").select("path", "source_name").distinct() if old is not None else files.select("path", F.col("stem").alias("source_name")).limit(0)).join(files.select("path"), "path", "left_semi")
    had = settled(had)
    taken = old.select(F.col("source_name").alias("stem")).distinct().withColumn("taken", F.lit(True)) if old is not None else files.select("stem", F.lit(True).alias("taken")).limit(0)
    first = F.row_number().over(W.partitionBy("stem").orderBy("path")) == 1
    fresh = files.join(had, "path", "left_anti").join(taken, "stem", "left").withColumn("alone", first & F.col("taken").isNull())
    names = settled(fresh.select("path", F.when(F.col("alone"), F.col("stem")).otherwise(F.concat_ws("@", "stem", F.lower(F.hex(F.xxhash64("path"))))).alias("name")))
    rows = tiles.join(had.select("path"), "path", "left_anti").join(names, "path", "left")
    return rows.withColumn("source_name", F.coalesce("name", "source_name")).drop("name"), had


def append_tiles(tiles: DataFrame, path: str, prefix: str, skip_known: bool = False) -> int:
    """Adds tiles (metadata without ``id``, and ``raster``) as originals, all or none, and returns how many there were.

    With a column ``path`` each file is a source of its own, also where files of several folders share a name; a file that the data source has already is an error, or left out
    with ``skip_known``. So are tiles whose source has tiles of the same numbers at that level.
    """
    store = TileStore(tiles.sparkSession, path, prefix)
    old = store.summary()
    base = None if old is None else settled(old.where(F.col("made") == BASE))
    if "path" in tiles.columns:
        tiles, had = _named(tiles, base)
        if not skip_known and (known := had.first()):
            raise RasterError(f"{known.path}: already there, as source {known.source_name}")
    batch, rows = store.stage(tiles, BASE)
    if batch is None:
        return 0
    if base is not None:
        other = base.select("px", "py", "source_name", F.col("first_tile").alias("a"), F.col("last_tile").alias("z"))
        if clash := rows.join(other, ["px", "py", "source_name"]).where("first_tile <= z and a <= last_tile").first():
            store.discard([batch])
            raise RasterError(f"source {clash.source_name} has tiles {clash.a} to {clash.z} at {clash.px} x {clash.py} already")
    store.commit([rows])
    return rows.agg(F.sum("n")).first()[0]


def register(spark: SparkSession, path: str, prefix: str, srid: int, auth_name: str, auth_srid: int, ref_sys_name: str, proj4text: str) -> None:
    """Adds a prefix to the spatial catalog of a folder: its metadata table and the reference system."""
    geometry = [(f"{prefix}_metadata", "geometry", 2, srid, "POLYGON", 1)]
    spark.createDataFrame(geometry, "f_table_name string, f_geometry_column string, coord_dimension int, srid int, geometry_type string, spatial_index_enabled int").write.mode("append").parquet(f"{path}/geometry_columns")
    spark.createDataFrame([(srid, auth_name, auth_srid, ref_sys_name, proj4text)], "srid int, auth_name string, auth_srid int, ref_sys_name string, proj4text string").write.mode("append").parquet(f"{path}/spatial_ref_sys")


class RasterSource:
    """An open data source. Opening checks the tables and their columns, by name in any case; it raises :class:`RasterError`.

    A folder may have a spatial catalog (``geometry_columns`` and ``spatial_ref_sys``); where it has one, the prefix must be in it. Levels, extent and sources come
    from the log; tables that something else wrote, without a log, are asked themselves.
    """

    def __init__(self, spark: SparkSession, path: str, prefix: str, transparent: int = TRANSPARENT_NONE, background: int = BACKGROUND_DEFAULT):
        self.spark, self.path, self.prefix = spark, path, prefix
        self.transparent, self.background = transparent, background
        self.store = TileStore(spark, path, prefix)
        self.summary = self.store.summary()
        batches = None if self.summary is None else self.store.batches()
        meta = lv.real_tiles(self._table("metadata", META_COLUMNS, batches))
        stale = None if self.summary is None else self.store.stale()
        self.meta = meta if stale is None else meta.join(F.broadcast(stale) if stale.count() <= BROADCAST_STALE else stale, ["batch", "source_name"], "left_anti")
        self.rasters = self._table("rasters", RASTER_COLUMNS, None if batches is None else sorted({*batches, *self.store.held()}))
        self.reference_system = self._reference_system()
        if not self.levels:
            raise RasterError(f"{prefix}: no levels")

    def _check(self, name: str, df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        have = {c.lower() for c in df.columns}
        if missing := [c for c in columns if c not in have]:
            raise RasterError(f"{name}: no column {', '.join(missing)}")
        return df

    def _table(self, name: str, columns: tuple[str, ...], batches: list[str] | None) -> DataFrame:
        df = self.store.read(name, batches)
        if df is None:
            raise RasterError(f"{self.path}: no table {self.prefix}_{name}")
        return self._check(f"{self.prefix}_{name}", df, columns)

    def _reference_system(self) -> dict | None:
        geometry, systems = (read_table(self.spark, f"{self.path}/{n}") for n in ("geometry_columns", "spatial_ref_sys"))
        if geometry is None and systems is None:
            return None
        if geometry is None or systems is None:
            raise RasterError(f"{self.path}: half a spatial catalog")
        kind = "type" if "type" in {c.lower() for c in geometry.columns} else "geometry_type"
        self._check("geometry_columns", geometry, ("f_table_name", "f_geometry_column", "coord_dimension", "srid", kind, "spatial_index_enabled"))
        row = srid_info(geometry, self._check("spatial_ref_sys", systems, SRS_COLUMNS), self.prefix).first()
        if row is None:
            raise RasterError(f"{self.prefix}: not in the spatial catalog")
        return row.asDict()

    @cached_property
    def levels(self) -> list[tuple[float, float, int]]:
        """(px, py, tiles), the coarsest first."""
        if self.summary is None:
            return [(r.px, r.py, r.tile_count) for r in lv.levels(self.meta).orderBy("level").collect()]
        rows = lv.real_tiles(self.summary).groupBy("px", "py").agg(F.sum("n").alias("n")).orderBy(F.desc("px"), F.desc("py"))
        return [(r.px, r.py, r.n) for r in rows.collect()]

    @cached_property
    def extent(self) -> tuple[float, float, float, float]:
        return tuple(lv.extent(self.meta if self.summary is None else lv.real_tiles(self.summary)).first())

    @cached_property
    def srid(self) -> int:
        return self.reference_system["srid"] if self.reference_system else (self.meta if self.summary is None else self.summary).agg(F.max("srid")).first()[0]

    @property
    def version(self) -> str:
        return __version__

    def resolution(self, level: int) -> tuple[float, float, int]:
        if not 0 <= level < len(self.levels):
            raise RasterError(f"no level {level}")
        return self.levels[level]

    def access(self, px: float, strategy: str = "auto") -> Access:
        return best_access(self.spark.createDataFrame(self.levels, "px double, py double, tile_count int"), px, strategy)

    def tiles(self, window: Window, strategy: str = "auto") -> DataFrame:
        """The tiles that a window meets, with their place on its canvas and their blobs."""
        return read_window(self.meta, self.rasters, self.access(window.px, strategy), window)

    def pixels(self, window: Window, strategy: str = "auto") -> DataFrame:
        """The window's pixels ``cy, cx, rgb``. Blobs that can't be read paint nothing; :meth:`errors` names them."""
        hits = settled(self.tiles(window, strategy))
        return paint(decoded_pixels(hits.select("id", "raster")), hits.drop("raster"), window, self.transparent, self.background)

    def errors(self, window: Window, strategy: str = "auto") -> DataFrame:
        return blob_errors(self.tiles(window, strategy).select("id", "raster"))

    def blocks(self, window: Window, kind: str = "PNG", strategy: str = "auto") -> DataFrame:
        """The window as blobs of blocks, see :func:`window_blocks`."""
        return window_blocks(self.tiles(window, strategy), window, kind, self.transparent, self.background)

    def windows(self, requests: DataFrame, kind: str = "PNG", strategy: str = "auto") -> DataFrame:
        """Many windows at once (``request_id, cx, cy, px, py, width, height``) as blobs of blocks, see :func:`windows_blocks`."""
        levels = self.spark.createDataFrame(self.levels, "px double, py double, tile_count long")
        return read_windows(self.meta, self.rasters, levels, requests, kind, self.transparent, self.background, strategy)

    def image(self, window: Window, kind: str = "PNG", strategy: str = "auto") -> DataFrame:
        """The window as one blob of ``kind`` PNG, TIFF, GEOTIFF, or a raw format (RGB, RGBA, ARGB, BGR, BGRA)."""
        return window_image(settled(self.tiles(window, strategy)), window, kind, self.transparent, self.background, self.srid)

    def write_image(self, window: Window, file: str, kind: str = "PNG", strategy: str = "auto", quantized: bool = False) -> Written:
        """Writes the window to one file of ``kind`` PNG, TIFF, GEOTIFF or a raw format on a shared mount, by many tasks: see :func:`write_window`."""
        return write_window(self.tiles(window, strategy), window, file, kind, self.transparent, self.background, self.srid, quantized=quantized)

    def sources(self) -> DataFrame:
        if self.summary is None:
            return lv.sources(self.meta)
        return lv.real_tiles(self.summary).groupBy("source_name").agg(F.sum("n").alias("tile_count")).orderBy("source_name")

    def files(self) -> DataFrame:
        """Rows ``source_name, path``: the files that sources were made from."""
        rows = self.summary if self.summary is not None else self.meta.limit(0).withColumn("path", F.lit(None).cast("string"))
        return rows.where("path is not null").select("source_name", "path").distinct()

    def blobs(self, ids: list[int]) -> DataFrame:
        """Rows ``id, raster`` of some tiles. The log's ranges of ids lead to the folders of their batches and levels; no other is read."""
        wanted = F.col("id").isin([int(i) for i in ids])
        if self.summary is None:
            return self.rasters.where(wanted).select("id", "raster")
        within = F.exists(F.array(*map(F.lit, map(int, ids))).cast("array<bigint>"), lambda i: i.between(F.col("first_id"), F.col("last_id")))
        level = level_name(F.col("px"), F.col("py")).alias("level")
        places = self.summary.where(within).select("batch", level).distinct().collect()
        inside = F.lit(False)
        for batch in sorted({p.batch for p in places}):
            inside = inside | ((F.col("batch") == batch) & F.col("level").isin(sorted(p.level for p in places if p.batch == batch)))
        found = self.rasters.where(inside & wanted).select("id", "raster")
        # a batch that is held has blobs of tiles that are no more: signs tell which are still there
        kept = self.store.holds().where(within).select("batch", "held", level).distinct().collect()
        if not kept:
            return found
        signs = self.store.read("signs", sorted({k.batch for k in kept})).where(wanted).select("id", F.col("home").alias("batch"))
        blobs = self.rasters.where(F.col("batch").isin(sorted({k.held for k in kept})) & F.col("level").isin(sorted({k.level for k in kept})) & wanted)
        return found.unionByName(blobs.join(signs, ["id", "batch"], "left_semi").select("id", "raster")).distinct()

    def reopened(self) -> RasterSource:
        return RasterSource(self.spark, self.path, self.prefix, self.transparent, self.background)

    def _log(self) -> DataFrame:
        if self.summary is None:
            raise RasterError(f"{self.prefix}: a data source without a log can't be changed")
        return settled(self.summary)

    def _replace(self, added: list[tuple[str, DataFrame]], old: DataFrame) -> RasterSource:
        """Commits new batches and takes old rows out of the log; then nothing that the log still has is in the way of deleting batches that are left whole."""
        before = {*self.store.batches(), *self.store.held()}
        self.store.commit([rows for _, rows in added], old.select("batch", "source_name").distinct())
        self.store.discard(sorted(before - set(self.store.batches())))
        return self.reopened()

    def _signs(self, made: DataFrame) -> DataFrame:
        """The tiles of the batches and sources ``made``: ``source_name, up_px, up_py, sign, id, home``."""
        batches = [r.batch for r in made.select("batch").distinct().collect()]
        signs = self.store.read("signs", [b for b in batches if exists(self.spark, f"{self.store.place('signs')}/batch={b}")])
        if signs is None:
            return self.spark.createDataFrame([], "source_name string, up_px double, up_py double, sign string, id long, home string")
        own = signs.join(made.select("batch", "source_name").distinct(), ["batch", "source_name"], "left_semi")
        return own.select("source_name", F.col("px").alias("up_px"), F.col("py").alias("up_py"), "sign", "id", "home")

    def build_pyramid(self, kind: str = "PNG") -> RasterSource:
        """Makes the levels over each source's finest tiles; returns the data source as it is then.

        Only sources whose originals have changed since their levels were made, or whose levels are of another ``kind``, are looked at; of these only squares over new originals, or
        whose tiles now meet in other ways, are made anew. All other tiles, and all originals of any size, stay as they are, and so does everything if a source's tiles don't make squares or can't be decoded: that is an error before the commit. Top-most
        levels go: :meth:`build_topmost` makes them again. Levels are made one after the other, each from the one before.
        """
        log = self._log()
        base = log.where((F.col("made") == BASE) & (F.col("px") > 0) & (F.col("py") > 0))
        origin = settled(base.groupBy("source_name").agg(F.concat_ws(":", F.lit(kind), F.array_sort(F.collect_set("batch"))).alias("origin"), F.max(F.struct(-F.col("px"), -F.col("py"))).alias("finest")))
        made = log.where(F.col("made") == PYRAMID)
        same = made.select("source_name", "origin").distinct().join(origin, ["source_name", "origin"], "left_semi")
        mixed = base.groupBy("source_name").agg(F.min("srid").alias("a"), F.max("other_srid").alias("b")).where("a <> b").first()
        if mixed:
            raise pyr.PyramidError(f"source {mixed.source_name}: tiles of several reference systems")
        todo = origin.join(same.select("source_name"), "source_name", "left_anti")
        finest = settled(todo.select("source_name", (-F.col("finest.col1")).alias("px"), (-F.col("finest.col2")).alias("py")))
        keep = base.select("batch").distinct()
        # metadata of the sources to be done, from originals alone
        names = [r.batch for r in keep.collect()]
        meta = self.store.read("metadata", names).join(finest, ["source_name", "px", "py"], "left_semi")
        rasters = self.store.read("rasters", names)
        indexed = settled(pyr.grid_index(meta)).withColumn("sign", F.sha2(F.concat_ws(":", F.lit(kind), "id"), 256))
        known = self._signs(made.join(todo.select("source_name"), "source_name", "left_semi"))
        srids = base.groupBy("source_name").agg(F.min("srid").alias("srid"))
        top = indexed.agg(F.max("n_levels")).first()[0] or 0
        staged: list[tuple[str, DataFrame]] = []
        try:
            for k in range(1, top + 1):
                current = indexed.where(F.col("n_levels") >= k)
                squares = pyr.checked(pyr.assemble(current).join(pyr.signed(current), [*pyr.SQUARE]).withColumns({"up_px": F.col("px") * 2, "up_py": F.col("py") * 2}))
                found = settled(squares.join(known, ["source_name", "up_px", "up_py", "sign"], "left"))
                fresh = found.where("id is null")
                children = pyr.squares_of(current).join(fresh.select(*pyr.SQUARE), [*pyr.SQUARE], "left_semi")
                made_now = settled(pyr.next_blobs(current, rasters.where(_stored_at(children)), kind, fresh))
                if wrong := made_now.where("error is not null").select("source_name", "error").first():
                    raise pyr.PyramidError(f"source {wrong.source_name}: {wrong.error}")
                kept = found.where("id is not null").withColumns({"px": F.col("up_px"), "py": F.col("up_py")}).select(*pyr.PLACED, "sign", "id", "home")
                level = settled(made_now.drop("error").unionByName(kept, allowMissingColumns=True))
                numbers = pyr.numbered(level).join(srids, "source_name")
                batch, rows = self.store.stage(numbers.withColumn("tile_id", F.col("tile_id").cast("int")), PYRAMID, origin.select("source_name", "origin"))
                staged.append((batch, rows))
                # the next level takes the ids that the tiles now have
                ids = self.store.read("metadata", [batch]).select("id", "source_name", "min_x", "max_y")
                rasters = self.store.read("rasters", [batch, *(r.held for r in rows.where("op = 'hold'").select("held").distinct().collect())])
                indexed = settled(level.drop("raster", "id", "home").join(ids, ["source_name", "min_x", "max_y"]))
        except Exception:
            self.store.discard([b for b, _ in staged])
            raise
        # a source may have levels no more, or never had any
        old = settled(made.join(same.select("source_name"), "source_name", "left_anti").unionByName(log.where(F.col("made") == TOP)))
        return self._replace(staged, old) if staged or not old.isEmpty() else self

    def build_topmost(self, size: int = 512, kind: str = "PNG") -> RasterSource:
        """Makes the top-most levels anew over the coarsest level of the sources, until one cell holds everything. A tile that can't be decoded is an error before anything changes."""
        log = self._log()
        own = log.where(F.col("made") != TOP)
        top = lv.base_and_top(own).first()
        px, py, cells = top.top_px, top.top_py, 2
        coarsest = settled(own.where((F.col("px") == px) & (F.col("py") == py)))
        batches = [r.batch for r in coarsest.select("batch").distinct().collect()]
        # the log may have dropped a source out of a batch
        meta = self.store.read("metadata", batches).join(coarsest.select("batch", "source_name"), ["batch", "source_name"], "left_semi")
        rasters, box = self.store.blobs_of(batches), tuple(lv.extent(coarsest).first())
        staged: list[tuple[str, DataFrame]] = []
        try:
            while cells > 1:
                level = settled(pyr.topmost_blobs(meta, rasters, box, px, py, size, kind, self.transparent, self.background))
                if wrong := level.where("error is not null").select("error").first():
                    raise pyr.PyramidError(f"{lv.TOPMOST}: {wrong.error}")
                batch, rows = self.store.stage(level.drop("error").withColumn("srid", F.lit(self.srid)), TOP)
                if batch is None:
                    break
                staged.append((batch, rows))
                cells = rows.agg(F.sum("n")).first()[0]
                px, py, meta, rasters = px * 2, py * 2, self.store.read("metadata", [batch]), self.store.read("rasters", [batch])
        except Exception:
            self.store.discard([b for b, _ in staged])
            raise
        return self._replace(staged, log.where(F.col("made") == TOP))


def srid_info(geometry_columns: DataFrame, spatial_ref_sys: DataFrame, prefix: str) -> DataFrame:
    """The reference system of a prefix's metadata table, found in any case."""
    own = geometry_columns.where(F.lower("f_table_name") == f"{prefix}_metadata".lower())
    return own.join(spatial_ref_sys, "srid").select("srid", "auth_name", "auth_srid", "ref_sys_name", "proj4text")


def prefixes_like(pyramids: DataFrame, prefix: str) -> DataFrame:
    """The rows of a table of levels (``table_prefix``) whose prefix matches in any case, ``_`` and ``%`` standing for any character and any characters."""
    return pyramids.where(F.col("table_prefix").ilike(prefix))
