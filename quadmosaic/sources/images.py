"""Image blobs and files as tables: PNG and TIFF blobs to pixel rows and back, GeoTIFF files to tiles, other image files by Spark's image source."""

from __future__ import annotations

import glob
import operator
import os
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StringType, StructField, StructType

from quadmosaic.functions import codecs
from quadmosaic.functions.codecs import png_decode, png_encode, tiff_decode, tiff_encode  # noqa: F401
from quadmosaic.functions.colors import ColorSpace, tile_size
from quadmosaic.functions.geometry import tile_grid
from quadmosaic.lineage import settled


def decoded_lines(rasters: DataFrame) -> DataFrame:
    """Rows ``tile, ty, line, error`` of the blobs (``id, raster``): one for each image line, as 0xRRGGBB integers. A blob that can't be read gives one row with ``error`` alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tile, blob in zip(pdf["id"], pdf["raster"]):
                image, _, error = codecs.decode_or_error(blob)
                if image is None:
                    yield pd.DataFrame({"tile": [tile], "ty": pd.array([None], "Int32"), "line": [None], "error": [error]})
                else:
                    yield pd.DataFrame({"tile": tile, "ty": np.arange(len(image), dtype=np.int32), "line": list(codecs.packed(image)), "error": None})

    return rasters.select("id", "raster").mapInPandas(run, "tile long, ty int, line array<int>, error string")


def decoded_pixels(rasters: DataFrame) -> DataFrame:
    """Rows ``tile, ty, x, r, g, b`` of the blobs (``id, raster``). Blobs that can't be read have none; :func:`blob_errors` names them."""
    return line_pixels(decoded_lines(rasters).where("error is null"))


def line_pixels(lines: DataFrame, *also: str) -> DataFrame:
    """Rows ``tile, ty, x, r, g, b`` of image lines (``tile, ty, line``), with the lines' columns ``also``."""
    rows = lines.select("tile", "ty", *also, F.posexplode("line").alias("x", "rgb"))
    byte = lambda s: F.shiftright("rgb", s).bitwiseAND(F.lit(255))
    return rows.select("tile", "ty", "x", byte(16).alias("r"), byte(8).alias("g"), byte(0).alias("b"), *also)


def blob_errors(rasters: DataFrame) -> DataFrame:
    """Rows ``id, error`` of the blobs that can't be read."""
    return decoded_lines(rasters).where("error is not null").select(F.col("tile").alias("id"), "error")


def blob_spaces(rasters: DataFrame) -> DataFrame:
    """``rasters`` (``id, raster``) as rows ``id, color_space``: how each blob is stored; null for one that can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spaces = [s if image is not None else None for image, s, _ in map(codecs.decode_or_error, pdf["raster"])]
            yield pd.DataFrame({"id": pdf["id"], "color_space": pd.array([None if s is None else int(s) for s in spaces], "Int32")})

    return rasters.select("id", "raster").mapInPandas(run, "id long, color_space int")


def encode_tiles(pixels: DataFrame, sizes: DataFrame | tuple[int, int], kind: str = "PNG", fit: bool = False) -> DataFrame:
    """Blobs ``id, raster`` of pixel rows ``tile, ty, x, r, g, b``; missing pixels are black.

    ``sizes`` is (width, height), or rows ``tile, width, height`` and, for kind GEOTIFF, ``left, top, px, py, srid``. With ``fit`` a blob is stored as its
    pixels allow: gray, palette, or RGB. Spark packs the pixels of a line; a task goes through sorted lines and holds one image.
    """
    geo = ("left", "top", "px", "py", "srid")
    rgb = (F.shiftleft(F.col("r").cast("int"), 16) + F.shiftleft(F.col("g").cast("int"), 8) + F.col("b").cast("int")).alias("rgb")
    lines = pixels.groupBy("tile", "ty").agg(F.array_sort(F.collect_list(F.struct(F.col("x").cast("int").alias("x"), rgb))).alias("cells"))
    lines = lines.select(F.col("tile").cast("long").alias("id"), F.col("ty").cast("int").alias("ty"), F.col("cells.x").alias("x"), F.col("cells.rgb").alias("rgb"))
    if isinstance(sizes, tuple):
        rows = lines.withColumns({"width": F.lit(sizes[0]), "height": F.lit(sizes[1])})
        own = ()
    else:
        own = tuple(c for c in geo if c in sizes.columns)
        rows = lines.join(sizes.select(F.col("tile").cast("long").alias("id"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), *own), "id")
    if kind == "GEOTIFF" and len(own) < len(geo):
        raise ValueError("a GeoTIFF needs sizes with left, top, px, py and srid")

    def finish(head, image: np.ndarray) -> pd.DataFrame:
        space = codecs.fitting_space(image, "TIFF" if "TIFF" in kind else kind) if fit else int(ColorSpace.RGB)
        return pd.DataFrame({"id": [head.id], "raster": [codecs.encode(image, kind, space, tuple(getattr(head, c) for c in own) or None)]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = image = None
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if head is None or row.id != head.id:
                    if head is not None:
                        yield finish(head, image)
                    head, image = row, np.zeros((row.height, row.width, 3), np.uint8)
                values = np.asarray(row.rgb)
                image[row.ty, np.asarray(row.x)] = np.stack([values >> 16, values >> 8 & 255, values & 255], axis=1)
        if head is not None:
            yield finish(head, image)

    # by a hash of its own: the join's shuffle by id would stand in for one by id, and Spark reads that by mapper once the join becomes a broadcast, which leaves a tile in many tasks
    return rows.repartition(F.xxhash64("id")).sortWithinPartitions("id", "ty").mapInPandas(run, "id long, raster binary")


INGESTED = "source_name string, path string, tile_id int, width int, height int, px double, py double, min_x double, min_y double, max_x double, max_y double, srid int, raster binary"
_KINDS = {"string": StringType(), "int": IntegerType(), "double": DoubleType(), "binary": BinaryType()}
_TILES = StructType([StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in f"{INGESTED}, error string".split(", "))])


def _cells(width: int, height: int, size: int) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """Sections of an axis, and (row of cells, x, y, width, height) of the cells that an image is cut into, row by row."""
    sections, tw, th = tile_grid(width, height, size)
    return sections, [(r, c * tw, r * th, min(tw, width - c * tw), min(th, height - r * th)) for r in range(sections) for c in range(sections) if c * tw < width and r * th < height]


#: Comparisons with a constant that readers of files understand.
_COMPARISONS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda a, b: a in b}


def _tests(filters: Iterable[Filter]) -> list[tuple]:
    """The comparisons (column, operation, constant) among ``filters``, which are conjoined; all others are left to Spark, as are NaN and null, which it orders in its own way."""
    known = [f for f in filters if type(f) in _COMPARISONS and len(f.attribute) == 1 and f.attribute[0] not in ("raster", "error")]
    plain = lambda v: v is not None and v == v
    return [(f.attribute[0], _COMPARISONS[type(f)], f.value) for f in known if (all(map(plain, f.value)) if type(f) is In else plain(f.value))]


def _may_pass(row: dict, tests: list[tuple]) -> bool:
    """Whether no test rules the row out, as far as it has the columns."""
    return all(row.get(c) is None or row[c] != row[c] or op(row[c], v) for c, op, v in tests)


def _cut(path: str, read, size: int, container: str, part: tuple[int, int] = (0, 1), tests: list[tuple] = ()) -> Iterator[dict]:
    """The tiles of one GeoTIFF, or of one part of its rows of cells (number, of how many). Cells that ``tests`` rule out are not read.

    A file that isn't one gives an error row, once; a part whose cells can't be read gives one where it ends.
    """
    path = _plain(path)
    own = {"source_name": _stem(path), "path": path}
    opened = False
    try:
        tiff = codecs.Tiff(read)
        h = tiff.header()
        cells = _cells(tiff.width, tiff.height, size)[1]
        opened = True
        for k, (row, x, y, w, rows) in enumerate(cells):
            if row % part[1] == part[0]:
                at = lambda i, j: (h["left"] + i * h["px"], h["top"] - j * h["py"])  # noqa: E731  equal edges of neighbours are equal numbers
                (a, t), (z, b) = at(x, y), at(x + w, y + rows)
                tile = own | {"tile_id": k, "width": w, "height": rows, "px": h["px"], "py": h["py"], "min_x": a, "min_y": b, "max_x": z, "max_y": t, "srid": h["srid"]}
                if _may_pass(tile, tests):
                    yield tile | {"raster": codecs.encode(tiff.part(x, y, w, rows), container, tiff.space)}
    except Exception as e:  # noqa: BLE001  a file that isn't a GeoTIFF is reported, not fatal
        if opened or part[0] == 0:
            yield own | {"error": f"{type(e).__name__}: {e}"}


def _stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def _plain(path: str) -> str:
    """A path of the local file system without its scheme, which not every reader puts before it."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def split_errors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("error is null").drop("error"), rows.where("error is not null").select("source_name", "path", "error")


def whole_files(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tiles of the files of which every tile could be read, and the errors of the others. ``rows`` (tiles, and rows with ``error``) are made once."""
    rows = settled(rows)
    tiles, rejected = split_errors(rows)
    return tiles.join(rejected.select("path").distinct(), "path", "left_anti"), rejected


def ingest_geotiff(files: DataFrame, size: int | None = None, container: str = "PNG") -> tuple[DataFrame, DataFrame]:
    """Tiles cut from GeoTIFF files (``path, content``, as Spark's ``binaryFile`` gives them), and the files that can't be read.

    The first is ``source_name, path, tile_id, width, height, px, py``, footprint, ``srid, raster``: one file makes one source, cut row by row, and is told from others of its name by its path. Tiles are stored
    gray, by palette or as RGB like their file. ``size`` is 512 by default and kept within 128 and 8192. For large files see :func:`geotiff_tiles`.
    """
    return split_errors(geotiff_rows(files, size, container))


def geotiff_rows(files: DataFrame, size: int | None = None, container: str = "PNG") -> DataFrame:
    """The tiles of :func:`ingest_geotiff`, and rows with ``error``, as one table."""
    size, fields = tile_size(size), to_arrow_schema(_TILES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for tile in _cut(row["path"], codecs.reader_of(row["content"]), size, container):
                    yield pa.RecordBatch.from_pylist([tile], schema=fields)

    return files.select("path", "content").mapInArrow(run, _TILES)


#: Bytes of files that make one partition: larger files are read by several, small ones together.
PARTITION_BYTES = 64 << 20


def _opened(path: str) -> pa.NativeFile:
    """A file of a mount or, by its URI, of another file system that Arrow knows, to be read at any place."""
    if "://" not in path:
        return fs.LocalFileSystem().open_input_file(_plain(path))
    scheme, place = path.split("://", 1)
    system, name = fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme) }://{quote(place, safe='/:@?=&')}")
    return system.open_input_file(name)


def _reader(f: pa.NativeFile):
    return lambda at, size: f.read_at(size, at)


def geotiff_parts(files: DataFrame, size: int | None = None, container: str = "PNG", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """:func:`geotiff_rows` for files of any size that are given by name and size (``path, length``, as ``binaryFile`` lists them).

    Files are opened by tasks alone, each of which reads the strips or tiles of its own rows of cells; a file of ``n`` times ``partition_bytes`` is read by ``n`` tasks.
    """
    size, fields = tile_size(size), to_arrow_schema(_TILES)
    n = F.greatest(F.ceil(F.col("length") / partition_bytes), F.lit(1)).cast("int")
    parts = settled(files.select("path", n.alias("n")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1))))
    tasks = files.agg(F.ceil(F.sum("length") / partition_bytes)).first()[0] or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    with _opened(row["path"]) as f:
                        for tile in _cut(row["path"], _reader(f), size, container, (row["part"], row["n"])):
                            yield pa.RecordBatch.from_pylist([tile], schema=fields)
                except OSError as e:
                    path = _plain(row["path"])
                    yield pa.RecordBatch.from_pylist([{"source_name": _stem(path), "path": path, "error": f"{type(e).__name__}: {e}"}], schema=fields)

    # as many tasks as the bytes ask for, at least those that there are; a given number isn't made smaller afterwards
    return parts.repartition(max(int(tasks), files.sparkSession.sparkContext.defaultParallelism), "path", "part").mapInArrow(run, _TILES)


class _Files(InputPartition):
    """Small files, or every ``n``-th row of cells of one file."""

    def __init__(self, paths: list[str], at: int = 0, n: int = 1):
        super().__init__((tuple(paths), at, n))
        self.paths, self.at, self.n = paths, at, n


class _BandReader(DataSourceReader):
    """Planning lists folders and asks for sizes; files are opened by the tasks alone."""

    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.pattern = _plain(options["path"])
        self.size, self.container = tile_size(int(options.get("size", 512))), options.get("container", "PNG")
        self.room = max(1, int(options.get("partitionbytes", PARTITION_BYTES)))
        self.tests: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons leave out files by name, and cells by place and size, before they are read; Spark looks at the rest once more."""
        self.tests = _tests(filters)
        return filters

    def _sizes(self) -> Iterator[tuple[str, int]]:
        for path in sorted(glob.glob(self.pattern)):
            if os.path.isdir(path):
                with os.scandir(path) as entries:
                    yield from sorted((e.path, e.stat().st_size) for e in entries if e.is_file())
            else:
                yield path, os.path.getsize(path)

    def partitions(self) -> list[_Files]:
        out, small, held = [], [], 0
        for path, size in self._sizes():
            if not _may_pass({"path": path, "source_name": _stem(path)}, self.tests):
                continue
            if size > self.room:
                n = -(-size // self.room)
                out += [_Files([path], k, n) for k in range(n)]
                continue
            if small and held + size > self.room:
                out.append(_Files(small))
                small, held = [], 0
            small.append(path)
            held += size
        return [*out, _Files(small)] if small or not out else out

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            with open(path, "rb") as f:

                def read(at: int, size: int, f=f) -> bytes:
                    f.seek(at)
                    return f.read(size)

                for tile in _cut(path, read, self.size, self.container, (partition.at, partition.n), self.tests):
                    yield tuple(tile.get(n) for n in _TILES.names)


class GeoTiffSource(DataSource):
    """``geotiff_tiles``: tiles of the GeoTIFF files of a folder or pattern on a shared mount. A large file makes several partitions, each of which reads only the strips or tiles of its own rows; small files share one.

    Comparisons of a column with a constant reach the reader (:func:`register`): a box on a file of any size reads the cells in the box alone.
    """

    @classmethod
    def name(cls) -> str:
        return "geotiff_tiles"

    def schema(self) -> StructType:
        return _TILES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _BandReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format ``geotiff_tiles`` known to a session, and lets filters reach data sources that are written in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiffSource)


def geotiff_tiles(spark: SparkSession, path: str, size: int | None = None, container: str = "PNG", partition_bytes: int = PARTITION_BYTES) -> tuple[DataFrame, DataFrame]:
    """:func:`ingest_geotiff` for files of any size on a shared mount: no task reads a whole large file, and the driver opens none."""
    register(spark)
    return split_errors(spark.read.format("geotiff_tiles").option("size", str(tile_size(size))).option("container", container).option("partitionBytes", str(partition_bytes)).load(path))


def geotiff_headers(files: DataFrame) -> DataFrame:
    """What each GeoTIFF of ``files`` (``path, content``) says of itself: sizes, layout, corner, pixel size, reference system; or ``error``."""
    schema = StructType.fromDDL("path string, width int, height int, bits int, samples int, photometric int, compression int, left double, top double, px double, py double, srid int, error string")
    fields = to_arrow_schema(schema)

    def header(row: dict) -> dict:
        try:
            return {"path": row["path"]} | codecs.Tiff(codecs.reader_of(row["content"])).header()
        except Exception as e:  # noqa: BLE001
            return {"path": row["path"], "error": f"{type(e).__name__}: {e}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([header(r) for r in batch.to_pylist()], schema=fields)

    return files.select("path", "content").mapInArrow(run, schema)


def read_images(spark: SparkSession, path: str, container: str = "PNG") -> DataFrame:
    """Rows ``source_name, width, height, raster`` of JPEG, GIF, BMP and other files that Spark's image source reads; files that it can't read are left out by it."""
    schema = StructType.fromDDL("source_name string, width int, height int, raster binary")
    fields = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                pixels = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                rgb = np.repeat(pixels, 3, axis=2) if r["nChannels"] == 1 else pixels[:, :, 2::-1]  # blue comes first
                out.append({"source_name": _stem(r["origin"]), "width": r["width"], "height": r["height"], "raster": codecs.encode(np.ascontiguousarray(rgb), container, codecs.fitting_space(rgb, container))})
            yield pa.RecordBatch.from_pylist(out, schema=fields)

    rows = spark.read.format("image").option("dropInvalid", True).load(path)
    return rows.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInArrow(run, schema)
