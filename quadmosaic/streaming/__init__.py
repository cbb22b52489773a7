"""Tiles that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadmosaic.sources.catalog import append_tiles
from quadmosaic.sources.images import PARTITION_BYTES, geotiff_parts, geotiff_rows, whole_files


def geotiff_files(spark: SparkSession, path: str, per_trigger: int = 64) -> DataFrame:
    """A stream of the files that appear in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def geotiff_names(spark: SparkSession, path: str, per_trigger: int = 64) -> DataFrame:
    """A stream of the names and sizes of files that appear in a folder: the stream remembers which it has given, and reads none. Tasks open the files, in parts, so these may be of any size."""
    return geotiff_files(spark, path, per_trigger).select("path", "length")


def ingest_batch(files: DataFrame, path: str, prefix: str, size: int | None = None, container: str = "PNG", partition_bytes: int = PARTITION_BYTES) -> None:
    """Cuts files (``path`` with ``content``, or with ``length`` alone) into tiles and adds these to the data source; files that can't be read go to ``<prefix>_rejected``.

    Of a file that can't be read to its end no tile is added.

    A file is known by its path: one that the data source has already is left out, so a batch may be repeated, and files of one name in several folders are several sources.
    """
    rows = geotiff_rows(files, size, container) if "content" in files.columns else geotiff_parts(files, size, container, partition_bytes)
    tiles, rejected = whole_files(rows)
    append_tiles(tiles, path, prefix, skip_known=True)
    if not rejected.isEmpty():
        rejected.write.mode("append").parquet(f"{path}/{prefix}_rejected")


def ingest(files: DataFrame, path: str, prefix: str, checkpoint: str, size: int | None = None, container: str = "PNG", partition_bytes: int = PARTITION_BYTES):
    """Starts a query that takes arriving files into the data source at ``path``: the same tables as batch ingest makes."""
    writer = files.writeStream.foreachBatch(lambda batch, _: ingest_batch(batch, path, prefix, size, container, partition_bytes))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
