"""Cutting lineage, and folders for what is written on the way."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``. Only a local session, which is one machine, may go without; a cluster is told to name one."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    return folder


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, so a lost executor costs no recomputation. Spark deletes it once nothing uses it where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder or file of any file system that Spark reaches; one that isn't there is no error."""
    fs, place = _path(spark, path)
    fs.delete(place, True)


def moved(spark: SparkSession, source: str, target: str) -> None:
    """Renames a folder; its new parent is made if needed."""
    fs, place = _path(spark, source)
    _, to = _path(spark, target)
    fs.mkdirs(to.getParent())
    if not fs.rename(place, to):
        raise OSError(f"{source} can't be moved to {target}")


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _path(spark, path)
    return fs.exists(place)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it isn't there."""
    fs, place = _path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


def claimed(spark: SparkSession, path: str, text: str) -> bool:
    """Whether this call has created the file ``path`` with ``text``; False if it was there."""
    fs, place = _path(spark, path)
    try:
        out = fs.create(place, False)
    except Py4JJavaError:
        if fs.exists(place):
            return False
        raise
    try:
        out.writeBytes(text)
    finally:
        out.close()
    return True


def text_of(spark: SparkSession, path: str) -> str:
    """The first line of a small file."""
    fs, place = _path(spark, path)
    source = fs.open(place)
    try:
        return source.readLine() or ""
    finally:
        source.close()
