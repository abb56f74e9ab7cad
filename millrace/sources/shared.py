"""Files in folders that the driver and all executors share, reached through Hadoop's file systems."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local one is made only where none is named and Spark runs on one machine."""
    at = spark.conf.get(_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _open(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none."""
    store, at = _open(spark, path)
    if not store.exists(at):
        return None
    source = store.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under another name and put it in the old one's place, so that no reader sees half of it."""
    store, at = _open(spark, path)
    new = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.new")
    sink = store.create(new, True)
    try:
        sink.write(bytearray(text.encode()))
    finally:
        sink.close()
    if not store.rename(new, at):  # stores that do not rename over a file
        store.delete(at, False)
        if not store.rename(new, at):
            raise OSError(f"cannot write {path}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder; none is no error."""
    store, at = _open(spark, path)
    store.delete(at, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Give a file or folder a name that is not taken."""
    store, at = _open(spark, old)
    if not store.rename(at, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"cannot rename {old} to {new}")


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no folder."""
    store, at = _open(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(at)) if store.exists(at) else []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, and a lost executor costs only its own tasks."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._path = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table that ``written`` returned, when what was derived from it has been written in turn."""
    remove(table.sparkSession, table._path)
