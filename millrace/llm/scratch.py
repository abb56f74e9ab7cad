"""Intermediate tables in the folder that the cluster shares, named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder; a local one is set only where the session names none and runs on one machine (tests)."""
    at = spark.conf.get(_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    ``tasks``: so many tasks write, for tables that are small after a shuffle, so that there are not as many files. Their rows are dealt
    out once more for that: what makes them keeps all of its tasks, and the parts that Spark has cut a hot key into.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df = df if tasks is None else df.repartition(tasks)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def fewer(spark: SparkSession, share: int = 8) -> int:
    """Tasks for what aggregation has made much smaller than what it read: a share of the shuffle partitions."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // share)


def tasks_of(rows: int, each: int = 200_000) -> int:
    """Tasks for so many short rows."""
    return rows // each + 1


def discard(table: DataFrame) -> None:
    """Delete a table that ``written`` returned. What was derived from it must have been written in turn."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
