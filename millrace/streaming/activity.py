"""Activity windows, sessions and trailing counters: one set of transformations for batch tables and streams."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KINDS = ("view", "click", "signup", "purchase", "error")


def _timed(events: DataFrame, lateness: str) -> DataFrame:
    """Events with an instant as event time, and a watermark where they stream."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", lateness) if events.isStreaming else e


def windows(events: DataFrame, length: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Activity by user and window: counts, counts by type, first and last time, and, where events have them, sessions and addresses.

    State is dropped once a window is late. Sessions are counted approximately in a stream, as exact distinct counts need all of
    them as state; addresses are a set, as there are few a user and window.
    """
    extra = []
    if "session_id" in events.columns:
        extra.append((F.approx_count_distinct("session_id", 0.01) if events.isStreaming else F.countDistinct("session_id")).alias("session_count"))
    if "ip_address" in events.columns:
        extra.append(F.array_sort(F.collect_set("ip_address")).alias("unique_ips"))
    kinds = [F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in KINDS]
    return _timed(events, lateness).groupBy(F.window("ts", length), "user_id").agg(F.count(F.lit(1)).alias("n"), *kinds, F.min("ts").alias("first"), F.max("ts").alias("last"), *extra)


def metrics(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """One row: all events and users, the distributions by type and by hour, and how long a session is on the mean."""
    whole = events.agg(F.count(F.lit(1)).alias("total"), F.countDistinct("user_id").alias("users"))
    spread = lambda key, name: events.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(F.array_sort(F.collect_list(F.struct("k", "n"))).alias(name))
    mean = sessions(events, gap).agg(F.avg("seconds").alias("mean_session"))
    # Each side is one row.
    return whole.crossJoin(spread(F.col("event_type"), "by_type")).crossJoin(spread(F.hour("ts"), "by_hour")).crossJoin(mean)


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Sessions: a user's events with no longer gap between neighbours."""
    grouped = _timed(events, lateness).groupBy(F.session_window("ts", gap).alias("session"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return grouped.withColumn("seconds", F.unix_timestamp("last") - F.unix_timestamp("first"))


def trailing(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Counters over sliding windows of 24 hours, an hour apart, by item: the streaming form of the trailing counters."""
    return _timed(events, lateness).groupBy(F.window("ts", "24 hours", "1 hour"), "source_id").agg(*(F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in KINDS))


def read_events(spark, path: str, schema) -> DataFrame:
    """A stream of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(path)


@dataclass(frozen=True)
class Kafka:
    """Where events stream from: brokers, the prefix of the topics, and how often a batch is made, in milliseconds."""

    brokers: str = "localhost:9092"
    topic_prefix: str = "events"
    checkpoint_interval: int = 5000

    def __post_init__(self):
        if not self.brokers.strip() or not self.topic_prefix.strip() or self.checkpoint_interval < 1:
            raise ValueError("brokers and topics have names, and an interval is positive")

    def options(self) -> dict[str, str]:
        """Of the ``kafka`` source: all topics of the prefix, from the first event on where nothing has been read."""
        return {"kafka.bootstrap.servers": self.brokers, "subscribePattern": re.escape(self.topic_prefix) + r"\..*", "startingOffsets": "earliest", "failOnDataLoss": "false"}

    def trigger(self) -> dict[str, str]:
        return {"processingTime": f"{self.checkpoint_interval} milliseconds"}


def parse_events(raw: DataFrame, schema) -> DataFrame:
    """The events in the JSON values of Kafka records; records that hold none go."""
    parsed = raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e"))
    return parsed.where(F.col("e.user_id").isNotNull() & F.col("e.ts").isNotNull()).select("e.*")


def read_kafka(spark, source: Kafka, schema) -> DataFrame:
    """The events of a Kafka source; needs Spark's Kafka package on the class path."""
    return parse_events(spark.readStream.format("kafka").options(**source.options()).load(), schema)


def upsert_sink(df: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...]) -> StreamingQuery:
    """Finished windows to Parquet, a folder a batch, so that a repeated batch overwrites itself: effectively once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(list(keys)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
