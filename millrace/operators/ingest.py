"""Batches of users, items and interactions that come in from outside, checked and put into tables that grow by deltas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.sync import DeltaTable

KINDS = ("view", "like", "dislike", "rate", "purchase", "click", "share", "comment")


@dataclass(frozen=True)
class Taken:
    """How many rows of a batch were taken, and how many were not."""

    rows: int
    refused: int


def _put(target: DeltaTable, rows: DataFrame, fine: Column, order: str | None) -> Taken:
    """The last of the rows that repeat a key within a batch counts, by ``order`` and then by their place; what is refused is counted, not stored."""
    total, good = rows.agg(F.count(F.lit(1)), F.count_if(F.coalesce(fine, F.lit(False)))).first()
    if good:
        placed = rows.withColumn("__place", F.monotonically_increasing_id()).where(F.coalesce(fine, F.lit(False)))
        by = F.struct(*([order] if order else []), "__place")
        last = placed.groupBy(target.key).agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), by).alias("__row"))
        target.upsert(last.select(*(F.col("__row")[c].alias(c) for c in rows.columns)))
    return Taken(good, total - good)


def users(target: DeltaTable, rows: DataFrame, order: str | None = None) -> Taken:
    return _put(target, rows, F.col(target.key).isNotNull(), order)


def items(target: DeltaTable, rows: DataFrame, order: str | None = None) -> Taken:
    return _put(target, rows, F.col(target.key).isNotNull(), order)


def interactions(target: DeltaTable, rows: DataFrame, order: str | None = None) -> Taken:
    """Events with a user, an item and a known type; ratings from 0 to 5."""
    rated = F.when(F.col("interaction_type") == "rate", F.coalesce(F.col("rating_value").between(0, 5), F.lit(False))).otherwise(True)
    return _put(target, rows, F.col(target.key).isNotNull() & F.col("user").isNotNull() & F.col("item_id").isNotNull() & F.col("interaction_type").isin(*KINDS) & rated, order)
