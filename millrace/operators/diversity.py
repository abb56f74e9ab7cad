"""How varied lists of items are: by content, tags, types and the people that they suit. Lists are rows (``by``, item_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.recommendation import entropy, pairwise_cosines
from millrace.sources.shared import written


def _evenness(counts: DataFrame, by: str) -> DataFrame:
    """Of each list's counts ``n``: distinct ``kinds``, their ``total``, and 1 less the mean deviation from equal counts, as a share of it."""
    over = Window.partitionBy(by)
    ideal = F.sum("n").over(over) / F.count(F.lit(1)).over(over)
    rows = counts.withColumn("off", F.abs(F.col("n") - ideal) / ideal)
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total"), (1 - F.least(F.lit(1.0), F.avg("off"))).alias("even"))


def by_content(lists: DataFrame, items: DataFrame, by: str) -> DataFrame:
    """1 less the mean cosine of the tag sets of all pairs; 1 with at most one item that has tags, 0.5 where no item of the table has any."""
    if items.where(F.size("tags") > 0).isEmpty():
        return lists.select(by).distinct().withColumn("content", F.lit(0.5))
    tagged = lists.join(items.select("item_id", "tags"), "item_id").select(by, "item_id", "tags")
    found = pairwise_cosines(tagged, by)
    return lists.select(by).distinct().join(found, by, "left").select(by, (1 - F.coalesce("mean", F.lit(0.0))).alias("content"))


def by_tag(lists: DataFrame, items: DataFrame, by: str) -> DataFrame:
    """0.7 of the evenness of tags (entropy) and 0.3 of the share of distinct ones; 0.5 without tags."""
    tags = lists.join(items.select("item_id", "tags"), "item_id").select(by, F.explode("tags").alias("tag"))
    e = entropy(tags.groupBy(by, "tag").agg(F.count(F.lit(1)).alias("n")), by, "tag")
    made = e.select(by, (0.7 * F.col("evenness") + 0.3 * F.col("kinds") / F.col("total")).alias("tag"))
    return lists.select(by).distinct().join(made, by, "left").fillna(0.5, ["tag"])


def by_type(lists: DataFrame, items: DataFrame, by: str) -> DataFrame:
    """0.6 of the share of distinct types and 0.4 of their evenness; 0.5 without types."""
    counts = lists.join(items.select("item_id", "type"), "item_id").where(F.col("type").isNotNull()).groupBy(by, "type").agg(F.count(F.lit(1)).alias("n"))
    made = _evenness(counts, by).select(by, (0.6 * F.col("kinds") / F.col("total") + 0.4 * F.col("even")).alias("type"))
    return lists.select(by).distinct().join(made, by, "left").fillna(0.5, ["type"])


def by_demography(lists: DataFrame, items: DataFrame, by: str) -> DataFrame:
    """0.4 of the evenness of target genders (0.5 unless there are two) and 0.6 of ages.

    Ages: half the share of the span of all ages that some item covers, half the evenness (entropy) of how many cover each
    covered age; 0.5 without a span.
    """
    rows = lists.join(items.select("item_id", "target_gender", "target_age_min", "target_age_max"), "item_id")
    genders = _evenness(rows.where(F.col("target_gender").isNotNull()).groupBy(by, "target_gender").agg(F.count(F.lit(1)).alias("n")), by)
    ranges = rows.where(F.col("target_age_min").isNotNull() & F.col("target_age_max").isNotNull() & (F.col("target_age_min") <= F.col("target_age_max")))
    ages = ranges.select(by, F.explode(F.sequence("target_age_min", "target_age_max")).alias("age")).groupBy(by, "age").agg(F.count(F.lit(1)).alias("n"))
    span = ranges.groupBy(by).agg((F.max("target_age_max") - F.min("target_age_min")).alias("span"))
    covered = entropy(ages, by, "age").join(span, by).where("span > 0").select(by, (0.5 * F.col("kinds") / (F.col("span") + 1) + 0.5 * F.col("evenness")).alias("age"))
    gender = genders.select(by, F.when(F.col("kinds") > 1, F.col("even")).otherwise(0.5).alias("gender"))
    every = lists.select(by).distinct().join(gender, by, "left").join(covered, by, "left").fillna(0.5, ["gender", "age"])
    return every.select(by, (0.4 * F.col("gender") + 0.6 * F.col("age")).alias("demographic"))


def total(lists: DataFrame, items: DataFrame, by: str) -> DataFrame:
    """0.4 content, 0.3 tags, 0.2 types and 0.1 demography; 1 for lists of at most one item."""
    # Each part is a table before they meet: a task would hold the sums of all of them at once.
    lists = written(lists.select(by, "item_id"), "lists")
    parts = [written(f(lists, items, by), "part") for f in (by_content, by_tag, by_type, by_demography)]
    number = lists.groupBy(by).agg(F.count(F.lit(1)).alias("items"))
    both = number
    for p in parts:
        both = both.join(p, by)
    mixed: Column = 0.4 * F.col("content") + 0.3 * F.col("tag") + 0.2 * F.col("type") + 0.1 * F.col("demographic")
    return both.select(by, F.when(F.col("items") <= 1, 1.0).otherwise(mixed).alias("diversity"))
