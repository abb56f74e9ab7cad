"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage works on all that its predecessor kept and returns the columns of documents; the last returns the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import decontaminate, jaccard_join, language_id, line_dedup, mixing
from millrace.llm.scratch import written

#: A document is rejected if no language has been recognised, or its words' labels are on the mean less sure than this.
LEAST_SURENESS = 0.4


def _packed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and the other columns in one: an operator's result columns cannot clash with them."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest, F.lit(0).alias("__none")).alias("__rest"))


def _unpacked(packed: DataFrame, columns: list[str]) -> DataFrame:
    return packed.select(*(c if c in ("doc_id", "text") else F.col("__rest")[c].alias(c) for c in columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in recognised languages, one or several; the main one becomes their ``lang``. The rest goes."""
    found = language_id.annotate(_packed(docs), language_id.train(docs))
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("lang_sure") >= LEAST_SURENESS))
    return _unpacked(kept.withColumn("__rest", F.col("__rest").withField("lang", F.col("lang_pred"))), docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that other documents keep."""
    found = line_dedup.dedup_lines(_packed(docs))
    changed = found.withColumn("text", F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text")))
    return _counted(_unpacked(changed, docs.columns))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest id. Documents without words group with none and stay."""
    found = jaccard_join.near_duplicates(docs.select("doc_id", "text"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("first")
    grouped = found.where(F.col("group").isNotNull()).groupBy("group").agg(first).select("first.id", "first.text_hash")
    lone = found.where(F.col("group").isNull()).select("id", "text_hash").distinct()
    # The keys are columns of one kind, so that the repeats meet where the join has brought them.
    keys = ["__key", "__none", "__hash"]
    named = [F.coalesce("id", F.lit(0)).alias("__key"), F.col("id").isNull().alias("__none"), F.col("text_hash").alias("__hash")]
    winners = grouped.withColumn("lone", F.lit(False)).union(lone.withColumn("lone", F.lit(True))).select(*named, F.col("lone").alias("__lone"))
    packed = _packed(docs).withColumns({"__key": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__none": F.col("doc_id").isNull(), "__hash": F.xxhash64(F.col("text").cast("string"))})
    kept = packed.join(winners, keys)
    # Rows that repeat the kept one in id and text go; those without words all stay.
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    return _unpacked(kept.withColumn("__n", place).where((F.col("__n") == 1) | F.col("__lone")), docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontaminate.contamination(_packed(docs), items)
    return _unpacked(found.where(~F.col("contaminated")), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document."""
    return mixing.mix(docs.select("doc_id", "text", "lang", "source")).select("doc_id", "lang", "source", "size", "source_size", "target", "taken")


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text where the table has it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_each_group),
    ("decontaminate", drop_contaminated),
    ("mixing", mix_sources),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
