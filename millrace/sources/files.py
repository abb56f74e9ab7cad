"""File sources and sinks: JSON arrays, judged cases, reviewed drafts, CSV and JSON lines."""

from __future__ import annotations

import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import cleaning
from millrace.sources import shared

CASE = T.StructType([
    T.StructField("case_id", T.StringType()), T.StructField("query", T.StringType()), T.StructField("top_k", T.IntegerType()), T.StructField("recall_k", T.IntegerType()),
    T.StructField("category", T.StringType()), T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()), T.StructField("radius_km", T.DoubleType()),
    T.StructField("should_return_results", T.BooleanType()), T.StructField("relevance", T.MapType(T.StringType(), T.IntegerType())), T.StructField("binary_relevance_threshold", T.IntegerType()),
])


def scan_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file that holds one JSON array; no rows where there is no file."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases, a JSON object a line, with defaults; malformed lines, repeated ids and files without cases are errors."""
    read = spark.read.schema(CASE).option("mode", "FAILFAST").json(path)
    cases = read.where(F.col("case_id").isNotNull() & (F.trim("query") != "")).withColumns({
        "top_k": F.coalesce("top_k", F.lit(10)), "recall_k": F.coalesce("recall_k", F.lit(200)), "binary_relevance_threshold": F.coalesce("binary_relevance_threshold", F.lit(1)),
    })
    total, distinct = cases.agg(F.count(F.lit(1)), F.countDistinct("case_id")).first()
    if not total:
        raise ValueError("no cases")
    if total != distinct:
        raise ValueError("a case id is repeated")
    return cases


def qrels(cases: DataFrame) -> DataFrame:
    """One row a judged document of a case."""
    return cases.select("case_id", F.explode("relevance").alias("source_id", "grade"))


def load_drafts(spark: SparkSession, path: str) -> DataFrame:
    """Drafted queries from a CSV with a header, with or without a byte order mark."""
    raw = spark.read.option("header", True).csv(path)
    named = raw.toDF(*(c.lstrip("﻿") for c in raw.columns))
    return named.where((F.trim("query") != "") & (F.col("review_status") == "query_drafted"))


def write_csv(df: DataFrame, path: str, columns: list[str], overwrite: bool = False, mark: bool = False) -> None:
    """Chosen columns in their order, with a header; an existing path is an error unless it may be overwritten.

    ``mark`` puts a byte order mark before the first column's name in each file's header, for spreadsheet programs.
    """
    named = df.select(*columns).toDF(*(("\ufeff" if mark and not i else "") + c for i, c in enumerate(columns)))
    named.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("encoding", "UTF-8").csv(path)


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_report(spark: SparkSession, path: str, configuration: dict, summary: DataFrame, cases: DataFrame, most: int = 100_000) -> None:
    """An evaluation as one JSON file: its settings, its summary and a row a case, of which there are at most ``most``."""
    rows = cases.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} cases; write them as JSON lines")
    report = {"configuration": configuration, "summary": [r.asDict(True) for r in summary.collect()], "cases": [r.asDict(True) for r in rows]}
    shared.write_text(spark, path, json.dumps(report, ensure_ascii=False, indent=2, default=str) + "\n")


def read_report(spark: SparkSession, path: str) -> dict:
    """A report that ``write_report`` wrote; one without cases is an error."""
    text = shared.read_text(spark, path)
    if text is None:
        raise FileNotFoundError(path)
    report = json.loads(text)
    if not isinstance(report, dict) or not isinstance(report.get("cases"), list):
        raise ValueError(f"{path} has no cases")
    return report


def scan_profiles(rows: DataFrame) -> DataFrame:
    """Stored profiles as recommendation reads them: rows without an id go, ids are formatted, ages numeric, absent lists empty."""
    kept = rows.where(F.col("id").isNotNull())
    lists = [f.name for f in kept.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType))]
    empty = {c: F.coalesce(F.col(c), (F.array() if isinstance(kept.schema[c].dataType, T.ArrayType) else F.create_map()).cast(kept.schema[c].dataType)) for c in lists}
    return kept.withColumns(empty | {"user_id": cleaning.format_user_id(F.col("id").cast("string")), "age": cleaning.bucket_age(F.col("age_bucket"))})


def vector_text(vector: Column, size: int) -> Column:
    """A vector as the literal that a vector store reads; one of another size, or that is not finite, is an error."""
    fine = F.coalesce((F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    text = F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: F.format_string("%.9g", x.cast("double"))), ","), F.lit("]"))
    return F.when(fine, text).otherwise(F.raise_error(F.lit(f"a vector has {size} finite numbers")).cast("string"))


def safe_name(name: str) -> str:
    """A name that can stand in SQL, quoted."""
    if not re.fullmatch(r"[A-Za-z0-9_$.-]+", name):
        raise ValueError(f"not a safe name: {name!r}")
    return "`" + name + "`"
