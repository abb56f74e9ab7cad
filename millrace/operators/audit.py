"""Audits of a posts table and comparison of two stores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _blank(name: str) -> Column:
    return F.coalesce(F.trim(name) == "", F.lit(True))


def quality_rules() -> dict[str, Column]:
    lat, lon = F.col("from_lat"), F.col("from_lng")
    no = F.lit(False)
    blanks = {"title": "title", "content": "detail", "category": "typecategory", "city": "city", "district": "district"}
    return {f"empty_{name}_count": _blank(c) for name, c in blanks.items()} | {
        "missing_coordinates_count": lat.isNull() & lon.isNull(), "partial_coordinates_count": lat.isNull() != lon.isNull(),
        "invalid_latitude_count": F.coalesce(~lat.between(-90, 90), no), "invalid_longitude_count": F.coalesce(~lon.between(-180, 180), no), "zero_coordinate_count": F.coalesce((lat == 0) & (lon == 0), no),
    } | {f"negative_{c}_count": F.coalesce(F.col(c) < 0, no) for c in ("likes", "views", "marks", "dislikes")}


def quality(rows: DataFrame) -> DataFrame:
    """All quality counters in one pass."""
    return rows.agg(*(F.count_if(c).alias(k) for k, c in quality_rules().items()))


def issues(rows: DataFrame, limit: int) -> DataFrame:
    """The first rows that break any rule."""
    return rows.where(reduce(lambda a, b: a | b, quality_rules().values())).orderBy("id").limit(limit)


def coverage(rows: DataFrame) -> DataFrame:
    """All coverage counters in one pass."""
    named = {c: F.nullif(F.trim(c), F.lit("")) for c in ("country", "province", "city", "district")}
    city, district = named["city"], named["district"]
    return rows.agg(
        F.count_if(F.col("from_lat").isNotNull() & F.col("from_lng").isNotNull()).alias("coordinate_count"), *(F.countDistinct(v).alias(f"distinct_{c}_count") for c, v in named.items()),
        F.countDistinct(F.when(city.isNotNull() & district.isNotNull(), F.struct(city.alias("c"), district.alias("d")))).alias("distinct_city_district_count"),
        F.count_if(_blank("address")).alias("empty_address_count"), F.count_if(F.col("createtime").isNull()).alias("missing_created_at_count"), F.count_if(F.col("updatetime").isNull()).alias("missing_updated_at_count"),
        F.count_if(F.col("updatetime") < F.col("createtime")).alias("updated_before_created_count"),
    )


def overall(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("id").alias("ids"), F.min("id").alias("least"), F.max("id").alias("most"), F.count_if(~F.col("owner").rlike("^[0-9]+$")).alias("non_numeric"))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("<NULL>")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def id_differences(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Ids of one store only: ``missing`` in the target, ``extra`` there."""
    missing = source.select(key).join(target.select(key), key, "left_anti").withColumn("kind", F.lit("missing"))
    return missing.unionByName(target.select(key).join(source.select(key), key, "left_anti").withColumn("kind", F.lit("extra")))


def verdict(source: DataFrame, target: DataFrame) -> DataFrame:
    """(metric, source, target, severity) of two one-row tables of counters: an error where they differ."""

    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias(name)) for c in df.columns])
        return df.select(F.explode(pairs).alias("p")).select("p.*")

    both = long(source, "source_value").join(long(target, "target_value"), "metric", "full_outer")
    return both.withColumn("severity", F.when(F.col("source_value").eqNullSafe(F.col("target_value")), "ok").otherwise("error"))
