"""Cleaning expressions for rows of source systems."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_user_id(raw: Column) -> Column:
    """``user_`` and at least four digits for numbers; anything else unchanged."""
    s = raw.cast("string")
    return F.when(s.rlike("^[0-9]+$"), F.concat(F.lit("user_"), F.when(F.length(s) < 4, F.lpad(s, 4, "0")).otherwise(s))).otherwise(s)


# Age bands with the ages that stand for them, groups, levels of income, categories and separators.
CATEGORIES = ("求助", "问答", "吐槽")
TAG_SEPARATORS, VALUE_SEPARATORS = "[,，;；]+", "[,，;；|、/]+"
BUCKET_AGE = {"18-24": 21, "25-34": 29, "35-44": 39, "45-54": 49, "55-64": 59, "65+": 70}


def bucket_age(bucket: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, age in BUCKET_AGE.items():
        out = F.when(bucket == name, age).otherwise(out)
    return out


def age_bucket(raw: Column) -> Column:
    age = raw.cast("string").try_cast("int")
    return (
        F.when(age.isNull() | (age < 18) | (age > 120), "unknown").when(age <= 24, "18-24").when(age <= 34, "25-34")
        .when(age <= 44, "35-44").when(age <= 54, "45-54").when(age <= 64, "55-64").otherwise("65+")
    )


def age_group(age: Column) -> Column:
    return F.when(age < 18, "teen").when(age < 25, "young_adult").when(age < 35, "adult").when(age < 50, "middle_age").when(age >= 50, "senior")


def income_level(amount: Column) -> Column:
    return F.when(amount < 50_000, "low").when(amount < 100_000, "medium").when(amount.isNotNull(), "high")


def optional_text(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def whole(number: Column) -> Column:
    """A count that is never null or negative."""
    return F.greatest(F.coalesce(number, F.lit(0)), F.lit(0))


def category(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return (
        F.when(t == "", "求助").when(t.isin(*CATEGORIES), t).when(F.contains(t, F.lit("问")), "问答")
        .when(F.contains(t, F.lit("吐")) | F.contains(t, F.lit("抱怨")), "吐槽").otherwise("求助")
    )


def split_tags(text: Column, separators: str = TAG_SEPARATORS) -> Column:
    """Trimmed, distinct, non-blank pieces in order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), separators), lambda t: F.trim(t)), lambda t: t != ""))


def multi_value(text: Column, limit: int = 128) -> Column:
    """A JSON array of texts, or a text with any of several separators, as distinct values of at most ``limit`` characters."""
    t = F.trim(F.coalesce(text, F.lit("")))
    listed = F.when(t.startswith("[") & t.endswith("]"), F.from_json(t, "array<string>"))
    pieces = F.coalesce(listed, F.split(t, VALUE_SEPARATORS))
    return F.array_distinct(F.filter(F.transform(pieces, lambda x: F.substring(F.trim(x), 1, limit)), lambda x: x != ""))


def repaired_update(created: Column, updated: Column) -> Column:
    """An update time that is never before the creation."""
    return F.when(created.isNull(), updated).otherwise(F.greatest(created, updated))


def source_name(table: Column) -> Column:
    s = F.regexp_replace(table, "[^A-Za-z0-9_]+", "_")
    return F.substring(F.when(s.startswith("mysql_"), s).otherwise(F.concat(F.lit("mysql_"), s)), 1, 64)
