"""Queries over audits and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import vectors
from millrace.operators import audit
from millrace.plans.registry import query
from millrace.sources import domain

_RULES = {
    **{f"empty_{k}_count": f"coalesce(trim({c}) = '', TRUE)" for k, c in (("title", "title"), ("content", "detail"), ("category", "typecategory"), ("city", "city"), ("district", "district"))},
    "missing_coordinates_count": "from_lat IS NULL AND from_lng IS NULL", "partial_coordinates_count": "(from_lat IS NULL) <> (from_lng IS NULL)", "invalid_latitude_count": "coalesce(from_lat NOT BETWEEN -90 AND 90, FALSE)",
    "invalid_longitude_count": "coalesce(from_lng NOT BETWEEN -180 AND 180, FALSE)", "zero_coordinate_count": "coalesce(from_lat = 0 AND from_lng = 0, FALSE)",
    **{f"negative_{c}_count": f"coalesce({c} < 0, FALSE)" for c in ("likes", "views", "marks", "dislikes")},
}
_QUALITY = "SELECT " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {k}" for k, c in _RULES.items()) + " FROM {0}"
_OVERALL = "SELECT count(*) AS rows, count(DISTINCT id) AS ids, min(id) AS least, max(id) AS most, count(*) FILTER (WHERE NOT regexp_matches(owner, '^[0-9]+$')) AS non_numeric FROM {0}"


@query("audit_quality", _QUALITY.format("raw_posts"), ["raw_posts"])
def audit_quality(spark, sf):
    return audit.quality(domain.raw_posts(spark, sf))


@query("audit_issue_samples", f"SELECT id FROM raw_posts WHERE {' OR '.join(f'({c})' for c in _RULES.values())} ORDER BY id LIMIT 20", ["raw_posts"])
def audit_issue_samples(spark, sf):
    return audit.issues(domain.raw_posts(spark, sf), 20).select("id")


_NAMED = ", ".join(f"count(DISTINCT nullif(trim({c}), '')) AS distinct_{c}_count" for c in ("country", "province", "city", "district"))


@query(
    "audit_coverage",
    f"SELECT count(*) FILTER (WHERE from_lat IS NOT NULL AND from_lng IS NOT NULL) AS coordinate_count, {_NAMED}, count(DISTINCT CASE WHEN trim(city) <> '' AND trim(district) <> '' THEN trim(city) || '|' || trim(district) END) AS distinct_city_district_count, "
    "count(*) FILTER (WHERE coalesce(trim(address), '') = '') AS empty_address_count, count(*) FILTER (WHERE createtime IS NULL) AS missing_created_at_count, count(*) FILTER (WHERE updatetime IS NULL) AS missing_updated_at_count, "
    "count(*) FILTER (WHERE updatetime < createtime) AS updated_before_created_count FROM raw_posts",
    ["raw_posts"],
)
def audit_coverage(spark, sf):
    return audit.coverage(domain.raw_posts(spark, sf))


@query("audit_overall", _OVERALL.format("raw_posts"), ["raw_posts"])
def audit_overall(spark, sf):
    return audit.overall(domain.raw_posts(spark, sf))


@query("audit_distribution", "SELECT coalesce(CAST(likes % 7 AS VARCHAR), '<NULL>') AS value, count(*) AS n FROM raw_posts GROUP BY 1", ["raw_posts"])
def audit_distribution(spark, sf):
    return audit.distribution(domain.raw_posts(spark, sf).select((F.col("likes") % 7).alias("likes")), "likes")


def _stores(spark, sf):
    rows = domain.raw_posts(spark, sf)
    return rows.where("id % 50 <> 7"), rows.where("id % 60 <> 11")


_DIFF_SQL = "a AS (SELECT * FROM raw_posts WHERE id % 50 <> 7), b AS (SELECT * FROM raw_posts WHERE id % 60 <> 11)"


@query("audit_id_diff", f"WITH {_DIFF_SQL} SELECT id, 'missing' AS kind FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT id, 'extra' FROM b WHERE id NOT IN (SELECT id FROM a)", ["raw_posts"])
def audit_id_diff(spark, sf):
    return audit.id_differences(*_stores(spark, sf), "id")


_LONG = "SELECT metric, v::BIGINT AS v FROM (UNPIVOT ({0}) ON COLUMNS(*) INTO NAME metric VALUE v)"


@query(
    "audit_verdict",
    f"WITH {_DIFF_SQL}, sa AS ({_LONG.format(_QUALITY.format('a'))}), sb AS ({_LONG.format(_QUALITY.format('b'))}) "
    "SELECT metric, sa.v AS source_value, sb.v AS target_value, CASE WHEN sa.v = sb.v THEN 'ok' ELSE 'error' END AS severity FROM sa JOIN sb USING (metric)",
    ["raw_posts"],
)
def audit_verdict(spark, sf):
    a, b = _stores(spark, sf)
    return audit.verdict(audit.quality(a), audit.quality(b))


@query("embedding_stats", "SELECT len(embedding) AS size, count(*) AS n, round(min(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS least, round(max(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS most FROM embeddings GROUP BY 1")
def embedding_stats(spark, sf):
    norm = vectors.norm(F.col("embedding"))
    return domain.table(spark, sf, "embeddings").groupBy(F.size("embedding").cast("long").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min(norm), 6).alias("least"), F.round(F.max(norm), 6).alias("most"))


@query("validate_posts", "SELECT id, views >= 0 AND (latitude IS NULL OR latitude BETWEEN -90 AND 90) AND category IN ('求助', '问答', '吐槽') AS valid FROM posts", ["posts"])
def validate_posts(spark, sf):
    lat = F.col("latitude")
    return domain.posts(spark, sf).select("id", ((F.col("views") >= 0) & (lat.isNull() | lat.between(-90, 90)) & F.col("category").isin(*domain.CATEGORIES)).alias("valid"))


@query("validate_profiles", "SELECT user_id, age BETWEEN 18 AND 120 AND len(interests) > 0 AS valid FROM users", ["users"])
def validate_profiles(spark, sf):
    return domain.users(spark, sf).select("user_id", (F.col("age").between(18, 120) & (F.size("interests") > 0)).alias("valid"))
