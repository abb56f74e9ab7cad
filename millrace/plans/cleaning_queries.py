"""Queries over the cleaning, text and scoring expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import cleaning, geo, scores, text, vectors
from millrace.operators import mapping
from millrace.plans.registry import query
from millrace.sources import domain


@query("format_user_id", "SELECT c_custkey, 'user_' || CASE WHEN length(c_custkey::VARCHAR) < 4 THEN lpad(c_custkey::VARCHAR, 4, '0') ELSE c_custkey::VARCHAR END AS user_id, c_name AS other FROM customer")
def format_user_id(spark, sf):
    return domain.table(spark, sf, "customer").select("c_custkey", cleaning.format_user_id(F.col("c_custkey")).alias("user_id"), cleaning.format_user_id(F.col("c_name")).alias("other"))


_AGE_SQL = "CASE WHEN a < 18 OR a > 120 THEN 'unknown' WHEN a <= 24 THEN '18-24' WHEN a <= 34 THEN '25-34' WHEN a <= 44 THEN '35-44' WHEN a <= 54 THEN '45-54' WHEN a <= 64 THEN '55-64' ELSE '65+' END"


@query("age_to_bucket", f"SELECT c_custkey, {_AGE_SQL} AS bucket FROM (SELECT c_custkey, c_custkey % 140 AS a FROM customer)")
def age_to_bucket(spark, sf):
    return domain.table(spark, sf, "customer").select("c_custkey", cleaning.age_bucket(F.col("c_custkey") % 140).alias("bucket"))


@query(
    "age_bucket_numeric",
    f"SELECT c_custkey, CASE b WHEN '18-24' THEN 21 WHEN '25-34' THEN 29 WHEN '35-44' THEN 39 WHEN '45-54' THEN 49 WHEN '55-64' THEN 59 WHEN '65+' THEN 70 END AS age "
    f"FROM (SELECT c_custkey, {_AGE_SQL} AS b FROM (SELECT c_custkey, c_custkey % 140 AS a FROM customer))",
)
def age_bucket_numeric(spark, sf):
    return domain.table(spark, sf, "customer").select("c_custkey", cleaning.bucket_age(cleaning.age_bucket(F.col("c_custkey") % 140)).alias("age"))


@query(
    "demographic_buckets",
    "SELECT c_custkey, CASE WHEN a < 18 THEN 'teen' WHEN a < 25 THEN 'young_adult' WHEN a < 35 THEN 'adult' WHEN a < 50 THEN 'middle_age' ELSE 'senior' END AS age_group, "
    "CASE WHEN b < 50000 THEN 'low' WHEN b < 100000 THEN 'medium' ELSE 'high' END AS income FROM (SELECT c_custkey, 10 + c_custkey % 70 AS a, c_acctbal * 15 AS b FROM customer)",
)
def demographic_buckets(spark, sf):
    k = F.col("c_custkey")
    return domain.table(spark, sf, "customer").select("c_custkey", cleaning.age_group(10 + k % 70).alias("age_group"), cleaning.income_level(F.col("c_acctbal") * 15).alias("income"))


_CATEGORY_SQL = (
    "CASE WHEN trim(typecategory) = '' THEN '求助' WHEN trim(typecategory) IN ('求助', '问答', '吐槽') THEN trim(typecategory) WHEN contains(typecategory, '问') THEN '问答' "
    "WHEN contains(typecategory, '吐') OR contains(typecategory, '抱怨') THEN '吐槽' ELSE '求助' END"
)
_TAGS_SQL = "list_filter(list_transform(regexp_split_to_array(tags, '[,，;；]+'), lambda t: trim(t)), lambda t: t <> '')"


@query("normalize_category", f"SELECT id, {_CATEGORY_SQL} AS category FROM raw_posts", ["raw_posts"])
def normalize_category(spark, sf):
    return domain.raw_posts(spark, sf).select("id", cleaning.category(F.col("typecategory")).alias("category"))


_DISTINCT = "array_to_string(list_filter({0}, lambda e, i: list_position({0}, e) = i), '|')"


@query("normalize_tags", f"SELECT id, {_DISTINCT.format('t')} AS tags FROM (SELECT id, {_TAGS_SQL} AS t FROM raw_posts)", ["raw_posts"])
def normalize_tags(spark, sf):
    return domain.raw_posts(spark, sf).select("id", F.array_join(cleaning.split_tags(F.col("tags")), "|").alias("tags"))


@query(
    "parse_multi_value",
    f"SELECT id, {_DISTINCT.format('t')} AS found FROM (SELECT id, list_filter(list_transform(regexp_split_to_array(tags || '/a|b、a', '[,，;；|、/]+'), lambda t: trim(t)), lambda t: t <> '') AS t FROM raw_posts)",
    ["raw_posts"],
)
def parse_multi_value(spark, sf):
    return domain.raw_posts(spark, sf).select("id", F.array_join(cleaning.multi_value(F.concat("tags", F.lit("/a|b、a"))), "|").alias("found"))


@query(
    "clean_columns",
    "SELECT id, nullif(trim(city), '') AS city, greatest(coalesce(views, 0), 0) AS views, greatest(coalesce(likes, 0), 0) AS likes, round(ratescore, 6) AS ratescore FROM raw_posts",
    ["raw_posts"],
)
def clean_columns(spark, sf):
    return domain.raw_posts(spark, sf).select(
        "id", cleaning.optional_text(F.col("city")).alias("city"), cleaning.whole(F.col("views")).alias("views"), cleaning.whole(F.col("likes")).alias("likes"), F.round("ratescore", 6).alias("ratescore")
    )


@query(
    "repair_times",
    "SELECT id, epoch(createtime)::BIGINT AS created, epoch(CASE WHEN createtime IS NULL THEN updatetime ELSE greatest(createtime, updatetime) END)::BIGINT AS updated FROM raw_posts",
    ["raw_posts"],
)
def repair_times(spark, sf):
    updated = cleaning.repaired_update(F.col("createtime"), F.col("updatetime"))
    return domain.raw_posts(spark, sf).select("id", F.unix_timestamp("createtime").alias("created"), F.unix_timestamp(updated).alias("updated"))


@query(
    "derive_source",
    "SELECT c_custkey, substr(CASE WHEN starts_with(s, 'mysql_') THEN s ELSE 'mysql_' || s END, 1, 64) AS source FROM (SELECT c_custkey, regexp_replace(c_name || ' geo.new', '[^A-Za-z0-9_]+', '_', 'g') AS s FROM customer)",
)
def derive_source(spark, sf):
    return domain.table(spark, sf, "customer").select("c_custkey", cleaning.source_name(F.concat("c_name", F.lit(" geo.new"))).alias("source"))


_MAP_SQL = f"""
SELECT id, coalesce(nullif(trim(title), ''), nullif(trim(substr(trim(detail), 1, 64)), ''), '帖子') AS title, coalesce(nullif(trim(detail), ''), nullif(trim(title), ''), '帖子') AS content,
  {_CATEGORY_SQL} AS category, {_DISTINCT.format(_TAGS_SQL)} AS tags, from_lat AS latitude, from_lng AS longitude, {', '.join(f"nullif(trim({c}), '') AS {c}" for c in ('country', 'province', 'city', 'district', 'address'))},
  {', '.join(f'greatest(coalesce({c}, 0), 0) AS {c}' for c in ('likes', 'views', 'marks', 'dislikes'))}, ratescore, status AS visible_status, epoch(createtime)::BIGINT AS created,
  epoch(CASE WHEN createtime IS NULL THEN updatetime ELSE greatest(createtime, updatetime) END)::BIGINT AS updated, 'tiezi' AS source
FROM raw_posts"""


def map_rows(raw):
    """Raw posts as canonical ones, with their number beside the source's id."""
    made = mapping.posts(raw, "tiezi").withColumn("id", F.col("source_id").cast("long"))
    flat = made.withColumns({"tags": F.array_join("tags", "|"), "created": F.unix_timestamp("created_at"), "updated": F.unix_timestamp("updated_at")})
    return flat.drop("source_id", "owner_id", "created_at", "updated_at")


@query("map_posts", _MAP_SQL, ["raw_posts"])
def map_posts(spark, sf):
    return map_rows(domain.raw_posts(spark, sf))


@query(
    "preview_text",
    "SELECT id, CASE WHEN length(s) > 40 THEN rtrim(substr(s, 1, 39)) || '…' ELSE s END AS preview FROM (SELECT id, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS s FROM posts)",
    ["posts"],
)
def preview_text(spark, sf):
    return domain.posts(spark, sf).select("id", text.preview(F.col("content"), 40).alias("preview"))


@query("normalize_text", "SELECT id, trim(regexp_replace(lower(content), '\\s+', ' ', 'g')) AS normal FROM posts", ["posts"])
def normalize_text(spark, sf):
    return domain.posts(spark, sf).select("id", text.normalize(F.col("content"), unicode=True).alias("normal"))


@query(
    "embedding_text",
    "SELECT id, concat_ws(chr(10), CASE WHEN trim(title) <> '' THEN '标题：' || trim(title) END, '类别：' || category, '标签：' || array_to_string(tags, ' '), CASE WHEN trim(content) <> '' THEN '正文：' || trim(content) END) AS text FROM posts",
    ["posts"],
)
def embedding_text(spark, sf):
    return domain.posts(spark, sf).select("id", text.embedding_text(F.col("title"), F.col("category"), F.col("tags"), F.col("content")).alias("text"))


@query("query_text", "SELECT p_partkey, '为这个句子生成表示以用于检索相关文章：' || trim(p_name) AS text FROM part")
def query_text(spark, sf):
    return domain.table(spark, sf, "part").select("p_partkey", text.query_text(F.col("p_name")).alias("text"))


@query("contains_cjk", "SELECT id, regexp_matches(typecategory, '[㐀-鿿]') AS cjk FROM raw_posts", ["raw_posts"])
def contains_cjk(spark, sf):
    return domain.raw_posts(spark, sf).select("id", text.contains_cjk(F.col("typecategory")).alias("cjk"))


_BIGRAMS = "CASE WHEN length(replace({0}, ' ', '')) = 1 THEN [replace({0}, ' ', '')] ELSE list_distinct(list_transform(generate_series(1, length(replace({0}, ' ', '')) - 1), lambda i: substr(replace({0}, ' ', ''), CAST(i AS INTEGER), 2))) END"


@query("char_bigrams", f"SELECT p_partkey, array_to_string(list_sort({_BIGRAMS.format('p_name')}), '|') AS grams FROM part")
def char_bigrams(spark, sf):
    return domain.table(spark, sf, "part").select("p_partkey", F.array_join(F.sort_array(text.char_bigrams(F.col("p_name"))), "|").alias("grams"))


FIELD_SQL = (
    "CASE WHEN {q} = '' OR {f} = '' THEN 0.0 WHEN {q} = {f} THEN 1.0 WHEN contains({f}, {q}) THEN 0.9 ELSE least(1.0, greatest("
    "0.8 * len(list_filter(list_distinct(list_filter(string_split({q}, ' '), lambda t: t <> '')), lambda t: contains({f}, t))) / greatest(len(list_distinct(list_filter(string_split({q}, ' '), lambda t: t <> ''))), 1), "
    "0.7 * len(list_intersect(" + _BIGRAMS.format("{q}") + ", " + _BIGRAMS.format("{f}") + ")) / greatest(len(" + _BIGRAMS.format("{q}") + "), 1))) END"
)


# The same for a query of at least two characters over long fields: the field has a pair of characters if it contains it.
LONG_FIELD_SQL = FIELD_SQL.replace("len(list_intersect(" + _BIGRAMS.format("{q}") + ", " + _BIGRAMS.format("{f}") + "))", "len(list_filter(" + _BIGRAMS.format("{q}") + ", lambda g: contains(replace({f}, ' ', ''), g)))")


@query("field_match_score", "SELECT p_partkey, round(" + FIELD_SQL.format(q="'blue ring ring small'", f="lower(p_name)") + ", 6)::DOUBLE AS score FROM part")
def field_match_score(spark, sf):
    return domain.table(spark, sf, "part").select("p_partkey", F.round(text.field_match(F.lit("blue ring ring small"), F.lower("p_name")), 6).alias("score"))


@query("match_count", "SELECT id, (CASE WHEN contains(lower(title), 'the') THEN 1.0 ELSE 0 END + CASE WHEN contains(lower(title), 'tion') THEN 1.0 ELSE 0 END)::DOUBLE AS n FROM posts", ["posts"])
def match_count(spark, sf):
    return domain.posts(spark, sf).select("id", text.match_count(F.col("title"), ["The", "tion"]).alias("n"))


_ROOT = "sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
HAVERSINE = f"2 * 6371.0088::DOUBLE * asin(CASE WHEN {_ROOT} > 1 THEN 1.0::DOUBLE ELSE {_ROOT} END)"


def haversine_sql(lat: float, lon: float) -> str:
    return HAVERSINE.format(lat1=f"{lat}::DOUBLE", lon1=f"{lon}::DOUBLE", lat2="latitude", lon2="longitude")


@query("haversine", f"SELECT id, round({haversine_sql(37.7, 112.7)}, 6) AS km FROM posts", ["posts"])
def haversine(spark, sf):
    return domain.posts(spark, sf).select("id", F.round(geo.haversine(F.lit(37.7), F.lit(112.7), F.col("latitude"), F.col("longitude")), 6).alias("km"))


_BOX = geo.bounding_box(37.7, 112.7, 20.0)


@query("bounding_box", f"SELECT id FROM posts WHERE latitude BETWEEN {_BOX[0]!r}::DOUBLE AND {_BOX[1]!r}::DOUBLE AND longitude BETWEEN {_BOX[2]!r}::DOUBLE AND {_BOX[3]!r}::DOUBLE", ["posts"])
def bounding_box(spark, sf):
    return domain.posts(spark, sf).where(geo.in_box(F.col("latitude"), F.col("longitude"), _BOX)).select("id")


@query(
    "geo_score",
    f"SELECT id, round(least(1.0, coalesce(0.70 * greatest(0.0, 1 - {haversine_sql(37.7, 112.7)} / 50), 0) + CASE WHEN city = 'c1' THEN 0.2 ELSE 0 END + CASE WHEN district = 'd3' THEN 0.1 ELSE 0 END), 6)::DOUBLE AS score FROM posts",
    ["posts"],
)
def geo_score(spark, sf):
    km = geo.haversine(F.lit(37.7), F.lit(112.7), F.col("latitude"), F.col("longitude"))
    return domain.posts(spark, sf).select("id", F.round(geo.geo_score(km, 50.0, F.col("city") == "c1", F.col("district") == "d3"), 6).alias("score"))


STATIC_SQL = "greatest(0.0, 0.20 * ln(1 + views) + 0.40 * ln(1 + likes) + 0.30 * ln(1 + marks) - 0.10 * ln(1 + dislikes))"
REALTIME_SQL = "0.20 * ln(1 + views_1h) + 0.25 * ln(1 + views_24h) + 0.35 * ln(1 + likes_24h) + 0.20 * ln(1 + marks_24h)"


@query("static_hot", f"SELECT id, round({STATIC_SQL}, 6)::DOUBLE AS hot FROM posts", ["posts"])
def static_hot(spark, sf):
    return domain.posts(spark, sf).select("id", F.round(scores.static_hot(*(F.col(c) for c in ("views", "likes", "marks", "dislikes"))), 6).alias("hot"))


@query("realtime_hot", f"SELECT source_id, round({REALTIME_SQL}, 6)::DOUBLE AS hot FROM counters", ["counters"])
def realtime_hot(spark, sf):
    return domain.counters(spark, sf).select("source_id", F.round(scores.realtime_hot(*(F.col(c) for c in ("views_1h", "views_24h", "likes_24h", "marks_24h"))), 6).alias("hot"))


@query("unlock_signal", "SELECT source_id, round(ln(1 + unlocks_24h), 6)::DOUBLE AS signal FROM counters", ["counters"])
def unlock_signal(spark, sf):
    return domain.counters(spark, sf).select("source_id", F.round(scores.unlock_signal(F.col("unlocks_24h")), 6).alias("signal"))


@query("calibrate_semantic", "SELECT id, round(CASE WHEN s IS NULL OR s < 0.5 THEN 0 ELSE (least(s, 1.0) - 0.5) / 0.5 END, 6)::DOUBLE AS score FROM (SELECT id, ratescore / 4.0::DOUBLE AS s FROM posts)", ["posts"])
def calibrate_semantic(spark, sf):
    return domain.posts(spark, sf).select("id", F.round(scores.calibrate(F.col("ratescore") / 4.0, 0.5), 6).alias("score"))


@query("popularity_adjustment", "SELECT id, round(greatest(0.01, 1 + 0.6::DOUBLE * 0.5 * ln(1 + 10 * (likes / 97.0::DOUBLE))), 6)::DOUBLE AS factor FROM posts", ["posts"])
def popularity_adjustment(spark, sf):
    return domain.posts(spark, sf).select("id", F.round(scores.popularity_multiplier(F.lit(0.6), F.col("likes") / F.lit(97.0)), 6).alias("factor"))


@query(
    "validate_embeddings",
    "SELECT vec_id, len(embedding) AS size, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, len(embedding) = 64 AND abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) <= 0.0001 AS valid FROM embeddings",
)
def validate_embeddings(spark, sf):
    e = F.col("embedding")
    return domain.table(spark, sf, "embeddings").select("vec_id", F.size(e).cast("long").alias("size"), F.round(vectors.norm(e), 6).alias("norm"), vectors.is_unit(e, 64).alias("valid"))
