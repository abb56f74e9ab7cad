"""Queries over scans, recall routes, merging, and ordered look-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import vectors
from millrace.operators import recall, vector_index
from millrace.plans.cleaning_queries import haversine_sql
from millrace.plans.registry import query
from millrace.sources import domain

_HERE = recall.Filters(visible_statuses=("0", "1", " 1 "), latitude=37.7, longitude=112.7, radius_km=60.0)
_BOX = _HERE.box
_BOX_SQL = f"latitude BETWEEN {_BOX[0]!r}::DOUBLE AND {_BOX[1]!r}::DOUBLE AND longitude BETWEEN {_BOX[2]!r}::DOUBLE AND {_BOX[3]!r}::DOUBLE"
_KM = haversine_sql(37.7, 112.7)


@query("filter_business", "SELECT id FROM posts WHERE category = '问答' AND city = 'c2' AND visible_status IN ('1', '2')", ["posts"])
def filter_business(spark, sf):
    f = recall.Filters(category="问答", city=" c2 ", visible_statuses=("1", "2"))
    return domain.posts(spark, sf).where(f.column()).select("id")


@query("filter_radius", f"SELECT id, round({_KM}, 4) AS distance_km FROM posts WHERE {_KM} <= 60 AND visible_status IN ('0', '1')", ["posts"])
def filter_radius(spark, sf):
    return recall.within_radius(domain.posts(spark, sf), _HERE).select("id", F.round("distance_km", 4).alias("distance_km"))


@query("recall_freshness", f"SELECT id, source_id FROM posts WHERE visible_status IN ('0', '1') AND {_BOX_SQL} ORDER BY updated_at DESC NULLS LAST, views DESC, id DESC LIMIT 200", ["posts"])
def recall_freshness(spark, sf):
    return recall.freshest(domain.posts(spark, sf), _HERE, 200).select("id", "source_id")


@query("keyset_batch", "SELECT doc_id, source FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 50")
def keyset_batch(spark, sf):
    return domain.table(spark, sf, "documents").where(F.col("doc_id") > 100).select("doc_id", "source").orderBy("doc_id").limit(50)


@query("keyset_users", "SELECT c_custkey, c_name FROM customer WHERE c_custkey > 20 ORDER BY c_custkey LIMIT 40")
def keyset_users(spark, sf):
    return domain.table(spark, sf, "customer").where(F.col("c_custkey") > 20).select("c_custkey", "c_name").orderBy("c_custkey").limit(40)


@query("semi_join_in_list", "SELECT id, owner_id FROM posts WHERE owner_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 10 = 3)", ["posts"])
def semi_join_in_list(spark, sf):
    chosen = domain.table(spark, sf, "customer").where(F.col("c_custkey") % 10 == 3).select(F.col("c_custkey").cast("string").alias("owner_id"))
    return domain.posts(spark, sf).select("id", "owner_id").join(chosen, "owner_id", "left_semi")


@query("point_lookup", "SELECT id, source, category, views FROM posts WHERE source = 'src7' AND source_id = '7'", ["posts"])
def point_lookup(spark, sf):
    return domain.posts(spark, sf).where((F.col("source") == "src7") & (F.col("source_id") == "7")).select("id", "source", "category", "views").limit(1)


_KEYS_SQL = "keys AS (SELECT 'src' || (k % 20) AS source, CAST(k AS VARCHAR) AS source_id, min(o) AS ordinal FROM (SELECT (o * 37) % 150 AS k, o FROM range(120) t(o)) GROUP BY ALL)"


def _keys(spark):
    k = F.col("id") * 37 % 150
    return spark.range(120).select(F.concat(F.lit("src"), (k % 20).cast("string")).alias("source"), k.cast("string").alias("source_id"), F.col("id").alias("ordinal"))


@query("hydrate_by_keys", f"WITH {_KEYS_SQL} SELECT ordinal, id, views FROM posts JOIN keys USING (source, source_id)", ["posts"])
def hydrate_by_keys(spark, sf):
    return recall.multi_get(domain.posts(spark, sf).select("source", "source_id", "id", "views"), _keys(spark)).select("ordinal", "id", "views")


@query(
    "realtime_features_join",
    "SELECT id, coalesce(views_1h, 0) AS views_1h, coalesce(views_24h, 0) AS views_24h, coalesce(likes_24h, 0) AS likes_24h, coalesce(marks_24h, 0) AS marks_24h, coalesce(unlocks_24h, 0) AS unlocks_24h FROM posts LEFT JOIN counters USING (source_id)",
    ["posts", "counters"],
)
def realtime_features_join(spark, sf):
    return with_counters(domain.posts(spark, sf).select("id", "source_id"), domain.counters(spark, sf)).drop("source_id")


COUNTERS = ("views_1h", "views_24h", "likes_24h", "marks_24h", "unlocks_24h")


def with_counters(rows, counters):
    """Rows with their activity counters; absent, invalid and negative ones are 0."""
    joined = rows.join(counters, "source_id", "left")
    return joined.withColumns({c: F.greatest(F.coalesce(F.col(c).try_cast("long"), F.lit(0)), F.lit(0)) for c in COUNTERS})


@query("missing_embeddings", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) ORDER BY doc_id LIMIT 100")
def missing_embeddings(spark, sf):
    have = domain.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return domain.table(spark, sf, "documents").select("doc_id").join(have, "doc_id", "left_anti").orderBy("doc_id").limit(100)


@query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("documents", "customer", "part", "events", "embeddings")))
def table_counts(spark, sf):
    parts = [domain.table(spark, sf, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in ("documents", "customer", "part", "events", "embeddings")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("max_numeric_source_id", "SELECT coalesce(max(TRY_CAST(source_id AS BIGINT)), 0) AS cursor FROM posts WHERE regexp_matches(source_id, '^[0-9]+$')", ["posts"])
def max_numeric_source_id(spark, sf):
    return domain.posts(spark, sf).where(F.col("source_id").rlike("^[0-9]+$")).agg(F.coalesce(F.max(F.col("source_id").try_cast("long")), F.lit(0)).alias("cursor"))


@query("inverted_index", "SELECT t AS term, count(*) AS posts FROM (SELECT id, unnest(list_distinct(tags)) AS t FROM posts) GROUP BY t", ["posts"])
def inverted_index(spark, sf):
    return recall.inverted_index(domain.posts(spark, sf), "tags").groupBy("term").agg(F.count(F.lit(1)).alias("posts"))


@query("tag_match_count", "SELECT id, len(list_filter(tags, lambda t: t IN ('en', 'm3', 'src5'))) AS n FROM posts", ["posts"])
def tag_match_count(spark, sf):
    return domain.posts(spark, sf).select("id", F.size(F.filter("tags", lambda t: t.isin("en", "m3", "src5"))).cast("long").alias("n"))


TERMS = ["the", "tion"]
TAG_TERMS = ["en", "m3", "src5"]
_LEX_SQL = """
own AS (
  SELECT id, source_id, updated_at, latitude, longitude, (contains(lower(title), 'the')::INT + contains(lower(title), 'tion')::INT)::DOUBLE AS in_title,
    (contains(lower(content), 'the')::INT + contains(lower(content), 'tion')::INT)::DOUBLE AS in_content, len(list_filter(tags, lambda t: t IN ('en', 'm3', 'src5')))::DOUBLE AS in_tags
  FROM posts WHERE visible_status IN ('0', '1')
), met AS (
  SELECT * FROM (SELECT * FROM own WHERE in_title > 0 ORDER BY in_title DESC, updated_at DESC NULLS LAST, id DESC LIMIT 100)
  UNION SELECT * FROM (SELECT * FROM own WHERE in_content > 0 ORDER BY in_content DESC, updated_at DESC NULLS LAST, id DESC LIMIT 100)
  UNION SELECT * FROM (SELECT * FROM own WHERE in_tags > 0 ORDER BY in_tags DESC, updated_at DESC NULLS LAST, id DESC LIMIT 100)
), lex AS (
  SELECT *, least(1.0::DOUBLE, in_title / 2) AS t, least(1.0::DOUBLE, 0.8::DOUBLE * in_content / 2) AS c, least(1.0::DOUBLE, in_tags / 2) AS g FROM met
)"""


@query("recall_lexical_routes", f"WITH {_LEX_SQL} SELECT id, in_title, in_content, in_tags FROM met", ["posts"])
def recall_lexical_routes(spark, sf):
    found = recall.lexical_routes(domain.posts(spark, sf), TERMS, TAG_TERMS, recall.Filters(visible_statuses=("0", "1")), 100)
    return found.select("id", "in_title", "in_content", "in_tags")


LEXICAL_SQL = (
    f"WITH {_LEX_SQL} SELECT id, round(0.55::DOUBLE * t + 0.30::DOUBLE * g + 0.15::DOUBLE * c, 6) AS lexical_score FROM lex "
    "ORDER BY round(0.55::DOUBLE * t + 0.30::DOUBLE * g + 0.15::DOUBLE * c, 9) DESC, t DESC, g DESC, c DESC, updated_at DESC NULLS LAST, id DESC LIMIT 50"
)


@query("recall_lexical", LEXICAL_SQL, ["posts"])
def recall_lexical(spark, sf):
    return recall.lexical(domain.posts(spark, sf), TERMS, TAG_TERMS, recall.Filters(visible_statuses=("0", "1")), limit=50).select("id", F.round("lexical_score", 6).alias("lexical_score"))


TYPED = "The, tion? m3"


LEXICAL_QUERY_SQL = (
    "WITH " + _LEX_SQL.replace("contains(lower(title), 'tion')::INT)", "contains(lower(title), 'tion')::INT + contains(lower(title), 'm3')::INT)").replace("contains(lower(content), 'tion')::INT)", "contains(lower(content), 'tion')::INT + contains(lower(content), 'm3')::INT)")
    .replace("('en', 'm3', 'src5')", "('the', 'tion', 'm3')").replace("in_title / 2", "in_title / 3").replace("in_content / 2", "in_content / 3")
    + " SELECT id, round(0.55::DOUBLE * t + 0.30::DOUBLE * g + 0.15::DOUBLE * c, 6) AS lexical_score FROM lex ORDER BY round(0.55::DOUBLE * t + 0.30::DOUBLE * g + 0.15::DOUBLE * c, 9) DESC, t DESC, g DESC, c DESC, updated_at DESC NULLS LAST, id DESC LIMIT 50"
)


@query("recall_lexical_query", LEXICAL_QUERY_SQL, ["posts"])
def recall_lexical_query(spark, sf):
    """A typed query, whose punctuation and case do not count."""
    found = recall.lexical_query(domain.posts(spark, sf), TYPED, recall.Filters(visible_statuses=("0", "1")), limit=50)
    return found.select("id", F.round("lexical_score", 6).alias("lexical_score"))


@query(
    "semantic_global",
    "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 5) ORDER BY list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) DESC, vec_id DESC LIMIT 50",
)
def semantic_global(spark, sf):
    e = domain.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id")
    asked = e.where("id = 5").limit(1).select(F.col("embedding").alias("q"))
    return recall.nearest_exact(e.crossJoin(F.broadcast(asked)), "embedding", F.col("q"), 50).select(F.col("id").alias("vec_id"), F.round("semantic_score", 6).alias("score"))


SEMANTIC_FILTERED_SQL = (
    f"SELECT id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score, round({_KM}, 4) AS distance_km FROM posts JOIN embeddings ON vec_id = id, (SELECT embedding AS q FROM embeddings WHERE vec_id = 5) "
    f"WHERE visible_status IN ('0', '1') AND {_KM} <= 60 ORDER BY list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) DESC, id DESC LIMIT 20"
)


@query("semantic_filtered", SEMANTIC_FILTERED_SQL, ["posts"])
def semantic_filtered(spark, sf):
    e = domain.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = e.where("id = 5").limit(1).select(F.col("embedding").alias("q"))
    near = recall.within_radius(domain.posts(spark, sf).select("id", "visible_status", "latitude", "longitude"), _HERE).join(e, "id").crossJoin(F.broadcast(asked))
    return recall.nearest_exact(near, "embedding", F.col("q"), 20).select("id", F.round("semantic_score", 6).alias("score"), F.round("distance_km", 4).alias("distance_km"))


_ROUTES_SQL = """
fresh AS (SELECT source, source_id, row_number() OVER (ORDER BY updated_at DESC NULLS LAST, views DESC, id DESC) AS rank FROM posts QUALIFY rank <= 60),
near AS (
  SELECT source, source_id, rank, semantic_score FROM (
    SELECT source, source_id, list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS semantic_score, row_number() OVER (ORDER BY list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) DESC, id DESC) AS rank
    FROM posts JOIN embeddings ON vec_id = id, (SELECT embedding AS q FROM embeddings WHERE vec_id = 5)) WHERE rank <= 60
), merged AS (
  SELECT coalesce(fresh.source, near.source) AS source, coalesce(fresh.source_id, near.source_id) AS source_id, fresh.rank AS freshness_rank, near.rank AS semantic_rank, semantic_score,
    concat_ws('|', CASE WHEN fresh.rank IS NOT NULL THEN 'freshness' END, CASE WHEN near.rank IS NOT NULL THEN 'semantic' END) AS recall_sources
  FROM fresh FULL JOIN near ON fresh.source = near.source AND fresh.source_id = near.source_id
)"""


def two_routes(spark, sf, limit: int = 60):
    """The freshness and vector routes of one request, each a bounded list with ranks."""
    p = domain.posts(spark, sf).select("id", "source", "source_id", "updated_at", "views")
    # The window sees at most `limit` rows.
    whole = Window.partitionBy(F.lit(0))
    fresh = recall.freshest(p, recall.Filters(), limit)
    fresh = fresh.withColumn("rank", F.row_number().over(whole.orderBy(F.desc_nulls_last("updated_at"), F.desc("views"), F.desc("id"))))
    e = domain.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = e.where("id = 5").limit(1).select(F.col("embedding").alias("q"))
    near = recall.nearest_exact(p.join(e, "id").crossJoin(F.broadcast(asked)), "embedding", F.col("q"), limit)
    near = near.withColumn("rank", F.row_number().over(whole.orderBy(F.desc("semantic_score"), F.desc("id"))))
    return fresh.select("source", "source_id", "rank"), near.select("source", "source_id", "rank", "semantic_score")


@query("merge_routes", f"WITH {_ROUTES_SQL} SELECT source, source_id, freshness_rank, semantic_rank, round(semantic_score, 6) AS semantic_score, recall_sources FROM merged", ["posts"])
def merge_routes(spark, sf):
    merged = recall.merge_routes(*two_routes(spark, sf))
    return merged.withColumns({"semantic_score": F.round("semantic_score", 6), "recall_sources": F.array_join("recall_sources", "|"), "freshness_rank": F.col("freshness_rank").cast("long"), "semantic_rank": F.col("semantic_rank").cast("long")})


@query("hydrate_candidates", f"WITH {_ROUTES_SQL} SELECT source_id, freshness_rank, semantic_rank, category, views FROM merged JOIN posts USING (source, source_id)", ["posts"])
def hydrate_candidates(spark, sf):
    found = recall.hydrate(recall.merge_routes(*two_routes(spark, sf)), domain.posts(spark, sf).select("source", "source_id", "category", "views"))
    return found.select("source_id", F.col("freshness_rank").cast("long").alias("freshness_rank"), F.col("semantic_rank").cast("long").alias("semantic_rank"), "category", "views")


@query("latest_by_key", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_by_key(spark, sf):
    return recall.latest_by(domain.table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("ordered_dedupe", "SELECT source, lang, first, row_number() OVER (ORDER BY first) - 1 AS place FROM (SELECT source, lang, min(doc_id) AS first FROM documents GROUP BY source, lang)")
def ordered_dedupe(spark, sf):
    """Sources with languages once each, in the order in which they first came."""
    return recall.ordered_dedupe(domain.table(spark, sf, "documents"), ["source", "lang"], "doc_id")


@query(
    "similar_items",
    "SELECT a.vec_id AS item, b.vec_id AS other, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id "
    "QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) <= 10",
)
def similar_items(spark, sf):
    e = domain.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = e.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    found = vector_index.scanned(asked, e, 10, largest=False, apart=True)
    return found.select(F.col("query_id").alias("item"), F.col("id").alias("other"), F.round("score", 6).alias("score"))
