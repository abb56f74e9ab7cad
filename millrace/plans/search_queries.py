"""Queries over post search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import scores, text
from millrace.operators import recall, search
from millrace.plans.cleaning_queries import LONG_FIELD_SQL, REALTIME_SQL, STATIC_SQL, haversine_sql
from millrace.plans.registry import query
from millrace.sources import domain

_Q = "the and of"
_PLACE = recall.Filters(visible_statuses=("0", "1"), city="c2", latitude=37.7, longitude=112.7, radius_km=80.0)
_BOX = _PLACE.box
_SQUEEZE = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"


def _match(field: str) -> str:
    return LONG_FIELD_SQL.format(q=f"'{_Q}'", f=field)


_HIT = "id AS post_id, source_id, category, round(final_score, 6)::DOUBLE AS score, round(text_score, 6)::DOUBLE AS text_score, round(geo_score, 6)::DOUBLE AS geo_score, round(hot, 6)::DOUBLE AS hot_score"


def _search_sql(where: str, km: str, located: bool, geo: str, top: int, semantic: tuple[float, float] | None = None, within: str = "TRUE", columns: str = _HIT) -> str:
    """``semantic``: the weight and least score of the vector route; ``within``: the condition of the radius on ``km``."""
    weight = "0.65" + (" + 0.25" if located else "") + (f" + {semantic[0]}" if semantic else "")
    total = "0.50 * text_score + 0.15 * hot" + (" + 0.25 * geo_score" if located else "") + (f" + {semantic[0]} * calibrated" if semantic else "")
    mm = "CASE WHEN max({0}) OVER () - min({0}) OVER () <= 1e-9 * greatest(abs(max({0}) OVER ()), abs(min({0}) OVER ())) THEN 0.0 ELSE ({0} - min({0}) OVER ()) / (max({0}) OVER () - min({0}) OVER ()) END"
    least = semantic[1] if semantic else 0.5
    near = f"""
near AS (
  SELECT id, list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS semantic_score FROM posts JOIN embeddings ON vec_id = id, (SELECT embedding AS q FROM embeddings WHERE vec_id = 5)
  WHERE {where} AND {within} ORDER BY semantic_score DESC, id DESC LIMIT 60
)""" if semantic else "near AS (SELECT NULL::BIGINT AS id, NULL::DOUBLE AS semantic_score WHERE FALSE)"
    return f"""
fresh AS (SELECT id FROM posts WHERE {where} ORDER BY updated_at DESC NULLS LAST, views DESC, id DESC LIMIT 200), {near},
recalled AS (SELECT posts.*, semantic_score, fresh.id IS NOT NULL AS by_time, near.id IS NOT NULL AS by_vector FROM posts LEFT JOIN fresh USING (id) LEFT JOIN near USING (id) WHERE fresh.id IS NOT NULL OR near.id IS NOT NULL),
fields AS (SELECT *, {_SQUEEZE.format('title')} AS ft, array_to_string(tags, ' ') AS fg, {_SQUEEZE.format('content')} AS fc FROM recalled),
matched AS (SELECT *, ({_match('ft')})::DOUBLE AS tm, ({_match('fg')})::DOUBLE AS gm, ({_match('fc')})::DOUBLE AS cm, {km} AS km FROM fields),
scored AS (
  SELECT matched.*, least(1.0::DOUBLE, 0.55::DOUBLE * tm + 0.30::DOUBLE * gm + 0.15::DOUBLE * cm) AS text_score, ({geo})::DOUBLE AS geo_score, ({STATIC_SQL})::DOUBLE AS st,
    coalesce(({REALTIME_SQL})::DOUBLE, 0) AS rt, ln(1 + coalesce(unlocks_24h, 0)) AS ul,
    CASE WHEN coalesce(semantic_score, 0) < {least} THEN 0 ELSE (least(1.0, semantic_score) - {least}) / (1 - {least}) END::DOUBLE AS calibrated
  FROM matched LEFT JOIN counters USING (source_id)
), kept AS (SELECT * FROM scored WHERE (text_score > 0{' OR calibrated > 0' if semantic else ''}) AND (km IS NULL OR {within})), normed AS (
  SELECT *, 0.65::DOUBLE * ({mm.format('st')}) + 0.35::DOUBLE * ({mm.format('rt')}) AS hot, {mm.format('ul')} AS us, max(ul > 0) OVER () AS unlocked FROM kept
), final AS (
  SELECT *, ({total} + CASE WHEN unlocked THEN 0.10 * us ELSE 0 END) / ({weight} + CASE WHEN unlocked THEN 0.10 ELSE 0 END) AS final_score FROM normed
)
SELECT {columns} FROM final ORDER BY round(final_score, 9) DESC, round(text_score, 9) DESC, round(calibrated, 9) DESC, round(km, 6) NULLS LAST, id DESC LIMIT {top}"""


_COLUMNS = ("post_id", "source_id", "category", "score", "text_score", "geo_score", "hot_score")
_PLAIN = "WITH " + _search_sql("visible_status IN ('0', '1')", "NULL::DOUBLE", False, "0", 10)
_KM = haversine_sql(37.7, 112.7)
_WHERE = f"visible_status IN ('0', '1') AND city = 'c2' AND latitude BETWEEN {_BOX[0]!r}::DOUBLE AND {_BOX[1]!r}::DOUBLE AND longitude BETWEEN {_BOX[2]!r}::DOUBLE AND {_BOX[3]!r}::DOUBLE"
_GEO = f"least(1.0, coalesce(0.70 * greatest(0.0, 1 - {_KM} / 80), 0) + CASE WHEN city = 'c2' THEN 0.20 ELSE 0 END)"
_NEAR = "WITH " + _search_sql(_WHERE, _KM, True, _GEO, 10, within=f"{_KM} <= 80")
_REASONS = (
    "nullif(concat_ws('；', CASE WHEN tm > 0 THEN '标题与搜索词相关' END, CASE WHEN gm > 0 THEN '标签与搜索词相关' END, CASE WHEN cm > 0 THEN '正文与搜索词相关' END, CASE WHEN semantic_score IS NOT NULL THEN '语义相关' END, "
    "CASE WHEN km IS NOT NULL THEN '距离约 ' || printf('%.1f', km) || ' km' END, CASE WHEN {city} THEN '位于指定城市' END, CASE WHEN rt > 0 THEN '近期互动较活跃' END, CASE WHEN ul > 0 THEN '近期解锁较多' END), '') AS reason"
)
_FOUND = (
    "concat_ws('|', CASE WHEN by_time THEN 'freshness' END, CASE WHEN by_vector THEN 'semantic' END, CASE WHEN tm > 0 THEN 'keyword_title' END, CASE WHEN gm > 0 THEN 'keyword_tags' END, CASE WHEN cm > 0 THEN 'keyword_content' END, "
    "CASE WHEN {radius} THEN 'radius_filter' END, CASE WHEN {city} THEN 'city_filter' END, CASE WHEN rt > 0 THEN 'redis_realtime' END, CASE WHEN ul > 0 THEN 'redis_unlock' END) AS recall_sources"
)


def _all_columns(city: str, radius: str) -> str:
    return (
        "id AS post_id, source, source_id, title, content, category, array_to_string(tags, '|') AS tags, city, district, address, latitude, longitude, round(km, 4) AS distance_km, round(final_score, 6)::DOUBLE AS score, "
        "round(text_score, 6)::DOUBLE AS text_score, round(semantic_score, 6) AS semantic_score, NULL::DOUBLE AS bm25_score, round(geo_score, 6)::DOUBLE AS geo_score, round(hot, 6)::DOUBLE AS hot_score, round(us, 6)::DOUBLE AS unlock_score, "
        + _FOUND.format(city=city, radius=radius) + ", " + _REASONS.format(city=city)
    )


@query("search_posts", _PLAIN, ["posts", "counters"])
def search_posts(spark, sf):
    found = search.search(domain.posts(spark, sf), domain.counters(spark, sf), search.Request(_Q, recall.Filters(visible_statuses=("0", "1"))))
    return found.select(*_COLUMNS)


@query("search_posts_near", _NEAR, ["posts", "counters"])
def search_posts_near(spark, sf):
    return search.search(domain.posts(spark, sf), domain.counters(spark, sf), search.Request(_Q, _PLACE)).select(*_COLUMNS)


def _hits(spark, sf, filters):
    """All hit columns of a search that merges the vector route in. The asked vector is one row."""
    request = search.Request(_Q, filters, top_k=20, semantic_weight=0.3, least_semantic=0.2)
    posts, e = domain.posts(spark, sf), domain.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = e.where("id = 5").limit(1).select(F.col("embedding").alias("q"))
    near = recall.semantic(posts, e.crossJoin(F.broadcast(asked)), F.col("q"), filters, 60)
    found = search.search(posts, domain.counters(spark, sf), request, near)
    return found.withColumns({"tags": F.array_join("tags", "|"), "recall_sources": F.array_join("recall_sources", "|")})


@query("search_hits", "WITH " + _search_sql("visible_status IN ('0', '1')", "NULL::DOUBLE", False, "0", 20, (0.3, 0.2), columns=_all_columns("FALSE", "FALSE")), ["posts", "counters"])
def search_hits(spark, sf):
    return _hits(spark, sf, recall.Filters(visible_statuses=("0", "1")))


@query("search_hits_near", "WITH " + _search_sql(_WHERE, _KM, True, _GEO, 20, (0.3, 0.2), f"{_KM} <= 80", _all_columns("city = 'c2'", "km IS NOT NULL")), ["posts", "counters"])
def search_hits_near(spark, sf):
    return _hits(spark, sf, _PLACE)


def _text_scores(posts):
    rows = search.match_fields(posts, F.lit(_Q))
    return rows.select("id", F.round(text.text_score(F.col("title_match"), F.col("tag_match"), F.col("content_match")), 6).alias("score"))


@query(
    "text_score",
    f"SELECT id, round(least(1.0, 0.55::DOUBLE * ({_match('ft')}) + 0.30::DOUBLE * ({_match('fg')}) + 0.15::DOUBLE * ({_match('fc')})), 6)::DOUBLE AS score "
    f"FROM (SELECT id, {_SQUEEZE.format('title')} AS ft, array_to_string(tags, ' ') AS fg, {_SQUEEZE.format('content')} AS fc FROM posts)",
    ["posts"],
)
def text_score(spark, sf):
    return _text_scores(domain.posts(spark, sf))


@query("minmax_normalize", "SELECT id, round((views - min(views) OVER w) / (max(views) OVER w - min(views) OVER w)::DOUBLE, 6) AS place FROM posts WINDOW w AS (PARTITION BY source)", ["posts"])
def minmax_normalize(spark, sf):
    return domain.posts(spark, sf).select("id", F.round(scores.min_max(F.col("views"), Window.partitionBy("source")), 6).alias("place"))


@query("search_admission", f"SELECT id FROM (SELECT id, ({_match('ft')}) AS t, ratescore / 5 AS s FROM (SELECT id, ratescore, {_SQUEEZE.format('title')} AS ft FROM posts)) WHERE t > 0.3 OR coalesce(s, 0) > 0.5", ["posts"])
def search_admission(spark, sf):
    t = F.col("title_match")
    return search.match_fields(domain.posts(spark, sf).select("id", "title", "tags", "content", "ratescore"), F.lit(_Q)).where((t > 0.3) | (F.coalesce(F.col("ratescore") / 5, F.lit(0.0)) > 0.5)).select("id")
