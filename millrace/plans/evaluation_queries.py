"""Queries over offline evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import batch_search
from millrace.operators import evaluation as ev
from millrace.plans.cleaning_queries import HAVERSINE, LONG_FIELD_SQL, REALTIME_SQL, STATIC_SQL
from millrace.plans.registry import query
from millrace.sources import domain
from millrace.sources.shared import written

_KS = (5, 10, 20)
_METRICS = """
ks(k) AS (VALUES (5), (10), (20)),
judged AS (SELECT r.case_id, route, rank, coalesce(grade, 0) AS grade FROM routes r LEFT JOIN qrels q ON q.case_id = r.case_id AND q.source_id = r.source_id),
totals AS (SELECT case_id, count(*) FILTER (WHERE grade >= 1) AS relevant, count(*) FILTER (WHERE grade = 3) AS g3 FROM qrels GROUP BY 1),
ideal AS (SELECT case_id, k, sum((pow(2.0, grade) - 1) / log2(r + 1)) AS ideal FROM (SELECT case_id, grade, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC, source_id) AS r FROM qrels WHERE grade > 0), ks WHERE r <= k GROUP BY 1, 2),
topk AS (
  SELECT case_id, route, k, count(*) FILTER (WHERE grade >= 1) AS hits, min(CASE WHEN grade >= 1 THEN rank END) AS first, count(*) AS returned,
    sum(CASE WHEN grade > 0 THEN (pow(2.0, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, max((grade = 3)::INT) AS any3 FROM judged, ks WHERE rank <= k GROUP BY 1, 2, 3
), m AS (
  SELECT case_id, route, k, returned, returned >= k AS complete, CASE WHEN relevant > 0 THEN round(hits / k::DOUBLE, 6) END AS precision, CASE WHEN relevant > 0 THEN round(hits / relevant::DOUBLE, 6) END AS recall,
    CASE WHEN relevant > 0 THEN round(coalesce(1 / first::DOUBLE, 0), 6) END AS rr, CASE WHEN ideal > 0 THEN round(dcg / ideal, 6) END AS ndcg, CASE WHEN g3 > 0 THEN any3 END AS grade3_hit
  FROM topk LEFT JOIN totals USING (case_id) LEFT JOIN ideal USING (case_id, k)
)"""
_TABLES = ["routes", "qrels"]


def _rq(spark, sf):
    return domain.routes(spark, sf), domain.qrels(spark, sf)


def _metrics(spark, sf):
    return ev.metrics_at(*_rq(spark, sf), _KS)


@query("ir_metrics", f"WITH {_METRICS} SELECT case_id, route, k, precision, recall, rr FROM m", _TABLES)
def ir_metrics(spark, sf):
    return _metrics(spark, sf).select("case_id", "route", "k", "precision", "recall", "rr")


@query("ndcg", f"WITH {_METRICS} SELECT case_id, route, k, ndcg FROM m", _TABLES)
def ndcg(spark, sf):
    return _metrics(spark, sf).select("case_id", "route", "k", "ndcg")


@query("cutoff_metrics", f"WITH {_METRICS} SELECT case_id, route, k, complete, CASE WHEN complete THEN recall END AS recall, CASE WHEN complete THEN grade3_hit END AS grade3_hit FROM m", _TABLES)
def cutoff_metrics(spark, sf):
    m = _metrics(spark, sf)
    return m.select("case_id", "route", "k", "complete", *(F.when(F.col("complete"), F.col(c)).alias(c) for c in ("recall", "grade3_hit")))


@query("eval_summary", f"WITH {_METRICS} SELECT route, k, count(*) AS cases, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM m GROUP BY 1, 2", _TABLES)
def eval_summary(spark, sf):
    g = _metrics(spark, sf).groupBy("route", "k")
    return g.agg(F.count(F.lit(1)).alias("cases"), *(F.round(F.avg(c), 6).alias(n) for c, n in (("precision", "precision"), ("recall", "recall"), ("rr", "mrr"), ("ndcg", "ndcg"))))


@query(
    "semantic_summary",
    f"""WITH {_METRICS} SELECT k, count(*) FILTER (WHERE complete) AS complete, count(*) FILTER (WHERE NOT complete) AS incomplete, round(avg(CASE WHEN complete THEN recall END), 6) AS recall, round(avg(CASE WHEN complete THEN rr END), 6) AS mrr,
  round(avg(CASE WHEN complete THEN grade3_hit END), 6) AS grade3_hit, min(returned) AS least, round(avg(returned), 6) AS mean, round(quantile_cont(returned, 0.5), 6) AS p50, max(returned) AS most FROM m WHERE route = 'semantic' GROUP BY 1""",
    _TABLES,
)
def semantic_summary(spark, sf):
    g = _metrics(spark, sf).where("route = 'semantic'").groupBy("k")
    over = lambda c: F.round(F.avg(F.when(F.col("complete"), F.col(c))), 6)
    return g.agg(
        F.count_if("complete").alias("complete"), F.count_if(~F.col("complete")).alias("incomplete"), over("recall").alias("recall"), over("rr").alias("mrr"), over("grade3_hit").alias("grade3_hit"), F.min("returned").alias("least"),
        F.round(F.avg("returned"), 6).alias("mean"), F.round(F.percentile("returned", F.lit(0.5)), 6).alias("p50"), F.max("returned").alias("most"),
    )


_MEMBERS = (("freshness",), ("freshness", "lexical"), ("freshness", "lexical", "semantic"))
_COVER = " UNION ALL ".join(
    f"SELECT '{'+'.join(m)}' AS member, case_id, count(*) AS candidates, count(*) FILTER (WHERE grade >= 1) AS hits, CASE WHEN any_value(relevant) > 0 THEN round(count(*) FILTER (WHERE grade >= 1) / any_value(relevant)::DOUBLE, 6) END AS recall "
    f"FROM (SELECT DISTINCT case_id, source_id FROM routes WHERE rank <= 10 AND route IN ({', '.join(repr(x) for x in m)})) LEFT JOIN qrels USING (case_id, source_id) LEFT JOIN (SELECT case_id, count(*) FILTER (WHERE grade >= 1) AS relevant FROM qrels GROUP BY 1) USING (case_id) GROUP BY case_id"
    for m in _MEMBERS
)


@query("route_coverage", _COVER, _TABLES)
def route_coverage(spark, sf):
    return ev.union_coverage(*_rq(spark, sf), _MEMBERS, 10)


_COVER_AT = " UNION ALL ".join(f"SELECT {k} AS k, * FROM ({_COVER.replace('rank <= 10', f'rank <= {k}')})" for k in _KS)
_GRADE3 = " UNION ALL ".join(
    f"SELECT {k} AS k, '{'+'.join(m)}' AS member, round(avg(h), 6) AS grade3_hit_rate FROM (SELECT case_id, max((r.source_id IS NOT NULL)::INT) AS h FROM (SELECT * FROM qrels WHERE grade = 3) q "
    f"LEFT JOIN (SELECT DISTINCT case_id, source_id FROM routes WHERE rank <= {k} AND route IN ({', '.join(repr(x) for x in m)})) r USING (case_id, source_id) GROUP BY 1) GROUP BY ALL"
    for k in _KS for m in _MEMBERS
)


@query("coverage_summary", f"SELECT k, member, round(avg(recall), 6) AS recall, any_value(grade3_hit_rate) AS grade3_hit_rate, round(avg(candidates), 6) AS candidates, sum(hits)::BIGINT AS hits FROM ({_COVER_AT}) JOIN ({_GRADE3}) USING (k, member) GROUP BY k, member", _TABLES)
def coverage_summary(spark, sf):
    """By union of routes and cutoff."""
    r, q = _rq(spark, sf)
    parts = []
    for k in _KS:
        per = ev.union_coverage(r, q, _MEMBERS, k).groupBy("member").agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("candidates"), 6).alias("candidates"), F.sum("hits").alias("hits"))
        parts.append(per.join(ev.grade_hits(r, q, _MEMBERS, k, 3), "member").withColumn("k", F.lit(k)))
    return reduce(lambda a, b: a.unionByName(b), parts).withColumnRenamed("hit_rate", "grade3_hit_rate")


@query("route_overlap", "SELECT case_id, count(*) FILTER (WHERE n = 2) AS common, count(*) AS all, round(count(*) FILTER (WHERE n = 2) / count(*)::DOUBLE, 6) AS jaccard FROM (SELECT case_id, source_id, count(DISTINCT route) AS n FROM routes WHERE rank <= 10 AND route IN ('freshness', 'lexical') GROUP BY 1, 2) GROUP BY 1", ["routes"])
def route_overlap(spark, sf):
    return ev.overlap(domain.routes(spark, sf), "freshness", "lexical", 10)


@query(
    "route_marginal",
    "SELECT case_id, count(*) AS new, count(*) FILTER (WHERE grade >= 1) AS relevant, count(*) FILTER (WHERE grade = 3) AS grade3 FROM routes r LEFT JOIN qrels USING (case_id, source_id) WHERE route = 'semantic' AND rank <= 10 "
    "AND NOT EXISTS (SELECT 1 FROM routes b WHERE b.case_id = r.case_id AND b.source_id = r.source_id AND b.rank <= 10 AND b.route IN ('freshness', 'lexical')) GROUP BY case_id",
    _TABLES,
)
def route_marginal(spark, sf):
    return ev.marginal(*_rq(spark, sf), "semantic", ("freshness", "lexical"), 10)


_FUSE = """
f AS (SELECT case_id, source_id, rank / q::DOUBLE AS priority, place, rank, route FROM routes JOIN (VALUES ('freshness', 10, 0), ('lexical', 6, 1), ('semantic', 4, 2)) v(route, q, place) USING (route)),
one AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY case_id, source_id ORDER BY priority, place, rank) = 1),
fused AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY priority, place, rank, source_id) AS position FROM one QUALIFY position <= 20)"""


def _fused(spark, sf):
    return ev.fuse(domain.routes(spark, sf), {"freshness": 10, "lexical": 6, "semantic": 4}, 20)


@query("rank_fusion", f"WITH {_FUSE} SELECT case_id, position, source_id, route FROM fused", ["routes"])
def rank_fusion(spark, sf):
    return _fused(spark, sf).select("case_id", F.col("position").cast("long").alias("position"), "source_id", "route")


@query("allocation_summary", f"WITH {_FUSE} SELECT route, count(*) AS chosen, count(*) FILTER (WHERE grade >= 1) AS relevant FROM fused LEFT JOIN qrels USING (case_id, source_id) GROUP BY route", _TABLES)
def allocation_summary(spark, sf):
    return _fused(spark, sf).join(domain.qrels(spark, sf), ["case_id", "source_id"], "left").groupBy("route").agg(F.count(F.lit(1)).alias("chosen"), F.count_if(F.col("grade") >= 1).alias("relevant"))


@query("judged_ranks", "SELECT q.case_id, q.source_id, grade, rank FROM qrels q LEFT JOIN (SELECT * FROM routes WHERE route = 'lexical') r ON r.case_id = q.case_id AND r.source_id = q.source_id", _TABLES)
def judged_ranks(spark, sf):
    r, q = _rq(spark, sf)
    return ev.judged_ranks(r.where("route = 'lexical'"), q).select("case_id", "source_id", "grade", F.col("rank").cast("long").alias("rank"))


@query("latency_summary", "SELECT event_type, count(value) AS n, round(avg(value), 3) AS mean, round(quantile_cont(value, 0.5), 3) AS p50, round(quantile_cont(value, 0.95), 3) AS p95, round(max(value), 3) AS most FROM events GROUP BY 1")
def latency_summary(spark, sf):
    return ev.latency(domain.table(spark, sf, "events"), "event_type", "value")


@query("latency_percentiles", "SELECT user_id, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1")
def latency_percentiles(spark, sf):
    return domain.table(spark, sf, "events").groupBy("user_id").agg(F.round(F.percentile("value", F.lit(0.9)), 6).alias("p90"))


@query("stratified_sample", "SELECT source_id, group_rank FROM (SELECT source_id, md5(source_id || 's1') AS code, row_number() OVER (PARTITION BY category, city, district ORDER BY md5(source_id || 's1'), source_id) AS group_rank FROM posts) WHERE group_rank <= 2 ORDER BY group_rank, code LIMIT 100", ["posts"])
def stratified_sample(spark, sf):
    found = ev.stratified_sample(domain.posts(spark, sf).select("source_id", "category", "city", "district"), ["category", "city", "district"], "source_id", "s1", 2, 100)
    return found.select("source_id", F.col("group_rank").cast("long").alias("group_rank"))


@query("annotation_rows", "SELECT 'draft_' || lpad(CAST(row_number() OVER (ORDER BY id) AS VARCHAR), 3, '0') AS draft_id, id FROM (SELECT min(id) AS id FROM (SELECT id % 400 AS source_id, id FROM posts WHERE trim(title) <> '' AND category = '问答') GROUP BY source_id ORDER BY id LIMIT 60)", ["posts"])
def annotation_rows(spark, sf):
    """A pool of 60 posts to annotate; of those that share a source id (here made to repeat) the first."""
    fit = domain.posts(spark, sf).where((text.preview(F.col("title"), 40) != "") & (F.col("category") == "问答")).select((F.col("id") % 400).alias("source_id"), "id")
    rows = fit.groupBy("source_id").agg(F.min("id").alias("id")).select("id").orderBy("id").limit(60)
    # A pool of 60 rows is numbered.
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("id"))
    return rows.select(F.format_string("draft_%03d", n).alias("draft_id"), "id")


@query("inject_anchor", "SELECT case_id, source_id, rank FROM routes WHERE route = 'lexical' AND rank <= 5 UNION ALL SELECT case_id, source_id, NULL FROM (SELECT case_id, min(source_id) AS source_id FROM routes WHERE route = 'freshness' GROUP BY 1) a WHERE NOT EXISTS (SELECT 1 FROM routes r WHERE r.case_id = a.case_id AND r.source_id = a.source_id AND route = 'lexical' AND rank <= 5)", _TABLES)
def inject_anchor(spark, sf):
    r, _ = _rq(spark, sf)
    top = r.where("route = 'lexical' AND rank <= 5").select("case_id", "source_id", F.col("rank").cast("long").alias("rank"))
    anchors = r.where("route = 'freshness'").groupBy("case_id").agg(F.min("source_id").alias("source_id"))
    return ev.with_anchors(top, anchors, "case_id")


@query(
    "draft_requests",
    "SELECT draft_id, query, CASE WHEN query_type = 'category_intent' THEN category END AS category, CASE WHEN query_type = 'geo_intent' THEN city END AS city, CASE WHEN query_type = 'geo_intent' THEN district END AS district, CASE WHEN query_type = 'geo_intent' THEN latitude END AS latitude, "
    "CASE WHEN query_type = 'geo_intent' THEN longitude END AS longitude, CASE WHEN query_type = 'geo_intent' AND latitude IS NOT NULL THEN 20.0 END::DOUBLE AS radius_km FROM drafts",
    ["drafts"],
)
def draft_requests(spark, sf):
    return ev.draft_requests(domain.drafts(spark, sf))


_KM_OF = HAVERSINE.format(lat1="lat", lon1="lon", lat2="latitude", lon2="longitude")
_MM = "CASE WHEN max({0}) OVER w - min({0}) OVER w <= 1e-9 * greatest(abs(max({0}) OVER w), abs(min({0}) OVER w)) THEN 0.0 ELSE ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) END"


def _runs(top_k: int, recall_k: int) -> str:
    """``runs``: the search of each draft written out, a draft's filters against all posts."""
    match = lambda f: LONG_FIELD_SQL.format(q="q", f=f)
    squeeze = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
    return f"""
asked AS (
  SELECT draft_id, {squeeze.format("query")} AS q, anchor, CASE WHEN query_type = 'category_intent' THEN category END AS want_category, CASE WHEN query_type = 'geo_intent' THEN city END AS want_city,
    CASE WHEN query_type = 'geo_intent' THEN district END AS want_district, CASE WHEN query_type = 'geo_intent' THEN latitude END AS lat, CASE WHEN query_type = 'geo_intent' THEN longitude END AS lon,
    CASE WHEN query_type = 'geo_intent' AND latitude IS NOT NULL THEN 20.0::DOUBLE END AS radius FROM drafts
), recalled AS (
  SELECT d.*, p.* FROM asked d JOIN posts p ON visible_status IN ('0', '1') AND (want_category IS NULL OR category = want_category) AND (want_city IS NULL OR city = want_city) AND (want_district IS NULL OR district = want_district)
    AND (radius IS NULL OR (latitude BETWEEN lat - radius / 111.32 AND lat + radius / 111.32 AND longitude BETWEEN lon - radius / (111.32 * cos(radians(lat))) AND lon + radius / (111.32 * cos(radians(lat)))))
  QUALIFY row_number() OVER (PARTITION BY draft_id ORDER BY updated_at DESC NULLS LAST, views DESC, id DESC) <= {recall_k}
), fields AS (SELECT *, {squeeze.format("title")} AS ft, {squeeze.format("array_to_string(tags, ' ')")} AS fg, {squeeze.format("content")} AS fc FROM recalled),
matched AS (SELECT *, least(1.0::DOUBLE, 0.55::DOUBLE * ({match("ft")}) + 0.30::DOUBLE * ({match("fg")}) + 0.15::DOUBLE * ({match("fc")})) AS text_score, {_KM_OF} AS km FROM fields),
scored AS (
  SELECT matched.*, least(1.0, coalesce(0.70 * CASE WHEN radius IS NULL THEN 1 / (1 + km / 10) ELSE greatest(0.0, 1 - km / radius) END, 0) + CASE WHEN city = want_city THEN 0.20 ELSE 0 END + CASE WHEN district = want_district THEN 0.10 ELSE 0 END)::DOUBLE AS geo_score,
    ({STATIC_SQL})::DOUBLE AS st, coalesce(({REALTIME_SQL})::DOUBLE, 0) AS rt, ln(1 + coalesce(unlocks_24h, 0)) AS ul, lat IS NOT NULL OR want_city IS NOT NULL AS located FROM matched LEFT JOIN counters USING (source_id)
  WHERE text_score > 0 AND (radius IS NULL OR km IS NULL OR km <= radius)
), normed AS (
  SELECT *, 0.65::DOUBLE * ({_MM.format("st")}) + 0.35::DOUBLE * ({_MM.format("rt")}) AS hot, {_MM.format("ul")} AS us, max(ul > 0) OVER w AS unlocked FROM scored WINDOW w AS (PARTITION BY draft_id)
), final AS (
  SELECT *, (0.50::DOUBLE * text_score + 0.15::DOUBLE * hot + CASE WHEN located THEN 0.25::DOUBLE * geo_score ELSE 0 END + CASE WHEN unlocked THEN 0.10::DOUBLE * us ELSE 0 END)
    / (0.65::DOUBLE + CASE WHEN located THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN unlocked THEN 0.10::DOUBLE ELSE 0 END) AS final_score FROM normed
), runs AS (
  SELECT draft_id, id, source_id, km, geo_score, final_score, row_number() OVER (PARTITION BY draft_id ORDER BY round(final_score, 9) DESC, round(text_score, 9) DESC, round(km, 6) NULLS LAST, id DESC) AS rank FROM final QUALIFY rank <= {top_k}
), pool AS (
  SELECT draft_id, source_id, rank, round(final_score, 6) AS score FROM runs UNION ALL SELECT draft_id, anchor, NULL, NULL FROM drafts d WHERE NOT EXISTS (SELECT 1 FROM runs f WHERE f.draft_id = d.draft_id AND f.source_id = d.anchor)
)"""


def _searched(spark, sf, top_k: int, recall_k: int):
    """Every draft's search, all in one job: ``draft_id, source_id, rank, score`` and what else a hit has."""
    p = domain.posts(spark, sf).where(F.col("visible_status").isin("0", "1"))
    asked = ev.draft_requests(domain.drafts(spark, sf)).withColumnRenamed("draft_id", "request_id")
    found = batch_search.search_many(p, domain.counters(spark, sf), asked, top_k, recall_k)
    return found.withColumnRenamed("request_id", "draft_id").withColumn("rank", F.col("rank").cast("long"))


def _pool(spark, sf):
    """The best 20 of 1,000 of each draft's search, and its anchor."""
    anchors = domain.drafts(spark, sf).select("draft_id", F.col("anchor").alias("source_id"))
    found = written(_searched(spark, sf, 20, 1000).select("draft_id", "source_id", "rank", "score"), "searched")
    whole = ev.with_anchors(found.select("draft_id", "source_id", "rank"), anchors, "draft_id")
    return whole.join(found.select("draft_id", "source_id", "score"), ["draft_id", "source_id"], "left")


_DRAFTED = ["posts", "drafts", "counters"]


@query("search_many", f"WITH {_runs(10, 200)} SELECT draft_id, id, rank, round(final_score, 6) AS score, round(km, 4) AS distance_km, round(geo_score, 6) AS geo_score FROM runs", _DRAFTED)
def search_many(spark, sf):
    """The ten best posts of every draft's search."""
    found = _searched(spark, sf, 10, 200)
    return found.select("draft_id", "id", "rank", "score", F.round("distance_km", 4).alias("distance_km"), "geo_score")


@query("judgment_pool", f"WITH {_runs(20, 1000)} SELECT draft_id, source_id, rank, score FROM pool", _DRAFTED)
def judgment_pool(spark, sf):
    """What is to be judged of each draft: the best 20 of 1,000 that its search finds, and its anchor."""
    return _pool(spark, sf).select("draft_id", "source_id", "rank", "score")


_GRADED = """
graded AS (SELECT draft_id, source_id, rank, CASE WHEN source_id = anchor THEN 3 ELSE coalesce(quality * 2, 0) END AS grade FROM pool JOIN drafts USING (draft_id) LEFT JOIN labels ON doc_id = CAST(source_id AS BIGINT)),
rel AS (SELECT draft_id, count(*) FILTER (WHERE grade >= 2) AS relevant FROM graded GROUP BY 1),
ideal AS (SELECT draft_id, sum((pow(2, grade) - 1) / log2(r + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY draft_id ORDER BY grade DESC, source_id) AS r FROM graded WHERE grade > 0) WHERE r <= 10 GROUP BY 1),
per AS (
  SELECT draft_id, count(*) AS returned, count(*) FILTER (WHERE grade >= 2) / 10 AS precision, count(*) FILTER (WHERE grade >= 2) / any_value(relevant) AS recall, coalesce(1 / min(rank) FILTER (WHERE grade >= 2), 0) AS rr,
    sum((pow(2, grade) - 1) / log2(rank + 1)) / any_value(ideal) AS ndcg, max((source_id = anchor)::INT) AS anchored
  FROM graded JOIN rel USING (draft_id) JOIN ideal USING (draft_id) JOIN drafts USING (draft_id) WHERE rank <= 10 GROUP BY 1
)"""


@query(
    "search_evaluation",
    f"WITH {_runs(20, 1000)}, {_GRADED.strip()} SELECT count(*) AS cases, round(avg(coalesce(per.returned, 0) = 0), 6) AS no_result_rate, round(avg(round(precision, 6)), 6) AS precision, round(avg(round(recall, 6)), 6) AS recall, round(avg(round(rr, 6)), 6) AS mrr, round(avg(round(ndcg, 6)), 6) AS ndcg, sum(coalesce(anchored, 0))::BIGINT AS anchors_found FROM drafts LEFT JOIN per USING (draft_id)".replace("avg(coalesce(per.returned, 0) = 0)", "avg((coalesce(per.returned, 0) = 0)::INT)"),
    _DRAFTED,
)
def search_evaluation(spark, sf):
    """The drafts' searches measured at ten by the grades of the pool: the anchor has 3, other posts twice the quality of their label."""
    drafts, pool = domain.drafts(spark, sf), written(_pool(spark, sf), "pool")
    labels = domain.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("source_id"), (F.col("quality") * 2).alias("label"))
    graded = pool.join(labels, "source_id", "left").join(drafts.select("draft_id", "anchor"), "draft_id")
    graded = graded.select(F.col("draft_id").alias("case_id"), "source_id", "rank", F.when(F.col("source_id") == F.col("anchor"), 3).otherwise(F.coalesce("label", F.lit(0))).cast("int").alias("grade"), (F.col("source_id") == F.col("anchor")).alias("anchor"))
    graded = written(graded, "graded")
    ranking = graded.where("rank IS NOT NULL").select("case_id", F.lit("search").alias("route"), "rank", "source_id")
    m = ev.metrics_at(ranking, graded.select("case_id", "source_id", "grade"), [10], threshold=2)
    hit = graded.where("rank <= 10").groupBy("case_id").agg(F.max(F.col("anchor").cast("int")).alias("anchored"))
    rows = drafts.select(F.col("draft_id").alias("case_id")).join(m, "case_id", "left").join(hit, "case_id", "left")
    return rows.agg(
        F.count(F.lit(1)).alias("cases"), F.round(F.avg((F.coalesce("returned", F.lit(0)) == 0).cast("double")), 6).alias("no_result_rate"),
        *(F.round(F.avg(c), 6).alias(n) for c, n in (("precision", "precision"), ("recall", "recall"), ("rr", "mrr"), ("ndcg", "ndcg"))), F.sum(F.coalesce("anchored", F.lit(0))).cast("long").alias("anchors_found"),
    )


@query(
    "eval_search_summary",
    """SELECT count(*) AS cases, round(avg(success::INT), 6) AS success_rate, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS rr, round(avg(ndcg), 6) AS ndcg, round(sum(geo_hits) / sum(located), 6) AS geo_hit_rate,
  round(avg((returned = 0)::INT), 6) AS no_result_rate, round(avg(((returned > 0) = expected)::INT), 6) AS expectation_accuracy, round(avg(degraded::INT), 6) AS degraded_rate, round(avg(survived::INT), 6) AS forced_failure_success_rate,
  round(avg(stable::INT), 6) AS stability_rate, round(avg(latency_ms), 3) AS latency_mean, round(quantile_cont(latency_ms, 0.5), 3) AS latency_p50, round(quantile_cont(latency_ms, 0.95), 3) AS latency_p95, round(max(latency_ms), 3) AS latency_max FROM case_results""",
    ["case_results"],
)
def eval_search_summary(spark, sf):
    return ev.summary(domain.case_results(spark, sf))


@query(
    "eval_cases",
    """WITH lists AS (SELECT case_id, run, string_agg(source_id, ',' ORDER BY rank) AS l, max(latency_ms) AS ms FROM repeated_runs GROUP BY ALL),
same AS (SELECT case_id, count(*) AS runs, count(DISTINCT l) = 1 AS stable, round(avg(ms), 6) AS latency_ms FROM lists GROUP BY 1)
SELECT case_id, count(*) AS returned, coalesce(string_agg(rank, ',' ORDER BY rank) FILTER (WHERE grade >= 1), '') AS relevant_ranks, count(distance_km) AS located, count(*) FILTER (WHERE distance_km <= 20.000001) AS geo_hits, any_value(runs) AS runs, any_value(stable) AS stable, any_value(latency_ms) AS latency_ms
FROM repeated_runs LEFT JOIN qrels USING (case_id, source_id) JOIN same USING (case_id) WHERE run = 1 GROUP BY 1""".replace("any_value(latency_ms)", "any_value(same.latency_ms)"),
    ["repeated_runs", "qrels"],
)
def eval_cases(spark, sf):
    found = ev.evaluate_cases(domain.repeated_runs(spark, sf), domain.qrels(spark, sf), 20.0)
    return found.withColumn("relevant_ranks", F.array_join("relevant_ranks", ","))


_SPLITS = dict(ev.parse_allocation(x, 20) for x in ("10,5,5", "8,8,4", "6,8,6", "4,8,8", "0,10,10"))
_ROUTES = ("freshness", "lexical", "semantic")


def _split_sql(name, quotas):
    values = ", ".join(f"('{r}', {quotas[r]}, {i})" for i, r in enumerate(_ROUTES))
    means = ", ".join(f"round(avg(n_{r}), 6) AS mean_{r}" for r in _ROUTES)
    counts = ", ".join(f"count(*) FILTER (WHERE route = '{r}') AS n_{r}" for r in _ROUTES)
    return f"""SELECT '{name}' AS allocation, count(*) AS cases, round(avg(hits / relevant), 6) AS recall, round(avg(CASE WHEN relevant > 0 THEN (hits > 0)::INT END), 6) AS hit_rate, round(avg(filled / 20), 6) AS fill_rate,
  count(*) FILTER (WHERE filled < 20) AS underfilled, sum(hits)::BIGINT AS hits, {means} FROM (
    SELECT f.case_id, count(*) AS filled, count(*) FILTER (WHERE grade >= 1) AS hits, {counts}, any_value(relevant) AS relevant FROM (
      SELECT * FROM (SELECT case_id, source_id, rank / q::DOUBLE AS priority, place, rank, route FROM routes JOIN (VALUES {values}) v(route, q, place) USING (route) WHERE q > 0
        QUALIFY row_number() OVER (PARTITION BY case_id, source_id ORDER BY priority, place, rank) = 1)
      QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY priority, place, rank, source_id) <= 20) f
    LEFT JOIN qrels USING (case_id, source_id) LEFT JOIN (SELECT case_id, count(*) AS relevant FROM qrels WHERE grade >= 1 GROUP BY 1) t ON t.case_id = f.case_id GROUP BY f.case_id)"""


@query("rank_fusion_eval", " UNION ALL ".join(_split_sql(n, q) for n, q in _SPLITS.items()), _TABLES)
def rank_fusion_eval(spark, sf):
    """Five allocations of one budget."""
    return ev.allocations(*_rq(spark, sf), _SPLITS, 20)


@query("build_cases", "SELECT case_id, count(*) AS judged, string_agg(source_id || '=' || grade, ',' ORDER BY source_id) AS relevance FROM qrels WHERE grade > 0 GROUP BY 1", ["qrels"])
def build_cases(spark, sf):
    pair = F.struct("source_id", "grade")
    g = domain.qrels(spark, sf).where("grade > 0").groupBy("case_id").agg(F.count(F.lit(1)).alias("judged"), F.array_sort(F.collect_list(pair)).alias("rows"))
    return g.select("case_id", "judged", F.array_join(F.transform("rows", lambda r: F.concat(r["source_id"], F.lit("="), r["grade"].cast("string"))), ",").alias("relevance"))


@query("case_analysis", f"SELECT case_id, member, k, metric, value FROM (UNPIVOT (SELECT case_id, member, k, candidates::DOUBLE AS candidates, hits::DOUBLE AS hits, recall FROM ({_COVER_AT})) ON candidates, hits, recall INTO NAME metric VALUE value) UNION ALL SELECT case_id, member, k, 'recall', NULL FROM ({_COVER_AT}) WHERE recall IS NULL", _TABLES)
def case_analysis(spark, sf):
    return ev.analysis(*_rq(spark, sf), _MEMBERS, _KS)


@query(
    "draft_cases",
    f"""WITH {_runs(20, 1000)}, judged AS (SELECT draft_id, source_id, CASE WHEN source_id = anchor THEN 3 ELSE CAST(source_id AS BIGINT) % 4 END AS grade FROM pool JOIN drafts USING (draft_id)),
cases AS (SELECT draft_id, string_agg(source_id || '=' || grade, ',' ORDER BY source_id) AS relevance FROM judged GROUP BY 1)
SELECT draft_id, query, CASE WHEN query_type = 'category_intent' THEN category END AS category, CASE WHEN query_type = 'geo_intent' THEN 20.0 END::DOUBLE AS radius_km, relevance, 10 AS top_k FROM drafts JOIN cases USING (draft_id)
WHERE query_type <> 'geo_intent' OR latitude IS NOT NULL""",
    _DRAFTED,
)
def draft_cases(spark, sf):
    """Cases of the drafts that can be ones, each judged on its own pool."""
    drafts = domain.drafts(spark, sf).where("query_type <> 'geo_intent' OR latitude IS NOT NULL")
    rows = _pool(spark, sf).join(drafts.select("draft_id", "anchor"), "draft_id")
    own = F.col("source_id") == F.col("anchor")
    judged = rows.select("draft_id", "source_id", F.when(own, 3).otherwise(F.col("source_id").cast("long") % 4).cast("int").alias("grade"), own.alias("is_anchor"), F.lit(True).alias("reviewed"))
    made = ev.cases_of_drafts(drafts, written(judged, "judged"))
    relevance = F.array_join(F.transform("relevance", lambda r: F.concat(r["source_id"], F.lit("="), r["grade"].cast("string"))), ",")
    return made.select("draft_id", "query", "category", "radius_km", relevance.alias("relevance"), "top_k")
