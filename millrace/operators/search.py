"""Post search: scoring of recalled candidates, final ranking, and hits with reasons."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import geo, scores, text
from millrace.operators import recall


@dataclass(frozen=True)
class Request:
    """A search request. ``top_k`` is at most ``recall_k``."""

    query: str
    filters: recall.Filters = field(default_factory=recall.Filters)
    top_k: int = 10
    recall_k: int = 200
    semantic_weight: float = 0.0
    least_semantic: float = 0.5

    def __post_init__(self):
        if not 1 <= len(self.query.strip()) <= 500:
            raise ValueError("a query has 1 to 500 characters")
        if not (1 <= self.top_k <= 100 and self.top_k <= self.recall_k <= recall.MOST):
            raise ValueError("top_k is 1 to 100 and at most recall_k, which is at most 2000")
        if not (0 <= self.semantic_weight <= 1 and 0 <= self.least_semantic <= 1):
            raise ValueError("weights are shares")


FIELDS = ("title", "tag", "content")


def normalised(rows: DataFrame) -> DataFrame:
    """``rows`` with ``__title``, ``__tag`` and ``__content``, the texts that are matched: in columns of their own, as Python may have to fold them
    and matching looks at them many times."""
    of = (F.col("title"), F.array_join("tags", " "), F.col("content"))
    return rows.withColumns({f"__{name}": text.normalize(c, unicode=True) for name, c in zip(FIELDS, of, strict=True)})


def match_fields(rows: DataFrame, query: Column) -> DataFrame:
    """``rows`` with ``title_match``, ``tag_match`` and ``content_match`` of a normalised query."""
    return normalised(rows).withColumns({f"{name}_match": text.field_match(query, F.col(f"__{name}")) for name in FIELDS}).drop(*(f"__{name}" for name in FIELDS))


def score(candidates: DataFrame, request: Request) -> DataFrame:
    """Text, semantic, geographic and static scores of each candidate; candidates without any relevance are dropped."""
    f = request.filters
    q = F.lit(" ".join(unicodedata.normalize("NFKC", request.query).lower().split()))
    near = F.col("semantic_score") if "semantic_score" in candidates.columns else F.lit(None).cast("double")
    rows = match_fields(candidates.withColumn("semantic_score", near), q)
    # The score comes out of an array of one element: as a plain column its condition would go below what reads the candidates, to the texts of all posts.
    rows = rows.select("*", F.explode(F.array(text.text_score(F.col("title_match"), F.col("tag_match"), F.col("content_match")))).alias("text_score")).withColumns({
        "semantic": scores.calibrate(F.col("semantic_score"), request.least_semantic), "distance_km": f.distance(),
        "static_raw": scores.static_hot(*(F.col(c) for c in ("views", "likes", "marks", "dislikes"))),
    })
    admitted = (F.col("text_score") > 0) | (F.lit(request.semantic_weight > 0) & (F.col("semantic") > 0))
    if f.radius_km is not None:
        # A candidate without a place passes; the box has dropped it where that route filters by range.
        admitted = admitted & (F.col("distance_km").isNull() | (F.col("distance_km") <= f.radius_km))
    city, district = ((F.col(c) == F.lit(v)) if v else F.lit(False) for c, v in (("city", f.city), ("district", f.district)))
    return rows.where(admitted).withColumn("geo_score", geo.geo_score(F.col("distance_km"), f.radius_km, F.coalesce(city, F.lit(False)), F.coalesce(district, F.lit(False))))


def rank(scored: DataFrame, request: Request, keys: tuple[str, ...] = ()) -> DataFrame:
    """The final score over each request's candidates, whose number recall bounds; ``keys`` name a batch's requests."""
    f = request.filters
    over = Window.partitionBy(*(keys or (F.lit(0),)))
    rows = scored.withColumns({
        "realtime_raw": scores.realtime_hot(*(F.col(c) for c in ("views_1h", "views_24h", "likes_24h", "marks_24h"))), "unlock_raw": scores.unlock_signal(F.col("unlocks_24h")),
    })
    rows = rows.withColumns({
        "hot_score": 0.65 * scores.min_max(F.col("static_raw"), over) + 0.35 * scores.min_max(F.col("realtime_raw"), over),
        "unlock_score": scores.min_max(F.col("unlock_raw"), over), "unlocked": F.max(F.col("unlock_raw") > 0).over(over),
    })
    located = f.latitude is not None or bool(f.city) or bool(f.district)
    total = 0.50 * F.col("text_score") + 0.15 * F.col("hot_score")
    weight = F.lit(0.65)
    if request.semantic_weight > 0:
        total, weight = total + request.semantic_weight * F.col("semantic"), weight + request.semantic_weight
    if located:
        total, weight = total + 0.25 * F.col("geo_score"), weight + 0.25
    total = total + F.when(F.col("unlocked"), 0.10 * F.col("unlock_score")).otherwise(0.0)
    weight = weight + F.when(F.col("unlocked"), 0.10).otherwise(0.0)
    return rows.withColumn("final_score", total / weight)


def best(ranked: DataFrame, top_k: int) -> DataFrame:
    order = [F.desc(F.round("final_score", 9)), F.desc(F.round("text_score", 9)), F.desc(F.round("semantic", 9)), F.asc_nulls_last(F.round("distance_km", 6)), F.desc("id")]
    return ranked.orderBy(*order).limit(top_k)


# What a hit says of itself, and the names of what found or lifted it.
_SAYS = {
    "title_match": ("标题与搜索词相关", "keyword_title"), "tag_match": ("标签与搜索词相关", "keyword_tags"), "content_match": ("正文与搜索词相关", "keyword_content"),
    "realtime_raw": ("近期互动较活跃", "redis_realtime"), "unlock_raw": ("近期解锁较多", "redis_unlock"),
}


def hits(rows: DataFrame, request: Request) -> DataFrame:
    """Result columns, rounded, with reasons and what found them."""
    f = request.filters
    none = F.lit(None).cast("string")
    there = lambda c, n: F.when(F.col(c) > 0, _SAYS[c][n])
    placed = F.col("distance_km").isNotNull()
    in_city, in_district = F.col("city") == F.lit(f.city), F.col("district") == F.lit(f.district)
    reasons = [
        there("title_match", 0), there("tag_match", 0), there("content_match", 0), F.when(F.col("semantic_score").isNotNull(), "语义相关"),
        F.when(placed, F.concat(F.lit("距离约 "), F.format_string("%.1f", "distance_km"), F.lit(" km"))), F.when(in_city, "位于指定城市"), F.when(in_district, "位于指定区域"),
        there("realtime_raw", 0), there("unlock_raw", 0),
    ]
    found = [
        there("title_match", 1), there("tag_match", 1), there("content_match", 1), F.when(placed, "radius_filter") if f.radius_km is not None else none,
        F.when(in_city, "city_filter"), F.when(in_district, "district_filter"), there("realtime_raw", 1), there("unlock_raw", 1),
    ]
    return rows.select(
        F.col("id").alias("post_id"), "source", "source_id", "title", "content", "category", "tags", "city", "district", "address", "latitude", "longitude",
        F.round("distance_km", 4).alias("distance_km"), F.round("final_score", 6).alias("score"), F.round("text_score", 6).alias("text_score"), F.round("semantic_score", 6).alias("semantic_score"),
        F.lit(None).cast("double").alias("bm25_score"), F.round("geo_score", 6).alias("geo_score"), F.round("hot_score", 6).alias("hot_score"), F.round("unlock_score", 6).alias("unlock_score"),
        F.array_compact(F.concat("recall_sources", F.array(*found))).alias("recall_sources"), F.nullif(F.concat_ws("；", *reasons), F.lit("")).alias("reason"),
    )


def candidates(posts: DataFrame, request: Request, semantic: DataFrame | None = None) -> DataFrame:
    """The rows of both routes' candidates with ``recall_sources`` and ``semantic_score``; none that a hard filter excludes.

    Recall reads keys alone; rows are read where the few keys are sent, so they are scored where they lie.
    """
    f = request.filters
    keys = recall.freshest(posts, f, request.recall_k).select("source", "source_id", F.lit(1).alias("rank"))
    near = None if semantic is None else semantic.select("source", "source_id", "semantic_score", F.lit(1).alias("rank"))
    if near is None:
        merged = keys.groupBy("source", "source_id").agg(F.lit(None).cast("double").alias("semantic_score"), F.array(F.lit("freshness")).alias("recall_sources"))
    else:
        merged = recall.merge_routes(keys, near).select("source", "source_id", "semantic_score", "recall_sources")
    return recall.hydrate(merged, posts.where(f.column()))


def search(posts: DataFrame, counters: DataFrame | None, request: Request, semantic: DataFrame | None = None) -> DataFrame:
    """The whole search. Absent counters and semantic candidates degrade to zeros, they never fail a request."""
    return _ranked_hits(candidates(posts, request, semantic), counters, request)


def _ranked_hits(rows: DataFrame, counters: DataFrame | None, request: Request) -> DataFrame:
    names = ("views_1h", "views_24h", "likes_24h", "marks_24h", "unlocks_24h")
    scored = score(rows, request)
    if counters is None:
        scored = scored.withColumns({c: F.lit(0) for c in names})
    else:
        scored = scored.join(counters, "source_id", "left").withColumns({c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)) for c in names})
    return hits(best(rank(scored, request), request.top_k), request)


@dataclass(frozen=True)
class Response:
    """A search's answer: at most ``top_k`` hits, and what was not at hand when it was made."""

    request_id: str
    query: str
    total_candidates: int
    result_count: int
    items: list[dict]
    degraded: bool
    degraded_reason: str | None


def respond(
    posts: DataFrame, request: Request, load_counters: Callable[[DataFrame], DataFrame] | None = None, recall_semantic: Callable[[Request], DataFrame] | None = None,
) -> Response:
    """Answer a request. ``load_counters`` gets the candidates' ``source_id``; if it or the vector route fails, the answer is a degraded one.

    Both are read here, since they may fail only when read: at most 200 candidates, and a row of counters a candidate.
    """
    spark, lost = posts.sparkSession, []

    def read(what: str, make: Callable[[], DataFrame]) -> DataFrame | None:
        try:
            found = make()
            return spark.createDataFrame(found.collect(), found.schema)
        except Exception as e:  # any failure of a helper leaves the search itself whole
            lost.append(f"{what} unavailable: {type(e).__name__}")
            return None

    near = read("Semantic recall", lambda: recall_semantic(request).limit(min(request.recall_k, 200))) if recall_semantic else None
    rows = candidates(posts, request, near)
    total = rows.count()
    counters = read("Redis realtime features", lambda: load_counters(rows.select("source_id"))) if load_counters and total else None
    items = [r.asDict(True) for r in _ranked_hits(rows, counters, request).collect()]
    return Response(uuid.uuid4().hex, request.query, total, len(items), items, bool(lost), "; ".join(lost) or None)
