"""Many searches in one job: a table of requests, recalled by their filters, scored together, and cut to the best of each.

Requests that have the same filters share what they recall, so recall is a join of distinct filters with posts: by equality on
the categories, cities and districts that they name, in blocks where many posts share one, and in blocks of both sides for filters that
name none. Of every filter only the freshest posts go on. Requests that have the same query as well are one search, whose list is that of
each. Texts are normalised once a post, queries cut up once a search, and scored where they meet: pairs are dealt out by their number, as the
freshest posts, which many searches share, are few bytes. The scores are those of ``search.search`` with the freshness route.

Defined cases: blank filters filter nothing; a request with an empty query, a null id, or a radius without a place is an error; one that
finds nothing has no rows; rows that repeat a request id are an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import geo, scores, text
from millrace.operators import recall, search
from millrace.operators.blocks import block_join, block_pairs
from millrace.sources.shared import written

_EQUAL = ("category", "city", "district")
_PLACE = ("latitude", "longitude", "radius_km")
_COUNTERS = ("views_1h", "views_24h", "likes_24h", "marks_24h", "unlocks_24h")
_FRESH = ("updated_at", "views", "id")


def checked(requests: DataFrame) -> DataFrame:
    """``request_id, q`` and the filters of requests (request_id, query and any of category, city, district, latitude, longitude, radius_km), written."""
    of = lambda c, kind: F.col(c).cast(kind) if c in requests.columns else F.lit(None).cast(kind)
    equal = [F.nullif(F.trim(of(c, "string")), F.lit("")).alias(c) for c in _EQUAL]
    rows = requests.select("request_id", text.normalize(F.col("query"), unicode=True).alias("q"), *equal, *(of(c, "double").alias(c) for c in _PLACE))
    rows = rows.withColumn("filter", F.md5(F.to_json(F.struct(*_EQUAL, *_PLACE))))
    table = written(rows, "requests")
    placed = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    total, ids, blank, wrong = table.agg(
        F.count(F.lit(1)), F.countDistinct("request_id"), F.count_if(F.coalesce(F.col("q") == "", F.lit(True))), F.count_if(F.col("radius_km").isNotNull() & (~placed | ~F.col("radius_km").between(1e-9, 500))),
    ).first()
    if ids != total or blank or wrong:
        raise ValueError(f"of {total} requests {total - ids} have no id of their own, {blank} no query, and {wrong} a radius without a place or beyond 500 km")
    return table


def recalled(posts: DataFrame, requests: DataFrame, recall_k: int) -> DataFrame:
    """``filter, id``: the freshest posts that pass each distinct filter of ``checked`` requests."""
    filters = requests.select("filter", *_EQUAL, *_PLACE).distinct()
    keys = posts.select(*_FRESH, "latitude", "longitude", *_EQUAL)
    named = [F.col(c).isNotNull().alias(c) for c in _EQUAL]
    parts = []
    for row in filters.select(*named).distinct().collect():  # at most eight
        own = [c for c in _EQUAL if row[c]]
        same = reduce(lambda a, c: a & (F.col(c).isNotNull() == F.lit(c in own)), _EQUAL, F.lit(True))
        some = filters.where(same).select(F.concat_ws("\u0001", *own).alias("key"), "filter", *_PLACE)
        there = keys.where(reduce(lambda a, c: a & F.col(c).isNotNull(), own, F.lit(True))).select(F.concat_ws("\u0001", *own).alias("key"), *_FRESH, "latitude", "longitude")
        parts.append((block_join(some, there, "key", "filter", "id") if own else block_pairs(some, there, "filter", "id")).select(
            "a.filter", *(F.col(f"a.{c}").alias(f"at_{c}") for c in _PLACE), *(f"b.{c}" for c in (*_FRESH, "latitude", "longitude")),
        ))
    if not parts:
        return filters.select("filter", F.lit(None).cast(posts.schema["id"].dataType).alias("id")).limit(0)
    met = reduce(lambda a, b: a.unionByName(b), parts)
    inside = geo.in_box_of(F.col("latitude"), F.col("longitude"), F.col("at_latitude"), F.col("at_longitude"), F.col("at_radius_km"))
    met = met.where(F.col("at_radius_km").isNull() | inside)
    # Spark keeps only the first of each filter in every task before it shuffles.
    rank = F.row_number().over(Window.partitionBy("filter").orderBy(F.desc_nulls_last("updated_at"), F.desc("views"), F.desc("id")))
    return met.withColumn("n", rank).where(F.col("n") <= recall_k).select("filter", "id")


def searches(asked: DataFrame) -> DataFrame:
    """``search, q, tokens, grams`` and the filters of ``checked`` requests, those with the same query and filters once, by the first of their ids."""
    once = asked.groupBy("q", "filter", *_EQUAL, *_PLACE).agg(F.min("request_id").alias("search"))
    return once.select("search", "q", text.tokens_of(F.col("q")).alias("tokens"), text.char_bigrams(F.col("q")).alias("grams"), "filter", *(F.col(c).alias(f"want_{c}") for c in _EQUAL), *_PLACE)


def search_many(posts: DataFrame, counters: DataFrame | None, requests: DataFrame, top_k: int = 10, recall_k: int = 200, task_pairs: int = 20_000) -> DataFrame:
    """``request_id, rank, id, source, source_id, category, distance_km, score, text_score, geo_score, hot_score`` of each request's best posts."""
    recall.checked_limit(recall_k)
    if not 1 <= top_k <= min(100, recall_k):
        raise ValueError("top_k is 1 to 100 and at most recall_k")
    asked = checked(requests)
    keys = written(recalled(posts, asked, recall_k), "recalled")
    rows = posts.join(keys.select("id").distinct(), "id", "left_semi")
    fields = rows.select(
        "id", "source", "source_id", "category", "city", "district", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "title", "tags", "content",
        scores.static_hot(*(F.col(c) for c in ("views", "likes", "marks", "dislikes"))).alias("static_raw"),
    )
    once = written(searches(asked), "searches")
    number = keys.groupBy("filter").agg(F.count(F.lit(1)).alias("n")).join(once.groupBy("filter").agg(F.count(F.lit(1)).alias("m")), "filter").agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0]
    tasks = max(int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions")), number // task_pairs)
    wanted = once.join(keys, "filter").drop("filter").repartition(tasks, "id")
    scored = _scored(_cut(search.normalised(fields)), wanted)
    if counters is None:
        scored = scored.withColumns({c: F.lit(0) for c in _COUNTERS})
    else:
        scored = scored.join(counters, "source_id", "left").withColumns({c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)) for c in _COUNTERS})
    best = written(_best(scored, top_k), "best")
    of = asked.join(once.select("search", "q", "filter"), ["q", "filter"]).select("search", "request_id")
    return of.join(best, "search").drop("search")


def _cut(fields: DataFrame) -> DataFrame:
    return fields.withColumns({f"__{name}_dense": text.dense_of(F.col(f"__{name}")) for name in search.FIELDS})


def _scored(fields: DataFrame, wanted: DataFrame) -> DataFrame:
    # Never a broadcast: where the posts lie, those that most searches want are in one task.
    met = fields.hint("merge").join(wanted, "id")
    matches = [text.field_match(F.col("q"), F.col(f"__{name}"), F.col(f"__{name}_dense"), F.col("tokens"), F.col("grams")) for name in search.FIELDS]
    same = lambda c: F.coalesce(F.col(c) == F.col(f"want_{c}"), F.lit(False))
    # The score comes out of an array of one element, so that its condition does not make it again.
    rows = met.select("*", F.explode(F.array(text.text_score(*matches))).alias("text_score")).withColumns({
        "distance_km": geo.haversine(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon")),
    })
    rows = rows.where((F.col("text_score") > 0) & (F.col("radius_km").isNull() | F.col("distance_km").isNull() | (F.col("distance_km") <= F.col("radius_km"))))
    located = F.col("latitude").isNotNull() | F.col("want_city").isNotNull() | F.col("want_district").isNotNull()
    return rows.select(
        "search", "id", "source", "source_id", "category", "static_raw", "text_score", "distance_km", located.alias("located"),
        geo.geo_score(F.col("distance_km"), F.col("radius_km"), same("city"), same("district")).alias("geo_score"),
    )


def _best(scored: DataFrame, top_k: int) -> DataFrame:
    """The final score over each search's candidates, whose number recall bounds."""
    over = Window.partitionBy("search")
    rows = scored.withColumns({"realtime_raw": scores.realtime_hot(*(F.col(c) for c in _COUNTERS[:4])), "unlock_raw": scores.unlock_signal(F.col("unlocks_24h"))})
    rows = rows.withColumns({
        "hot_score": 0.65 * scores.min_max(F.col("static_raw"), over) + 0.35 * scores.min_max(F.col("realtime_raw"), over), "unlock_score": scores.min_max(F.col("unlock_raw"), over),
        "unlocked": F.max(F.col("unlock_raw") > 0).over(over),
    })
    part = lambda cond, value: F.when(F.col(cond), value).otherwise(0.0)
    total = 0.50 * F.col("text_score") + 0.15 * F.col("hot_score") + part("located", 0.25 * F.col("geo_score")) + part("unlocked", 0.10 * F.col("unlock_score"))
    rows = rows.withColumn("final_score", total / (0.65 + part("located", F.lit(0.25)) + part("unlocked", F.lit(0.10))))
    order: list[Column] = [F.desc(F.round("final_score", 9)), F.desc(F.round("text_score", 9)), F.asc_nulls_last(F.round("distance_km", 6)), F.desc("id")]
    rank = F.row_number().over(over.orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top_k).select(
        "search", "rank", "id", "source", "source_id", "category", "distance_km", F.round("final_score", 6).alias("score"), *(F.round(c, 6).alias(c) for c in ("text_score", "geo_score", "hot_score")),
    )
