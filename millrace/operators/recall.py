"""Recall routes over posts: hard filters, freshness, lexical and vector routes, merging and hydration."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import geo, text, vectors
from millrace.operators import vector_index
from millrace.operators.recommendation import dense_index

FRESHNESS = (F.desc_nulls_last, "updated_at"), (F.desc, "views"), (F.desc, "id")
MOST = 2000


@dataclass(frozen=True)
class Filters:
    """Optional hard filters; a blank text or an empty list filters nothing."""

    category: str | None = None
    visible_statuses: Sequence[str] = field(default_factory=tuple)
    city: str | None = None
    district: str | None = None
    latitude: float | None = None
    longitude: float | None = None
    radius_km: float | None = None

    def __post_init__(self):
        if (self.latitude is None) != (self.longitude is None):
            raise ValueError("latitude and longitude come together")
        if self.latitude is not None and not (-90 <= self.latitude <= 90 and -180 <= self.longitude <= 180):
            raise ValueError("a latitude is from -90 to 90, a longitude from -180 to 180")
        if self.radius_km is not None and (self.latitude is None or not 0 < self.radius_km <= 500):
            raise ValueError("a radius is above 0 and at most 500 km, and needs a place")

    @property
    def box(self):
        return None if self.radius_km is None else geo.bounding_box(self.latitude, self.longitude, self.radius_km)

    def column(self, box: bool = True) -> Column:
        """Plain predicates on columns, which Catalyst pushes into the scan."""
        out = F.lit(True)
        for name in ("category", "city", "district"):
            if (value := getattr(self, name)) and value.strip():
                out = out & (F.col(name) == value.strip())
        if statuses := list(dict.fromkeys(s.strip() for s in self.visible_statuses if s and s.strip())):
            out = out & F.col("visible_status").isin(statuses)
        return out & geo.in_box(F.col("latitude"), F.col("longitude"), self.box) if box and self.box else out

    def distance(self) -> Column:
        if self.latitude is None:
            return F.lit(None).cast("double")
        return geo.haversine(F.lit(self.latitude), F.lit(self.longitude), F.col("latitude"), F.col("longitude"))


def checked_limit(limit: int, most: int = MOST) -> int:
    if not 1 <= limit <= most:
        raise ValueError(f"a limit is between 1 and {most}")
    return limit


def freshest(posts: DataFrame, filters: Filters, limit: int = 200) -> DataFrame:
    """The most recently updated posts that pass the filters: one bounded top-k, no full sort."""
    return posts.where(filters.column()).orderBy(F.desc_nulls_last("updated_at"), F.desc("views"), F.desc("id")).limit(checked_limit(limit))


def within_radius(rows: DataFrame, filters: Filters) -> DataFrame:
    """Rows with coordinates inside the radius, with ``distance_km``; the box goes first, as plain ranges."""
    return rows.where(filters.column()).withColumn("distance_km", filters.distance()).where(F.col("distance_km") <= filters.radius_km)


def lexical_routes(posts: DataFrame, text_terms: Sequence[str], tag_terms: Sequence[str], filters: Filters, scan: int) -> DataFrame:
    """The union of three bounded routes: most terms in the title, in the content, most tags."""
    own = posts.where(filters.column()).select(
        "id", "source", "source_id", "updated_at", "latitude", "longitude", text.match_count(F.col("title"), list(text_terms)).alias("in_title"),
        text.match_count(F.col("content"), list(text_terms)).alias("in_content"),
        F.size(F.filter("tags", lambda t: t.isin(list(tag_terms)))).cast("double").alias("in_tags"),
    )
    routes = [own.where(F.col(c) > 0).orderBy(F.desc(c), F.desc_nulls_last("updated_at"), F.desc("id")).limit(scan) for c in ("in_title", "in_content", "in_tags")]
    return routes[0].unionByName(routes[1]).unionByName(routes[2]).distinct()


def lexical(posts: DataFrame, text_terms: Sequence[str], tag_terms: Sequence[str], filters: Filters, limit: int = 200, overfetch: float = 2.0) -> DataFrame:
    """Posts by weighted term matches in title, tags and content, from three bounded routes."""
    met = lexical_routes(posts, text_terms, tag_terms, filters, min(MOST, max(limit, math.ceil(limit * overfetch))))
    return score_lexical(met, text_terms, tag_terms, filters, limit)


def score_lexical(met: DataFrame, text_terms: Sequence[str], tag_terms: Sequence[str], filters: Filters, limit: int) -> DataFrame:
    """Rows of ``lexical_routes`` by their weighted matches."""
    terms = len(text_terms) or 1
    scored = met.withColumns({
        "title_score": F.least(F.lit(1.0), F.col("in_title") / terms),
        "content_score": F.least(F.lit(1.0), 0.8 * F.col("in_content") / terms),
        "tag_score": F.least(F.lit(1.0), F.col("in_tags") / max(1, min(2, len(tag_terms)))),
    }).withColumn("lexical_score", 0.55 * F.col("title_score") + 0.30 * F.col("tag_score") + 0.15 * F.col("content_score"))
    if filters.radius_km is not None:
        scored = scored.withColumn("distance_km", filters.distance()).where(F.col("distance_km") <= filters.radius_km)
    order = [F.desc("lexical_score"), F.desc("title_score"), F.desc("tag_score"), F.desc("content_score"), F.desc_nulls_last("updated_at"), F.desc("id")]
    return scored.orderBy(*order).limit(checked_limit(limit))


def lexical_query(posts: DataFrame, query: str, filters: Filters, limit: int = 200, overfetch: float = 2.0) -> DataFrame:
    """Lexical recall of a query as it was typed: its terms are drawn from it on the driver, once."""
    words, tags = text.query_terms(query)
    return lexical(posts, words, tags, filters, limit, overfetch)


@dataclass(frozen=True)
class Route:
    """How a route recalls, checked as a whole."""

    name: str
    limit: int = 200
    overfetch: float = 2.0
    ef_search: int = 200
    iterative_scan: str = "strict_order"

    def __post_init__(self):
        most = {"freshness": 1.0, "lexical": 10.0, "semantic": 4.0}.get(self.name)
        if most is None:
            raise ValueError(f"no route {self.name!r}")
        checked_limit(self.limit)
        if not 1 <= self.ef_search <= 1000 or self.iterative_scan not in ("off", "strict_order"):
            raise ValueError("ef_search is 1 to 1000, and a scan is off or strict_order")
        if self.name != "freshness" and not 1 <= self.overfetch <= most:
            raise ValueError(f"overfetch is 1 to {most:g}")

    def scan(self, radius: bool) -> int:
        """Rows to fetch before exact filters: a semantic route fetches more only for a radius, a lexical one for its three parts."""
        if self.name == "freshness" or (self.name == "semantic" and not radius):
            return self.limit
        return min(MOST, max(self.limit, math.ceil(self.limit * self.overfetch)))


def check_vectors(rows: DataFrame, column: str, size: int) -> int:
    """The number of stored vectors; an error if one has another size than the index is made for."""
    found, wrong = rows.where(F.col(column).isNotNull()).agg(F.count(F.lit(1)), F.count_if(F.size(column) != size)).first()
    if wrong:
        raise ValueError(f"{wrong} of {found} vectors have not {size} numbers")
    return found


def nearest_exact(rows: DataFrame, vector: str, asked: Column, limit: int) -> DataFrame:
    """Rows by cosine to one vector: an exact scan in whole-stage code with a bounded top-k."""
    return rows.withColumn("semantic_score", vectors.cosine(F.col(vector), asked)).orderBy(F.desc("semantic_score"), F.desc("id")).limit(checked_limit(limit))


def merge_routes(freshness: DataFrame, semantic: DataFrame) -> DataFrame:
    """Candidates of both routes once each: ranks, the best semantic score, and the routes that found them."""
    key = ["source", "source_id"]
    fresh = freshness.groupBy(*key).agg(F.min("rank").alias("freshness_rank"))
    near = semantic.groupBy(*key).agg(F.min("rank").alias("semantic_rank"), F.max("semantic_score").alias("semantic_score"))
    found = F.array_compact(F.array(F.when(F.col("freshness_rank").isNotNull(), "freshness"), F.when(F.col("semantic_rank").isNotNull(), "semantic")))
    return fresh.join(near, key, "full_outer").withColumn("recall_sources", found)


def semantic(posts: DataFrame, vectors_: DataFrame, asked: Column, filters: Filters, limit: int = 200) -> DataFrame:
    """``source, source_id, semantic_score``: the posts that pass all hard filters, radius included, nearest to a vector. ``vectors_``: id, embedding."""
    rows = posts.where(filters.column())
    if filters.radius_km is not None:
        rows = rows.where(filters.distance() <= filters.radius_km)
    return nearest_exact(rows.select("id", "source", "source_id").join(vectors_, "id"), "embedding", asked, limit).select("source", "source_id", "semantic_score")


def semantic_indexed(posts: DataFrame, index: DataFrame, queries: DataFrame, vectors_: DataFrame, filters: Filters, route: Route) -> DataFrame:
    """``query_id, id, semantic_score, rank`` (and ``distance_km`` with a radius): the nearest posts that pass all hard filters, by a vector index.

    The box of a radius is a filter of the index search, which fetches more then; the exact radius goes last. Scores are of the
    stored vectors (``vectors_``: id, embedding), only those of rows that were found; ``queries``: query_id, vector.
    """
    allowed = posts.where(filters.column())
    scan = route.scan(filters.radius_km is not None)
    found = vector_index.search(index, queries, scan, ef_search=route.ef_search, allowed=allowed, iterative=route.iterative_scan).select("query_id", "id")
    rows = found.join(allowed.select("id", filters.distance().alias("distance_km")), "id")
    rows = rows if filters.radius_km is None else rows.where(F.col("distance_km") <= filters.radius_km)
    scored = rows.join(vectors_.select("id", "embedding"), "id").join(queries.select("query_id", "vector"), "query_id")
    scored = scored.select("query_id", "id", "distance_km", vectors.cosine(F.col("embedding"), F.col("vector")).alias("semantic_score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("semantic_score"), F.desc("id")))
    return scored.withColumn("rank", rank).where(F.col("rank") <= route.limit)


def hydrate(candidates: DataFrame, posts: DataFrame) -> DataFrame:
    """Candidates with their rows; those without one are dropped. Recall bounds the candidates to a few thousand keys, so they go to the posts."""
    return posts.join(F.broadcast(candidates), ["source", "source_id"])


def checked_keys(keys: DataFrame) -> DataFrame:
    """Trimmed business keys; a blank one is an error, raised by the task that meets it."""
    blank = (F.trim("source") == "") | (F.trim("source_id") == "") | F.col("source").isNull() | F.col("source_id").isNull()
    fail = F.raise_error(F.lit("a candidate needs a source and a source id")).cast("string")
    return keys.withColumns({"source": F.when(blank, fail).otherwise(F.trim("source")), "source_id": F.when(blank, fail).otherwise(F.trim("source_id"))})


def multi_get(posts: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows in the order of a key table (source, source_id, ordinal); repeated keys keep their first place, blank ones find nothing."""
    first = keys.where((F.trim("source") != "") & (F.trim("source_id") != "")).groupBy(F.trim("source").alias("source"), F.trim("source_id").alias("source_id")).agg(F.min("ordinal").alias("ordinal"))
    return posts.join(first, ["source", "source_id"])


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order given."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def ordered_dedupe(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Each key once, with its ``first`` place in a numeric order and its ``place`` among the keys that are left, from 0."""
    once = rows.groupBy(*keys).agg(F.min(order).alias("first"))
    return once.join(dense_index(once, "first"), "first").select(*keys, "first", F.col("row").alias("place"))


def inverted_index(posts: DataFrame, column: str) -> DataFrame:
    """(term, id) pairs of the distinct words of a text, or of the elements of an array."""
    words = F.col(column) if dict(posts.dtypes)[column].startswith("array") else F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return posts.select(F.explode(F.array_distinct(words)).alias("term"), "id")
