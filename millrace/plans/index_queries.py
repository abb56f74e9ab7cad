"""Queries over the vector index and the posting index, each built in the shared folder and searched."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from millrace.operators import posting_index, recall, vector_index
from millrace.plans.recall_queries import LEXICAL_QUERY_SQL, LEXICAL_SQL, SEMANTIC_FILTERED_SQL, TAG_TERMS, TERMS, TYPED
from millrace.plans.registry import query
from millrace.sources import domain
from millrace.sources.shared import new_path

EFS, CUTOFFS = (40, 100, 200), [20, 50, 100, 200, 500]
_SHOWN = recall.Filters(visible_statuses=("0", "1"))
_RARE = recall.Filters(visible_statuses=("1",), category="问答", city="c1")


def _vectors(spark, sf):
    return domain.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _index(spark, sf):
    return vector_index.build(_vectors(spark, sf), new_path(spark, "vectors"), 64)


def _asked(spark, sf):
    return _vectors(spark, sf).where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))


@query("semantic_index_recall")
def semantic_index_recall(spark, sf):
    """By ``ef_search`` and cutoff: how many lists of every fiftieth vector are complete, and their recall against the exact scan."""
    index, asked = _index(spark, sf), _asked(spark, sf)
    truth = vector_index.exact(_vectors(spark, sf), asked, max(CUTOFFS)).persist()
    parts = [vector_index.measured(vector_index.search(index, asked, max(CUTOFFS), ef_search=ef), truth, CUTOFFS).withColumn("ef_search", F.lit(ef)) for ef in EFS]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "semantic_index_filtered",
    "SELECT q.vec_id AS query_id, count(*) FILTER (WHERE n <= 20) AS returned FROM (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0) q, (SELECT row_number() OVER (ORDER BY id) AS n FROM posts JOIN embeddings ON vec_id = id WHERE visible_status = '1' AND category = '问答' AND city = 'c1') GROUP BY 1",
    ["posts"],
)
def semantic_index_filtered(spark, sf):
    """How many rows a strict search under a rare filter gives: all that pass, or as many as wanted, although the nearest rows do not pass."""
    allowed = domain.posts(spark, sf).where(_RARE.column()).select("id")
    found = vector_index.search(_index(spark, sf), _asked(spark, sf), 20, ef_search=40, allowed=allowed)
    return found.join(allowed, "id").groupBy("query_id").agg(F.count(F.lit(1)).alias("returned"))


@query("semantic_indexed", SEMANTIC_FILTERED_SQL, ["posts"])
def semantic_indexed(spark, sf):
    """The vector route of one request within a radius, by the index."""
    filters = recall.Filters(visible_statuses=("0", "1"), latitude=37.7, longitude=112.7, radius_km=60.0)
    asked = _vectors(spark, sf).where("id = 5").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    found = recall.semantic_indexed(domain.posts(spark, sf), _index(spark, sf), asked, _vectors(spark, sf), filters, recall.Route("semantic", 20, 4.0, 200))
    return found.select("id", F.round("semantic_score", 6).alias("score"), F.round("distance_km", 4).alias("distance_km"))


def _postings(spark, sf):
    return posting_index.build(domain.posts(spark, sf), new_path(spark, "postings"))


@query("recall_lexical_indexed", LEXICAL_SQL, ["posts"])
def recall_lexical_indexed(spark, sf):
    found = posting_index.lexical(_postings(spark, sf), domain.posts(spark, sf), TERMS, TAG_TERMS, _SHOWN, limit=50)
    return found.select("id", F.round("lexical_score", 6).alias("lexical_score"))


@query("recall_lexical_query_indexed", LEXICAL_QUERY_SQL, ["posts"])
def recall_lexical_query_indexed(spark, sf):
    found = posting_index.lexical_query(_postings(spark, sf), domain.posts(spark, sf), TYPED, _SHOWN, limit=50)
    return found.select("id", F.round("lexical_score", 6).alias("lexical_score"))


@query(
    "posting_counts",
    " UNION ALL ".join(f"SELECT '{f}' AS field, '{t}' AS term, count(*) AS posts FROM posts WHERE contains(lower({f}), '{t}')" for f in ("title", "content") for t in ("the", "ion", "un", "é"))
    + " UNION ALL SELECT 'tags', t, count(*) FROM (SELECT id, unnest(list_distinct(tags)) AS t FROM posts) WHERE t IN ('en', 'm3') GROUP BY t",
    ["posts"],
)
def posting_counts(spark, sf):
    """How many posts hold a term, from the lengths of its posting blocks."""
    grams = ["the", "ion", "un", "é"]
    found = _postings(spark, sf).rows({"title": grams, "content": grams, "tags": ["en", "m3"]})
    return found.groupBy("field", "term").agg(F.sum("n").alias("posts"))
