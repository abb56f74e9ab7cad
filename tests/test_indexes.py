"""The vector index against an exact scan, and the posting index against the lexical scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import blocks, posting_index, recall, vector_index
from millrace.plans import registry
from millrace.sources import domain

SF = "/root/testdata/sf0.001"


def clustered(rng, n, dim=24):
    middle = rng.normal(size=(12, dim))
    return middle[rng.integers(0, 12, n)] + 0.7 * rng.normal(size=(n, dim))


def units(x):
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("<f4")


def test_graph():
    rng = np.random.default_rng(1)
    x = units(clustered(rng, 3000))
    made = vector_index.Graph.build(np.arange(3000), x)
    row = made.row(0)
    graph = vector_index.Graph.read(row["ids"], row["units"], row["starts"], row["links"])
    assert len(graph.levels) > 1 and all((a == b).all() for old, new in zip(made.levels, graph.levels, strict=True) for a, b in zip(old, new, strict=True))
    true = lambda q, rows, k: set(rows[np.argsort(-(x[rows] @ q), kind="stable")[:k]].tolist())
    every, some = np.arange(3000), rng.random(3000) < 0.01
    for ef, k, least in ((40, 20, 0.9), (100, 50, 0.9), (200, 100, 0.95), (200, 200, 0.9)):
        hits = sum(len(true(q, every, k) & set(sorted(graph.search(q, k, ef), key=lambda j: -(x[j] @ q))[:k])) for q in x[::100])
        assert hits >= least * k * 30
    for q in x[::300]:
        # A rare filter: the walk goes on until enough pass, or nothing is left; without strictness it stops.
        assert len(graph.search(q, 10, 40, some)) >= 10
        assert set(graph.search(q, 10_000, 40, some)) == set(np.flatnonzero(some).tolist())
        assert len(graph.search(q, 10, 40, some, strict=False)) < 10
        assert graph.search(q, 10, 40, np.zeros(3000, bool)) == []


def test_graphs_of_few_equal_and_far_rows():
    for x in (np.ones((1, 4)), np.ones((50, 4)), np.concatenate((np.tile([[1.0, 0, 0, 0]], (200, 1)), np.tile([[0, 1.0, 0, 0]], (200, 1)), np.tile([[0, 0, -1.0, 0]], (3, 1))))):
        graph = vector_index.Graph.build(np.arange(len(x)), units(x))
        for q in units(x)[:: max(1, len(x) // 5)]:
            assert len(graph.search(q, 5, len(x))) == len(x)  # every row can be reached
            assert max(graph.units[graph.search(q, 1, 10)] @ q) == pytest.approx(1)


def test_search_over_shards(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = clustered(rng, 900)
    rows = spark.createDataFrame([(int(3_000_000_000 + i), v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    index = vector_index.build(rows.repartition(7), f"file://{tmp_path}/v", 24, shard_rows=200)
    assert index.count() == vector_index.shards_of(index) == 5
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    truth = vector_index.exact(rows, asked, 50)
    found = vector_index.search(vector_index.read(spark, f"file://{tmp_path}/v"), asked, 50, ef_search=200, block=5)
    got = {r.k: r for r in vector_index.measured(found, truth, [10, 50]).collect()}
    assert got[50].queries == got[50].complete == 18 and got[10].recall >= 0.99 and got[50].recall >= 0.97 and got[50].least == 50
    same = found.where("rank = 1").join(truth.where("rank = 1").select("query_id", F.col("id").alias("best"), F.col("score").alias("own")), "query_id")
    assert same.where("id <> best OR abs(score - own) > 1e-6 OR id <> query_id").isEmpty()
    # Under a filter the lists are those of the exact scan of what passes, complete, and none else.
    allowed = rows.where("id % 45 = 0").select("id")
    filtered = vector_index.search(index, asked, 30, ef_search=40, allowed=allowed)
    want = vector_index.exact(rows.join(allowed, "id", "left_semi"), asked, 30)
    assert filtered.select("query_id", "id").exceptAll(want.select("query_id", "id")).isEmpty() and filtered.count() == want.count() == 18 * 20
    assert vector_index.search(index, asked, 5, allowed=rows.limit(0)).isEmpty()
    for wrong in ({"ef_search": 0}, {"ef_search": 1001}, {"iterative": "relaxed"}):
        with pytest.raises(ValueError):
            vector_index.search(index, asked, 5, **wrong)


def test_rows_that_cannot_be_indexed(spark, tmp_path):
    fine = [(1, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [1e200, 1e200]), (3, [1e-200, 0.0])]
    for bad in ((4, None), (4, []), (4, [1.0]), (4, [0.0, 0.0]), (4, [1.0, float("nan")]), (4, [float("inf"), 1.0]), (4, [None, 1.0]), (None, [1.0, 1.0])):
        with pytest.raises(ValueError, match="1 of 5"):
            vector_index.build(spark.createDataFrame([*fine, bad], "id long, embedding array<double>"), f"file://{tmp_path}/x", 2)
    index = vector_index.build(spark.createDataFrame(fine, "id long, embedding array<double>"), f"file://{tmp_path}/y", 2)
    asked = spark.createDataFrame([(7, [1.0, 1.0]), (8, None), (9, [0.0, 0.0]), (10, [1.0])], "query_id long, vector array<double>")
    rows = vector_index.search(index, asked, 9).orderBy("rank").collect()
    assert [r.id for r in rows] == [2, 1, 1, 3] and {r.query_id for r in rows} == {7}
    empty = vector_index.build(spark.createDataFrame([], "id long, embedding array<double>"), f"file://{tmp_path}/z", 2)
    assert vector_index.search(empty, asked, 3).isEmpty()


def test_recall_of_the_registered_index(spark):
    rows = {(r.ef_search, r.k): r for r in registry.QUERIES["semantic_index_recall"](spark, SF).collect()}
    assert len(rows) == 15 and all(rows[200, k].recall >= 0.9 for k in (20, 50, 100, 200)) and rows[40, 20].recall >= 0.9
    assert all(r.most <= ef and (r.complete == r.queries) == (k <= ef) for (ef, k), r in rows.items())


def test_coded_places():
    rng = np.random.default_rng(3)
    for top in (1, 100, 300, 40_000, 2**31 - 1):
        places = np.unique(rng.integers(0, top, 200))
        assert (posting_index.unpacked(int(places[0]), posting_index.packed(places)) == places).all()


def test_grams():
    texts = ["ab c", "", "éab", "漢字漢", "ab", "a\0b", "aaaa", "𝒳y"]
    codes, at = posting_index.grams(texts)
    want = {(t[i : i + n], k) for k, t in enumerate(texts) for n in (1, 2, 3) for i in range(len(t) - n + 1) if "\0" not in t[i : i + n]}
    assert len(codes) == len(want) and set(zip(posting_index.spelled(codes), at.tolist(), strict=True)) == want
    assert posting_index.needed("ABcd") == ["abc", "bcd"] and posting_index.needed("é") == ["é"] and posting_index.needed("a\0bcde") == ["a", "bcd", "cde"] and posting_index.needed("\0") == []


@pytest.fixture(scope="module")
def posted(spark, tmp_path_factory):
    odd = [(9001, None, None, None, None), (9002, "", "", [], None), (9003, "The THE the", "ｔｈｅ", ["the", None, "the"], "2030-01-01"), (9004, "x\0y", "修电脑 附近", ["修电脑"], "2030-01-01")]
    rows = spark.createDataFrame(odd, "id long, title string, content string, tags array<string>, updated string")
    rows = rows.select("id", F.lit("s").alias("source"), F.col("id").cast("string").alias("source_id"), "title", "content", "tags", F.lit("求助").alias("category"), F.lit("c1").alias("city"), F.lit("d1").alias("district"), F.lit("0").alias("visible_status"), F.lit(37.7).alias("latitude"), F.lit(112.7).alias("longitude"), F.col("updated").cast("timestamp").alias("updated_at"))
    posts = domain.posts(spark, SF).select(*rows.columns).withColumn("updated_at", F.col("updated_at").cast("timestamp")).unionByName(rows).persist()
    return posts, posting_index.build(posts, f"file://{tmp_path_factory.mktemp('postings')}", segment_rows=60, buckets=16)


def test_postings_give_what_the_scan_gives(spark, posted):
    posts, index = posted
    assert index.docs.select("segment").distinct().count() >= 3
    filters = [recall.Filters(), recall.Filters(visible_statuses=("0",), city="c1"), recall.Filters(latitude=37.7, longitude=112.7, radius_km=40.0)]
    cases = [(["the", "tion"], ["en", "m3"], 3), (["un", "é", "zz"], ["de"], 50), (["電脑", "修电脑"], ["修电脑"], 5), (["a"], [], 2), (["x\0y", "the"], ["the"], 7), ([], ["src1"], 4), (["nothing at all"], ["none"], 5), (["", "the"], [], 4)]
    key = lambda df: [tuple(r) for r in df.select("id", "in_title", "in_content", "in_tags").orderBy("id").collect()]
    for n, (words, tags, scan) in enumerate(cases):
        f = filters[n % 3]
        assert key(posting_index.lexical_routes(index, posts, words, tags, f, scan)) == key(recall.lexical_routes(posts, words, tags, f, scan)), (words, f)


def test_typed_queries_by_postings(spark, posted):
    posts, index = posted
    for typed, f in (("The, tion? m3", recall.Filters()), ("怎么修电脑？附近", recall.Filters(city="c1")), ("ed of", recall.Filters(visible_statuses=("0", "2")))):
        got = posting_index.lexical_query(index, posts, typed, f, limit=6)
        want = recall.lexical_query(posts, typed, f, limit=6)
        assert [(r.id, r.lexical_score) for r in got.collect()] == [(r.id, r.lexical_score) for r in want.collect()]


def test_a_query_reads_the_buckets_of_its_terms(spark, posted):
    _, index = posted
    rows = index.rows({"title": ["the"], "tags": ["en"]})
    assert {tuple(r) for r in rows.select("field", "term").distinct().collect()} == {("title", "the"), ("tags", "en")}
    assert "PartitionFilters: [isnotnull(bucket" in rows._jdf.queryExecution().executedPlan().toString() or "PartitionFilters: [bucket" in rows._jdf.queryExecution().executedPlan().toString()
    read = {r[0] for r in rows.select(F.regexp_extract(F.input_file_name(), r"bucket=(\d+)", 1).cast("int")).distinct().collect()}
    assert len(read) <= 2 and index.rows({}).isEmpty()


def test_scans_of_vectors_are_blocks_in_tasks_of_their_own(spark):
    """Against brute force, with many equal vectors, and with one that has no direction; blocks are not put into one task, however small they are."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8)).round(3)
    x[100:160] = x[7]
    keys = rng.permutation(300).tolist()
    for none in (False, True):
        rows = spark.createDataFrame([(i, x[at].tolist() if i or not none else None) for at, i in enumerate(keys)], "id long, v array<double>")
        asked = rows.where("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("vector")).where("vector IS NOT NULL")
        of = {i: x[at] for at, i in enumerate(keys) if i or not none}
        for largest, apart in ((True, False), (False, True)):
            got = {}
            for r in vector_index.scanned(asked, rows, 12, largest=largest, apart=apart).orderBy("query_id", "rank").collect():
                got.setdefault(r.query_id, []).append(r.id)
            cosine = lambda a, b: round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 12)
            want = {q: sorted((j for j in of if not apart or j != q), key=lambda j, q=q: (-cosine(of[q], of[j]), -j if largest else j))[:12] for q in of if q % 10 == 0}
            assert got == want
    left, right = spark.range(40), spark.range(60).withColumnRenamed("id", "other")
    pairs = blocks.block_pairs(left, right, "id", "other", 10)
    assert pairs.rdd.getNumPartitions() == 24 and pairs.distinct().count() == 2400


def test_grams_by_one_number_or_two():
    """Against brute force, whether an n-gram and its text fit one number or not."""
    texts = ["", "abcab", "a", "é漢字\U0001f600ab", "a\0b", "ab", "\U0010ffff" * 4]
    want = {(g, n) for n, t in enumerate(texts) for size in (1, 2, 3) for at in range(len(t) - size + 1) if "\0" not in (g := t[at : at + size])}
    for bits in (62, 1):
        code, of = posting_index.grams(texts, bits)
        got = [(g.rstrip("\0"), n) for g, n in zip(posting_index.spelled(code), of.tolist(), strict=True)]
        assert len(got) == len(want) and set(got) == want and np.array_equal(np.lexsort((of, code)), np.arange(len(code)))
    assert [len(x) for x in posting_index.grams([""])] == [0, 0]
