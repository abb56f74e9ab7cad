"""Queries that ask the whole table: nothing is left out by an id."""

import itertools
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import blocks, matching, social
from millrace.operators import recommendation as rec
from millrace.operators.blocks import block_pairs
from millrace.plans import registry
from millrace.sources import domain

SF = "/root/testdata/sf0.001"


def match(query, field):
    if not query or not field:
        return 0.0
    if query == field:
        return 1.0
    if query in field:
        return 0.9
    grams = lambda s: {s} if len(s) == 1 else {s[i : i + 2] for i in range(len(s) - 1)}
    tokens, wanted = query.split(), grams(query.replace(" ", ""))
    covered = sum(t in field for t in tokens) / max(len(tokens), 1)
    shared = len(wanted & grams(field.replace(" ", ""))) / max(len(wanted), 1)
    return min(1.0, max(0.8 * covered, 0.7 * shared))


def test_text_scores_of_every_post(spark):
    squeeze = lambda s: re.sub(r"\s+", " ", s.lower()).strip(" ")
    q, want = "the and of", {}
    for r in domain.posts(spark, SF).select("id", "title", "tags", "content").collect():
        parts = (squeeze(r.title or ""), squeeze(" ".join(r.tags)), squeeze(r.content or ""))
        want[r.id] = sum(w * match(q, f) for w, f in zip((0.55, 0.3, 0.15), parts, strict=True))
    got = {r.id: r.score for r in registry.QUERIES["text_score"](spark, SF).collect()}
    assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("query", ["a", "ab", "a b", "é漢 x", "aab"])
def test_field_match_of_short_fields(spark, query):
    fields = ["", "a", "b", "ab", "b a", "xaab", "é", "é 漢x", "ba b"]
    df = spark.createDataFrame([(f,) for f in fields], "f string")
    got = [r[0] for r in df.select(text.field_match(F.lit(query), F.col("f"))).collect()]
    assert got == pytest.approx([match(query, f) for f in fields])


def test_rating_matrix_of_every_user(spark):
    users = sorted({r.user for r in domain.ratings(spark, SF).select("user").collect()})
    got = registry.QUERIES["rating_matrix"](spark, SF).collect()
    assert {r.row for r in got} == set(range(len(users))) and len(got) == domain.ratings(spark, SF).count()


@pytest.mark.parametrize("keys", [[], [3], [5, 1, 5, None, 9, -2], list(range(0, 900, 7))])
def test_dense_index(spark, keys):
    got = rec.dense_index(spark.createDataFrame([(k,) for k in keys], "k long"), "k").collect()
    assert sorted((r.k, r.row) for r in got) == [(k, i) for i, k in enumerate(sorted({k for k in keys if k is not None}))]


def test_item_similarities_of_every_pair(spark):
    tags = {r.item_id: set(r.tags) for r in domain.items(spark, SF).select("item_id", "tags").collect()}
    of = {r.item_id: r.representative for r in registry.QUERIES["item_classes"](spark, SF).collect()}
    sim = {(r.item, r.other): r.sim for r in registry.QUERIES["item_cosine_classes"](spark, SF).collect()}
    for a, x in tags.items():
        for b, y in tags.items():
            got = 1.0 if of[a] == of[b] else sim.get((of[a], of[b]), 0.0)
            assert got == pytest.approx(len(x & y) / (len(x) * len(y)) ** 0.5, abs=1e-6)


def test_whole_texts_of_raw_posts(spark, tmp_path):
    long = "word " * 100 + "end"
    docs = [(i, t, "en", "web", len(t)) for i, t in ((1, long), (2, " " * 200 + "late"), (3, " " * 300))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: r.content for r in registry.QUERIES["map_posts"](spark, str(tmp_path)).collect()}
    assert got == {1: long, 2: "late", 3: "帖子"}
    assert registry.QUERIES["audit_quality"](spark, str(tmp_path)).first().empty_content_count == 1


PAIRED = ("user_similarity", "personality_compat", "complementarity", "common_interests", "interaction_jaccard", "compatibility")


@pytest.mark.parametrize("name", PAIRED)
def test_every_fiftieth_user_is_asked(spark, name):
    n = domain.users(spark, SF).count()
    assert registry.QUERIES[name](spark, SF).count() == (n // 50) * (n - 1)


def test_blocks_make_each_pair_once(spark):
    left, right = spark.range(23), spark.range(100, 117)
    got = block_pairs(left, right, "id", "id", rows=4).select("a.id", "b.id").collect()
    assert sorted(map(tuple, got)) == [(a, b) for a in range(23) for b in range(100, 117)]
    assert block_pairs(left.limit(0), right, "id", "id").count() == 0


def test_recommendations_reach_every_asked_user(spark):
    asked = {r.key for r in domain.users(spark, SF).collect() if r.key % 50 == 0}
    for name in ("recommend_content", "recommend_sequence", "recommend_context", "cold_start", "recommend_cf"):
        assert {r.user for r in registry.QUERIES[name](spark, SF).select("user").collect()} == asked, name
    both = {r.user for r in registry.QUERIES["recommend_hybrid_cf"](spark, SF).select("user").collect()}
    assert both == asked | {-1}


def test_factor_model_finds_its_own_ratings(spark):
    """The errors of the factor model on the ratings that it has learned, against those of the mean and of a dense factorisation."""
    import numpy as np

    rng = np.random.default_rng(3)
    u, v = rng.uniform(0.5, 1.5, (40, 2)), rng.uniform(0.5, 1.5, (30, 2))
    dense = u @ v.T
    known = [(i, j, float(dense[i, j])) for i in range(40) for j in range(30) if rng.random() < 0.6]
    ratings = spark.createDataFrame(known, "user long, item_id long, rating double")
    model = rec.factorize(ratings, rank=4)
    users, items = model.userFactors.toDF("user", "factors"), model.itemFactors.toDF("item_id", "factors")
    got = rec.errors(ratings, users, items).first()
    spread = float(np.std([r for _, _, r in known]))
    assert got.n == len(known) and got.rmse < 0.3 * spread
    every = rec.errors(spark.createDataFrame([(i, j, float(dense[i, j])) for i in range(40) for j in range(30)], "user long, item_id long, rating double"), users, items).first()
    assert every.rmse < 0.5 * spread  # unseen pairs, too: the matrix has rank 2


def test_pairwise_cosines_are_those_of_all_pairs(spark):
    rows = [(1, i, t) for i, t in enumerate([["a", "b"], ["b", "c"], ["c"], ["a", "b", "d"], [], ["z"]])] + [(2, 9, ["a"])]
    got = {r.g: r for r in rec.pairwise_cosines(spark.createDataFrame(rows, "g long, item_id long, tags array<string>"), "g").collect()}
    sets = [set(t) for g, _, t in rows if g == 1 and t]
    all_ = [len(a & b) / (len(a) * len(b)) ** 0.5 for i, a in enumerate(sets) for b in sets[i + 1 :]]
    mean = sum(all_) / len(all_)
    assert got[1].mean == pytest.approx(mean) and got[1].deviation == pytest.approx((sum((c - mean) ** 2 for c in all_) / len(all_)) ** 0.5)
    assert got[2].mean is None and got[2].pairs == 0


def test_cold_start_of_blank_profiles(spark):
    items, users = domain.item_profiles(spark, SF), domain.profiles(spark, SF).limit(1)
    blank = users.select(F.lit(7).cast("long").alias("user"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in users.schema.fields))
    fame = items.select("item_id", F.lit(1).cast("long").alias("fame")).limit(0)
    got = rec.cold_start(blank, items, fame, 10).collect()
    assert len(got) == 10 and all(set(r.reasons) <= {"性别匹配", "年龄匹配"} for r in got)
    assert rec.cold_start(blank.limit(0), items, fame, 10).count() == 0


def test_pair_scores_have_the_likeness_to_known_items(spark):
    items = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 9.0), (4, 8.0)], "item_id long, x double").selectExpr(
        "item_id", "x", "array('a') AS tags", "'male' AS target_gender", "0 AS target_age_min", "0 AS target_age_max", "0.0D AS couples_score"
    )
    seen = items.where("item_id = 3").select("item_id")
    near = matching.pair_cf(items, seen, ["x"])
    assert {r.item_id: round(r.cf, 6) for r in near.collect()} == {1: -1.0, 2: -1.0, 4: 1.0}
    nobody = {"interests": [], "gender": None, "age": None}
    got = matching.recommend_pair(nobody, nobody, items, seen, similar=near).collect()
    # 0.3 times the likeness, and 0.2 times the profile: 0.3 of 0.5 for ages without a target, nothing for a gender that nobody has.
    assert [(r.item_id, r.pair_score) for r in got] == [(4, 0.33), (1, -0.27), (2, -0.27)]


def test_best_pairs_are_those_of_all_pairs(spark):
    """With many ties, rows that are no results, and a bound that leaves few rows to rank."""
    from millrace.operators.blocks import best_pairs

    left, right = spark.range(12).selectExpr("id AS user"), spark.range(900).selectExpr("id AS item")
    seen = []

    def made(pairs):
        rows = pairs.selectExpr("a.user AS user", "b.item AS item", "__least", "__last", "explode(array((a.user * 7 + b.item * 31) % 40)) AS points")
        seen.append(rows)
        return rows

    got = best_pairs(left, right, "user", "item", made, 5, "user", "item", lambda rows: rows.where("item % 3 <> 0"), share=4)
    want = [(u, i, n) for u in range(12) for n, i in enumerate(sorted((i for i in range(900) if i % 3), key=lambda i: (-((u * 7 + i * 31) % 40), i))[:5], 1)]
    assert sorted((r["user"], r["item"], r["rank"]) for r in got.collect()) == want
    assert len(seen) == 3
    kept = seen[-1].where("points > __least OR points = __least AND item <= __last").count()
    assert seen[-1].count() == 12 * 900 and kept < 12 * 900 / 4


def test_content_similarity_shuffles_no_pairs(spark):
    import re

    from millrace.operators import recommendation as rec

    items = spark.createDataFrame([(1, ["x", "y"]), (2, ["x"]), (3, ["z", "x"]), (4, [])], "item_id long, tags array<string>")
    made = rec.content_similarity(items, items.where("item_id = 1"))
    assert not re.search(r"hashpartitioning\(item#\w+, other#", made._jdf.queryExecution().executedPlan().toString())
    assert sorted(r["other"] for r in made.collect()) == [2, 3, 4]


def test_stretches_of_histories_are_found_without_looking_at_every_bound(spark):
    """The stretch of an event is a binary search in generated code, not a filter of all bounds a row."""
    rows = [(u, (u * 7 + n) % 11, datetime(2024, 1, 1) + timedelta(hours=(n * 37 + u) % 500), n) for u in range(5) for n in range(60)]
    events = spark.createDataFrame(rows, "user long, item_id long, ts timestamp, seq long")
    moves = rec.transitions(events)
    assert "lambda" not in moves._jdf.queryExecution().optimizedPlan().toString()
    want = []
    for u in range(5):
        own = [r[1] for r in sorted((r for r in rows if r[0] == u), key=lambda r: (r[2], r[3], r[1]))]
        want += [(u, a, b) for a, b in itertools.pairwise(own)]
    assert sorted(map(tuple, moves.collect())) == sorted(want)
    values = [None, -5, 0, 3, 4, 9, 10**18]
    placed = blocks.placed_among(spark.createDataFrame([(v,) for v in values], "v long"), F.col("v"), [-5, 3, 3, 9], "n").collect()
    assert [r["n"] for r in placed] == [sum(b < v for b in (-5, 3, 3, 9)) if v is not None else 0 for v in values]
    assert [r["n"] for r in blocks.placed_among(spark.createDataFrame([(1,)], "v long"), F.col("v"), [], "n").collect()] == [0]


@pytest.mark.parametrize("most", [256, 2])
def test_rows_alike_are_paired_once(spark, monkeypatch, most):
    """Rows that agree in what points are made of meet the others once, and each has its own best ones all the same."""
    left = spark.createDataFrame([(u, u % 3 if u % 7 else None) for u in range(120)], "user long, taste long")
    right = spark.createDataFrame([(i, i * 13 % 17) for i in range(300)], "item_id long, kind long")
    seen = [(u, (u * 5 + n * 3) % 300) for u in range(120) for n in range(u % 6)]
    known = spark.createDataFrame([*seen, *seen[:9], (999, 1)], "user long, item_id long")
    points = F.when(F.col("b.item_id") != 7, F.coalesce(F.col("a.taste"), F.lit(5)) * F.col("b.kind") % 11)
    made = lambda pairs: pairs.select("a.user", "b.item_id", "__least", "__last", F.explode(F.array(points)).alias("points"))
    paired, plain = [], blocks.block_pairs
    monkeypatch.setattr(blocks, "block_pairs", lambda a, *rest: paired.append(a.count()) or plain(a, *rest))
    found = blocks.best_unknown(left, right, "user", "item_id", made, 4, known, ["taste"], most).select("user", "item_id", "points", "rank").collect()
    want = []
    for u in range(120):
        taste = u % 3 if u % 7 else 5
        best = sorted((-(taste * (i * 13 % 17) % 11), i) for i in range(300) if i != 7 and (u, i) not in seen)[:4]
        want += [(u, i, -p, n + 1) for n, (p, i) in enumerate(best)]
    assert sorted(map(tuple, found)) == sorted(want)
    assert min(paired) == 4


def test_people_for_users_alike_are_scored_once(spark, monkeypatch):
    paired, plain = [], blocks.block_pairs
    monkeypatch.setattr(blocks, "block_pairs", lambda a, *rest: paired.append(a.count()) or plain(a, *rest))
    people = domain.profiles(spark, "/root/testdata/sf0.01").withColumn("user", F.col("key")).withColumns({c: F.lit(25) for c in ("wanted_age_min", "wanted_age_max")})
    asked, at = people.where("key % 16 = 0"), {"location": "c2", "activity": "sport", "time": "night"}
    found = social.best_people(people, asked, 3, at).select("user", "person", F.round("score", 9).alias("score"), "rank").collect()
    assert max(paired) == 3 and len(found) == 3 * asked.count()
    pairs = block_pairs(asked, people, "key", "key").where("a.key <> b.key").withColumn("match_score", F.lit(None).cast("double"))
    every = social.score_people(pairs, at).select(F.col("a.key").alias("user"), F.col("b.key").alias("person"), "score")
    want = rec.ranked(every, "user", "score", 3, "person").select("user", "person", F.round("score", 9).alias("score"), "rank").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, want))


def test_every_user_with_ratings_is_evaluated(spark):
    rated = domain.ratings(spark, SF).select("user").distinct().count()
    assert registry.QUERIES["evaluate_recs"](spark, SF).first().users == rated > domain.users(spark, SF).count() // 50


def test_every_user_with_ratings_gets_content(spark):
    rated = {r.user for r in domain.ratings(spark, SF).select("user").distinct().collect()}
    assert {r.user for r in registry.QUERIES["recommend_content"](spark, SF).select("user").distinct().collect()} == rated


def test_every_profile_gets_items_for_a_context(spark):
    keys = {r.key for r in domain.profiles(spark, SF).select("key").collect()}
    assert {r.user for r in registry.QUERIES["recommend_context"](spark, SF).select("user").distinct().collect()} == keys


def test_every_profile_gets_filtered_items(spark):
    sf = "/root/testdata/sf0.01"  # the smallest tables have too few good items of the type
    found = registry.QUERIES["recommend_filtered"](spark, sf).select("user").distinct().count()
    assert found == domain.profiles(spark, sf).count()


def test_item_cosine_asks_every_item(spark):
    tags = {r.item_id: set(r.tags) for r in domain.items(spark, SF).select("item_id", "tags").collect()}
    got = {(r.item, r.other) for r in registry.QUERIES["item_cosine"](spark, SF).collect()}
    assert got == {(a, b) for a, x in tags.items() for b, y in tags.items() if a != b and x & y}


@pytest.mark.parametrize("more", ([], [(1, ["a"])]))
def test_tag_similarities_are_those_of_pairs(spark, more):
    rows = [(1, ["a", "b"]), (2, ["b", "a", "a"]), (3, ["a"]), (4, []), (5, None), (6, ["c"]), (7, ["b", "a"]), (8, ["c"]), *more]
    items = spark.createDataFrame(rows, "item_id long, tags array<string>")
    pairs = lambda df: sorted((r.item, r.other, round(r.sim, 9)) for r in df.collect())
    assert pairs(rec.tag_similarities(items, rows=2)) == pairs(rec.tag_similarity(items, items))


def test_common_interests_of_every_user(spark):
    liked = {r.key: set(r.interests) for r in domain.users(spark, SF).select("key", "interests").collect()}
    got = sorted((r.a, r.b, r.common) for r in registry.QUERIES["common_interests"](spark, SF).collect())
    assert got == sorted((a, b, "|".join(sorted(x & y))) for a, x in liked.items() for b, y in liked.items() if a != b)


def test_common_interests_of_few_and_repeated_users(spark):
    rows = [(1, ["x", "y", "x"]), (2, ["y", "x"]), (3, None), (4, []), (5, ["y"]), (5, ["z"])]
    users = spark.createDataFrame(rows, "key long, interests array<string>")
    got = [(r.a, r.b, r.common) for r in matching.common_interests(users, rows=1).collect()]
    none = lambda x, y: None if x is None or y is None else sorted({*x} & {*y})
    assert sorted(map(str, got)) == sorted(str((a, b, none(x, y))) for a, x in rows for b, y in rows if a != b)


def test_every_profile_gets_a_cold_start(spark):
    keys = {r.key for r in domain.profiles(spark, SF).select("key").collect()}
    assert {r.user for r in registry.QUERIES["cold_start"](spark, SF).select("user").distinct().collect()} == keys


def test_cold_start_pairs_kinds_of_users_and_items(spark, monkeypatch):
    """40 users of one kind, and 60 items that differ in fame alone: one pair."""
    user, item = domain.profiles(spark, SF).where("key = 2").withColumn("user", F.lit(0)), domain.item_profiles(spark, SF).where("item_id = 5")
    users = user.drop("user").crossJoin(spark.range(40).withColumnRenamed("id", "user"))
    items = item.drop("item_id").crossJoin(spark.range(60).withColumnRenamed("id", "item_id"))
    fame = spark.createDataFrame([(i, 1 + i % 7) for i in range(50)], "item_id long, fame long")
    paired, plain = [], blocks.block_pairs
    monkeypatch.setattr(blocks, "block_pairs", lambda a, b, *rest: paired.append(a.count() * b.count()) or plain(a, b, *rest))
    got = {}
    for r in rec.cold_start(users, items, fame, 10).orderBy("user", "rank").collect():
        got.setdefault(r.user, []).append(r.item_id)
    order = sorted(range(60), key=lambda i: (-(1 + i % 7) if i < 50 else 0, i))[:20]
    assert paired == [1] and len(got) == 40
    assert all(len(x) == 10 and set(x) <= set(order) and x[0] == order[0] and x == got[0] for x in got.values())


def test_every_profile_gets_a_combined_list(spark):
    keys = {r.key for r in domain.profiles(spark, SF).select("key").collect()}
    assert {r.user for r in registry.QUERIES["recommend_hybrid"](spark, SF).select("user").distinct().collect()} == keys | {-1}
