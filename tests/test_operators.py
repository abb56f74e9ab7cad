"""Edge cases of mapping, profiles, backfill, streams, people and exploration."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import batch_search, blocks, diversity, evaluation, ingest, mapping, matching, profiles, recall, search, social, sync
from millrace.operators import recommendation as rec
from millrace.sources import domain
from millrace.streaming import activity


def test_mapping_takes_the_first_name_that_has_a_value(spark):
    rows = spark.createDataFrame([("7", None, " T ", None, -3, "求助"), ("8", "a", "b", "body", 4, None)], "post_id string, title string, subject string, body string, like_count int, topic string")
    got = {r.source_id: r for r in mapping.posts(rows, "s").collect()}
    assert got["7"].title == "T" and got["7"].content == "T" and got["7"].likes == 0 and got["7"].category == "求助" and got["7"].views == 0 and got["7"].city is None and got["7"].tags == []
    assert got["8"].title == "a" and got["8"].content == "body" and got["8"].source == "s"
    blank = mapping.posts(spark.createDataFrame([(" ", "x")], "id string, title string"))
    with pytest.raises(Exception, match="id"):
        blank.collect()


def test_missing_vectors_are_encoded_and_checked(spark):
    rows = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", None), (3, "c", None)], "id long, text string, vector0 array<double>")
    unit = lambda df: df.withColumn("vector", F.array(F.lit(0.0), F.lit(1.0)))
    got = {r.id: r.vector0 for r in profiles.encode_missing(rows, unit, "id", "vector0", 2).collect()}
    assert got == {1: [1.0, 0.0], 2: [0.0, 1.0], 3: [0.0, 1.0]}
    some = {r.id: r.vector0 for r in profiles.encode_missing(rows, unit, "id", "vector0", 2, limit=1).collect()}
    assert some == {1: [1.0, 0.0], 2: [0.0, 1.0], 3: None}
    for wrong in (lambda df: df.withColumn("vector", F.array(F.lit(2.0), F.lit(0.0))), lambda df: unit(df).limit(1), lambda df: unit(df).withColumn("vector", F.array(F.lit(1.0)))):
        with pytest.raises(RuntimeError):
            profiles.encode_missing(rows, wrong, "id", "vector0", 2)


def test_profile_sync(spark):
    new = spark.createDataFrame([("s", "1", 5), ("s", "2", 6)], "source string, source_user_id string, x int")
    old, kept = new.where("source_user_id = '1'").withColumn("x", F.lit(0)), []
    assert profiles.sync_profiles(new, old, kept.append, dry_run=True) == {"profiles": 2, "new": 1, "changed": 1, "written": 0} and not kept
    assert profiles.sync_profiles(new, old, kept.append)["written"] == 2 and sorted(map(tuple, kept[0].collect())) == [("s", "1", 5), ("s", "2", 6)]
    with pytest.raises(RuntimeError):
        profiles.sync_profiles(new.union(new), None, kept.append)


def test_kafka(spark):
    source = activity.Kafka("a:1,b:2", "top.ic", 1000)
    assert source.options()["subscribePattern"] == "top\\.ic\\..*" and source.trigger() == {"processingTime": "1000 milliseconds"}
    for wrong in ({"brokers": " "}, {"topic_prefix": ""}, {"checkpoint_interval": 0}):
        with pytest.raises(ValueError):
            activity.Kafka(**wrong)
    values = [json.dumps({"user_id": 1, "ts": "2024-01-01T00:00:00"}), "no event", json.dumps({"user_id": 2})]
    raw = spark.createDataFrame([(bytearray(v.encode()),) for v in values], "value binary")
    assert [r.user_id for r in activity.parse_events(raw, "user_id long, ts timestamp").collect()] == [1]


def _user(spark, **known):
    names = {"activity_level": "double", "received": "int", "accepted": "int", "social_preference": "double"}
    return spark.createDataFrame([(1, *(known.get(n) for n in names))], "user long, " + ", ".join(f"{n} {t}" for n, t in names.items()))


def test_items_for_a_pair(spark):
    """Worked out by hand: 0.2 times the profile's 0.3 gender + 0.3 age + 0.4 couples, and 0.5 times the share of common tags."""
    schema = "item_id long, name string, type string, tags array<string>, target_gender string, target_age_min int, target_age_max int, couples_score double"
    items = spark.createDataFrame([
        (1, "a", "t", ["x"], "both", 20, 50, 0.0),          # 0.3 + 0.3 (both in range)
        (2, "b", "t", ["music"], None, 0, 50, None),        # 0.15 + 0.15, and no tag in common
        (3, "c", "t", ["art"], "male", 20, 38, 0.0),        # 0.3 + 0.21 (their mean, 35, in range)
        (4, "d", "t", ["art"], "female", 20, 50, 1.0),      # 0 + 0.3 + 0.4
        (5, "e", "t", ["film", "art"], "male", 60, 70, 0.0),  # 0.3 + 0, and one of two tags in common
        (6, "f", "t", ["art"], "female", 60, 70, 0.0),      # nothing: left out
        (7, "g", "t", ["film"], "both", 20, 50, 1.0),       # known
    ], schema)
    seen = spark.createDataFrame([(1, 7)], "user long, item_id long")
    him, her = {"interests": ["music", "film"], "gender": "male", "age": 30}, {"interests": ["art2", "film"], "gender": "F", "age": 40}
    found = {r.item_id: r for r in matching.recommend_pair(him, her, items, seen).collect()}
    want = {1: 0.12, 2: 0.06, 3: 0.102, 4: 0.14, 5: 0.06 + 0.25}
    assert {i: r.pair_score for i, r in found.items()} == pytest.approx(want)
    assert found[5].sources == ["common_interests", "user_profile"] and found[5].reason == "推荐e，基于你们共同的film兴趣" and found[4].reason == "推荐d，特别适合情侣/伴侣共同体验"
    turned = {r.item_id: r.pair_score for r in matching.recommend_pair(her, him, items, seen).collect()}
    assert turned == pytest.approx({1: 0.12, 2: 0.06, 3: 0.042, 4: 0.2, 5: 0.25, 6: 0.06})
    near = spark.createDataFrame([(6, -0.5), (1, 0.5)], "item_id long, cf double")
    cf = {r.item_id: r for r in matching.recommend_pair(him, her, items, seen, similar=near).collect()}
    assert cf[6].pair_score == pytest.approx(-0.15) and cf[6].sources == ["collaborative_filtering"] and cf[1].pair_score == pytest.approx(0.27)
    nobody = {"interests": [], "gender": None, "age": None}
    assert {r.item_id: r.pair_score for r in matching.recommend_pair(nobody, nobody, items, seen).collect()} == pytest.approx({1: 0.06, 2: 0.06, 4: 0.08})


def test_text_scores(spark):
    """Worked out by hand: repeated words of a query count once, and compatibility forms are folded."""
    request = lambda q: search.Request(q)
    rows = spark.createDataFrame([(1, "xx zq yy", "ＡＢＣ"), (2, "ﬁne ①", "ab c")], "id long, title string, content string").withColumns({"tags": F.array().cast("array<string>"), "latitude": F.lit(None).cast("double"), "longitude": F.lit(None).cast("double"), "city": F.lit("c"), "district": F.lit("d"), **{c: F.lit(0) for c in ("views", "likes", "marks", "dislikes")}})
    of = lambda q, column: {r.id: r[column] for r in search.score(rows, request(q)).collect()}
    assert of("zq zq kw", "title_match") == {1: pytest.approx(0.4)}
    assert of("abc", "content_match") == {1: 1.0, 2: pytest.approx(0.7)} and of("Ａｂｃ", "content_match") == of("abc", "content_match")
    assert of("fine 1", "title_match") == {2: 1.0}
    names = ["  ＡＢＣ   测试  ", None, "İstanbul ﬁ", "e\u0301", "plain", "…", "½", "Ⅷ", "한", "ｶﾞ", ""]
    got = spark.createDataFrame([(n, x) for n, x in enumerate(names)], "n int, x string").select("n", text.normalize(F.col("x"), unicode=True).alias("y")).collect()
    import unicodedata

    assert {r.n: r.y for r in got} == {n: " ".join(unicodedata.normalize("NFKC", x or "").lower().split()) for n, x in enumerate(names)}


def test_many_searches_are_single_ones(spark):
    """A batch gives each request what a search of its own gives; requests that cannot be are an error."""
    sf = "/root/testdata/sf0.001"
    posts, counters = domain.posts(spark, sf), domain.counters(spark, sf)
    asked = [("a", "The  OF and", None, None, None, None, None, None), ("b", "ｔｈｅ", " 问答 ", None, "", None, None, None), ("c", "un de", None, "c2", None, 37.7, 112.7, 80.0), ("d", "the", None, None, "d3", 37.5, 112.5, None), ("e", "zzzzzz", None, "nowhere", None, None, None, None), ("f", "the of", None, None, None, None, None, None)]
    schema = "request_id string, query string, category string, city string, district string, latitude double, longitude double, radius_km double"
    got = {}
    for r in batch_search.search_many(posts, counters, spark.createDataFrame(asked, schema), 7, 60).collect():
        got.setdefault(r.request_id, []).append((r["rank"], r.id, r.score, r.text_score, r.geo_score, r.hot_score))
    for name, q, category, city, district, lat, lon, radius in asked:
        one = search.search(posts, counters, search.Request(q, recall.Filters(category, (), city, district, lat, lon, radius), 7, 60)).collect()
        want = [(n + 1, r.post_id, r.score, r.text_score, r.geo_score, r.hot_score) for n, r in enumerate(one)]
        assert sorted(got.get(name, [])) == [pytest.approx(w) for w in want], name
    for wrong in ([asked[0], asked[0]], [("x", " ", *asked[0][2:])], [("x", "the", None, None, None, None, None, 5.0)], [("x", "the", None, None, None, 1.0, 1.0, 501.0)], [(None, *asked[0][1:])]):
        with pytest.raises(ValueError, match="requests"):
            batch_search.search_many(posts, counters, spark.createDataFrame(wrong, schema), 7, 60)
    assert batch_search.search_many(posts, None, spark.createDataFrame([], schema), 7, 60).isEmpty()


def test_similar_items(spark):
    """Against dense standardised vectors: tags of all items, of one, none at all, and few tags, so that items without a common tag are alike."""
    import numpy as np

    rng = np.random.default_rng(3)
    for number, width, least in ((40, 5, 0.2), (40, 2, 0.05), (60, 12, 0.3), (30, 1, 0.2)):
        tags = [sorted({f"t{t}" for t in rng.zipf(1.5, rng.integers(0, width + 1)) if t < 40}) + ["all"] for _ in range(number)]
        items = spark.createDataFrame([(i, t + t[:1]) for i, t in enumerate(tags)], "item_id long, tags array<string>")
        vocab = sorted({t for x in tags for t in x})
        x = np.array([[t in own for t in vocab] for own in tags], float)
        z = np.where(x.std(axis=0) > 0, (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1), 0)
        size = np.linalg.norm(z, axis=1)
        sim = z @ z.T / np.where(size[:, None] * size > 1e-12, size[:, None] * size, np.inf)
        want = {(i, j): sim[i, j] for i in range(0, number, 2) for j in range(number) if i != j and round(sim[i, j], 9) >= least}
        rows = rec.similar_items(items, items.where("item_id % 2 = 0"), least).collect()
        assert len(rows) == len(want) and {(r.item, r.other): r.sim for r in rows} == pytest.approx(want)
        both = rec.similar_items(items, items, least, itself=True).where("item = other").count()
        assert both == int((size > 1e-12).sum())


def test_hot_keys_are_joined_in_blocks(spark):
    rows = spark.range(300).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"))
    made = blocks.block_join(rows, rows, "k", "id", "id", rows=10).select("k", F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    plain = rows.withColumnRenamed("id", "a").join(rows.withColumnRenamed("id", "b"), "k")
    assert made.exceptAll(plain).isEmpty() and plain.exceptAll(made).isEmpty()


def test_sequences(spark):
    """Every event counts, by a user's own order; a user's own moves do not count for that user."""
    events = [(1, "2024-01-01", 1, 10), (1, "2024-01-02", 2, 11), (1, "2024-01-03", 3, 10), (1, "2024-01-03", 4, 12), (2, "2024-01-01", 5, 10), (2, "2024-02-01", 6, 13), (2, "2024-03-01", 7, 10), (2, "2024-04-01", 8, 13), (3, "2024-01-01", 9, 12)]
    table = spark.createDataFrame(events, "user long, ts string, seq long, item_id long").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3)
    moves = sorted(map(tuple, rec.transitions(table).select("user", "item_id", "next").collect()))
    assert moves == [(1, 10, 11), (1, 10, 12), (1, 11, 10), (2, 10, 13), (2, 10, 13), (2, 13, 10)]
    asked = spark.createDataFrame([(1,), (2,), (3,)], "user long")
    got = {(r.user, r.item_id): r.score for r in rec.sequence(table, asked, 10).collect()}
    from math import log

    # Of user 1: after 10, user 2 went to 13 twice; of user 2: after 10, user 1 went to 11 and 12; nothing follows 12.
    assert got == pytest.approx({(1, 13): 0.5 * 2 + 0.5 * log(3), (2, 11): 0.5 + 0.5 * log(2), (2, 12): 0.5 + 0.5 * log(3)})


def test_tolerance(spark):
    none = spark.createDataFrame([], "user long, ts timestamp")
    of = lambda at=None, events=none, **known: round(social.tolerance(_user(spark, **known), events, F.lit("2024-02-01").cast("timestamp"), at).first().tolerance, 9)
    assert of() == 0.5 and of(social_preference=0.9) == 0.9 and of(social_preference=1.9, activity_level=0.2) == 0.2 and of(activity_level=7.0) == 0.5
    assert of(received=4, accepted=1) == 0.25 and of(received=0, accepted=0) == 0.5 and of({"hour": 9}) == 0.4 and of({"hour": 3, "place": "bar"}) == 0.65
    events = spark.createDataFrame([(1, "2024-01-20"), (1, "2020-01-01")], "user long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert of(events=events) == round(1 / 30, 9) and of(events=events.where("ts < '2021-01-01'")) == 0.5


def test_people_in_lists(spark):
    lists = spark.createDataFrame([(1, 100 + r, r) for r in range(1, 11)] + [(2, 7, 1)], "user long, item_id long, rank int")
    people = spark.createDataFrame([(u, p, float(p)) for u in (1, 2) for p in (1, 2, 3, 4)], "user long, person long, score double")
    openness = spark.createDataFrame([(1, 1.0), (2, 1.0)], "user long, tolerance double")
    got = sorted((r.user, r.position, r.item_id, r.person) for r in social.insert_people(lists, people, openness).collect())
    mine = [g for g in got if g[0] == 1]
    want = [100 + r for r in range(1, 11)]
    for place, person in zip(social.positions(10, 3, 2), (4, 3, 2), strict=False):
        want.insert(place, -person)
    assert [g[2] if g[3] is None else -g[3] for g in mine] == want and [g[1] for g in mine] == list(range(len(want)))
    assert [g for g in got if g[0] == 2] == [(2, 0, 7, None)]  # shorter than the distance: nobody comes in


def test_lists_of_items_without_tags(spark):
    items = spark.createDataFrame([(1, []), (2, None)], "item_id long, tags array<string>")
    lists = spark.createDataFrame([(1, 1), (1, 2)], "user long, item_id long")
    assert [r.content for r in diversity.by_content(lists, items, "user").collect()] == [0.5]
    tagged = items.union(spark.createDataFrame([(3, ["a"])], items.schema))
    assert [r.content for r in diversity.by_content(lists, tagged, "user").collect()] == [1.0]


def test_ordered_dedupe(spark):
    rows = spark.createDataFrame([("b", 3), ("a", 5), ("b", 9), ("c", -1), ("a", 7)], "k string, n long")
    assert sorted(map(tuple, recall.ordered_dedupe(rows, ["k"], "n").collect()), key=lambda r: r[2]) == [("c", -1, 0), ("b", 3, 1), ("a", 5, 2)]


def test_lists_of_one_item_are_varied(spark):
    items = spark.createDataFrame([(1, ["a"], "t", None, 0, 0), (2, [], None, "male", None, None)], "item_id long, tags array<string>, type string, target_gender string, target_age_min int, target_age_max int")
    lists = spark.createDataFrame([(1, 1), (2, 1), (2, 2)], "user long, item_id long")
    got = {r.user: r.diversity for r in diversity.total(lists, items, "user").collect()}
    assert got[1] == 1.0 and got[2] == pytest.approx(0.4 * 1 + 0.3 * 0.3 + 0.2 * 1 + 0.1 * 0.5)


def test_exploring_lets_types_take_turns(spark):
    items = spark.createDataFrame([(i, "x" if i < 4 else "y") for i in range(1, 7)], "item_id long, type string")
    found = spark.createDataFrame([(1, i, 10.0 - i) for i in range(1, 7)], "user long, item_id long, score double")
    order = lambda level: [r.item_id for r in rec.explore(found, items, level, 4).orderBy("rank").collect()]
    assert order(0.0) == [1, 2, 3, 4] and order(0.9) == [1, 4, 2, 5] and order(1.0)[:2] == [1, 4]
    with pytest.raises(ValueError):
        rec.explore(found, items, 1.5, 4)


def test_ingest(spark, tmp_path):
    target = sync.DeltaTable(spark, f"file://{tmp_path}/t", "id")
    rows = spark.createDataFrame([(1, 1, 2, "like", None), (1, 1, 2, "like", None), (2, None, 2, "like", None), (3, 1, 2, "odd", None), (4, 1, 2, "rate", 9.0), (5, 1, 2, "rate", 5.0), (None, 1, 2, "like", None)],
                                 "id long, user long, item_id long, interaction_type string, rating_value double")
    taken = ingest.interactions(target, rows)
    assert (taken.rows, taken.refused) == (3, 4) and sorted(r.id for r in target.read().collect()) == [1, 5]
    assert ingest.interactions(target, rows.limit(0)).rows == 0
    people = sync.DeltaTable(spark, f"file://{tmp_path}/u", "key")
    ingest.users(people, spark.createDataFrame([(1, "a"), (None, "b")], "key long, name string"))
    ingest.users(people, spark.createDataFrame([(1, "c")], "key long, name string"))
    assert [tuple(r) for r in people.read().collect()] == [(1, "c")]
    ingest.users(people, spark.createDataFrame([(1, "old"), (1, "new")], "key long, name string").coalesce(1))
    assert [tuple(r) for r in people.read().collect()] == [(1, "new")]
    ingest.users(people, spark.createDataFrame([(1, "z"), (1, "y"), (1, "x")], "key long, name string"), order="name")
    assert [tuple(r) for r in people.read().collect()] == [(1, "z")]


def test_routes():
    assert recall.Route("lexical", 200, 2.0).scan(False) == 400 and recall.Route("semantic", 200, 2.0).scan(False) == 200 and recall.Route("semantic", 1500, 2.0).scan(True) == 2000
    for wrong in (("x",), ("lexical", 0), ("lexical", 2001), ("lexical", 10, 11.0), ("semantic", 10, 5.0), ("semantic", 10, 2.0, 0), ("semantic", 10, 2.0, 10, "relaxed")):
        with pytest.raises(ValueError):
            recall.Route(*wrong)


def test_stored_vectors(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<double>")
    assert recall.check_vectors(rows, "v", 2) == 1
    with pytest.raises(ValueError):
        recall.check_vectors(rows, "v", 3)


def test_cases_of_drafts(spark):
    drafts = spark.createDataFrame([("d1", "q", "text_intent", "c", "x", None, None)], "draft_id string, query string, query_type string, category string, city string, latitude double, longitude double")
    fine = [("d1", "1", 3, True, True), ("d1", "2", 0, False, True)]
    of = lambda rows: spark.createDataFrame(rows, "draft_id string, source_id string, grade int, is_anchor boolean, reviewed boolean")
    row = evaluation.cases_of_drafts(drafts, of(fine)).first()
    assert [tuple(r) for r in row.relevance] == [("1", 3), ("2", 0)] and row.category is None and row.binary_relevance_threshold == 2
    wrong = {
        "no judged": [("d2", "1", 3, True, True)], "not reviewed": [*fine, ("d1", "3", 1, False, False)], "without a grade": [*fine, ("d1", "3", 7, False, True)], "one anchor": [fine[1]], "no relevant": [("d1", "1", 1, True, True)],
    }
    for message, rows in wrong.items():
        with pytest.raises(ValueError, match=message):
            evaluation.cases_of_drafts(drafts, of(rows))
    with pytest.raises(ValueError, match="no drafted"):
        evaluation.cases_of_drafts(drafts.limit(0), of(fine))
    with pytest.raises(ValueError, match="place"):
        evaluation.cases_of_drafts(drafts.withColumn("query_type", F.lit("geo_intent")), of(fine))


def test_a_search_matches_the_texts_of_its_candidates_alone(spark):
    """What a score asks of the texts stays above the join with the recalled keys, and one Python worker a task folds all fields."""
    posts = domain.posts(spark, "/root/testdata/sf0.001")
    for filters in (recall.Filters(), recall.Filters(city="c2", latitude=37.7, longitude=112.7, radius_km=80.0)):
        found = search.search(posts, None, search.Request("the and of", filters))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("Join Inner")


def test_sums_over_lists_are_made_where_their_rows_lie(spark):
    """One shuffle deals out the items of all lists; a list's evenness waits for no total, and the parts of a diversity do not meet in a task."""
    lists = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1), (2, 4)], "user long, item_id long")
    items = spark.createDataFrame([(1, ["a", "b"], "x"), (2, ["b", "c", "b"], "x"), (3, ["a", "b"], "y"), (4, [], None)], "item_id long, tags array<string>, type string")
    items = items.withColumns({"target_gender": F.lit("male"), "target_age_min": F.lit(20), "target_age_max": F.lit(30)})
    pairs = rec.pairwise_cosines(lists.join(F.broadcast(items), "item_id").select("user", "item_id", "tags"), "user")
    got = {r.user: r for r in pairs.collect()}
    assert got[1].items == 3 and abs(got[1].mean - (0.5 + 1 + 0.5) / 3) < 1e-12 and abs(got[1].deviation - (0.5**2 * 2 / 9) ** 0.5) < 1e-9 and got[2].items == 1 and got[2].mean is None
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan(rec.pairwise_cosines(lists.join(F.broadcast(items), "item_id").select("user", "item_id", "tags"), "user")).count("Exchange hashpartitioning") == 1
    counts = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (2, "a", 5)], "user long, tag string, n long")
    even = rec.entropy(counts, "user", "tag")
    assert "Window" not in plan(even)
    assert {r.user: (round(r.evenness, 9), r.kinds, r.total) for r in even.collect()} == {1: (0.811278124, 2, 4), 2: (0.0, 1, 5)}
    assert "Generate" not in plan(diversity.total(lists, items, "user"))


def test_pairs_carry_their_histories(spark):
    """No pair is shuffled for the items of its users, and what they share counts as it does when histories are joined to pairs."""
    rows = [(1, 1.0, "male", 30, ["a"]), (2, 2.0, "female", 31, ["a", "b"]), (3, 0.5, None, None, [])]
    users = spark.createDataFrame(rows, "key long, age_like double, gender string, age int, interests array<string>").withColumns({t: F.lit(0.5) for t in matching.TRAITS})
    users = matching.standardized(users, ("age_like",))
    history = spark.createDataFrame([(1, [1, 2, 3]), (2, [2, 3, 4])], "user long, items array<int>")
    known = matching.with_history(users, history).withMetadata("z", users.schema["z"].metadata)
    own = matching.compatibility(matching.scored_pairs(known, known))
    joined = matching.compatibility(matching.scored_pairs(users, users), history)
    cells = lambda df: {(r.a.key, r.b.key): (r.overlap, r.compatibility, r.level, r.kind) for r in df.collect()}
    assert cells(own) == cells(joined) and len(cells(own)) == 6 and cells(own)[1, 2][0] == 0.5 and cells(own)[1, 3][0] == 0.0
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    # The only joins: histories with either side's users, the moments with these, and blocks.
    assert plan.index("__i") < plan.index("__user") and "ua#" not in plan


def test_content_joins_few_items_of_few_classes(spark, monkeypatch):
    """Against all pairs: of classes behind enough better ones, or seen wholly, no item is joined, and ties between classes stay."""
    import numpy as np

    tags = ["ab", "ac", "ad", "bc", "bd", "cd", "ab", "e", "ef"]
    items = spark.createDataFrame([(i, list(tags[i % len(tags)])) for i in range(90)], "item_id long, tags array<string>")
    rated = [(1, 0, 5.0), (1, 1, 3.0), (2, 7, 4.0), *((3, i, 4.0) for i in range(90) if i % 9 == 8), (4, 5, 1.0)]
    ratings = spark.createDataFrame([(u, i, r, 1_700_000_000 - 86400 * u * i) for u, i, r in rated], "user long, item_id long, rating double, at long").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    own, joined = rec.ranked, []
    monkeypatch.setattr(rec, "ranked", lambda rows, *more: joined.append(rows.count()) or own(rows, *more))
    got = {(r.user, r.item_id): r.score for r in rec.content(ratings, items, ratings.select("user").distinct(), 1).collect()}
    x = np.array([[t in tags[i % 9] for t in "abcdef"] for i in range(90)], float)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    sim = z @ z.T / np.outer(np.linalg.norm(z, axis=1), np.linalg.norm(z, axis=1))
    last, want = min(u * i for u, i, _ in rated), {}
    for user in (1, 2, 3, 4):
        scores = {}
        for u, i, r in rated:
            for j in range(90):
                if u == user and round(sim[i, j], 9) >= 0.2 and (user, j) not in {(a, b) for a, b, _ in rated}:
                    scores[j] = scores.get(j, 0.0) + sim[i, j] * r * 0.95 ** (u * i - last)
        want |= {(user, j): scores[j] for j in sorted(scores, key=lambda j: (-round(scores[j], 9), j))[:1]}
    assert got == pytest.approx(want)
    # Each user's best class, with one item more than are seen of it; of every class like a user's there are 11.
    assert joined and max(joined) < 6, joined


def test_equal_requests_are_searched_once(spark, monkeypatch):
    """Requests of one query and one filter meet the posts as one, dealt out by the number of pairs, and each has the list."""
    sf = "/root/testdata/sf0.001"
    asked = spark.createDataFrame([(f"r{i}", "the of" if i % 2 else "The  of", "问答" if i < 8 else None) for i in range(10)], "request_id string, query string, category string")
    own, met = batch_search._scored, []
    monkeypatch.setattr(batch_search, "_scored", lambda fields, wanted: met.append((wanted.count(), wanted.rdd.getNumPartitions())) or own(fields, wanted))
    rows = batch_search.search_many(domain.posts(spark, sf), None, asked, 5, 20, **({"task_pairs": 10} if "task_pairs" in batch_search.search_many.__code__.co_varnames else {})).collect()
    lists = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        lists.setdefault(r.request_id, []).append((r.id, r.score))
    assert len(lists) == 10 and all(len(x) == 5 for x in lists.values())
    assert all(lists[f"r{i}"] == lists["r0"] for i in range(8)) and lists["r8"] == lists["r9"]
    assert met == [(40, 4)]
