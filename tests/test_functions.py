"""Literal expectations of the expressions and driver-side helpers."""

import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import cleaning, geo, scores, text
from millrace.operators import evaluation, recall, search, social
from millrace.sources import domain

SF = "/root/testdata/sf0.001"


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_text(spark):
    lit = F.lit
    assert one(spark, text.normalize(lit("  ＡＢＣ   测试  "), unicode=True), text.normalize(lit(None).cast("string"), unicode=True)) == ("abc 测试", "")
    grams = one(spark, text.char_bigrams(lit("附近修电脑")), text.char_bigrams(lit("电")), text.char_bigrams(lit("")))
    assert [set(g) for g in grams] == [{"附近", "近修", "修电", "电脑"}, {"电"}, set()]
    exact, part, none = one(spark, text.field_match(lit("a b"), lit("a b")), text.field_match(lit("a"), lit("xa")), text.field_match(lit("q"), lit("zz")))
    assert exact == 1.0 and 0 < part < 1 and none == 0.0
    assert one(spark, text.preview(lit("abc  \n def"), 20), text.preview(lit("abcdef"), 5)) == ("abc def", "abcd…")
    made = one(spark, text.embedding_text(lit("文件安全问题"), lit("求助"), F.array(lit("手机"), lit("安全")), lit("")))[0]
    assert made == "标题：文件安全问题\n类别：求助\n标签：手机 安全"


def test_query_terms():
    words, tags = text.query_terms("手机里的文件安全问题应该怎么处理？")
    assert {"手机", "文件", "安全"} <= set(tags) and {"文件安全", "文件安", "件安全"} <= set(words)
    assert not {"机文", "件安", "怎么", "处理"} & set(tags)
    words, tags = text.query_terms("Python API 开发工具")
    assert {"python", "api"} <= set(words) and "python" in tags


def test_geo(spark):
    d = one(spark, geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)), geo.haversine(F.lit(5.0), F.lit(5.0), F.lit(5.0), F.lit(5.0)))
    assert abs(d[0] - 111.195) < 0.01 and d[1] == 0
    low, high, west, east = geo.bounding_box(37.7, 112.7, 10)
    assert low < 37.7 < high and west < 112.7 < east
    assert geo.bounding_box(0, 179.99, 10)[2:] == (None, None)
    for bad in ((91, 0, 1), (0, 181, 1), (0, 0, 0), (0, 0, math.inf)):
        with pytest.raises(ValueError):
            geo.bounding_box(*bad)


def test_scores(spark):
    assert one(spark, scores.calibrate(F.lit(0.49), 0.5), scores.calibrate(F.lit(0.75), 0.5), scores.calibrate(F.lit(None).cast("double"), 0.5)) == (0.0, 0.5, 0.0)
    rows = spark.createDataFrame([(1, 10.0), (1, 20.0), (1, 30.0), (2, 5.0), (2, 5.0)], "g int, v double")
    from pyspark.sql import Window

    assert [r[0] for r in rows.select(scores.min_max(F.col("v"), Window.partitionBy("g")).alias("m"), "g", "v").orderBy("g", "v").collect()] == [0.0, 0.5, 1.0, 0.0, 0.0]


def test_cleaning(spark):
    got = one(spark, cleaning.format_user_id(F.lit("7")), cleaning.format_user_id(F.lit("12345")), cleaning.format_user_id(F.lit("x1")), cleaning.age_bucket(F.lit("abc")), cleaning.age_bucket(F.lit("34")))
    assert got == ("user_0007", "user_12345", "x1", "unknown", "25-34")
    assert one(spark, cleaning.multi_value(F.lit('["a", "b ", "a"]')), cleaning.multi_value(F.lit("a、b|c/a"))) == (["a", "b"], ["a", "b", "c"])


def test_requests():
    with pytest.raises(ValueError):
        search.Request(" ")
    with pytest.raises(ValueError):
        search.Request("a", top_k=20, recall_k=10)
    with pytest.raises(ValueError):
        recall.Filters(radius_km=5)
    with pytest.raises(ValueError):
        recall.Filters(latitude=1.0)
    with pytest.raises(ValueError):
        recall.Filters(latitude=91.0, longitude=0.0)


def test_keys(spark):
    rows = spark.createDataFrame([(" a ", "1 ")], "source string, source_id string")
    assert tuple(recall.checked_keys(rows).first()) == ("a", "1")
    for blank in ((" ", "1"), ("a", None)):
        with pytest.raises(Exception, match="source"):
            recall.checked_keys(spark.createDataFrame([blank], rows.schema)).collect()


def test_responses(spark):
    posts, counters = domain.posts(spark, SF), domain.counters(spark, SF)
    request = search.Request("the and of", recall.Filters(visible_statuses=("0", "1")), semantic_weight=0.3)

    def fails(_):
        raise ConnectionError("down")

    whole = search.respond(posts, request, lambda ids: counters.join(ids, "source_id", "left_semi"))
    assert not whole.degraded and whole.degraded_reason is None and whole.result_count == len(whole.items) == 10 and whole.total_candidates >= 10
    assert len(whole.items[0]) == 22 and whole.request_id != search.respond(posts, request).request_id
    lost = search.respond(posts, request, fails, fails)
    assert lost.degraded and lost.degraded_reason == "Semantic recall unavailable: ConnectionError; Redis realtime features unavailable: ConnectionError"
    assert lost.total_candidates == whole.total_candidates and lost.result_count == 10
    late = search.respond(posts, request, lambda ids: counters.withColumn("views_1h", F.raise_error(F.lit("late"))))
    assert late.degraded and late.result_count == 10
    none = search.respond(posts, search.Request("x", recall.Filters(city="nowhere")), fails)
    assert none.total_candidates == none.result_count == 0 and not none.degraded


def test_hard_filters_hold_for_the_vector_route(spark):
    posts = domain.posts(spark, SF)
    hidden = posts.where("visible_status = '2'").select("source", "source_id", F.lit(0.99).alias("semantic_score"))
    request = search.Request("the", recall.Filters(visible_statuses=("0",)), top_k=100, semantic_weight=1.0, least_semantic=0.0)
    hits = search.search(posts, None, request, hidden).select("source_id").collect()
    assert hits and not {h.source_id for h in hits} & {r.source_id for r in hidden.collect()}


def test_allocations_and_settings():
    assert evaluation.parse_allocation("100,50,50", 200) == ("f100_l50_s50", {"freshness": 100, "lexical": 50, "semantic": 50})
    for wrong in ("100,50", "100,50,60", "-1,1,0", "a,b,c"):
        with pytest.raises(ValueError):
            evaluation.parse_allocation(wrong, 0 if wrong == "-1,1,0" else 200)
    assert evaluation.settings([20, 5, 5], 100) == [5, 20]
    for wrong in ([], [0], [101], [True], [1.5]):
        with pytest.raises(ValueError):
            evaluation.settings(wrong, 100)


def test_anchors(spark):
    found = spark.createDataFrame([("a", "1", 1), ("b", "2", 1)], "c string, source_id string, rank int")
    anchors = spark.createDataFrame([("a", "1"), ("b", "9")], "c string, source_id string")
    assert sorted(map(tuple, evaluation.with_anchors(found, anchors, "c").collect()), key=str) == [("a", "1", 1), ("b", "2", 1), ("b", "9", None)]
    for wrong in (anchors.limit(1), anchors.union(anchors)):
        with pytest.raises(ValueError, match="anchor"):
            evaluation.with_anchors(found, wrong, "c")


def test_positions():
    assert social.positions(0, 2, 2) == [] and social.positions(2, 3, 2) == [0] and social.positions(10, 1, 2) == [2] and social.positions(3, 1, 2) == [2]
    for length in range(3, 30):
        for people in range(2, 5):
            found = social.positions(length, people, 2)
            assert found == sorted(set(found)) and len(found) <= people and all(0 <= p < length for p in found)
