"""The community-content tables, derived from the star-schema tables that are at hand.

Each function reads only the columns that it needs and adds no shuffle, except where a table is an aggregate by nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CATEGORIES = ("求助", "问答", "吐槽")
INTERESTS = ("music", "travel", "food", "sport", "film", "books")
TAGS = ("anvil", "blue", "bolt", "cold", "gear", "gizmo", "hot", "large", "new", "old", "plate", "red", "ring", "rod", "small", "widget")
EDUCATION, RELATIONSHIP = ("bachelor", "master", "phd"), ("single", "dating", "married")
LIFESTYLE, INCOMES = ("active", "homebody", "foodie", "traveler"), ("low", "medium", "high")
AGE_GROUPS = ("teen", "young_adult", "adult", "middle_age", "senior")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
TIMES, ACTIVITIES = ("morning", "noon", "evening", "night"), ("work", "sport", "dining", "travel")
TRAITS = ("extraversion", "agreeableness", "conscientiousness", "neuroticism", "openness")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _unless(condition: Column, value: Column) -> Column:
    return F.when(~condition, value)


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i, n = F.col("doc_id"), F.col("n_chars")
    created = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=(i % 1_000_000).cast("int"))
    return d.select(
        i.alias("id"), "source", i.cast("string").alias("source_id"), F.substring("text", 1, 64).alias("title"), F.col("text").alias("content"),
        F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (i % 3).cast("int") + 1).alias("category"),
        F.array("lang", "source", F.concat(F.lit("m"), (i % 7).cast("string"))).alias("tags"),
        _unless(i % 23 == 0, F.lit(37.0) + (i % 200) * F.lit(0.01)).alias("latitude"),
        _unless(i % 23 == 0, F.lit(112.0) + (i % 170) * F.lit(0.01)).alias("longitude"),
        F.concat(F.lit("c"), (i % 5).cast("string")).alias("city"), F.concat(F.lit("d"), (i % 11).cast("string")).alias("district"),
        _unless(i % 3 == 0, F.concat(F.lit("road "), (i % 40).cast("string"))).alias("address"), n.alias("views"), (n % 97).alias("likes"), (n % 31).alias("marks"), (n % 7).alias("dislikes"),
        _unless(i % 13 == 0, (n % 50) / F.lit(10.0)).alias("ratescore"), (i % 3).cast("string").alias("visible_status"),
        (i % 150).cast("string").alias("owner_id"), created.alias("created_at"),
        _unless(i % 19 == 0, created + F.make_dt_interval(hours=(i % 50).cast("int"))).alias("updated_at"),
    )


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing activity counters by post at the time of the last event."""
    events = table(spark, sf_dir, "events")
    # Two one-row tables.
    count = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("posts"))
    now = events.agg(F.max("ts").alias("now"))
    e = events.crossJoin(F.broadcast(count)).crossJoin(F.broadcast(now)).withColumn("source_id", (F.col("event_id") % F.col("posts")).cast("string"))

    def trailing(kind: str, hours: int) -> Column:
        return F.count_if((F.col("event_type") == kind) & (F.col("ts") > F.col("now") - F.expr(f"INTERVAL {hours} HOURS")))

    return e.groupBy("source_id").agg(
        trailing("view", 1).alias("views_1h"), trailing("view", 24).alias("views_24h"), trailing("click", 24).alias("likes_24h"),
        trailing("signup", 24).alias("marks_24h"), trailing("purchase", 24).alias("unlocks_24h"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    liked = [F.when((k * 7 + n * 3) % 4 < 2, F.lit(name)) for n, name in enumerate(INTERESTS)]
    traits = {"extraversion": 11, "agreeableness": 7, "conscientiousness": 13, "neuroticism": 5, "openness": 9}
    return table(spark, sf_dir, "customer").select(
        k.alias("key"), F.concat(F.lit("user_"), F.when(F.length(k.cast("string")) < 4, F.lpad(k.cast("string"), 4, "0")).otherwise(k.cast("string"))).alias("user_id"),
        _unless(k % 29 == 0, F.when(k % 2 == 0, "male").otherwise("female")).alias("gender"), _unless(k % 31 == 0, 18 + k % 60).alias("age"),
        F.array_compact(F.array(*liked)).alias("interests"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"),
        *(_unless(k % 17 == 0, (k % m) / F.lit(float(m - 1))).alias(t) for t, m in traits.items()),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    age = F.when(k % 4 == 0, F.lit(0)).otherwise(18 + k % 30)
    return table(spark, sf_dir, "part").select(
        k.alias("item_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.split("p_name", " ").alias("tags"), F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"),
        F.when(k % 3 == 0, "male").when(k % 3 == 1, "female").alias("target_gender"), age.alias("target_age_min"), (age + 20).alias("target_age_max"),
        ((k % 10) / F.lit(10.0)).alias("couples_score"),
    )


def _named(names: Column, value) -> Column:
    """An array of (name, value), the value by place."""
    return F.transform(names, lambda x, i: F.struct(x.alias("name"), value(i).cast("double").alias("value")))


def _pick(names: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), at.cast("int") + 1)


def _where(names: tuple[str, ...], keep) -> Column:
    return F.array_compact(F.array(*[F.when(keep(n), F.lit(x)) for n, x in enumerate(names)]))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with all that recommendation reads of them; absent values are null, a few preferences are out of range."""
    k = F.col("key")
    return users(spark, sf_dir).withColumns({
        "interests": F.array_distinct(F.concat("interests", F.array(_pick(TAGS, k % 16), _pick(TAGS, k * 5 % 16)))),
        "preferences": _named(F.array(_pick(TAGS, k % 16), _pick(TAGS, (k + 3) % 16), _pick(TAGS, (k + 7) % 16)), lambda i: (k + i) % 5 / F.lit(4.0)),
        "location": F.concat(F.lit("c"), (k % 5).cast("string")), "education": _unless(k % 10 == 0, _pick(EDUCATION, k % 3)), "occupation": F.col("segment"), "income": F.col("balance") * 12,
        "relationship": _unless(k % 4 == 3, _pick(RELATIONSHIP, k % 3)), "lifestyle": _where(LIFESTYLE, lambda n: (k + n) % 3 == 0), "social_group": F.concat(F.lit("g"), (k % 4).cast("string")),
        "novelty": F.when(k % 6 == 0, (k % 11) / F.lit(10.0)).when(k % 6 == 1, 1.5), "social_preference": F.when(k % 5 == 0, (k % 9) / F.lit(8.0)).when(k % 5 == 1, 2.0),
        "activity_level": F.when(k % 7 == 3, None).when(k % 11 == 0, 1.5).otherwise((k % 7) / F.lit(6.0)), "received": _unless(k % 9 == 0, k % 4), "accepted": k % 3,
        "friends": k % 30, "response_rate": (k % 8) / F.lit(7.0), "active_times": _where(TIMES, lambda n: (k + n) % 2 == 0), "preferred_activities": _where(ACTIVITIES, lambda n: (k + n) % 3 == 1),
        "gender_preference": F.when(k % 3 == 0, "all").when(k % 3 == 1, "female"), "wanted_age_min": _unless(k % 8 == 0, 18 + k % 20), "wanted_age_max": _unless(k % 8 == 0, 38 + k % 20),
    })


def item_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their target groups, features and the contexts that suit them."""
    k = F.col("item_id")
    return items(spark, sf_dir).withColumns({
        "target_gender": F.when(k % 5 == 0, "both").otherwise(F.col("target_gender")), "features": _named(F.array_distinct("tags"), lambda i: (k + i) % 5 / F.lit(5.0) + 0.2),
        "target_age_group": _unless(k % 6 == 0, _pick(AGE_GROUPS, k % 5)), "target_location": _where(("c0", "c1", "c2", "c3", "c4"), lambda n: (k + n) % 5 < 2), "target_education": _unless(k % 7 == 0, _pick(EDUCATION, k % 3)),
        "target_occupation": _where(SEGMENTS, lambda n: (k + n) % 5 < 2), "target_income": _pick(INCOMES, k % 3), "target_relationship": _pick(RELATIONSHIP, k * 2 % 3),
        "target_lifestyle": _where(LIFESTYLE, lambda n: (k + n) % 2 == 0), "target_social_group": F.concat(F.lit("g"), (k % 4).cast("string")),
        "suitable_time": _where(TIMES, lambda n: (k + n) % 4 == 0), "suitable_location": _where(("c0", "c1", "c2"), lambda n: (k + n) % 3 == 0), "suitable_device": _where(("mobile", "desktop"), lambda n: (k + n) % 2 == 0),
        "suitable_activity": _where(ACTIVITIES, lambda n: (k + n) % 5 == 0),
    })


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of a user with an item: type, time and, for ratings, the value."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    flag = F.col("l_returnflag")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item_id"), F.col("l_shipdate").alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.when(flag == "A", "rate").when(flag == "N", "like").otherwise("purchase").alias("interaction_type"),
        F.when(flag == "A", 1 + F.col("l_quantity") % 5).alias("rating_value"), F.col("l_quantity").alias("score"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last rating of each user for each item."""
    kind = F.col("interaction_type")
    rated = interactions(spark, sf_dir).withColumn("rating", F.when(kind == "rate", F.col("rating_value")).when(kind == "like", 4.0).otherwise(5.0))
    last = F.max_by(F.struct("rating", "ts"), F.struct("ts", "seq")).alias("last")
    return rated.groupBy("user", "item_id").agg(last).select("user", "item_id", "last.rating", "last.ts")


def raw_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts as a source system might send them: blanks, mixed separators, coordinates out of range."""
    return raw_posts_of(table(spark, sf_dir, "documents"))


def raw_posts_of(documents: DataFrame) -> DataFrame:
    """The same, of documents that may be a stream."""
    detail = F.col("text")
    i, n = F.col("doc_id"), F.col("n_chars")
    made = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=(i % 1_000_000).cast("int"))
    return documents.select(
        i.alias("id"), F.when(i % 11 == 0, "  ").otherwise(F.substring("text", 1, 30)).alias("title"), F.when(i % 13 == 0, "").otherwise(detail).alias("detail"),
        F.element_at(F.array(*[F.lit(c) for c in (" ", "求助", "我要问答", "想吐一下", "抱怨", "other")]), (i % 6).cast("int") + 1).alias("typecategory"),
        F.concat(F.col("lang"), F.lit(" ,"), F.col("source"), F.lit("；"), F.col("lang"), F.lit(";;x"), (i % 4).cast("string")).alias("tags"),
        _unless(i % 17 == 0, made).alias("createtime"), F.when(i % 5 == 0, made - F.expr("INTERVAL 1 HOUR")).when(i % 5 == 1, F.lit(None).cast("timestamp")).otherwise(made + F.expr("INTERVAL 2 HOURS")).alias("updatetime"),
        F.when(i % 37 == 0, 0.0).when(i % 29 == 0, 95.0).when(i % 7 == 0, None).otherwise(37.0 + (i % 200) * F.lit(0.01)).alias("from_lat"),
        F.when(i % 37 == 0, 0.0).when(i % 31 == 0, -200.0).when(i % 14 == 0, None).otherwise(112.0 + (i % 170) * F.lit(0.01)).alias("from_lng"),
        (n - 500).alias("views"), F.when(i % 9 == 0, None).otherwise(n % 97).alias("likes"), (i % 150).cast("string").alias("owner"),
        F.when(i % 10 == 0, " ").otherwise(F.concat(F.lit(" c"), (i % 5).cast("string"))).alias("city"), F.when(i % 4 == 0, None).otherwise((n % 50) / F.lit(10.0) - 1).alias("ratescore"),
        F.when(i % 12 == 0, "").otherwise(F.concat(F.lit("d"), (i % 11).cast("string"))).alias("district"), _unless(i % 40 == 0, F.lit("cn")).alias("country"), F.concat(F.lit("p"), (i % 3).cast("string")).alias("province"),
        F.when(i % 8 == 0, " ").otherwise("road").alias("address"), (n % 31 - 2).alias("marks"), _unless(i % 6 == 0, n % 7 - 1).alias("dislikes"), (i % 3).cast("string").alias("status"),
    )


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments: a case for each source, with grades 0 to 3 of some of its documents."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "source")
    grade = F.col("quality") * 2 + F.when((F.col("quality") == 1) & (F.col("doc_id") % 5 == 0), 1).otherwise(0)
    return labels.join(docs, "doc_id").select(F.col("source").alias("case_id"), F.col("doc_id").cast("string").alias("source_id"), grade.cast("int").alias("grade"))


def routes(spark: SparkSession, sf_dir: str, depth: int = 40) -> DataFrame:
    """Three rankings of each case's documents: case, route, rank, source_id."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    keys = {"freshness": [F.col("doc_id").desc()], "lexical": [F.col("n_chars").desc(), F.col("doc_id").desc()], "semantic": [(F.col("doc_id") * 7919 % 1009), F.col("doc_id").desc()]}
    parts = []
    for name, order in keys.items():
        # Only the first `depth` rows of a case survive each task, before any shuffle.
        rank = F.row_number().over(Window.partitionBy("source").orderBy(*order))
        parts.append(d.withColumn("rank", rank).where(F.col("rank") <= depth).select(F.col("source").alias("case_id"), F.lit(name).alias("route"), "rank", F.col("doc_id").cast("string").alias("source_id")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def case_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an evaluation run has noted of each case: a row a case, absent judgements null."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        i.alias("case_id"), (F.col("event_type") != "error").alias("success"), (i % 12).alias("returned"), (i % 5 != 0).alias("expected"), (i % 4).alias("located"), F.least(i % 3, i % 4).alias("geo_hits"),
        (i % 7 == 0).alias("degraded"), _unless(i % 2 == 0, i % 9 != 0).alias("stable"), _unless(i % 3 != 0, i % 11 != 0).alias("survived"), _unless(i % 6 == 0, (i % 10) / F.lit(10.0)).alias("precision"),
        _unless(i % 6 == 0, (i % 8) / F.lit(8.0)).alias("recall"), _unless(i % 6 == 0, 1 / (i % 5 + 1)).alias("rr"), _unless(i % 6 == 0, (i % 4) / F.lit(4.0)).alias("ndcg"), F.col("value").alias("latency_ms"),
    )


def repeated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of two runs of each case; a few cases come out differently the second time. ``distance_km`` is null without a place."""
    r = routes(spark, sf_dir).where("route = 'lexical' AND rank <= 12")
    both = r.withColumn("run", F.lit(1)).unionByName(r.withColumn("run", F.lit(2)).where("NOT (case_id LIKE '%3' AND rank = 5)"))
    k = F.col("source_id").cast("long")
    return both.select("case_id", "run", "rank", "source_id", _unless(k % 9 == 0, (k % 50).cast("double")).alias("distance_km"), (k % 40 + F.col("run") * 3).cast("double").alias("latency_ms"))


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafted queries, one for every fiftieth post, which should be found, of three types."""
    i = F.col("id")
    kind = _pick(("text_intent", "geo_intent", "category_intent"), i % 3)
    return posts(spark, sf_dir).where("id % 50 = 0").select(
        F.concat(F.lit("draft_"), i.cast("string")).alias("draft_id"), F.concat_ws(" ", F.lit("the of"), F.lower("category"), F.split_part("title", F.lit(" "), F.lit(1))).alias("query"), kind.alias("query_type"), F.col("source_id").alias("anchor"), "source", "category", "city", "district", "latitude", "longitude"
    )
