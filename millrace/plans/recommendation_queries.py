"""Queries over recommendation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import diversity, factors
from millrace.operators import recommendation as rec
from millrace.plans.registry import query
from millrace.sources import domain
from millrace.sources.shared import written


def _everyone(spark, sf):
    """Who has orders; nobody else has ratings."""
    return domain.table(spark, sf, "orders").select(F.col("o_custkey").alias("user")).distinct()


def _asked(spark, sf):
    return domain.table(spark, sf, "customer").where(F.col("c_custkey") % 50 == 0).select(F.col("c_custkey").alias("user"))


@query("valid_interactions", "SELECT interaction_type, count(*) AS n, round(sum(score), 6) AS total FROM interactions GROUP BY 1", ["interactions"])
def valid_interactions(spark, sf):
    ok = F.col("user").isNotNull() & F.col("item_id").isNotNull() & (F.col("interaction_type") != "")
    return domain.interactions(spark, sf).where(ok).groupBy("interaction_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.coalesce("score", F.lit(1.0))), 6).alias("total"))


@query("interaction_ratings", 'SELECT "user", item_id, rating FROM ratings WHERE item_id IN (SELECT item_id FROM items) AND "user" IN (SELECT key FROM users)', ["ratings", "users", "items"])
def interaction_ratings(spark, sf):
    r = domain.ratings(spark, sf)
    known = r.join(domain.items(spark, sf).select("item_id"), "item_id", "left_semi").join(domain.users(spark, sf).select(F.col("key").alias("user")), "user", "left_semi")
    return known.select("user", "item_id", "rating")


@query("rating_to_type", 'SELECT "user", item_id, CASE WHEN rating >= 4 THEN \'like\' ELSE \'view\' END AS kind FROM ratings', ["ratings"])
def rating_to_type(spark, sf):
    return domain.ratings(spark, sf).select("user", "item_id", F.when(F.col("rating") >= 4, "like").otherwise("view").alias("kind"))


@query("interaction_last", 'SELECT "user", item_id, rating, epoch(ts)::BIGINT AS at FROM ratings', ["ratings"])
def interaction_last(spark, sf):
    return domain.ratings(spark, sf).select("user", "item_id", "rating", F.unix_timestamp("ts").alias("at"))


@query("rating_matrix", 'SELECT dense_rank() OVER (ORDER BY "user") - 1 AS row, item_id, sum(rating) AS value FROM ratings GROUP BY "user", item_id', ["ratings"])
def rating_matrix(spark, sf):
    r = domain.ratings(spark, sf).groupBy("user", "item_id").agg(F.sum("rating").alias("value"))
    return r.join(rec.dense_index(domain.interactions(spark, sf), "user"), "user").select("row", "item_id", "value")


@query("item_popularity", "SELECT item_id, count(*) AS n FROM interactions GROUP BY item_id", ["interactions"])
def item_popularity(spark, sf):
    return domain.interactions(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


_POP = "pop AS (SELECT item_id, count(*) AS n, ln(1 + count(*)) / ln(1 + max(count(*)) OVER ()) AS popularity FROM ratings WHERE ts >= (SELECT max(ts) FROM ratings) - INTERVAL 365 DAY GROUP BY item_id)"


@query("popularity_scores", f"WITH {_POP} SELECT item_id, round(popularity, 6) AS popularity FROM pop", ["ratings"])
def popularity_scores(spark, sf):
    return rec.popularity(domain.ratings(spark, sf), 365).select("item_id", F.round("popularity", 6).alias("popularity"))


def _popular(days: int):
    sql = (
        "WITH c AS (SELECT item_id, count(*) AS a, count(*) FILTER (WHERE floor((epoch((SELECT max(ts) FROM interactions)) - epoch(ts)) / 86400) <= {0}) AS r FROM interactions GROUP BY 1), "
        "n AS (SELECT item_id, CASE WHEN max(r) OVER () > 0 THEN r ELSE a END AS n FROM c) SELECT item_id, round(ln(1 + n), 6) AS score FROM n WHERE n > 0 ORDER BY n DESC, item_id LIMIT 20"
    ).format(days)

    def run(spark, sf):
        return rec.popular_items(domain.interactions(spark, sf), 20, days).select("item_id", F.round("score", 6).alias("score"))

    return sql, run


for _name, _days in (("popular_items", 30), ("trending_day", 1), ("trending_week", 7), ("trending_month", 30)):
    _sql, _run = _popular(_days)
    query(_name, _sql, ["interactions"])(_run)


@query("popular_items_of_all_time", "SELECT item_id, count(*) AS n FROM interactions GROUP BY item_id ORDER BY n DESC, item_id LIMIT 20", ["interactions"])
def popular_items_of_all_time(spark, sf):
    """Nothing happened in the last days before this time, so all events count."""
    return rec.popular_items(domain.interactions(spark, sf), 20, 30, F.lit("2100-01-01").cast("timestamp")).select("item_id", "n")


_SIM = """
tags AS (SELECT item_id, unnest(list_distinct(tags)) AS tag, len(list_distinct(tags)) AS n FROM items),
sims AS (SELECT a.item_id AS item, b.item_id AS other, count(*) / sqrt(any_value(a.n) * any_value(b.n)) AS sim FROM tags a JOIN tags b USING (tag) WHERE a.item_id <> b.item_id {0} GROUP BY 1, 2)"""


@query("item_cosine", f"WITH {_SIM.format('')} SELECT item, other, round(sim, 6)::DOUBLE AS sim FROM sims", ["items"])
def item_cosine(spark, sf):
    return rec.tag_similarities(domain.items(spark, sf)).select("item", "other", F.round("sim", 6).alias("sim"))


@query(
    "content_similarity",
    """
WITH once AS (SELECT item_id, list_distinct(tags) AS tags FROM items), vocab AS (SELECT tag, count(*) / (SELECT count(*) FROM items)::DOUBLE AS p FROM (SELECT unnest(tags) AS tag FROM once) GROUP BY 1),
dense AS (
  SELECT item_id, list(CASE WHEN p < 1 THEN (CASE WHEN list_contains(tags, tag) THEN 1 ELSE 0 END - p) / sqrt(p * (1 - p)) ELSE 0 END::DOUBLE ORDER BY tag) AS z FROM once, vocab GROUP BY item_id
)
SELECT a.item_id AS item, b.item_id AS other, round(coalesce(list_cosine_similarity(a.z, b.z), 0), 6) AS sim FROM dense a, dense b WHERE a.item_id % 50 = 0 AND a.item_id <> b.item_id""",
    ["items"],
)
def content_similarity(spark, sf):
    i = domain.items(spark, sf)
    return rec.content_similarity(i, i.where("item_id % 50 = 0")).select("item", "other", F.round("sim", 6).alias("sim"))


_CLASSES = """
sets AS (SELECT item_id, list_sort(list_distinct(tags)) AS s FROM items),
classes AS (SELECT item_id, min(item_id) OVER (PARTITION BY s) AS representative FROM sets)"""


@query("item_classes", f"WITH {_CLASSES} SELECT item_id, representative FROM classes", ["items"])
def item_classes(spark, sf):
    return rec.tag_classes(domain.items(spark, sf))


@query("item_cosine_classes", f"WITH {_CLASSES}, {_SIM.format('').strip()} SELECT item, other, round(sim, 6)::DOUBLE AS sim FROM sims WHERE item IN (SELECT representative FROM classes) AND other IN (SELECT representative FROM classes)", ["items"])
def item_cosine_classes(spark, sf):
    """The similarities of all items, as pairs of the first items of ``item_classes``; items of one class have 1, pairs that are not named 0."""
    i = domain.items(spark, sf)
    first = i.join(rec.tag_classes(i).select(F.col("representative").alias("item_id")).distinct(), "item_id", "left_semi")
    return rec.tag_similarity(first, first).select("item", "other", F.round("sim", 6).alias("sim"))


_ASKED = '"user" % 50 = 0'
_DAYS = "floor((epoch((SELECT max(ts) FROM ratings)) - epoch(ts)) / 86400)"


_DENSE = """
once AS (SELECT item_id, list_distinct(tags) AS tags FROM items), vocab AS (SELECT tag, count(*) / (SELECT count(*) FROM items)::DOUBLE AS p FROM (SELECT unnest(tags) AS tag FROM once) GROUP BY 1),
dense AS (
  SELECT item_id, list(CASE WHEN p < 1 THEN (CASE WHEN list_contains(tags, tag) THEN 1 ELSE 0 END - p) / sqrt(p * (1 - p)) ELSE 0 END::DOUBLE ORDER BY tag) AS z FROM once, vocab GROUP BY item_id
)"""


def _content(top_k: int, asked: str = _ASKED) -> str:
    """Every candidate against every rated item, by the cosine of standardised vectors written out."""
    return f"""
own AS (SELECT *, rating * pow(0.95::DOUBLE, {_DAYS}) AS weight FROM ratings WHERE {asked}), {_DENSE.strip()},
sims AS (SELECT a.item_id AS item, b.item_id AS other, list_cosine_similarity(a.z, b.z) AS sim FROM dense a, dense b WHERE a.item_id IN (SELECT item_id FROM own)),
content AS (
  SELECT own."user", other AS item_id, sum(sim * weight) AS score FROM own JOIN sims ON own.item_id = item WHERE round(sim, 9) >= 0.2
    AND NOT EXISTS (SELECT 1 FROM own o WHERE o."user" = own."user" AND o.item_id = other) GROUP BY own."user", other
  QUALIFY row_number() OVER (PARTITION BY own."user" ORDER BY round(sum(sim * weight), 9) DESC, other) <= {top_k}
)"""


@query("similar_classes", f"WITH {_CLASSES}, {_DENSE.strip()} SELECT a.item_id AS item, b.item_id AS other, round(list_cosine_similarity(a.z, b.z), 6) AS sim FROM dense a, dense b WHERE a.item_id IN (SELECT representative FROM classes) AND b.item_id IN (SELECT representative FROM classes) AND a.item_id <> b.item_id AND round(list_cosine_similarity(a.z, b.z), 9) >= 0.2", ["items"])
def similar_classes(spark, sf):
    """Every item against all, at least 0.2 alike by standardised tags, as pairs of the first items of ``item_classes``; items of one class are alike wholly."""
    i = domain.items(spark, sf)
    firsts = rec.tag_classes(i).select(F.col("representative").alias("item_id")).distinct()
    return rec.similar_items(i, firsts, 0.2, among=firsts).select("item", "other", F.round("sim", 6).alias("sim"))


@query("recommend_content", f'WITH {_content(10, "TRUE")} SELECT "user", item_id, round(score, 6) AS score FROM content', ["ratings", "items"])
def recommend_content(spark, sf):
    # The last event of all is a last rating as well.
    now = domain.interactions(spark, sf).agg(F.max("ts").alias("now"))
    found = rec.content(domain.ratings(spark, sf), domain.items(spark, sf), _everyone(spark, sf), 10, now=now)
    return found.select("user", "item_id", F.round("score", 6).alias("score"))


@query("item_transitions", 'SELECT item_id, next, count(*) AS n FROM (SELECT item_id, lead(item_id) OVER (PARTITION BY "user" ORDER BY ts, seq, item_id) AS next FROM interactions) WHERE next IS NOT NULL GROUP BY ALL', ["interactions"])
def item_transitions(spark, sf):
    return rec.transitions(domain.interactions(spark, sf)).groupBy("item_id", "next").agg(F.count(F.lit(1)).alias("n"))


@query("recent_items", 'SELECT "user", item_id, row_number() OVER (PARTITION BY "user" ORDER BY ts DESC, seq DESC, item_id DESC) AS back FROM interactions QUALIFY back <= 5', ["interactions"])
def recent_items(spark, sf):
    return rec.recent(domain.interactions(spark, sf)).select("user", "item_id", F.col("back").cast("long").alias("back"))


@query("train_test_split", 'SELECT "user", count(*) FILTER (WHERE n <= 5) AS test, count(*) FILTER (WHERE n > 5) AS train FROM (SELECT "user", row_number() OVER (PARTITION BY "user" ORDER BY ts DESC, item_id DESC) AS n FROM ratings) GROUP BY 1', ["ratings"])
def train_test_split(spark, sf):
    n = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("ts"), F.desc("item_id")))
    return domain.ratings(spark, sf).withColumn("n", n).groupBy("user").agg(F.count_if(F.col("n") <= 5).alias("test"), F.count_if(F.col("n") > 5).alias("train"))


def _sequence(top_k: int, asked: str = _ASKED) -> str:
    return f"""
moves AS (SELECT "user", item_id, lead(item_id) OVER (PARTITION BY "user" ORDER BY ts, seq, item_id) AS next FROM interactions),
last5 AS (SELECT DISTINCT asked, item_id FROM (SELECT "user" AS asked, item_id FROM interactions WHERE {asked} QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY ts DESC, seq DESC, item_id DESC) <= 5)),
freq AS (SELECT asked AS "user", next AS item_id, count(*) AS freq FROM moves JOIN last5 USING (item_id) WHERE next IS NOT NULL AND "user" <> asked GROUP BY ALL),
known AS (SELECT item_id, count(*) AS known FROM interactions GROUP BY 1),
sequence AS (
  SELECT freq."user", item_id, 0.5::DOUBLE * freq + 0.5::DOUBLE * ln(1 + known) AS score FROM freq JOIN known USING (item_id)
  WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r."user" = freq."user" AND r.item_id = freq.item_id)
  QUALIFY row_number() OVER (PARTITION BY freq."user" ORDER BY round(0.5::DOUBLE * freq + 0.5::DOUBLE * ln(1 + known), 9) DESC, item_id) <= {top_k}
)"""


@query("recommend_sequence", f'WITH {_sequence(10)} SELECT "user", item_id, round(score, 6) AS score FROM sequence', ["interactions", "ratings"])
def recommend_sequence(spark, sf):
    return rec.sequence(domain.interactions(spark, sf), _asked(spark, sf), 10).select("user", "item_id", F.round("score", 6).alias("score"))


def _fame(spark, sf):
    return domain.interactions(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("fame"))


def _people(spark, sf):
    return domain.profiles(spark, sf).withColumn("user", F.col("key"))


def _profiles(spark, sf):
    return _people(spark, sf).where("key % 50 = 0")


_LIKING = "coalesce(list_sum(list_transform(u.preferences, lambda p: p.value * coalesce(list_sum(list_transform(list_filter(i.features, lambda f: f.name = p.name), lambda f: f.value)), 0))), 0)"
_FAMED = "famed AS (SELECT item_id, count(*) AS fame FROM interactions GROUP BY 1)"
_GROUP = "CASE WHEN coalesce(u.age, 0) <= 0 THEN '' WHEN u.age < 18 THEN 'teen' WHEN u.age < 25 THEN 'young_adult' WHEN u.age < 35 THEN 'adult' WHEN u.age < 50 THEN 'middle_age' ELSE 'senior' END"
_INCOME = "CASE WHEN u.income < 50000 THEN 'low' WHEN u.income < 100000 THEN 'medium' WHEN u.income IS NOT NULL THEN 'high' END"
_RULES = [
    "CASE WHEN i.target_gender = 'both' OR i.target_gender = u.gender THEN 1.0 ELSE 0 END", "CASE WHEN coalesce(u.age, 0) BETWEEN i.target_age_min AND i.target_age_max THEN 1.0 ELSE 0 END",
    f"CASE WHEN i.target_age_group = {_GROUP} THEN 0.5 ELSE 0 END", "0.5 * len(list_intersect(u.interests, i.tags))", f"0.3::DOUBLE * {_LIKING}", "CASE WHEN list_contains(i.target_location, u.location) THEN 0.8 ELSE 0 END",
    "CASE WHEN i.target_education = u.education THEN 0.6 ELSE 0 END", "CASE WHEN list_contains(i.target_occupation, u.occupation) THEN 0.7 ELSE 0 END", f"CASE WHEN i.target_income = {_INCOME} THEN 0.5 ELSE 0 END",
    "CASE WHEN i.target_relationship = u.relationship THEN 0.6 ELSE 0 END", "0.3 * len(list_intersect(u.lifestyle, i.target_lifestyle))", "CASE WHEN i.target_social_group = u.social_group THEN 0.5 ELSE 0 END",
]
_MET = ", ".join(f"CASE WHEN round(r{n}, 9) > {({3: 0.5, 4: 0.3, 10: 0.3}).get(n, 0)} THEN {n} END" for n in range(12))
_COLD = f"""
{_FAMED}, points AS (
  SELECT u.key AS "user", i.item_id, ln(1 + fame) AS famous, list_sort(list_intersect(u.interests, i.tags))[1:2] AS common, {', '.join(f'({r})::DOUBLE AS r{n}' for n, r in enumerate(_RULES))}
  FROM profiles u, item_profiles i LEFT JOIN famed USING (item_id)
), met AS (
  SELECT *, {' + '.join(f'r{n}' for n in range(12))} AS base, list_filter([{_MET}], lambda x: x IS NOT NULL) AS met FROM points
), hit AS (
  SELECT "user", item_id, common, base + coalesce(famous * CASE WHEN len(met) <= 1 THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END, 0) AS score, CASE WHEN famous > 1 THEN list_append(met, 12) ELSE met END AS met FROM met
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY round(score, 9) DESC, item_id) AS rank, count(*) OVER (PARTITION BY "user") AS hits FROM hit WHERE score > 0
), best AS (SELECT * FROM placed WHERE rank <= 20),
picks AS (
  SELECT "user", item_id, min(no * 1000 + place) AS pick FROM (
    SELECT *, row_number() OVER (PARTITION BY "user", no ORDER BY rank) AS place FROM (SELECT "user", item_id, rank, unnest(met) AS no FROM best WHERE hits > 20)
  ) WHERE place <= 3 GROUP BY ALL
), cold AS (
  SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY pick NULLS LAST, rank) AS nth FROM best LEFT JOIN picks USING ("user", item_id) QUALIFY nth <= 10
)"""
_NAMES = "[" + ", ".join(f"'{r}'" for r in rec.REASONS) + "]"


@query(
    "cold_start",
    f"""WITH {_COLD} SELECT "user", item_id, nth AS rank, round(score, 6) AS score, CASE WHEN len(met) > 0 THEN '推荐理由: ' || array_to_string(list_transform(met, lambda n: {_NAMES}[n + 1])[1:2], ' 和 ')
WHEN len(common) > 0 THEN '与您的' || array_to_string(common, '/') || '兴趣相关' ELSE '基于您的个人资料推荐' END AS reason FROM cold""",
    ["profiles", "item_profiles", "interactions"],
)
def cold_start(spark, sf):
    found = rec.cold_start(_people(spark, sf), domain.item_profiles(spark, sf), _fame(spark, sf), 10)
    return found.select("user", "item_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), "reason")


_AT = {"time": "evening", "location": "c1", "device": "mobile", "activity": "dining"}


def _context(top_k: int, asked: str = "u.key % 50 = 0") -> str:
    fit = " + ".join(f"CASE WHEN list_contains(i.suitable_{n}, '{_AT[n]}') THEN {w} ELSE 0 END" for n, w in (("time", 1.0), ("location", 1.0), ("device", 0.5), ("activity", 1.5)))
    return f"""
{_FAMED}, fits AS (
  SELECT u.key AS "user", i.item_id, fame, ({fit})::DOUBLE AS fit, {_LIKING} AS liking FROM profiles u, item_profiles i LEFT JOIN famed USING (item_id) WHERE {asked}
), mixed AS (
  SELECT "user", item_id, CASE WHEN fame IS NULL THEN 0.6::DOUBLE * fit + 0.4::DOUBLE * liking ELSE 0.8::DOUBLE * (0.6::DOUBLE * fit + 0.4::DOUBLE * liking) + 0.2::DOUBLE * ln(1 + fame) END AS score FROM fits WHERE fit > 0
), context AS (
  SELECT * FROM mixed m WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r."user" = m."user" AND r.item_id = m.item_id) QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY round(score, 9) DESC, item_id) <= {top_k}
)"""


@query("recommend_context", f'WITH {_context(10, "TRUE")} SELECT "user", item_id, round(score, 6) AS score FROM context', ["profiles", "item_profiles", "interactions", "ratings"])
def recommend_context(spark, sf):
    found = rec.context(_people(spark, sf), domain.item_profiles(spark, sf), domain.ratings(spark, sf), _fame(spark, sf), _AT, 10)
    return found.select("user", "item_id", F.round("score", 6).alias("score"))


_LEAN = f"""
{_POP}, lean AS (
  SELECT "user", greatest(-1.0, least(1.0, 2 * (avg(coalesce(popularity, 0)) - (SELECT avg(popularity) FROM pop)) / greatest((SELECT avg(popularity) FROM pop), 0.01)))::DOUBLE AS preference
  FROM ratings LEFT JOIN pop USING (item_id) GROUP BY 1
)"""


@query("popularity_preference", f'WITH {_LEAN} SELECT "user", round(preference, 6) AS preference FROM lean', ["ratings"])
def popularity_preference(spark, sf):
    r = domain.ratings(spark, sf)
    return rec.popularity_preference(r, rec.popularity(r, 365)).select("user", F.round("preference", 6).alias("preference"))


def _factor(scenario: str) -> str:
    return f"""factor AS (
  SELECT key AS "user", coalesce(CASE WHEN novelty BETWEEN 0 AND 1 THEN 2 * novelty - 1 WHEN novelty IS NULL THEN {scenario} END, preference, 0)::DOUBLE AS factor FROM profiles LEFT JOIN lean ON lean."user" = key
)"""


@query(
    "adaptive_factor",
    f"""WITH {_LEAN}, {_factor('NULL')}, scene AS (SELECT "user", factor AS explore FROM ({_factor('-0.6').removeprefix('factor AS (').removesuffix(')')})) SELECT "user", round(factor, 6) AS factor, round(explore, 6) AS explore FROM factor JOIN scene USING ("user")""",
    ["profiles", "ratings"],
)
def adaptive_factor(spark, sf):
    """Of every user, without a scenario and in one."""
    r, users = domain.ratings(spark, sf), domain.profiles(spark, sf).withColumn("user", F.col("key"))
    lean = rec.popularity_preference(r, rec.popularity(r, 365))
    plain, explore = rec.adaptive_factor(users, lean), rec.adaptive_factor(users, lean, scenario="Explore").withColumnRenamed("factor", "explore")
    return plain.join(explore, "user").select("user", F.round("factor", 6).alias("factor"), F.round("explore", 6).alias("explore"))


def _weights(where: str) -> str:
    return f"""
cosines AS (
  SELECT a."user", len(list_intersect(x.tags, y.tags)) / sqrt(len(list_distinct(x.tags)) * len(list_distinct(y.tags))) AS c
  FROM ratings a JOIN ratings b ON a."user" = b."user" AND a.item_id < b.item_id JOIN items x ON x.item_id = a.item_id JOIN items y ON y.item_id = b.item_id WHERE {where.format('a."user"')}
), alike AS (SELECT "user", 1 - least(1.0, stddev_pop(c)) AS content FROM cosines GROUP BY 1),
gaps AS (SELECT "user", epoch(ts) - epoch(lag(ts) OVER (PARTITION BY "user" ORDER BY ts, seq)) AS gap FROM interactions),
regular AS (SELECT "user", CASE WHEN count(*) >= 3 AND avg(gap) > 0 THEN 1 - least(1.0, stddev_pop(gap) / avg(gap)) END AS sequence FROM gaps GROUP BY 1),
number AS (SELECT "user", count(*) AS known FROM ratings GROUP BY 1),
raw AS (
  SELECT key AS "user", 0.35::DOUBLE AS collaborative, CASE WHEN coalesce(known, 0) < 5 OR coalesce(content, 0) <= 0 THEN 0.25 ELSE content END::DOUBLE AS content,
    CASE WHEN coalesce(known, 0) < 5 OR coalesce(sequence, 0) <= 0 THEN 0.25 ELSE sequence END::DOUBLE AS sequence, CASE WHEN coalesce(known, 0) < 5 THEN 0.15 ELSE 0.5 END::DOUBLE AS context
  FROM profiles LEFT JOIN number ON number."user" = key LEFT JOIN alike ON alike."user" = key LEFT JOIN regular ON regular."user" = key WHERE {where.format('key')}
), weights AS (
  SELECT "user", collaborative / s AS collaborative, content / s AS content, sequence / s AS sequence, context / s AS context FROM (SELECT *, collaborative + content + sequence + context AS s FROM raw)
)"""


@query("adaptive_weights", f'WITH {_weights("TRUE")} SELECT "user", round(collaborative, 6) AS collaborative, round(content, 6) AS content, round(sequence, 6) AS sequence, round(context, 6) AS context FROM weights', ["profiles", "items", "interactions", "ratings"])
def adaptive_weights(spark, sf):
    users = domain.profiles(spark, sf).select(F.col("key").alias("user"))
    found = rec.adaptive_weights(users, domain.ratings(spark, sf), domain.items(spark, sf), domain.interactions(spark, sf))
    return found.select("user", *(F.round(c, 6).alias(c) for c in rec.WEIGHTS))


def _hybrid(spark, sf, collaborative=None, weights=None, users=None):
    """The combined lists of ``users``, of every fiftieth one unless they are given, and of one (-1) that has no profile."""
    # Written once, as every strategy reads them.
    events = written(domain.interactions(spark, sf).select("user", "item_id", "ts", "seq"), "events")
    r, items, users = written(domain.ratings(spark, sf), "ratings"), domain.item_profiles(spark, sf), _profiles(spark, sf) if users is None else users
    fame = events.groupBy("item_id").agg(F.count(F.lit(1)).alias("fame"))
    parts = {"content": rec.content(r, items, users, 20), "sequence": rec.sequence(events, users, 20), "context": rec.context(users, items, r, fame, _AT, 20)}
    if collaborative is not None:
        parts = {"collaborative": collaborative, **parts}
    pop = rec.popularity(r, 365)
    weights = rec.adaptive_weights(users, r, items, events) if weights is None else weights
    asked = users.select("user").union(spark.range(1).select(F.lit(-1).cast("long")))
    mixed = rec.hybrid(parts, weights, rec.adaptive_factor(users, rec.popularity_preference(r, pop)), pop, r, rec.popular_items(events, 10), asked, 10)
    return rec.explained(mixed, items, r)


_TAGGED = 'liked AS (SELECT "user", list_sort(list_distinct(flatten(list(tags)))) AS liked FROM ratings JOIN items USING (item_id) WHERE rating > 3 GROUP BY 1)'
_SAYS = (
    "list_filter([CASE WHEN list_contains(found, 'content') THEN CASE WHEN len(list_intersect(tags, liked)) > 0 THEN '包含您喜欢的' || array_to_string(list_transform(list_sort(list_intersect(tags, liked))[1:2], lambda t: 'tag_' || t), '/') || '特征' "
    "ELSE '与您的品味相符' END END, CASE WHEN list_contains(found, 'sequence') THEN '基于您的浏览历史' END, CASE WHEN list_contains(found, 'context') THEN '适合您当前的场景' END], lambda x: x IS NOT NULL)[1:2]"
)
_POPULAR = _popular(30)[0].removeprefix("WITH ").replace(" SELECT item_id, round(ln(1 + n), 6) AS score FROM n WHERE n > 0 ORDER BY n DESC, item_id LIMIT 20", ", popular AS (SELECT item_id, ln(1 + n) AS score, row_number() OVER (ORDER BY n DESC, item_id) AS rank FROM n WHERE n > 0 QUALIFY rank <= 10)")


def _hybrid_sql(weights: str, everyone: bool = False) -> str:
    asked = ("TRUE",) if everyone else ()
    return f"""WITH {_content(20, *asked)}, {_sequence(20, *asked)}, {_context(20, *asked)}, {_LEAN}, {_factor('NULL')}, {weights}, {_TAGGED}, {_POPULAR},
parts AS (
  SELECT c.*, 'content' AS s, content AS w FROM content c JOIN weights USING ("user") UNION ALL SELECT c.*, 'sequence', sequence FROM sequence c JOIN weights USING ("user")
  UNION ALL SELECT c.*, 'context', context FROM context c JOIN weights USING ("user")
), merged AS (SELECT "user", item_id, sum(score * w) / sum(w) AS base, list(s) AS found FROM parts GROUP BY ALL),
adjusted AS (
  SELECT "user", item_id, found, base * greatest(0.01, 1 + factor * 0.5 * ln(1 + 10 * coalesce(popularity, 0)))::DOUBLE AS score FROM merged JOIN factor USING ("user") LEFT JOIN pop USING (item_id)
  WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r."user" = merged."user" AND r.item_id = merged.item_id)
), best AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY round(score, 9) DESC, item_id) AS rank FROM adjusted QUALIFY rank <= 10),
whole AS (
  SELECT "user", item_id, rank, score, found FROM best
  UNION ALL SELECT "user", item_id, rank, score, [] FROM (SELECT key AS "user" FROM profiles {"" if everyone else "WHERE key % 50 = 0 "}UNION ALL SELECT -1), popular WHERE "user" NOT IN (SELECT "user" FROM best)
)
SELECT "user", item_id, rank, round(score, 6) AS score, CASE WHEN len(found) = 0 THEN '根据您的个人喜好推荐' ELSE '为您推荐' || name || '，' || array_to_string({_SAYS}, '，并且') END AS reason
FROM whole JOIN items USING (item_id) LEFT JOIN liked USING ("user")"""


_HYBRID_TABLES = ["profiles", "item_profiles", "interactions", "ratings"]


@query("recommend_hybrid", _hybrid_sql(_weights("TRUE"), True), _HYBRID_TABLES)
def recommend_hybrid(spark, sf):
    """Content, sequence and context, by adaptive weights and factors, with reasons; the factor model is left to ``recommend_hybrid_cf``."""
    return _hybrid(spark, sf, users=_people(spark, sf)).select("user", "item_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), "reason")


def _collaborative(spark, sf, top_k: int):
    """The best items of every fiftieth user by the cosine of factors, those that they know left out."""
    r = domain.ratings(spark, sf)
    made = factors.truncated_svd(r)
    return factors.nearest_factors(made.users.join(_asked(spark, sf), "user", "left_semi"), made.items, r.select("user", "item_id"), top_k)


@query("recommend_hybrid_cf")
def recommend_hybrid_cf(spark, sf):
    """All four strategies."""
    found = _hybrid(spark, sf, _collaborative(spark, sf, 20).drop("rank"))
    return found.select("user", "item_id", "rank", F.round("score", 6).alias("score"), F.array_join("strategies", "|").alias("strategies"), "reason")


_AB = {"control": (0.35, 0.25, 0.25, 0.15), "sequence_first": (0.2, 0.2, 0.5, 0.1)}


@query("ab_assignments", """SELECT c_custkey AS "user", CASE WHEN CAST('0x' || substr(md5(c_custkey::VARCHAR || 'weight_exp_1'), 1, 8) AS BIGINT) % 100 < 50 THEN 'control' ELSE 'sequence_first' END AS arm FROM customer""")
def ab_assignments(spark, sf):
    bucket = rec.ab_bucket(F.col("c_custkey"), "weight_exp_1")
    return domain.table(spark, sf, "customer").select(F.col("c_custkey").alias("user"), F.when(bucket < 50, "control").otherwise("sequence_first").alias("arm"))


_ARMS = "CASE WHEN CAST('0x' || substr(md5(key::VARCHAR || 'weight_exp_1'), 1, 8) AS BIGINT) % 100 < 50 THEN {0} ELSE {1} END::DOUBLE AS {2}"
_AB_WEIGHTS = 'weights AS (SELECT key AS "user", ' + ", ".join(_ARMS.format(*(w[n] for w in _AB.values()), name) for n, name in enumerate(rec.WEIGHTS)) + " FROM profiles WHERE key % 50 = 0)"


@query("recommend_ab", f"""SELECT "user", item_id, rank, score, CASE WHEN "user" >= 0 THEN CASE WHEN CAST('0x' || substr(md5("user"::VARCHAR || 'weight_exp_1'), 1, 8) AS BIGINT) % 100 < 50 THEN 'control' ELSE 'sequence_first' END END AS arm FROM ({_hybrid_sql(_AB_WEIGHTS)})""", _HYBRID_TABLES)
def recommend_ab(spark, sf):
    """The combined lists by the weights of each user's arm."""
    arms = ab_assignments(spark, sf).where("user % 50 = 0")
    weights = arms.select("user", *(F.when(F.col("arm") == "control", _AB["control"][n]).otherwise(_AB["sequence_first"][n]).alias(name) for n, name in enumerate(rec.WEIGHTS)))
    found = _hybrid(spark, sf, weights=weights)
    return found.join(arms, "user", "left").select("user", "item_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), "arm")


@query("ab_bucket", "SELECT c_custkey, CAST('0x' || substr(md5(c_custkey::VARCHAR || 'weight_exp_1'), 1, 8) AS BIGINT) % 100 AS bucket FROM customer")
def ab_bucket(spark, sf):
    return domain.table(spark, sf, "customer").select("c_custkey", rec.ab_bucket(F.col("c_custkey"), "weight_exp_1").alias("bucket"))


@query("anti_seen_items", 'SELECT item_id FROM items WHERE item_id NOT IN (SELECT item_id FROM interactions WHERE "user" = 5)', ["items", "interactions"])
def anti_seen_items(spark, sf):
    seen = domain.interactions(spark, sf).where("user = 5").select("item_id")
    return domain.items(spark, sf).select("item_id").join(seen, "item_id", "left_anti")


@query(
    "diversity_tag",
    """
WITH c AS (SELECT "user", tag, count(*) AS n FROM (SELECT "user", unnest(tags) AS tag FROM ratings JOIN items USING (item_id)) GROUP BY ALL),
p AS (SELECT *, n / (sum(n) OVER (PARTITION BY "user"))::DOUBLE AS p FROM c)
SELECT "user", round(CASE WHEN count(*) > 1 THEN 0.7::DOUBLE * -sum(p * ln(p)) / ln(count(*)) ELSE 0 END + 0.3::DOUBLE * count(*) / sum(n)::DOUBLE, 6) AS diversity FROM p GROUP BY 1""",
    ["ratings", "items"],
)
def diversity_tag(spark, sf):
    tags = domain.ratings(spark, sf).join(domain.items(spark, sf).select("item_id", "tags"), "item_id").select("user", F.explode("tags").alias("tag"))
    e = rec.entropy(tags.groupBy("user", "tag").agg(F.count(F.lit(1)).alias("n")), "user", "tag")
    return e.select("user", F.round(0.7 * F.col("evenness") + 0.3 * F.col("kinds") / F.col("total"), 6).alias("diversity"))


@query("interval_regularity", "SELECT user_id, round(CASE WHEN count(d) >= 2 AND avg(d) > 0 THEN 1 - least(1.0, stddev_pop(d) / avg(d)) END, 6)::DOUBLE AS regularity FROM (SELECT user_id, epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS d FROM events) GROUP BY 1")
def interval_regularity(spark, sf):
    gap = F.unix_timestamp("ts") - F.lag(F.unix_timestamp("ts")).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    d = domain.table(spark, sf, "events").withColumn("d", gap).groupBy("user_id")
    return d.agg(F.round(F.when((F.count("d") >= 2) & (F.avg("d") > 0), 1 - F.least(F.lit(1.0), F.stddev_pop("d") / F.avg("d"))), 6).alias("regularity"))


@query("recommend_cf")
def recommend_cf(spark, sf):
    """The nearest items of every fiftieth user by the factors of a truncated decomposition of all ratings, those that they know left out."""
    return _collaborative(spark, sf, 10).select("user", "item_id", "rank", F.round("score", 6).alias("score"))


@query("similar_items_cf")
def similar_items_cf(spark, sf):
    """The nearest items of every fiftieth item by the same factors."""
    made = factors.truncated_svd(domain.ratings(spark, sf)).items
    asked = made.where("item_id % 50 = 0").withColumnRenamed("item_id", "item")
    found = factors.nearest_factors(asked, made, asked.select("item", F.col("item").alias("item_id")), 10, key="item")
    return found.select("item", F.col("item_id").alias("other"), "rank", F.round("score", 6).alias("score"))


_LISTS = 'lists AS (SELECT "user", item_id FROM ratings QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY ts DESC, item_id DESC) <= 10)'
_DIVERSE = f"""
{_LISTS}, own AS (SELECT "user", item_id, i.* EXCLUDE (item_id) FROM lists JOIN item_profiles i USING (item_id)),
pairs AS (SELECT a."user", avg(len(list_intersect(a.tags, b.tags)) / sqrt(len(list_distinct(a.tags)) * len(list_distinct(b.tags)))) AS c FROM own a JOIN own b ON a."user" = b."user" AND a.item_id < b.item_id GROUP BY 1),
tagged AS (SELECT "user", tag, count(*) AS n FROM (SELECT "user", unnest(tags) AS tag FROM own) GROUP BY ALL), tagp AS (SELECT *, n / (sum(n) OVER (PARTITION BY "user"))::DOUBLE AS p FROM tagged),
tag AS (SELECT "user", CASE WHEN count(*) > 1 THEN 0.7::DOUBLE * -sum(p * ln(p)) / ln(count(*)) ELSE 0 END + 0.3::DOUBLE * count(*) / sum(n)::DOUBLE AS tag FROM tagp GROUP BY 1),
typed AS (SELECT "user", type, count(*) AS n FROM own GROUP BY ALL), typei AS (SELECT *, avg(n) OVER (PARTITION BY "user") AS ideal FROM typed),
kind AS (SELECT "user", 0.6::DOUBLE * count(*) / sum(n) + 0.4::DOUBLE * (1 - least(1.0, avg(abs(n - ideal) / ideal))) AS type FROM typei GROUP BY 1),
gen AS (SELECT "user", target_gender, count(*) AS n FROM own WHERE target_gender IS NOT NULL GROUP BY ALL), geni AS (SELECT *, avg(n) OVER (PARTITION BY "user") AS ideal FROM gen),
gender AS (SELECT "user", CASE WHEN count(*) > 1 THEN 1 - least(1.0, avg(abs(n - ideal) / ideal)) ELSE 0.5 END AS gender FROM geni GROUP BY 1),
ages AS (SELECT "user", age, count(*) AS n FROM (SELECT "user", unnest(generate_series(target_age_min, target_age_max)) AS age FROM own) GROUP BY ALL), agep AS (SELECT *, n / (sum(n) OVER (PARTITION BY "user"))::DOUBLE AS p FROM ages),
age AS (SELECT "user", 0.5::DOUBLE * count(*) / (max(age) - min(age) + 1) + 0.5::DOUBLE * CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END AS age FROM agep GROUP BY 1 HAVING max(age) > min(age)),
diverse AS (
  SELECT l."user", l.n, 1 - coalesce(c, 0) AS content, coalesce(tag, 0.5) AS tag, coalesce(type, 0.5) AS type, 0.4::DOUBLE * coalesce(gender, 0.5) + 0.6::DOUBLE * coalesce(age, 0.5) AS demographic
  FROM (SELECT "user", count(*) AS n FROM lists GROUP BY 1) l LEFT JOIN pairs USING ("user") LEFT JOIN tag USING ("user") LEFT JOIN kind USING ("user") LEFT JOIN gender USING ("user") LEFT JOIN age USING ("user")
)"""


def _lists(spark, sf):
    return rec.recent(domain.ratings(spark, sf), 10, ("ts", "item_id")).select("user", "item_id")


for _name, _part, _of in (("diversity_content", "content", diversity.by_content), ("diversity_type", "type", diversity.by_type), ("diversity_demographic", "demographic", diversity.by_demography)):
    query(_name, f'WITH {_DIVERSE} SELECT "user", round({_part}, 6)::DOUBLE AS diversity FROM diverse', ["item_profiles", "ratings"])(
        lambda spark, sf, of=_of, part=_part: of(_lists(spark, sf), domain.item_profiles(spark, sf), "user").select("user", F.round(part, 6).alias("diversity"))
    )


@query("diversity_total", f'WITH {_DIVERSE} SELECT "user", round(CASE WHEN n <= 1 THEN 1.0 ELSE 0.4::DOUBLE * content + 0.3::DOUBLE * tag + 0.2::DOUBLE * type + 0.1::DOUBLE * demographic END, 6)::DOUBLE AS diversity FROM diverse', ["item_profiles", "ratings"])
def diversity_total(spark, sf):
    return diversity.total(_lists(spark, sf), domain.item_profiles(spark, sf), "user").select("user", F.round("diversity", 6).alias("diversity"))


_FACTORS = '[("user" % 7) / 7.0::DOUBLE + 1, ("user" % 5) / 2.0::DOUBLE]', "[(item_id % 6) / 3.0::DOUBLE + 1, (item_id % 4) / 4.0::DOUBLE]"


@query("rmse_mae", f'WITH p AS (SELECT rating - list_inner_product({_FACTORS[0]}, {_FACTORS[1]}) AS d FROM ratings) SELECT round(sqrt(avg(d * d)), 6) AS rmse, round(avg(abs(d)), 6) AS mae, count(*) AS n FROM p', ["ratings"])
def rmse_mae(spark, sf):
    r = domain.ratings(spark, sf)
    users = r.select("user").distinct().withColumn("factors", F.array(F.col("user") % 7 / F.lit(7.0) + 1, F.col("user") % 5 / F.lit(2.0)))
    items = r.select("item_id").distinct().withColumn("factors", F.array(F.col("item_id") % 6 / F.lit(3.0) + 1, F.col("item_id") % 4 / F.lit(4.0)))
    return rec.errors(r, users, items).select(F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"), "n")


@query(
    "evaluate_recs",
    f"""WITH {_sequence(10, 'TRUE')}, recs AS (SELECT "user", item_id, row_number() OVER (PARTITION BY "user" ORDER BY round(score, 9) DESC, item_id) AS rank FROM sequence),
held AS (SELECT "user", item_id, rating FROM ratings QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY ts DESC, item_id DESC) <= 5),
held_out AS (SELECT * FROM held UNION ALL SELECT "user", item_id + 1, 5.0 FROM recs WHERE rank IN (2, 3) AND "user" % 100 = 0),
good AS (SELECT "user", count(*) AS good FROM held_out WHERE rating >= 4 GROUP BY 1), asked AS (SELECT DISTINCT "user" FROM held_out),
hit AS (SELECT recs."user", count(*) AS n, count(h.item_id) AS hits, sum(CASE WHEN h.item_id IS NOT NULL THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM recs LEFT JOIN (SELECT DISTINCT "user", item_id FROM held_out WHERE rating >= 4) h ON h."user" = recs."user" AND h.item_id = recs.item_id GROUP BY 1),
per AS (
  SELECT asked."user", CASE WHEN good > 0 AND n > 0 THEN hits / n ELSE 0 END AS p, CASE WHEN good > 0 THEN coalesce(hits, 0) / good ELSE 0 END AS r,
    CASE WHEN good > 0 AND n > 0 THEN dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(good, n) + 1) t(i)) ELSE 0 END AS g FROM asked LEFT JOIN good USING ("user") LEFT JOIN hit USING ("user")
)
SELECT count(*) AS users, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(g), 6) AS ndcg, round((SELECT count(DISTINCT item_id) FROM recs) / (SELECT count(*) FROM items), 6) AS coverage FROM per""",
    ["interactions", "ratings", "items"],
)
def evaluate_recs(spark, sf):
    """The sequence strategy against each user's last five ratings, with a few made hits."""
    r = domain.ratings(spark, sf)
    recs = written(rec.sequence(domain.interactions(spark, sf), _everyone(spark, sf), 10).select("user", "item_id", "rank"), "lists")
    made = recs.where(F.col("rank").isin(2, 3) & (F.col("user") % 100 == 0)).select("user", (F.col("item_id") + 1).alias("item_id"), F.lit(5.0).alias("rating"))
    held = rec.recent(r, 5, ("ts", "item_id")).select("user", "item_id", F.col("rating").cast("double").alias("rating")).unionByName(made)
    found = rec.evaluate(recs, held, domain.items(spark, sf).count())
    return found.select("users", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "ndcg", "coverage")))


@query(
    "explore_items",
    f"""WITH {_context(40)}, typed AS (SELECT "user", item_id, score * pow(0.3::DOUBLE, row_number() OVER (PARTITION BY "user", type ORDER BY round(score, 9) DESC, item_id) - 1) AS score FROM context JOIN items USING (item_id))
SELECT "user", item_id, round(score, 6) AS score FROM typed QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY round(score, 9) DESC, item_id) <= 10""",
    ["profiles", "item_profiles", "interactions", "ratings"],
)
def explore_items(spark, sf):
    items = domain.item_profiles(spark, sf)
    found = rec.context(_profiles(spark, sf), items, domain.ratings(spark, sf), _fame(spark, sf), _AT, 40)
    return rec.explore(found, items, 0.7, 10).select("user", "item_id", F.round("score", 6).alias("score"))


@query(
    "recommend_filtered",
    f"""WITH {_context(10, 'TRUE').replace("FROM profiles u, item_profiles i LEFT JOIN", "FROM profiles u, (SELECT * FROM item_profiles WHERE type = 'ECONOMY' AND item_id IN (SELECT item_id FROM ratings GROUP BY 1 HAVING avg(rating) >= 3.5)) i LEFT JOIN")} SELECT "user", item_id, round(score, 6) AS score FROM context""",
    ["profiles", "item_profiles", "interactions", "ratings"],
)
def recommend_filtered(spark, sf):
    """Of one type, and rated well."""
    r = domain.ratings(spark, sf)
    items = rec.filtered(domain.item_profiles(spark, sf), r, item_type="ECONOMY", least_rating=3.5)
    return rec.context(_people(spark, sf), items, r, _fame(spark, sf), _AT, 10).select("user", "item_id", F.round("score", 6).alias("score"))


@query("trending_of_type", _popular(7)[0].replace("FROM interactions GROUP BY 1)", "FROM interactions WHERE item_id IN (SELECT item_id FROM items WHERE type = 'SMALL') GROUP BY 1)"), ["interactions", "items"])
def trending_of_type(spark, sf):
    """The week's items of one type."""
    events = domain.interactions(spark, sf)
    of = rec.filtered(domain.items(spark, sf), domain.ratings(spark, sf), item_type="SMALL").select("item_id")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    return rec.popular_items(events.join(of, "item_id", "left_semi"), 20, 7, now).select("item_id", F.round("score", 6).alias("score"))
