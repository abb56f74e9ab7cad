"""User matching: similarity, complementarity, compatibility, and items for a pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import sets, vectors
from millrace.functions.scores import billionths
from millrace.operators.blocks import best_pairs, block_pairs, member_pairs
from millrace.sources.shared import written

TRAITS = ("extraversion", "agreeableness", "conscientiousness", "neuroticism", "openness")
MALE, FEMALE = ("male", "m", "男"), ("female", "f", "女")


def standardized(users: DataFrame, numbers: Sequence[str]) -> DataFrame:
    """``z``: the users' numbers less their mean, over their population deviation, 0 where a number never varies; ``norm``: its length.

    The moments are one grouped row, joined back as a broadcast of fixed size.
    """
    cols = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numbers}
    moments = users.agg(*(F.avg(v).alias(f"m_{c}") for c, v in cols.items()), *(F.stddev_pop(v).alias(f"s_{c}") for c, v in cols.items()))
    z = [F.when(F.col(f"s_{c}") > 1e-12, (v - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0) for c, v in cols.items()]
    wide = users.crossJoin(F.broadcast(moments)).withColumn("z", F.array(*z)).withColumn("norm", vectors.norm(F.col("z"))).drop(*moments.columns)
    return wide.withMetadata("z", {"width": len(cols)})


def _width(rows: DataFrame) -> int | None:
    return rows.schema["z"].metadata.get("width")


def personality(a: str, b: str) -> Column:
    """Mean compatibility of the traits that both have; 0.5 if there are none."""
    parts = []
    for t in TRAITS:
        x, y = F.col(f"{a}.{t}"), F.col(f"{b}.{t}")
        if t == "extraversion":
            parts.append(1 - 2 * F.abs(F.abs(x - y) - 0.5))
        elif t == "neuroticism":
            parts.append(1 - (x + y) / 2)
        else:
            parts.append(1 - F.abs(x - y))
    known = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    mean = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)) / known
    return F.when(known == 0, 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean)))


def similarity(a: str, b: str, width: int | None = None) -> Column:
    """0.7 of the cosine of the standardised features and 0.3 of the personalities' compatibility."""
    return 0.7 * _likeness(a, b, width) + 0.3 * personality(a, b)


def _likeness(a: str, b: str, width: int | None = None) -> Column:
    """Cosine of two sides' standardised numbers; 0 without a direction."""
    size = F.col(f"{a}.norm") * F.col(f"{b}.norm")
    return F.when(size > 0, vectors.dot(F.col(f"{a}.z"), F.col(f"{b}.z"), width) / size).otherwise(0.0)


def _prepared(users: DataFrame, words: Sequence[str] | None) -> DataFrame:
    """What pairs compare, made once a row: ``sex`` (1, 2 or 0), the number of interests and, of few words, their masks."""
    g = F.lower("gender")
    sex = F.when(g.isin(*MALE), 1).when(g.isin(*FEMALE), 2).otherwise(0)
    made = users.withColumns({"sex": sex, "n_interests": F.size(F.array_distinct(F.coalesce("interests", F.array().cast("array<string>"))))})
    return made if words is None else made.withColumns(sets.masks(F.col("interests"), words, "interest_bits"))


def complementarity(a: str, b: str, words: Sequence[str] | None) -> Column:
    """Of ``_prepared`` sides: opposite genders, interests of which half are shared, and ages near each other."""
    opposite = F.col(f"{a}.sex") + F.col(f"{b}.sex") == 3
    n, m = F.col(f"{a}.n_interests"), F.col(f"{b}.n_interests")
    both = F.coalesce(F.size(F.array_intersect(f"{a}.interests", f"{b}.interests")), F.lit(0)) if words is None else sets.common(a, b, "interest_bits", words)
    shared = F.when((n > 0) & (m > 0), both / (n + m - both))
    interests = F.coalesce(1 - 2 * F.abs(0.5 - shared), F.lit(0.0))
    gap = F.abs(F.col(f"{a}.age") - F.col(f"{b}.age"))
    ages = F.coalesce(F.when(gap <= 15, 1 - gap / 15), F.lit(0.0))
    return 0.4 * F.when(opposite & (F.col(f"{a}.sex") != F.col(f"{b}.sex")), 1.0).otherwise(0.0) + 0.4 * interests + 0.2 * ages


def pairs(users: DataFrame, asked: DataFrame, key: str = "key", rows: int = 2000) -> DataFrame:
    """Each asked user with every other, as columns ``a`` and ``b``."""
    return block_pairs(asked, users, key, key, rows).where(F.col(f"a.{key}") != F.col(f"b.{key}"))


def common_interests(users: DataFrame, key: str = "key", rows: int = 2000) -> DataFrame:
    """``a, b, common``: what each user has in common with every other, in order; made once for users of equal interests, whose keys meet in blocks."""
    of = users.select(key, F.array_sort(F.array_distinct("interests")).alias("interests"))
    # Written, so that a number stays that of its kind.
    kinds = written(of.select("interests").distinct().withColumn("kind", F.monotonically_increasing_id()), "kinds")
    met = block_pairs(kinds, kinds, "kind", "kind").select(F.col("a.kind").alias("a"), F.col("b.kind").alias("b"), F.array_sort(F.array_intersect("a.interests", "b.interests")).alias("common"))
    named = kinds.withColumnRenamed("interests", "__interests")
    members = of.join(named, F.col("interests").eqNullSafe(F.col("__interests"))).select("kind", key)
    return member_pairs(met, members, "a", "b", "kind", key, rows).where("a <> b")


def scored_pairs(users: DataFrame, asked: DataFrame, key: str = "key") -> DataFrame:
    """Scores of each asked user with every other; of users with their ``items`` (``with_history``), pairs have these as well."""
    more = ("interests", *(c for c in ("items",) if c in users.columns and c in asked.columns))
    return _scored(users, asked, key, more).withColumn("common", F.array_intersect("a.interests", "b.interests"))


def _scored(users: DataFrame, asked: DataFrame, key: str, more: Sequence[str] = ()) -> DataFrame:
    """Pairs of keys, what scores read and ``more`` columns, with their scores."""
    mine, theirs, words, width = _narrow(users, asked, key, more)
    return pairs(theirs, mine, key).withColumns({
        "similarity": similarity("a", "b", width), "complementarity": complementarity("a", "b", words), "personality": personality("a", "b"),
    })


def _narrow(users: DataFrame, asked: DataFrame, key: str, more: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, Sequence[str] | None, int | None]:
    """Both sides, the asked one first, with what scores read, as rows that meet many others are narrow; the words and numbers there are."""
    words, width = sets.vocabulary("interests", users, asked), _width(users)

    def narrow(df: DataFrame) -> DataFrame:
        made = _prepared(df, words)
        bits = [c for c in made.columns if c.startswith("interest_bits")] or ["interests"]
        return made.select(*dict.fromkeys((key, "z", "norm", "sex", "age", "n_interests", *TRAITS, *bits, *more)))

    return narrow(asked), narrow(users), words, width


def potential_matches(
    users: DataFrame, asked: DataFrame, top_k: int = 10, least_similarity: float = 0.3, least_complementarity: float = 0.3, key: str = "key", gender: str | None = None,
) -> DataFrame:
    """Each asked user's best matches, of one ``gender`` if given, above both thresholds, by 0.4 similarity and 0.6 complementarity."""
    pool = users.where(F.lower("gender") == gender.lower()) if gender else users
    mine, theirs, words, width = _narrow(pool, asked, key)

    def made(both: DataFrame) -> DataFrame:
        scored = both.where(F.col(f"a.{key}") != F.col(f"b.{key}")).withColumns({"similarity": similarity("a", "b", width), "complementarity": complementarity("a", "b", words)})
        keys = (F.col(f"{side}.{key}").alias(f"{side}_key") for side in ("a", "b"))
        narrow = scored.select(*keys, "similarity", "complementarity", *(billionths(F.col(n)).alias(c) for n, c in (("similarity", "s"), ("complementarity", "c"))), "__least", "__last")
        # Rows come out of an array, so that thresholds and bounds stay behind the scores: as a filter they would be evaluated in the join once more.
        fine = (F.col("s") >= billionths(F.lit(least_similarity))) & (F.col("c") >= billionths(F.lit(least_complementarity)))
        rows = narrow.select("*", F.explode(F.when(fine, F.array((0.4 * F.col("s") + 0.6 * F.col("c")) / 1e9))).alias("match_score"))
        return rows.drop("s", "c").withColumn("points", billionths(F.col("match_score")))

    found = best_pairs(mine, theirs, key, key, made, top_k, "a_key", "b_key")
    sides = (F.struct(F.col(f"{side}_key").alias(key)).alias(side) for side in ("a", "b"))
    return found.select(*sides, "similarity", "complementarity", "match_score", "rank")


def with_history(users: DataFrame, history: DataFrame, key: str = "key") -> DataFrame:
    """``users`` with the ``items`` of their history (user, items), so that pairs of them are not shuffled for these; null where there are none."""
    return users.join(history.select(F.col("user").alias("__user"), "items"), F.col(key) == F.col("__user"), "left").drop("__user")


def compatibility(scored: DataFrame, history: DataFrame | None = None, key: str = "key") -> DataFrame:
    """Overall compatibility of scored pairs, its level and type. Their histories (user, items) are joined to few pairs; without, pairs have their own."""
    rows, ia, ib = scored, F.col("a.items") if history is None else F.col("ia"), F.col("b.items") if history is None else F.col("ib")
    if history is not None:
        ha, hb = history.select(F.col("user").alias("ua"), F.col("items").alias("ia")), history.select(F.col("user").alias("ub"), F.col("items").alias("ib"))
        rows = scored.join(ha, F.col(f"a.{key}") == F.col("ua"), "left").join(hb, F.col(f"b.{key}") == F.col("ub"), "left")
    # Items are distinct, so the union's size is known.
    both, sizes = F.size(F.array_intersect(ia, ib)), F.size(ia) + F.size(ib)
    overlap = F.coalesce(F.when(ia.isNotNull() & ib.isNotNull() & (sizes > 0), both / (sizes - both)), F.lit(0.0))
    total = F.round(0.3 * F.col("similarity") + 0.4 * F.col("complementarity") + 0.15 * F.size("common") / 10 + 0.15 * overlap, 9)
    kind = F.when(F.round("similarity", 9) > F.round("complementarity", 9), "朋友型").when(F.round("similarity", 9) < F.round("complementarity", 9), "互补型").otherwise("平衡型")
    return rows.withColumns({
        "overlap": overlap, "compatibility": F.least(F.lit(1.0), total), "level": F.when(total >= 0.7, "高").when(total >= 0.4, "中").otherwise("低"), "kind": kind,
    })


def history(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("user").agg(F.collect_set("item_id").alias("items"))


def feature_similarity(rows: DataFrame, asked: DataFrame, key: str, numbers: Sequence[str]) -> DataFrame:
    """``a, b, sim``: cosine of the standardised numbers of each asked row with every other."""
    z = standardized(rows, numbers).select(key, "z", "norm")
    width = _width(z)
    both = block_pairs(z.join(asked.select(key), key, "left_semi"), z, key, key).where(F.col(f"a.{key}") != F.col(f"b.{key}"))
    return both.select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), _likeness("a", "b", width).alias("sim"))


def numeric_columns(rows: DataFrame, apart: Sequence[str]) -> list[str]:
    """The columns that make a feature vector, in order of their names: numbers and truth values, without those that name a row."""
    return sorted(f.name for f in rows.schema.fields if f.name not in apart and isinstance(f.dataType, (T.NumericType, T.BooleanType)))


def pair_cf(items: DataFrame, seen: DataFrame, numbers: Sequence[str]) -> DataFrame:
    """``item_id, cf``: the largest cosine of each unseen item's standardised numbers with an item that either of two users knows."""
    own, known = standardized(items, numbers).select("item_id", "z", "norm"), seen.select("item_id").distinct()
    both = block_pairs(own.join(known, "item_id", "left_anti"), own.join(known, "item_id", "left_semi"), "item_id", "item_id")
    return both.groupBy(F.col("a.item_id").alias("item_id")).agg(F.max(_likeness("a", "b", _width(own))).alias("cf"))


def recommend_pair(a: dict, b: dict, items: DataFrame, seen: DataFrame, top_k: int = 10, item_type: str | None = None, similar: DataFrame | None = None) -> DataFrame:
    """Items that neither of two users knows, with ``pair_score``, ``sources`` and ``reason``.

    The score: the share of tags among the interests that both have (0.5), the largest likeness to a known item (0.3, if ``similar`` has
    ``pair_cf``) and the target profile (0.2): gender, ages of both or their mean, and how well it suits couples. ``a`` is the first user and ``b``
    the second; a null age is 0. ``seen`` holds their items. An item that none of the three finds is left out.
    """
    common = sorted({*a["interests"]} & {*b["interests"]})
    pool = items.join(seen.select("item_id").distinct(), "item_id", "left_anti")
    pool = pool.where(F.col("type") == item_type) if item_type else pool
    liked = F.size(F.filter("tags", lambda t: t.isin(common or [""]))) / F.greatest(F.size("tags"), F.lit(1)) if common else F.lit(0.0)
    # A target of one gender asks for a first user of it and a second one of the other.
    genders = (a["gender"] or "").lower(), (b["gender"] or "").lower()
    fits = ["both"] + ["male"] * (genders[0] in MALE and genders[1] in FEMALE) + ["female"] * (genders[0] in FEMALE and genders[1] in MALE)
    gender = F.when(F.coalesce("target_gender", F.lit("")) == "", 0.5).when(F.col("target_gender").isin(fits), 1.0).otherwise(0.0)
    ages = (a["age"] or 0), (b["age"] or 0)
    low, high = F.coalesce("target_age_min", F.lit(0)), F.coalesce("target_age_max", F.lit(0))
    within = lambda x: F.lit(x).between(low, high)
    age = F.when((low == 0) | (high == 0), 0.5).when(within(ages[0]) & within(ages[1]), 1.0).when(within(sum(ages) / 2), 0.7).otherwise(0.0)
    profile = 0.3 * gender + 0.3 * age + 0.4 * F.coalesce("couples_score", F.lit(0.0))
    pool = pool.join(similar, "item_id", "left") if similar is not None else pool.withColumn("cf", F.lit(None).cast("double"))
    near = F.coalesce("cf", F.lit(0.0))
    pool = pool.where((liked > 0) | F.col("cf").isNotNull() | (profile > 0))
    best = pool.withColumn("pair_score", F.round(0.5 * liked + 0.3 * near + 0.2 * profile, 6)).orderBy(F.desc("pair_score"), "item_id").limit(top_k)
    found = [F.when(liked > 0, "common_interests"), F.when(F.col("cf").isNotNull(), "collaborative_filtering"), F.when(profile > 0, "user_profile")]
    shared = F.lit(f"基于你们共同的{'/'.join(common[:2])}兴趣" if common else None).cast("string")
    couples = F.when(F.col("couples_score") > 0.7, "特别适合情侣/伴侣共同体验").when(F.col("couples_score") > 0.4, "适合两人一起参与")
    says = F.slice(F.array_compact(F.array(F.when(liked > 0, shared), F.when(F.col("cf").isNotNull(), "与你们之前喜欢的内容相似"), F.when(profile > 0, couples))), 1, 2)
    name = F.coalesce("name", F.lit("此项目")) if "name" in items.columns else F.lit("此项目")
    reason = F.when(F.size(says) == 0, F.concat(F.lit("推荐"), name, F.lit("，可能适合你们共同体验"))).otherwise(F.concat(F.lit("推荐"), name, F.lit("，"), F.array_join(says, "，并且")))
    return best.withColumns({"sources": F.array_compact(F.array(*found)), "reason": reason})


def with_details(found: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``found`` with the whole row of its ``key`` as ``details``; null where there is none."""
    details = rows.select(F.col(key).alias("__key"), F.struct(*rows.columns).alias("details"))
    return found.join(details, F.col(key) == F.col("__key"), "left").drop("__key")


def dashboard(compatible: DataFrame, top: DataFrame, types: dict[str, str], key: str = "key") -> DataFrame:
    """One row of a pair: ``compatible`` (its ``compatibility``) with the best of its few items ``top`` by type, and the first of all."""
    first = lambda cond: F.max_by(F.when(cond, F.col("item_id")), F.when(cond, F.struct("pair_score", (-F.col("item_id")).alias("n"))))
    best = top.agg(*(first(F.col("type") == t).alias(name) for name, t in types.items()), first(F.lit(True)).alias("first"))  # one row
    return compatible.crossJoin(F.broadcast(best)).select(
        F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), F.round("compatibility", 6).alias("compatibility"), "level", "kind", F.round("similarity", 6).alias("similarity"),
        F.round("complementarity", 6).alias("complementarity"), F.array_join(F.sort_array("common"), "|").alias("common"), F.size("common").cast("long").alias("common_count"), F.round("overlap", 6).alias("overlap"), *types, "first",
    )
