"""Offline evaluation of rankings: metrics at cutoffs, coverage of routes, rank fusion, samples and summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("precision", "recall", "rr", "ndcg", "grade3_hit")


def metrics_at(ranking: DataFrame, qrels: DataFrame, cutoffs: Sequence[int], threshold: int = 1) -> DataFrame:
    """Per case, route and cutoff: precision, recall, reciprocal rank, graded nDCG and grade-3 hit; null without relevant documents.

    ``complete`` tells whether the route returned as many as the cutoff.
    """
    ks = ranking.sparkSession.createDataFrame([(k,) for k in cutoffs], "k int")
    judged = ranking.join(qrels, ["case_id", "source_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    ideal_rank = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("grade"), "source_id"))
    ideal = qrels.where("grade > 0").withColumn("r", ideal_rank)
    totals = qrels.groupBy("case_id").agg(F.count_if(F.col("grade") >= threshold).alias("relevant"), F.count_if(F.col("grade") == 3).alias("grade3"))
    best = ideal.crossJoin(F.broadcast(ks)).where(F.col("r") <= F.col("k")).groupBy("case_id", "k").agg(F.sum((F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("r") + 1)).alias("ideal"))
    hit = F.col("grade") >= threshold
    at = (
        judged.crossJoin(F.broadcast(ks)).where(F.col("rank") <= F.col("k")).groupBy("case_id", "route", "k")
        .agg(F.count_if(hit).alias("hits"), F.min(F.when(hit, F.col("rank"))).alias("first"), F.count(F.lit(1)).alias("returned"),
             F.sum(F.when(F.col("grade") > 0, (F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"), F.max((F.col("grade") == 3).cast("int")).alias("any3"))
    )
    rows = at.join(totals, "case_id", "left").join(best, ["case_id", "k"], "left")
    some = F.coalesce(F.col("relevant"), F.lit(0)) > 0
    return rows.select(
        "case_id", "route", "k", "returned", (F.col("returned") >= F.col("k")).alias("complete"), F.when(some, F.round(F.col("hits") / F.col("k"), 6)).alias("precision"),
        F.when(some, F.round(F.col("hits") / F.col("relevant"), 6)).alias("recall"), F.when(some, F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6)).alias("rr"),
        F.when(F.col("ideal") > 0, F.round(F.col("dcg") / F.col("ideal"), 6)).alias("ndcg"), F.when(F.col("grade3") > 0, F.col("any3")).alias("grade3_hit"),
    )


def union_coverage(ranking: DataFrame, qrels: DataFrame, members: Sequence[Sequence[str]], k: int, threshold: int = 1) -> DataFrame:
    """Recall of the union of several routes' first ``k``."""
    parts = []
    totals = qrels.groupBy("case_id").agg(F.count_if(F.col("grade") >= threshold).alias("relevant"))
    for names in members:
        met = ranking.where((F.col("rank") <= k) & F.col("route").isin(list(names))).select("case_id", "source_id").distinct().join(qrels, ["case_id", "source_id"], "left")
        one = met.groupBy("case_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("grade") >= threshold).alias("hits"))
        parts.append(one.join(totals, "case_id", "left").select(F.lit("+".join(names)).alias("member"), "case_id", "candidates", "hits", F.when(F.col("relevant") > 0, F.round(F.col("hits") / F.col("relevant"), 6)).alias("recall")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def grade_hits(ranking: DataFrame, qrels: DataFrame, members: Sequence[Sequence[str]], k: int, grade: int) -> DataFrame:
    """``member, hit_rate``: of the cases with a document of a grade, the share in which a union of routes finds one."""
    wanted = qrels.where(F.col("grade") == grade).select("case_id", "source_id")
    parts = []
    for names in members:
        met = ranking.where((F.col("rank") <= k) & F.col("route").isin(list(names))).select("case_id", "source_id", F.lit(1).alias("met")).distinct()
        hit = wanted.join(met, ["case_id", "source_id"], "left").groupBy("case_id").agg(F.max(F.coalesce("met", F.lit(0))).alias("hit"))
        parts.append(hit.agg(F.round(F.avg("hit"), 6).alias("hit_rate")).select(F.lit("+".join(names)).alias("member"), "hit_rate"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def overlap(ranking: DataFrame, a: str, b: str, k: int) -> DataFrame:
    """Common candidates, all candidates and their ratio for two routes."""
    flags = ranking.where((F.col("rank") <= k) & F.col("route").isin(a, b)).groupBy("case_id", "source_id").agg(F.countDistinct("route").alias("routes"))
    both = F.count_if(F.col("routes") == 2)
    return flags.groupBy("case_id").agg(both.alias("common"), F.count(F.lit(1)).alias("all"), F.round(both / F.count(F.lit(1)), 6).alias("jaccard"))


def marginal(ranking: DataFrame, qrels: DataFrame, added: str, base: Sequence[str], k: int, threshold: int = 1) -> DataFrame:
    """Relevant documents that a route adds to others."""
    top = ranking.where(F.col("rank") <= k)
    new = top.where(F.col("route") == added).select("case_id", "source_id").join(top.where(F.col("route").isin(list(base))).select("case_id", "source_id"), ["case_id", "source_id"], "left_anti")
    graded = new.join(qrels, ["case_id", "source_id"], "left")
    return graded.groupBy("case_id").agg(F.count(F.lit(1)).alias("new"), F.count_if(F.col("grade") >= threshold).alias("relevant"), F.count_if(F.col("grade") == 3).alias("grade3"))


def fuse(ranking: DataFrame, quotas: dict[str, int], budget: int) -> DataFrame:
    """Weighted rank fusion: a document's priority is its rank over its route's quota; the first places of each case fill the budget."""
    if any(q < 0 for q in quotas.values()) or sum(quotas.values()) != budget:
        raise ValueError("quotas are not negative and add up to the budget")
    order = {r: i for i, r in enumerate(quotas)}
    quota, place = F.lit(None).cast("int"), F.lit(None).cast("int")
    for r, q in quotas.items():
        quota, place = F.when(F.col("route") == r, q).otherwise(quota), F.when(F.col("route") == r, order[r]).otherwise(place)
    rows = ranking.withColumns({"quota": quota, "place": place}).where(F.col("quota") > 0).withColumn("priority", F.col("rank") / F.col("quota"))
    first = rows.groupBy("case_id", "source_id").agg(F.min(F.struct("priority", "place", "rank", "route")).alias("f")).select("case_id", "source_id", "f.*")
    n = F.row_number().over(Window.partitionBy("case_id").orderBy("priority", "place", "rank", "source_id"))
    return first.withColumn("position", n).where(F.col("position") <= budget)


def judged_ranks(ranking: DataFrame, qrels: DataFrame) -> DataFrame:
    return qrels.join(ranking.select("case_id", "source_id", "rank"), ["case_id", "source_id"], "left")


def latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    v = F.col(value)
    return rows.groupBy(by).agg(
        F.count(v).alias("n"), F.round(F.avg(v), 3).alias("mean"), F.round(F.percentile(v, F.lit(0.5)), 3).alias("p50"), F.round(F.percentile(v, F.lit(0.95)), 3).alias("p95"), F.round(F.max(v), 3).alias("most")
    )


def stratified_sample(rows: DataFrame, strata: Sequence[str], key: str, seed: str, each: int, limit: int) -> DataFrame:
    """The first rows of each stratum in a seeded order, then the first of all."""
    code = F.md5(F.concat(F.col(key), F.lit(seed)))
    n = F.row_number().over(Window.partitionBy(*strata).orderBy(code, key))
    return rows.withColumns({"code": code, "group_rank": n}).where(F.col("group_rank") <= each).orderBy("group_rank", "code").limit(limit)


def summary(cases: DataFrame) -> DataFrame:
    """One row over evaluated cases (a row each): rates, macro means over judged cases, and latencies. A null judgement counts for no rate."""
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    some = F.col("returned") > 0
    return cases.agg(
        F.count(F.lit(1)).alias("cases"), share(F.col("success")).alias("success_rate"), *(F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "rr", "ndcg")),
        F.when(F.sum("located") > 0, F.round(F.sum("geo_hits") / F.sum("located"), 6)).alias("geo_hit_rate"), share(~some).alias("no_result_rate"), share(some == F.col("expected")).alias("expectation_accuracy"),
        share(F.col("degraded")).alias("degraded_rate"), share(F.col("survived")).alias("forced_failure_success_rate"), share(F.col("stable")).alias("stability_rate"), F.round(F.avg("latency_ms"), 3).alias("latency_mean"),
        F.round(F.percentile("latency_ms", F.lit(0.5)), 3).alias("latency_p50"), F.round(F.percentile("latency_ms", F.lit(0.95)), 3).alias("latency_p95"), F.round(F.max("latency_ms"), 3).alias("latency_max"),
    )


def evaluate_cases(runs: DataFrame, qrels: DataFrame, radius_km: float, threshold: int = 1) -> DataFrame:
    """By case, over repeated runs (case_id, run, rank, source_id, distance_km, latency_ms): what the first found, and whether all agree."""
    judged = runs.join(qrels, ["case_id", "source_id"], "left")
    one = F.col("run") == 1
    near = F.col("distance_km") <= radius_km + 1e-6
    per_run = runs.groupBy("case_id", "run").agg(F.array_sort(F.collect_list(F.struct("rank", "source_id"))).alias("list"), F.max("latency_ms").alias("latency_ms"))
    same = per_run.groupBy("case_id").agg(F.count(F.lit(1)).alias("runs"), (F.size(F.collect_set("list")) == 1).alias("stable"), F.round(F.avg("latency_ms"), 6).alias("latency_ms"))
    found = judged.where(one).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("returned"), F.array_sort(F.collect_list(F.when(F.col("grade") >= threshold, F.col("rank")))).alias("relevant_ranks"), F.count("distance_km").alias("located"), F.count_if(near).alias("geo_hits"),
    )
    return found.join(same, "case_id")


def allocations(ranking: DataFrame, qrels: DataFrame, splits: dict[str, dict[str, int]], budget: int, threshold: int = 1) -> DataFrame:
    """By allocation of a budget to routes: macro recall, hit and fill rates, underfilled cases, relevant hits, and the mean share of each route."""
    totals = qrels.where(F.col("grade") >= threshold).groupBy("case_id").agg(F.count(F.lit(1)).alias("relevant"))
    out = None
    for name, quotas in splits.items():
        fused = fuse(ranking, quotas, budget).join(qrels, ["case_id", "source_id"], "left")
        each = [F.count_if(F.col("route") == r).alias(f"n_{r}") for r in quotas]
        per = fused.groupBy("case_id").agg(F.count(F.lit(1)).alias("filled"), F.count_if(F.col("grade") >= threshold).alias("hits"), *each).join(totals, "case_id", "left")
        one = per.agg(
            F.count(F.lit(1)).alias("cases"), F.round(F.avg(F.col("hits") / F.col("relevant")), 6).alias("recall"), F.round(F.avg(F.when(F.col("relevant") > 0, (F.col("hits") > 0).cast("double"))), 6).alias("hit_rate"),
            F.round(F.avg(F.col("filled") / budget), 6).alias("fill_rate"), F.count_if(F.col("filled") < budget).alias("underfilled"), F.sum("hits").alias("hits"), *(F.round(F.avg(f"n_{r}"), 6).alias(f"mean_{r}") for r in quotas),
        ).select(F.lit(name).alias("allocation"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def parse_allocation(text: str, budget: int, routes: Sequence[str] = ("freshness", "lexical", "semantic")) -> tuple[str, dict[str, int]]:
    """The name and quotas of an allocation such as 100,50,50."""
    try:
        quotas = [int(x) for x in text.split(",")]
    except ValueError as e:
        raise ValueError(f"an allocation is numbers and commas, not {text!r}") from e
    if len(quotas) != len(routes) or min(quotas) < 0 or sum(quotas) != budget:
        raise ValueError(f"an allocation has {len(routes)} quotas that are not negative and add up to {budget}")
    return "_".join(f"{r[0]}{q}" for r, q in zip(routes, quotas, strict=True)), dict(zip(routes, quotas, strict=True))


def settings(values: Sequence[int], most: int) -> list[int]:
    """Distinct positive numbers of at most ``most`` in order."""
    found = sorted(set(values))
    if not found or any(isinstance(v, bool) or not isinstance(v, int) or not 1 <= v <= most for v in found):
        raise ValueError(f"settings are whole numbers from 1 to {most}")
    return found


def draft_requests(drafts: DataFrame, radius_km: float = 20.0) -> DataFrame:
    """Drafted queries as requests: a place only where the draft is about one, a category only where it is about that."""
    place, kind = F.col("query_type") == "geo_intent", F.col("query_type") == "category_intent"
    drafts = drafts if "district" in drafts.columns else drafts.withColumn("district", F.lit(None).cast("string"))
    return drafts.select(
        "draft_id", "query", F.when(kind, F.col("category")).alias("category"), *(F.when(place, F.col(c)).alias(c) for c in ("city", "district", "latitude", "longitude")),
        F.when(place & F.col("latitude").isNotNull(), F.lit(float(radius_km))).alias("radius_km"),
    )


def with_anchors(found: DataFrame, anchors: DataFrame, by: str) -> DataFrame:
    """Found rows (``by``, source_id, rank) and, without a rank, each anchor (``by``, source_id) that is not among them.

    Each ``by`` has exactly one anchor: more, or none for a found one, is an error.
    """
    counted = anchors.groupBy(by).agg(F.count("source_id").alias("n"))
    wrong = counted.where("n <> 1").unionByName(found.select(by).distinct().join(counted, by, "left_anti").withColumn("n", F.lit(0).cast("long"))).limit(5).collect()
    if wrong:
        raise ValueError(f"not one anchor each: {[(r[by], r['n']) for r in wrong]}")
    return found.unionByName(anchors.join(found.select(by, "source_id"), [by, "source_id"], "left_anti").withColumn("rank", F.lit(None).cast(found.schema["rank"].dataType)))


GRADES = (0, 1, 2, 3)


def cases_of_drafts(drafts: DataFrame, judgments: DataFrame, threshold: int = 2, top_k: int = 10, recall_k: int = 200, radius_km: float = 20.0) -> DataFrame:
    """Evaluation cases from drafted queries and their reviewed candidates, ``relevance`` as pairs in order of the source id.

    ``drafts``: draft_id, query, query_type, category, city, latitude, longitude. ``judgments``: draft_id, source_id, grade, is_anchor, reviewed. No
    drafts, a draft without candidates, an unreviewed or ungraded candidate, not one anchor, no grade of at least ``threshold``, or
    a draft about a place without one is an error that names a few of the drafts.
    """
    fit = drafts.where(F.trim("query") != "")
    if fit.isEmpty():
        raise ValueError("there are no drafted queries")
    per = judgments.groupBy("draft_id").agg(
        F.count(F.lit(1)).alias("judged"), F.count_if(F.coalesce(~F.col("reviewed"), F.lit(True))).alias("open"), F.count_if(F.coalesce(~F.col("grade").isin(*GRADES), F.lit(True))).alias("ungraded"),
        F.count_if("is_anchor").alias("anchors"), F.max("grade").alias("best"), F.array_sort(F.collect_list(F.struct("source_id", "grade"))).alias("relevance"),
    )
    both = fit.join(per, "draft_id", "left")
    place = F.col("query_type") == "geo_intent"
    wrong = {
        "has no judged candidates": F.col("judged").isNull(), "has candidates that are not reviewed": F.col("open") > 0, "has candidates without a grade": F.col("ungraded") > 0, "has not one anchor": F.col("anchors") != 1,
        "has no relevant candidate": F.col("best") < threshold, "is about a place and has none": place & (F.col("latitude").isNull() | F.col("longitude").isNull()),
    }
    why = F.coalesce(*[F.when(c, F.lit(w)) for w, c in wrong.items()])
    found = both.withColumn("why", why).where("why IS NOT NULL").select("draft_id", "why").orderBy("draft_id").limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r.draft_id} {r.why}" for r in found))
    asked = draft_requests(fit, radius_km)
    return asked.join(per.select("draft_id", "relevance"), "draft_id").withColumns({"top_k": F.lit(top_k), "recall_k": F.lit(recall_k), "binary_relevance_threshold": F.lit(threshold)})


def analysis(ranking: DataFrame, qrels: DataFrame, members: Sequence[Sequence[str]], cutoffs: Sequence[int], threshold: int = 1) -> DataFrame:
    """``case_id, member, k, metric, value``: every union of routes at every cutoff, case by case, in long form."""
    parts = []
    for k in cutoffs:
        one = union_coverage(ranking, qrels, members, k, threshold).withColumn("k", F.lit(k))
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("candidates", "hits", "recall")])
        parts.append(one.select("case_id", "member", "k", F.explode(pairs).alias("p")).select("case_id", "member", "k", "p.*"))
    return reduce(lambda a, b: a.unionByName(b), parts)
