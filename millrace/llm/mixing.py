"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that a document belongs to). A flow network routes
each pattern's words to source quotas; a pattern's n-th pass over its words costs more than the pass before, so
repetition is spread as evenly as the quotas allow. Each pattern's words are then taken from its documents in a seeded
order: whole passes over all of them, and a last pass that stops inside the document where the quota is met.

Neither documents nor patterns nor sources reach the driver. Targets are found by raising one level for all sources until
the shares meet the total, an aggregate a step. Sources that share documents form a component, a source that shares none
one by itself, and every component's words are routed by a flow of its own, many small components in one task. A component is
never cut: what a task holds of it is its membership patterns, not documents, at about a kilobyte each (20,000 patterns of 300
sources take 0.2 s). In the seeded order only the bucket of
hashes in which a pattern's last pass ends is sorted; it is cut to finer buckets until it holds few rows. All other rows
are decided by their bucket alone.

Defined cases: null text has size 0; a null source (or an empty membership) is a source of its own that sorts last;
documents of size 0 take 0; rows that repeat an id are documents of their own; an empty table gives no rows. Targets stop at
``max_passes`` times the words that a source can reach; the excess goes to the other sources by weight.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.components import connected
from millrace.llm.scratch import fewer, written

WORD = r"[^\x20\x09-\x0D]+"


def text_size(text: Column) -> Column:
    """The number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def route(capacity: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], max_passes: int) -> dict[tuple[int, int], int]:
    """Words that each (pattern, source) pair carries: a min-cost flow.

    Pass k of a pattern carries at most its capacity at cost k, so costs are convex in repetition. Sources are served to
    their quotas, or as far as the network reaches. A path from the source to the sink uses one pass and otherwise only
    free arcs, so it costs what its pass costs, and the shortest paths are found pass by pass: each pass opens its arcs and
    augments along shortest layers until no path is left, which needs a few searches of the network, not one a path.
    """
    n_p, n_s = len(capacity), len(quotas)
    source, sink = n_p + n_s, n_p + n_s + 1
    to: list[int] = []
    cap: list[int] = []
    adj: list[list[int]] = [[] for _ in range(n_p + n_s + 2)]

    def arc(u: int, v: int, c: int) -> int:
        for a, b, x in ((u, v, c), (v, u, 0)):
            adj[a].append(len(to))
            to.append(b)
            cap.append(x)
        return len(to) - 2

    opened = [arc(source, p, 0) for p in range(n_p)]
    carried = {(p, s): arc(p, n_p + s, max_passes * capacity[p]) for p in range(n_p) for s in members[p]}
    for s, q in enumerate(quotas):
        arc(n_p + s, sink, q)
    for _ in range(max_passes):
        for p, e in enumerate(opened):
            cap[e] += capacity[p]
        while _augment(adj, to, cap, source, sink):
            pass
    return {key: cap[e ^ 1] for key, e in carried.items() if cap[e ^ 1]}


def _augment(adj: list[list[int]], to: list[int], cap: list[int], source: int, sink: int) -> bool:
    """Fill the network of shortest paths; False if the sink cannot be reached."""
    depth = [-1] * len(adj)
    depth[source] = 0
    queue = deque([source])
    while queue and depth[sink] < 0:
        u = queue.popleft()
        for e in adj[u]:
            if cap[e] and depth[to[e]] < 0:
                depth[to[e]] = depth[u] + 1
                queue.append(to[e])
    if depth[sink] < 0:
        return False
    turn, path, u = [0] * len(adj), [], source
    while True:
        if u == sink:
            room = min(cap[e] for e in path)
            for e in path:
                cap[e] -= room
                cap[e ^ 1] += room
            # Back to the first arc that is full.
            full = next(i for i, e in enumerate(path) if not cap[e])
            u = to[path[full] ^ 1]
            del path[full:]
            continue
        while turn[u] < len(adj[u]):
            e = adj[u][turn[u]]
            if cap[e] and depth[to[e]] == depth[u] + 1:
                break
            turn[u] += 1
        if turn[u] < len(adj[u]):
            path.append(adj[u][turn[u]])
            u = to[path[-1]]
        elif path:
            u = to[path.pop() ^ 1]
            turn[u] += 1
        else:
            return True


def _numbered(sources: DataFrame, each: int = 100_000) -> DataFrame:
    """``sources`` with ``number``, its place by code points (null last): ranges are counted apart and moved on by those before."""
    parts = sources.count() // each + 1  # as many tasks, too
    # The reading partitions of a written table are no ranges, so the range is a column.
    ranged = written(sources.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("__part", F.spark_partition_id()), "sources", parts)
    # At most one row a range.
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).select("__part", before.alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranged.withColumn("__place", place).join(offsets, "__part").withColumn("number", F.col("__before") + F.col("__place")).drop("__part", "__before", "__place")


def share_out(sources: DataFrame, total: float) -> DataFrame:
    """``sources`` (weight, limit) with ``target``: shares of ``total`` by weight, each at most its limit; the excess goes to the others by weight.

    All shares are one level times their weight, or the limit: the level rises until what it gives meets the total.
    """
    level = 0.0
    while True:
        full = F.col("limit") <= level * F.col("weight")
        row = sources.agg(F.sum(F.when(full, F.col("limit"))).alias("used"), F.sum(F.when(~full, F.col("weight"))).alias("mass")).first()
        used, mass = row["used"] or 0.0, row["mass"] or 0.0
        if not mass:
            return sources.withColumn("target", F.col("limit"))
        left = total - used
        if left / mass <= level:
            return sources.withColumn("target", F.when(full, F.col("limit")).otherwise(F.least("limit", F.lit(left) * F.col("weight") / F.lit(mass))))
        level = left / mass


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    sources: Column | None = None,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    max_passes: int = 2,
    seed: str = "mix-1",
    bits: int = 12,
    edge_rows: int = 100_000,
) -> DataFrame:
    """``docs`` with ``size``, ``sources``, ``source_size``, ``target`` and ``taken`` (words taken, repeats counted).

    Columns of these names are replaced. ``sources``: an array column of the sources that a row belongs to; by default the one in ``source``. ``weights``
    repeat over the sources in code-point order, null last. ``source_size`` and ``target`` are those of the row's first
    source in that order. Buckets are split ``bits`` bits at a time until at most ``edge_rows`` rows have to be sorted.
    """
    docs = docs.drop("size", "source_size", "target", "taken", *(() if sources is not None else ("sources",)))
    of = F.array(F.col("source").cast("string")) if sources is None else sources
    names = F.array_sort(F.array_distinct(F.when(F.size(of) > 0, of).otherwise(F.array(F.lit(None).cast("string")))))
    order = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(seed)))
    placed = docs.withColumns({"sources": names, "__order": order}).withColumn("__hash", F.conv(F.substring("__order", 1, 8), 16, 10).cast("long"))
    sized = placed.withColumn("size", text_size(F.col(text_col)))

    def cells(rows: DataFrame, depth: int) -> DataFrame:
        cell = F.shiftright("__hash", 32 - depth).alias("__cell")
        return written(rows.groupBy("sources", cell).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")), "cells", fewer(docs.sparkSession))

    first = cells(sized, bits)
    plan = _plan(first.groupBy("sources").agg(F.sum("words").alias("words")), weights, share, max_passes)
    # The cell in which the last pass of each pattern ends, and the words that are left for it there.
    edges = _edges(first, plan.select("sources", "source_size", "target", "whole", F.col("rest").alias("room")))
    depth = bits
    while depth < 32 and (edges.agg(F.max("rows")).first()[0] or 0) > edge_rows:
        deeper = min(32, depth + bits)
        prefix = edges.select(F.col("sources").alias("__s"), F.col("__cell").alias("__up"))
        inside = placed.join(prefix, (F.col("sources") == F.col("__s")) & (F.shiftright("__hash", 32 - depth) == F.col("__up"))).withColumn("size", text_size(F.col(text_col)))
        # What lies before the edge is settled, so the room counts from its start.
        edges, depth = _edges(cells(inside, deeper), edges.drop("__cell", "rows")), deeper
    return _take(placed, edges, depth, id_col, text_size(F.col(text_col))).drop("__order", "__hash")


def _plan(patterns: DataFrame, weights: Sequence[float], share: float, max_passes: int, components: int = 1000) -> DataFrame:
    """``sources, source_size, target, whole, rest``: by pattern the size and target of its first source, whole passes, and words of the last pass.

    ``components``: how many components of sources share a task, on the mean.
    """
    few = fewer(patterns.sparkSession)
    patterns = written(patterns, "patterns", few)
    total = patterns.agg(F.sum("words")).first()[0] or 0
    members = patterns.select("sources", "words", F.posexplode("sources").alias("place", "source"))
    reach = members.groupBy("source").agg(F.sum("words").alias("source_size"), F.count(F.lit(1)).alias("patterns"), F.max(F.size("sources")).alias("width"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights)).cast("int") + 1)
    known = _numbered(reach).withColumns({"weight": weight, "limit": F.col("source_size").cast("double") * max_passes})
    known = written(share_out(known, share * total), "targets", few).withColumn("quota", F.floor("target"))
    theirs = known.select(F.col("source").alias("__source"), "source_size", "target", "number", "quota", "patterns", "width")
    joined = members.join(theirs, F.col("source").eqNullSafe(F.col("__source"))).withColumn("group", F.col("number"))
    if not known.where("width > 1").isEmpty():
        # Sources that share a document are one component; a source that shares none is one by itself.
        heads = joined.where("place = 0").select(F.col("sources").alias("__s"), F.col("number").alias("head"))
        links = joined.join(heads, F.col("sources") == F.col("__s")).select(F.col("number").alias("a"), F.col("head").alias("b"))
        groups = connected(links, "overlaps").withColumnRenamed("node", "number")
        joined = joined.join(groups, "number", "left").withColumn("group", F.coalesce("root", "number"))
    # Many components to a task: each is a network of its own there.
    tasks = known.count() // components + 1
    rows = joined.select(F.pmod(F.xxhash64("group"), F.lit(tasks)).alias("task"), "group", "sources", "words", "number", "quota", "place", "source_size", "target")
    done = rows.groupBy("task").applyInArrow(lambda t: _routed(t, max_passes), "sources array<string>, words long, source_size long, target double, taken long")
    passes = F.when(F.col("words") > 0, F.expr("taken DIV words")).otherwise(0)
    return written(done.select("sources", "source_size", "target", passes.alias("whole"), F.when(F.col("words") > 0, F.col("taken") % F.col("words")).otherwise(0).alias("rest")), "plan", few)


def _routed(table: pa.Table, max_passes: int) -> pa.Table:
    """``sources, words, source_size, target, taken`` of the patterns of some components, each component by a flow; a row of the table is a pattern's source."""
    # In one order, so that a repeated task takes the same flow.
    rows = sorted(table.to_pylist(), key=lambda r: (r["group"], [(x is None, x or "") for x in r["sources"]], r["place"]))
    out: dict[str, list] = {c: [] for c in ("sources", "words", "source_size", "target", "taken")}
    for _, component in groupby(rows, key=itemgetter("group")):
        heads: list[dict] = []
        members: list[list[int]] = []
        quotas: dict[int, int] = {}
        place: dict[int, int] = {}
        for row in component:
            if row["place"] == 0:
                heads.append(row)
                members.append([])
            members[-1].append(place.setdefault(row["number"], len(place)))
            quotas[row["number"]] = row["quota"]
        taken = [0] * len(heads)
        for (p, _), words in route([h["words"] for h in heads], members, list(quotas.values()), max_passes).items():
            taken[p] += words
        for head, words in zip(heads, taken, strict=True):
            for c in ("sources", "words", "source_size", "target"):
                out[c].append(head[c])
            out["taken"].append(words)
    kinds = (pa.list_(pa.string()), pa.int64(), pa.int64(), pa.float64(), pa.int64())
    return pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))


def _edges(cells: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` (with ``room`` words left for the last pass) with the cell where the room ends, that cell's rows, and the room in it.

    Where no room is left, or more than the cells hold, the edge lies behind them.
    """
    # A pattern's cells are at most two to the number of bits.
    before = F.coalesce(F.sum("words").over(Window.partitionBy("sources").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = cells.withColumn("before", before).join(plan.select(F.col("sources").alias("__s"), F.col("room").alias("__room")), F.col("sources") == F.col("__s"))
    edge = found.where((F.col("before") <= F.col("__room")) & (F.col("__room") < F.col("before") + F.col("words"))).select(F.col("__s"), "__cell", "rows", (F.col("__room") - F.col("before")).alias("__left"))
    return written(plan.join(edge, F.col("sources") == F.col("__s"), "left").withColumn("room", F.coalesce("__left", F.lit(0))).drop("__s", "__left"), "edges", fewer(plan.sparkSession))


def _take(placed: DataFrame, edges: DataFrame, depth: int, id_col: str, size: Column) -> DataFrame:
    """Rows before their pattern's edge are taken in the last pass, rows behind it are not, and rows in it as far as the room goes."""
    plan = edges.select(F.col("sources").alias("__s"), "source_size", "target", F.col("whole").alias("__whole"), F.col("__cell").alias("__edge"), F.col("room").alias("__room"))
    rows = placed.join(plan, F.col("sources") == F.col("__s")).withColumn("__at", F.shiftright("__hash", 32 - depth))
    on_edge = F.col("__edge").eqNullSafe(F.col("__at"))
    aside = rows.where(~on_edge).withColumn("size", size)
    aside = aside.withColumn("taken", F.col("size") * (F.col("__whole") + F.when(F.col("__at") < F.col("__edge"), 1).otherwise(0)))
    within = Window.partitionBy("__s").orderBy("__order", id_col, "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.where(on_edge).withColumn("size", size).withColumn("__before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    inside = inside.withColumn("taken", F.col("__whole") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("__room") - F.col("__before"))))
    return aside.unionByName(inside.drop("__before")).drop("__s", "__whole", "__edge", "__room", "__at")
