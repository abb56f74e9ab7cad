"""A vector index for cosine search: a navigable small-world graph for each shard of the vectors, kept as bytes in a table.

Vectors are dealt out to shards by their key; a task links each shard by itself, and a row of the index holds a whole shard:
keys, unit vectors, and the links of every level. On the lowest level a vector is linked to near ones that do not hide each other
(one is left out if a nearer link is closer to it than the vector itself), links go both ways, and parts that would be apart are
joined; each higher level holds a fixed share of the one below, drawn by key. A search walks down from the top and then keeps the
``ef`` nearest it has met. Shards are searched apart, queries in blocks, and the lists of all shards are merged by true cosine.

A filtered search keeps what passes. Where fewer than wanted have passed when a walk ends, it goes on from the nearest vectors
that it had set aside, until enough have passed or the shard has no more: in strict order, so the result is sorted and complete whenever
the shard has that many rows. An exact scan of the same table is there to measure recall against.

Defined cases: vectors that are null, empty, zero, of another size than asked or not finite are an error when the index is built, as
they have no direction (``usable`` says which are); null keys as well; keys that repeat are vectors of their own; fewer rows than
wanted give all of them; an empty table gives an index without shards; ties go to the larger key.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import vectors

_SHARD = "shard int, ids array<long>, units binary, starts binary, links binary"


def usable(vector: Column, size: int) -> Column:
    """True for vectors of a size with a direction."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == size) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _chosen(near: np.ndarray, alike: np.ndarray, x: np.ndarray, m: int) -> list[int]:
    """Of candidates from the nearest on, those that no chosen one is nearer to than the vector itself; then the nearest of the rest."""
    kept: list[int] = []
    for c, s in zip(near.tolist(), alike.tolist(), strict=True):
        if not kept or (x[kept] @ x[c]).max() < s:
            kept.append(c)
            if len(kept) == m:
                return kept
    return kept + [c for c in near.tolist() if c not in kept][: m - len(kept)]


def _linked(x: np.ndarray, m: int, most: int, wide: int) -> list[list[int]]:
    """Links among all rows of ``x`` (unit vectors): ``m`` chosen by each, and those back, of which ``most`` stay."""
    links: list[list[int]] = [[] for _ in x]
    for at in range(0, len(x), 512):
        alike = x[at : at + 512] @ x.T
        alike[np.arange(len(alike)), np.arange(at, at + len(alike))] = -np.inf
        few = min(wide, len(x) - 1)
        if few <= 0:
            continue
        near = np.argpartition(-alike, few - 1, axis=1)[:, :few]
        for i, (row, own) in enumerate(zip(near, alike, strict=True)):
            row = row[np.lexsort((row, -own[row]))]
            links[at + i] = _chosen(row, own[row], x, m)
    back: list[set[int]] = [set(own) for own in links]
    for i, own in enumerate(links):
        for j in own:
            back[j].add(i)
    for i, own in enumerate(back):
        every = np.array(sorted(own), np.int64)
        if len(every) > most:
            alike = x[every] @ x[i]
            order = np.lexsort((every, -alike))
            own = _chosen(every[order], alike[order], x, most)
        links[i] = list(own)
    return _joined(links, x)


def _joined(links: list[list[int]], x: np.ndarray) -> list[list[int]]:
    """Parts that no walk from row 0 reaches get a link there and back from the nearest row that one does."""
    seen = np.zeros(len(x), bool)

    def walk(start: int) -> None:
        open_ = [start]
        seen[start] = True
        while open_:
            for j in links[open_.pop()]:
                if not seen[j]:
                    seen[j] = True
                    open_.append(j)

    if len(x):
        walk(0)
    for i in range(len(x)):
        if not seen[i]:
            there = np.flatnonzero(seen)
            near = int(there[(x[there] @ x[i]).argmax()])
            links[near].append(i)
            links[i].append(near)
            walk(i)
    return links


@dataclass
class Graph:
    """A shard: keys, unit vectors, and for each level (the lowest first) its rows and their links in one array with offsets."""

    ids: np.ndarray
    units: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def build(ids: np.ndarray, units: np.ndarray, m: int = 16, wide: int = 64, share: int = 16) -> Graph:
        rows, levels = np.arange(len(ids)), []
        draw = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        while len(rows):
            # The lowest level, where the answers are, has more links.
            links = _linked(units[rows], m if levels else m + m // 2, 2 * m, wide)
            offsets = np.concatenate(([0], np.cumsum([len(own) for own in links]))).astype(np.int32)
            flat = rows[np.array([j for own in links for j in own], np.int64)] if offsets[-1] else np.zeros(0, np.int64)
            levels.append((rows.astype(np.int32), offsets, flat.astype(np.int32)))
            if len(rows) <= share:
                break
            above = rows[draw[rows] % np.uint64(share ** len(levels)) == 0]
            rows = above if len(above) < len(rows) else rows[:share]
        return Graph(ids, units, levels)

    def row(self, shard: int) -> dict:
        starts = np.concatenate([np.concatenate(([len(r), len(f)], r, o)) for r, o, f in self.levels]).astype("<i4")
        return {"shard": shard, "ids": self.ids, "units": self.units.astype("<f4").tobytes(), "starts": starts.tobytes(), "links": np.concatenate([f for *_, f in self.levels]).astype("<i4").tobytes()}

    @staticmethod
    def read(ids: np.ndarray, units: bytes, starts: bytes, links: bytes) -> Graph:
        x, s, flat = np.frombuffer(units, "<f4"), np.frombuffer(starts, "<i4"), np.frombuffer(links, "<i4")
        levels, at, link = [], 0, 0
        while at < len(s):
            n, f = int(s[at]), int(s[at + 1])
            levels.append((s[at + 2 : at + 2 + n], s[at + 2 + n : at + 3 + 2 * n], flat[link : link + f]))
            at, link = at + 3 + 2 * n, link + f
        return Graph(ids, x.reshape(len(ids), -1), levels)

    def _near(self, level: int, row: int) -> np.ndarray:
        rows, offsets, flat = self.levels[level]
        at = row if level == 0 else int(np.searchsorted(rows, row))
        return flat[offsets[at] : offsets[at + 1]]

    def _entry(self, q: np.ndarray) -> int:
        """The row where a walk down the upper levels ends."""
        now = int(self.levels[-1][0][0])
        best = float(self.units[now] @ q)
        for level in range(len(self.levels) - 1, 0, -1):
            while len(near := self._near(level, now)):
                alike = self.units[near] @ q
                if alike.max() <= best:
                    break
                now, best = int(near[alike.argmax()]), float(alike.max())
        return now

    def search(self, q: np.ndarray, k: int, ef: int, passing: np.ndarray | None = None, strict: bool = True) -> list[int]:
        """Rows near to ``q``, the ``ef`` nearest that the walk has met; of those that pass a filter, at least ``k`` if there are so many and ``strict``."""
        if not len(self.ids):
            return []
        start = self._entry(q)
        seen = np.zeros(len(self.ids), bool)
        seen[start] = True
        alike = float(self.units[start] @ q)
        open_: list[tuple[float, int]] = [(-alike, start)]
        best: list[tuple[float, int]] = [(alike, start)]
        aside: list[tuple[float, int]] = []  # met, but too far for the walk
        found: list[int] = []
        wanted = k if strict and passing is not None else 0
        while True:
            while open_:
                far, row = heapq.heappop(open_)
                if len(best) >= ef and -far < best[0][0]:
                    heapq.heappush(aside, (far, row))
                    break
                near = self._near(0, row)
                near = near[~seen[near]]
                if not len(near):
                    continue
                seen[near] = True
                for s, j in zip((self.units[near] @ q).tolist(), near.tolist(), strict=True):
                    if len(best) < ef or s > best[0][0]:
                        heapq.heappush(open_, (-s, j))
                        heapq.heappush(best, (s, j))
                        if len(best) > ef:
                            lost = heapq.heappop(best)
                            heapq.heappush(aside, (-lost[0], lost[1]))
                    else:
                        heapq.heappush(aside, (-s, j))
            found += [j for _, j in best if passing is None or passing[j]]
            if len(found) >= wanted:
                return found
            # Go on from the nearest that were set aside or are still open.
            taken = {j for _, j in best}
            for entry in open_:
                heapq.heappush(aside, entry)
            open_, best, once = [], [], set()
            while aside and len(best) < ef:
                far, j = heapq.heappop(aside)
                if j not in taken and j not in once:
                    once.add(j)
                    open_.append((far, j))
                    best.append((-far, j))
            if not best:
                return found
            heapq.heapify(open_)
            heapq.heapify(best)


def shards_of(index: DataFrame) -> int:
    return index.select(F.coalesce(F.max("shard") + 1, F.lit(0))).first()[0]


def build(rows: DataFrame, path: str, size: int, *, id_col: str = "id", vector_col: str = "embedding", shard_rows: int = 8192, m: int = 16, ef_construction: int = 64) -> DataFrame:
    """Write the index of ``rows`` to a folder and read it back; an error if a vector has no direction of ``size`` numbers."""
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    total, wrong = own.agg(F.count(F.lit(1)), F.count_if(~usable(F.col("v"), size) | F.col("id").isNull())).first()
    if wrong:
        raise ValueError(f"{wrong} of {total} rows have no key or no direction of {size} numbers")
    shards = -(-total // shard_rows)

    def shard(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, size)
        largest = np.abs(x).max(axis=1, keepdims=True)
        x = x / largest  # so that no square overflows
        units = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("<f4")
        row = Graph.build(table.column("id").to_numpy(), units, m, ef_construction).row(int(table.column("shard")[0].as_py()))
        return pa.table({"shard": pa.array([row["shard"]], pa.int32()), "ids": pa.array([row["ids"]], pa.list_(pa.int64())), **{c: pa.array([row[c]], pa.binary()) for c in ("units", "starts", "links")}})

    dealt = own.withColumn("shard", _shard(F.col("id"), shards))
    dealt.groupBy("shard").applyInArrow(shard, _SHARD).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return read(rows.sparkSession, path)


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(max(1, shards))).cast("int")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SHARD).parquet(path)


def search(index: DataFrame, queries: DataFrame, k: int, *, ef_search: int = 200, allowed: DataFrame | None = None, iterative: str = "strict_order", block: int = 256) -> DataFrame:
    """``query_id, id, score, rank``: the ``k`` nearest rows that the index finds for each of ``queries`` (query_id, vector).

    ``allowed``: the ids (id) that pass a filter; each goes to its shard. Without a filter a shard gives at most ``ef_search`` rows. ``iterative``
    ``strict_order`` walks on where the filter leaves too few, ``off`` does not. Score is the cosine by the stored unit vectors.
    """
    if not 1 <= ef_search <= 1000 or k < 1 or iterative not in ("off", "strict_order"):
        raise ValueError("ef_search is 1 to 1000, k at least 1, and a scan is off or strict_order")
    shards = shards_of(index)
    blocks = max(1, -(-queries.count() // block))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("v"))
    asked = asked.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), every(max(1, shards), "shard"), "query_id", "v", F.lit(None).cast("long").alias("id"))
    if allowed is not None:
        keys = allowed.select(F.col("id").cast("long").alias("id")).distinct()
        asked = asked.unionByName(keys.select(every(blocks, "block"), _shard(F.col("id"), shards).alias("shard"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("array<double>").alias("v"), "id"))
    filtered, strict = allowed is not None, iterative == "strict_order"

    def walk(shard: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "id": [], "score": []}
        some = asked.filter(asked.column("v").is_valid())
        if len(shard) and len(some):
            graph = Graph.read(shard.column("ids").combine_chunks().flatten().to_numpy(), *(shard.column(c)[0].as_py() for c in ("units", "starts", "links")))
            passing = np.isin(graph.ids, asked.column("id").drop_null().to_numpy()) if filtered else None
            for name, v in zip(some.column("query_id").to_pylist(), some.column("v").to_pylist(), strict=True):
                q = np.array(v)
                size = np.linalg.norm(q)
                if not np.isfinite(size) or not size or len(q) != graph.units.shape[1]:
                    continue
                q = (q / size).astype("<f4")
                rows = np.array(graph.search(q, k, ef_search, passing, strict), np.int64)
                alike = graph.units[rows].astype(float) @ q.astype(float)
                order = np.lexsort((-graph.ids[rows], -alike))[:k]
                out["query_id"] += [name] * len(order)
                out["id"] += graph.ids[rows[order]].tolist()
                out["score"] += alike[order].tolist()
        return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())]))

    copies = index.select("*", every(blocks, "block"))
    found = copies.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(walk, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def exact(rows: DataFrame, queries: DataFrame, k: int, *, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, id, score, rank``: the same by a scan of all rows, in blocks of both sides."""
    base = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    return scanned(queries.select("query_id", "vector"), base, k)


def scanned(asked: DataFrame, base: DataFrame, k: int, *, largest: bool = True, apart: bool = False) -> DataFrame:
    """``query_id, id, score, rank``: the ``k`` rows of ``base`` (id, v) with the largest cosine to each of ``asked`` (query_id, vector), ties to the ``largest``
    key or to the smallest, ``apart`` from the row of the query's own key.

    Where all vectors have a direction and one size, both sides are dealt out to blocks, and a task multiplies two of them and gives what can be among
    the best; otherwise pairs are scored one by one, as a score may be null.
    """
    from millrace.operators.blocks import best_pairs, block_keys

    double = lambda c: F.col(c).cast("array<double>")
    mine = asked.select("query_id", double("vector").alias("v")).withColumn("norm", vectors.norm(F.col("v")))
    theirs = base.select("id", double("v").alias("v")).withColumn("norm", vectors.norm(F.col("v")))
    theirs = theirs.withColumn("__tie", F.bitwise_not(F.col("id")) if largest else F.col("id"))
    size = F.coalesce(F.size("v"), F.lit(-1))
    least, most, odd = mine.select("v").unionByName(theirs.select("v")).agg(F.min(size), F.max(size), F.count_if(~usable(F.col("v"), size))).first()
    if least is not None and least == most and not odd:
        left, right, parts = block_keys(mine.select("query_id", "v"), theirs.select("id", "__tie", "v"), "query_id", "id", 2000, 8192)
        both = left.repartition(parts, "__i", "__j").groupBy("__i", "__j").cogroup(right.repartition(parts, "__i", "__j").groupBy("__i", "__j"))
        found = both.applyInArrow(lambda a, b: _best_of_blocks(a, b, k, apart), "query_id long, id long, __tie long, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "__tie"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")

    def made(pairs: DataFrame) -> DataFrame:
        some = pairs.where("a.query_id <> b.id") if apart else pairs
        score = vectors.dot(F.col("a.v"), F.col("b.v")) / (F.col("a.norm") * F.col("b.norm"))
        rows = some.select(F.col("a.query_id").alias("query_id"), F.col("b.id").alias("id"), F.col("b.__tie").alias("__tie"), "__least", "__last", F.explode(F.array(score)).alias("score"))
        return rows.withColumn("points", F.coalesce("score", F.lit(float("-inf"))))

    return best_pairs(mine, theirs, "query_id", "id", made, k, "query_id", "__tie").select("query_id", "id", "score", "rank")


def _best_of_blocks(asked: pa.Table, base: pa.Table, k: int, apart: bool, rows: int = 256) -> pa.Table:
    """The rows of one block that can be among the best ``k`` of each query of another, with their cosines."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    if len(asked) and len(base):
        base = base.sort_by("__tie")
        matrix = lambda table: table.column("v").combine_chunks().flatten().to_numpy().reshape(len(table), -1)
        q, v = matrix(asked), matrix(base)
        names, ids, ties = asked.column("query_id").to_numpy(), base.column("id").to_numpy(), base.column("__tie").to_numpy()
        # Of equal vectors, which are next to each other in this order, only the first can be among the best.
        order = np.lexsort((np.arange(len(v)), *v.T))
        new = np.append(True, (v[order][1:] != v[order][:-1]).any(axis=1))
        nth = np.arange(len(v)) - np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
        kept = np.sort(order[nth < k + apart])
        v, ids, ties = v[kept], ids[kept], ties[kept]
        sizes = np.sqrt((v * v).sum(axis=1))
        for at in range(0, len(q), rows):
            some, own = q[at : at + rows], names[at : at + rows]
            length = np.sqrt((some * some).sum(axis=1))
            near = some @ v.T / (length[:, None] * sizes)
            if apart:
                near[own[:, None] == ids] = -np.inf
            last = -np.partition(-near, k - 1, axis=1)[:, k - 1] if len(v) > k else np.full(len(some), -2.0)
            # Products of matrices differ by rounding with a row's place, sums of one row do not.
            i, j = np.nonzero(near >= np.maximum(last, -2.0)[:, None] - 1e-9)
            score = (some[i] * v[j]).sum(axis=1) / (length[i] * sizes[j])
            for c, x in zip(out, (own[i], ids[j], ties[j], score), strict=True):
                c.append(x)
    return pa.table([pa.array(np.concatenate(c) if c else [], kind) for c, kind in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "id", "__tie", "score"])


def measured(found: DataFrame, truth: DataFrame, cutoffs: list[int]) -> DataFrame:
    """By cutoff: queries, how many lists are complete, the mean recall against the true lists, and how many rows came back."""
    ks = found.sparkSession.createDataFrame([(k,) for k in cutoffs], "k int")
    at = lambda df, name: df.crossJoin(F.broadcast(ks)).where(F.col("rank") <= F.col("k")).groupBy("query_id", "k").agg(F.count(F.lit(1)).alias(name))
    hits = found.select("query_id", "id", "rank").join(truth.select("query_id", "id", F.col("rank").alias("true")), ["query_id", "id"])
    hits = hits.crossJoin(F.broadcast(ks)).where((F.col("rank") <= F.col("k")) & (F.col("true") <= F.col("k"))).groupBy("query_id", "k").agg(F.count(F.lit(1)).alias("hits"))
    rows = at(truth, "wanted").join(at(found, "returned"), ["query_id", "k"], "left").join(hits, ["query_id", "k"], "left").fillna(0, ["returned", "hits"])
    return rows.groupBy("k").agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(F.col("returned") >= F.col("wanted")).alias("complete"), F.round(F.avg(F.col("hits") / F.col("wanted")), 6).alias("recall"),
        F.min("returned").alias("least"), F.round(F.avg("returned"), 6).alias("mean"), F.max("returned").alias("most"),
    )
