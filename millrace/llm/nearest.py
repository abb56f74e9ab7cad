"""Approximate nearest neighbours with balanced posting lists.

Fit: a bounded sample of the vectors is clustered on the driver into lists of even size (an overfull cluster gives half of
its members to the emptiest). Every vector then goes to its nearest centroid's list, and a vector near a border also to
other lists whose centroids are at most ``(1 + spread)`` times as far, up to ``copies``. Queries find their lists in
memory by a best-first walk on a neighbour graph of the centroids; lists whose centroid is more than ``ratio`` times as
far as the nearest one (or as a typical vector's nearest one, if that is farther) are left out. How many lists a query may
probe is calibrated to ``recall`` with a sample of the queries, against brute force over the sample of the rows, band by
band of a query's distance from its nearest centroid: queries need not be spread as the rows are, and those far from all
rows may need many lists. A band that the ratio would keep from its recall has none. A query that finds fewer than ``k``
rows in its lists asks all lists. Distances are exact, in double precision on the original vectors.

Scale: the centroids number at most ``max_lists``, so what is sent to tasks has a fixed size. Lists are not: a list with
many vectors is dealt out over blocks of about ``block_rows``, one asked by many queries over blocks of
``block_queries``, and every pair of blocks is a task's group, so a list that holds a third of all rows is many groups.

Defined cases: vectors that are null, empty, zero, or that hold null or non-finite components take no part, as base or as
query; vectors of different lengths have no distance, so each length is searched by itself; ties go to the smaller id;
with fewer candidates than ``k`` all come back; rows that repeat an id with one vector count once, with several vectors by
the nearest; null ids take no part; an empty table gives no rows; columns other than id and vector are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.scratch import written


#: Rows whose distances to all centroids are held at once.
_CHUNK = 1024


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None] - 2 * (x @ c.T), 0)


def clusters(x: np.ndarray, k: int, *, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Centroids of ``k`` lists of even size."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for turn in range(rounds):
        own = np.concatenate([_squared(x[i : i + _CHUNK], centres).argmin(axis=1) for i in range(0, len(x), _CHUNK)])
        count = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        if turn < rounds - 2:
            full, empty = np.argsort(-count), np.argsort(count)
            for a, b in zip(full[: k // 4], empty[: k // 4], strict=True):
                if count[a] > 2 * len(x) / k and count[b] < len(x) / k / 2:
                    centres[b] = x[rng.choice(np.flatnonzero(own == a))]
    return centres


@dataclass
class Index:
    origin: np.ndarray  # the sample's mean, from which centroids are measured
    centres: np.ndarray
    graph: np.ndarray  # neighbours of each centroid, nearest first, then a few far ones
    spread: float
    copies: int
    edges: np.ndarray  # bounds of the bands: distances of a query from its nearest centroid
    probes: list[int]  # the lists that a query may ask, by band
    ratios: list[float]
    typical: float  # median distance of a sample row from its nearest centroid

    def walk(self, q: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """Centroids found by best-first search from centroid 0, and their distances, nearest first."""
        wide = max(2 * wanted, 32)
        q = q - self.origin
        far = lambda i: np.sqrt(((self.centres[i] - q) ** 2).sum(axis=1))
        seen = np.zeros(len(self.centres), bool)
        seen[0] = True
        d = float(far(np.array([0]))[0])
        open_, best = [(d, 0)], [(-d, 0)]
        while open_:
            d, i = heapq.heappop(open_)
            if len(best) >= wide and d > -best[0][0]:
                break
            new = self.graph[i][~seen[self.graph[i]]]
            seen[new] = True
            for e, j in zip(far(new).tolist() if len(new) else [], new.tolist(), strict=True):
                if len(best) < wide or e < -best[0][0]:
                    heapq.heappush(open_, (e, j))
                    heapq.heappush(best, (-e, j))
                    if len(best) > wide:
                        heapq.heappop(best)
        found = sorted((-d, i) for d, i in best)[:wanted]
        return np.array([i for _, i in found]), np.array([d for d, _ in found])

    def lists_of_query(self, q: np.ndarray) -> list[int]:
        lists, d = self.walk(q, min(self.probes))
        band = int(np.searchsorted(self.edges, d[0]))
        if self.probes[band] > len(lists):
            lists, d = self.walk(q, self.probes[band])
        return lists[d <= self.limit(d, self.ratios[band])].tolist()

    def limit(self, d: np.ndarray, ratio: float) -> float:
        return ratio * max(float(d[0]), self.typical)

    def lists_of(self, x: np.ndarray) -> list[list[int]]:
        """The lists that hold each vector."""
        d = np.sqrt(_squared(x - self.origin, self.centres))
        near = np.argsort(d, axis=1, kind="stable")[:, : self.copies]
        far = np.take_along_axis(d, near, 1)
        return [n[f <= (1 + self.spread) * f[0]].tolist() for n, f in zip(near, far, strict=True)]


#: Queries of the calibration in a band, at least, and bands at most.
_BAND_QUERIES, _BANDS = 50, 8


def build(
    sample: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, rows: int, *,
    list_rows: int = 200, max_lists: int = 4096, copies: int = 4, spread: float = 0.15, ratio: float = 1.5, recall: float = 0.97, k: int = 10,
) -> Index:
    """Fit centroids, their graph and the number of probes on samples of a table of ``rows`` vectors and of its queries."""
    origin = sample.mean(axis=0, dtype=np.float64)
    sample, queries = sample - origin, queries - origin
    # The queries of the calibration are kept from the clustering, where enough other rows are left.
    other = ~np.isin(ids, query_ids)
    seen = sample[other] if 2 * other.sum() > len(sample) else sample
    number = int(max(1, min(max_lists, rows // list_rows, len(seen) // 4 or 1)))
    centres = clusters(seen, number)
    near = np.concatenate([np.argsort(_squared(centres[i : i + _CHUNK], centres), axis=1, kind="stable")[:, 1:25] for i in range(0, number, _CHUNK)])
    rng = np.random.default_rng(5)
    graph = np.concatenate((near, rng.integers(0, number, (number, 4))), axis=1)
    # A chain over all centroids keeps the graph connected.
    graph = np.concatenate((graph, ((np.arange(number) + 1) % number)[:, None]), axis=1)
    typical = float(np.median(np.concatenate([np.sqrt(_squared(sample[i : i + _CHUNK], centres).min(axis=1)) for i in range(0, len(sample), _CHUNK)])))
    index = Index(np.zeros_like(origin), centres, graph, spread, copies, np.arange(0), [number], [np.inf], typical)
    if len(queries) and number > 1:
        _calibrate(index, sample, ids, queries, query_ids, recall, ratio, k)
    index.origin = origin
    return index


def _calibrate(index: Index, sample: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, recall: float, ratio: float, k: int) -> None:
    """The fewest probes with which the queries of each band find ``recall`` of their brute-force neighbours in the sample."""
    number, most = len(index.centres), min(k, len(sample))
    member = np.full((len(sample), index.copies), -1)
    for i in range(0, len(sample), _CHUNK):
        for j, lists in enumerate(index.lists_of(sample[i : i + _CHUNK])):
            member[i + j, : len(lists)] = lists
    nearest, need, bounded = np.empty(len(queries)), np.full((len(queries), most), number + 1), np.full((len(queries), most), number + 1)
    for at in range(0, len(queries), 64):
        squared = _squared(queries[at : at + 64], sample)
        squared[query_ids[at : at + 64, None] == ids[None]] = np.inf
        for i, d in enumerate(squared, at):
            true = np.argpartition(d, most - 1)[:most]
            true = true[np.isfinite(d[true])]
            lists, far = index.walk(queries[i], number)
            place = np.full(number + 1, number + 1)  # not reached; also that of no list, -1
            place[lists] = np.arange(len(lists)) + 1
            need[i, : len(true)] = place[member[true]].min(axis=1)
            place[lists[far > index.limit(far, ratio)]] = number + 1
            bounded[i, : len(true)] = place[member[true]].min(axis=1)
            need[i, len(true) :] = bounded[i, len(true) :] = 0
            nearest[i] = far[0]
    bands = max(1, min(_BANDS, len(queries) // _BAND_QUERIES))
    index.edges = np.quantile(nearest, np.arange(1, bands) / bands)
    band = np.searchsorted(index.edges, nearest)
    index.probes, index.ratios = [], []
    for b in range(bands):
        for places, limit in ((bounded, ratio), (need, np.inf)):
            places = places[band == b]
            count = np.bincount(places[places > 0], minlength=number + 2)
            enough = np.flatnonzero(np.cumsum(count[1:-1]) >= recall * count.sum())
            if len(enough):
                break
        index.probes.append(int(enough[0]) + 1 if len(enough) else number)
        index.ratios.append(limit)


def _valid(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _post(batch_iter: Iterator[pa.RecordBatch], index: Index, dim: int) -> Iterator[pa.RecordBatch]:
    for whole in batch_iter:
        for at in range(0, len(whole), 1024):
            batch = whole.slice(at, 1024)
            x = _vectors(batch, dim)
            lists = index.lists_of(x)
            count = np.array([len(y) for y in lists])
            ids, bodies = np.repeat(batch.column("id").to_numpy(), count), [v.tobytes() for v in x]
            yield pa.RecordBatch.from_pydict({
                "list": pa.array(np.concatenate([np.array(y) for y in lists]), pa.int32()), "id": pa.array(ids, pa.int64()),
                "v": pa.array([bodies[i] for i in np.repeat(np.arange(len(x)), count)], pa.binary()),
            })


def _ask(batch_iter: Iterator[pa.RecordBatch], index: Index, dim: int, every: bool = False) -> Iterator[pa.RecordBatch]:
    """The lists that each query asks: those of the index, or ``every`` one."""
    whole_index = range(len(index.centres))
    for whole in batch_iter:
        for at in range(0, len(whole), 256):
            batch = whole.slice(at, 256)
            x, ids = _vectors(batch, dim), batch.column("id").to_pylist()
            rows = [(y, i, v.tobytes()) for i, v in zip(ids, x, strict=True) for y in (whole_index if every else index.lists_of_query(v))]
            yield pa.RecordBatch.from_pydict({
                "list": pa.array([r[0] for r in rows], pa.int32()), "id": pa.array([r[1] for r in rows], pa.int64()), "v": pa.array([r[2] for r in rows], pa.binary()),
            })


def _match(base: pa.Table, asked: pa.Table, k: int, dim: int) -> pa.Table:
    """The ``k`` nearest of a block of a list to each query of a block of queries."""
    out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    if len(base) and len(asked):
        x = np.frombuffer(b"".join(base.column("v").to_pylist())).reshape(-1, dim)
        ids, own = base.column("id").to_numpy(), asked.column("id").to_numpy()
        q = np.frombuffer(b"".join(asked.column("v").to_pylist())).reshape(-1, dim)
        for i, some in enumerate(_candidates(x, q, ids, own, k)):
            exact = np.sqrt(((x[some] - q[i]) ** 2).sum(axis=1))
            # An id that comes with several vectors counts once, so more rows than k may be needed.
            order = np.lexsort((ids[some], exact))
            near = order[np.sort(np.unique(ids[some][order], return_index=True)[1])][:k]
            out["query_id"] += [int(own[i])] * len(near)
            out["vec_id"] += ids[some][near].tolist()
            out["score"] += exact[near].tolist()
    return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))


def _candidates(x: np.ndarray, q: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each query the rows that can be among the ``k`` nearest ids other than its own.

    A product of matrices gives squared distances up to an error that is bounded by the norms after centring; rows stay
    if they are within that error of the k-th. The rows that repeat an id are counted with the largest number there is of any.
    """
    centre = x.mean(axis=0)
    with np.errstate(over="ignore", invalid="ignore"):
        xc, qc = x - centre, q - centre
        xx, qq = (xc * xc).sum(axis=1), (qc * qc).sum(axis=1)
        approx = xx[None] + qq[:, None] - 2 * (qc @ xc.T)
        slack = 4 * np.finfo(float).eps * (x.shape[1] + 8) * (xx.max() + qq)
    repeats = int(np.unique(ids, return_counts=True)[1].max())
    few = min(k * repeats, len(x))
    for i in range(len(q)):
        others = ids != own[i]
        near = np.where(others, approx[i], np.inf)
        if not np.isfinite(slack[i]) or np.isnan(near).any():
            yield np.flatnonzero(others)
            continue
        edge = np.partition(near, few - 1)[few - 1]
        yield np.flatnonzero(others & (near <= edge + 2 * slack[i]))


_FOUND = "query_id long, vec_id long, score double"

#: Queries that the number of probes is calibrated with.
_CALIBRATED = 400


def search(
    base: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, sample_rows: int = 50_000,
    block_rows: int = 2048, block_queries: int = 512, **options,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest rows of ``base`` but itself, nearest first."""

    def clean(df: DataFrame) -> DataFrame:
        own = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        return own.where(F.col("id").isNotNull() & _valid(F.col("v")))

    spark, rows, asked = base.sparkSession, clean(base), clean(queries)
    blocks = (block_rows, block_queries)
    found = None
    # One row a length of vectors.
    for size in rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect():
        dim = size["dim"]
        one = _search(rows.where(F.size("v") == dim), asked.where(F.size("v") == dim), dim, size["n"], k, sample_rows, blocks, options)
        found = one if found is None else found.union(one)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, asked: DataFrame, dim: int, number: int, k: int, sample_rows: int, blocks: tuple[int, int], options: dict) -> DataFrame:
    """``_FOUND`` rows for vectors of one length: at least the ``k`` nearest that the index finds of each query."""
    # A row is drawn by the hash of its id and vector: about sample_rows of them, never more than half as many again. Where
    # rows repeat so much that the hash draws few, any rows serve.
    drawn = rows if number <= sample_rows else rows.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 20)) < int((1 << 20) * sample_rows / number) + 1)
    sample = drawn.orderBy("id").limit(sample_rows * 3 // 2).toArrow()
    if len(sample) < min(number, sample_rows) // 2:
        sample = rows.limit(sample_rows).toArrow()
    some = asked.orderBy(F.xxhash64("id", "v"), "id").limit(_CALIBRATED).toArrow()
    vectors = lambda t: t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
    index = build(vectors(sample), sample.column("id").to_numpy(), vectors(some), some.column("id").to_numpy(), number, k=k, **options)

    postings = written(rows.mapInArrow(lambda it: _post(it, index, dim), "list int, id long, v binary"), "postings")
    first = written(_nearest_in(postings, written(asked.mapInArrow(lambda it: _ask(it, index, dim), "list int, id long, v binary"), "asked"), k, dim, blocks), "found")
    full = first.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")).where(F.col("n") >= k)
    short = written(asked.join(full.select(F.col("query_id").alias("id")), "id", "left_anti"), "short")
    if short.isEmpty():
        return first
    again = written(short.mapInArrow(lambda it: _ask(it, index, dim, True), "list int, id long, v binary"), "asked")
    return first.union(_nearest_in(postings, again, k, dim, blocks))


def _nearest_in(postings: DataFrame, asked: DataFrame, k: int, dim: int, blocks: tuple[int, int]) -> DataFrame:
    """Lists and the queries that ask them meet block by block."""
    spark, (block_rows, block_queries) = postings.sparkSession, blocks
    # At most one row a list.
    n_base = {r["list"]: r["n"] for r in postings.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_asked = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    wide = [(y, -(-n_base[y] // block_rows), -(-n // block_queries)) for y, n in n_asked.items() if y in n_base]
    if not wide:
        return spark.createDataFrame([], _FOUND)
    plan = F.broadcast(spark.createDataFrame(wide, "list int, b int, q int"))
    left = postings.join(plan, "list").select(
        "list", F.pmod(F.xxhash64("id", "v"), F.col("b")).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("q"), "id", "v"
    )
    right = asked.join(plan, "list").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("b"), F.pmod(F.xxhash64("id"), F.col("q")).cast("int").alias("q"), "id", "v"
    )
    keys = ("list", "b", "q")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda x, y: _match(x, y, k, dim), _FOUND)
