"""Centroid clustering of integer vectors with bounds by group of centroids (Yinyang).

The centroids are clustered into groups once. Every vector keeps its centroid, an upper bound of the distance to it and a
lower bound for each group: of the distances to the group's centroids other than its own. When centroids move, the upper
bound grows by its centroid's move and the group bounds fall by the farthest move in the group. A vector whose upper bound
is under all group bounds stays (the global filter), also after the upper bound has been made exact; of the others, groups
above the upper bound are left out (the group filter), then centroids that their own move cannot have brought near
enough. The centroids that survive are scanned with exact integer distances. Bounds are compared strictly and rounded
outwards, so a tie is always scanned and the smaller number wins.

A round is one pass of tasks over rows of state in the shared folder, without a shuffle: each task writes the new state and
what its moved vectors change in the sums of centroids. Those changes are added up by Spark; the driver holds ``k`` centroids
and their sums. A lost executor repeats its own tasks. The round before is deleted when the next is written.

Defined cases: vectors that are null, have other than ``dim`` components, or hold null or non-finite ones take no part;
rows that repeat an id are vectors of their own; a null id takes part, and its hash sorts last; vectors of one id start in
the order of their components; with fewer vectors than ``k`` there are as many centroids as vectors; an empty table gives no rows;
a centroid without vectors stays where it is. A component beyond 2**27 after scaling is an error, as squared distances
would not fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.integer_vectors import above, below, finite, floors, packed, squares, sums_by, unpacked
from millrace.llm.scratch import discard, written

_STATE = "id long, point binary, cluster int, upper double, lower binary, n long, sums array<long>"
_FOUND = "id long, cluster int, distance long"
_FAR = np.iinfo(np.int64).max


@dataclass
class Clusters:
    """``rows``: id, cluster, distance (squared) of every vector; ``centroids``: the final ones."""

    rows: DataFrame
    centroids: np.ndarray


def grouped(centroids: np.ndarray, groups: int) -> np.ndarray:
    """The group of each centroid: a few rounds of Lloyd's algorithm over the centroids themselves."""
    x = centroids.astype(np.float64)
    middle = x[:: max(1, -(-len(x) // groups))][:groups].copy()
    for _ in range(5):
        of = ((x[:, None] - middle[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in np.unique(of):
            middle[g] = x[of == g].mean(axis=0)
    return np.unique(of, return_inverse=True)[1]


def _by_group(low: np.ndarray, own: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The least bound in each group, the own centroid's left out."""
    low = low.copy()
    low[np.arange(len(low)), own] = np.inf
    return np.stack([low[:, group == g].min(axis=1) for g in range(group.max() + 1)], axis=1)


def assign(x: np.ndarray, centroids: np.ndarray, group: np.ndarray, state: tuple | None = None, drift: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row of ``x``, its upper bound and group bounds, and how many distances were computed.

    ``state``: those of the round before; ``drift``: how far each centroid has moved since.
    """
    if state is None:
        exact = np.stack([squares(x, c) for c in centroids], axis=1)
        own = exact.argmin(axis=1)
        root = np.sqrt(exact.astype(np.float64))
        return own, above(root[np.arange(len(x)), own]), _by_group(below(root), own, group), exact.size
    own, upper, was = (y.copy() for y in state)
    upper = above(upper + drift[own])
    lower = below(was - np.array([drift[group == g].max() for g in range(group.max() + 1)]))
    # Global filter, with the bound as it is and then with the exact distance.
    rows = np.flatnonzero(~(upper < lower.min(axis=1)))
    exact = squares(x[rows], centroids[own[rows]])
    scanned = len(rows)
    upper[rows] = above(np.sqrt(exact.astype(np.float64)))
    open_ = ~(upper[rows] < lower[rows].min(axis=1))
    rows, exact = rows[open_], exact[open_]
    # Group filter, then each centroid of a group that survives by its own move.
    before, u, at = own[rows], upper[rows], np.arange(len(rows))
    low, distance = lower[rows][:, group], np.full((len(rows), len(centroids)), _FAR)
    for c in range(len(centroids)):
        g = group[c]
        left = below(was[rows, g] - drift[c])
        low[:, c] = np.maximum(low[:, c], left)
        hit = np.flatnonzero((before != c) & ~(u < lower[rows, g]) & ~(u < left))
        distance[hit, c] = squares(x[rows[hit]], centroids[c])
        low[hit, c] = below(np.sqrt(distance[hit, c].astype(np.float64)))
        scanned += len(hit)
    distance[at, before] = exact
    low[at, before] = below(np.sqrt(exact.astype(np.float64)))
    own[rows] = distance.argmin(axis=1)
    upper[rows] = above(np.sqrt(distance.min(axis=1).astype(np.float64))) if len(rows) else upper[rows]
    lower[rows] = _by_group(low, own[rows], group)
    return own, upper, lower, scanned


def _changes(x: np.ndarray, own: np.ndarray, was: np.ndarray | None) -> pa.RecordBatch:
    """What vectors that have moved change in their centroids' numbers and sums."""
    new = np.arange(len(x)) if was is None else np.flatnonzero(own != was)
    keys, signs, rows = own[new], np.ones(len(new), np.int64), x[new]
    if was is not None:
        keys, signs, rows = np.concatenate((keys, was[new])), np.concatenate((signs, -signs)), np.concatenate((rows, rows))
    there, n, sums = sums_by(keys, rows, signs)
    none = len(there)
    return pa.RecordBatch.from_pydict({
        "id": pa.nulls(none, pa.int64()), "point": pa.nulls(none, pa.binary()), "cluster": pa.array(there, pa.int32()), "upper": pa.nulls(none, pa.float64()),
        "lower": pa.nulls(none, pa.binary()), "n": pa.array(n, pa.int64()), "sums": pa.array(list(sums), pa.list_(pa.int64())),
    })


def _pass(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, group: np.ndarray, drift: np.ndarray | None, scale: int, last: bool) -> Iterator[pa.RecordBatch]:
    """One assignment over rows of vectors (the first time) or of state; ``last`` gives the result instead of state."""
    dim, groups = centroids.shape[1], int(group.max()) + 1
    for batch in batches:
        if not len(batch):
            continue
        if drift is None:
            x, was, state = floors(batch.column("v"), scale, dim), None, None
        else:
            x = unpacked(batch.column("point"), "<i4", dim).astype(np.int64)
            was = batch.column("cluster").to_numpy().astype(np.int64)
            state = was, batch.column("upper").to_numpy(), unpacked(batch.column("lower"), "<f8", groups)
        own, upper, lower, _ = assign(x, centroids, group, state, drift)
        if last:
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "cluster": pa.array(own, pa.int32()), "distance": pa.array(squares(x, centroids[own]), pa.int64())})
            continue
        yield pa.RecordBatch.from_pydict({
            "id": batch.column("id"), "point": packed(x.astype("<i4")), "cluster": pa.array(own, pa.int32()), "upper": pa.array(upper, pa.float64()),
            "lower": packed(lower.astype("<f8")), "n": pa.nulls(len(x), pa.int64()), "sums": pa.nulls(len(x), pa.list_(pa.int64())),
        })
        yield _changes(x, own, was)


def cluster(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3, groups: int | None = None,
) -> Clusters | None:
    """Lloyd's clustering of ``floor(scale * x)`` after ``rounds`` rounds, by Yinyang's bounds; None where no vector is left.

    Centroids start as the vectors whose ids have the smallest SHA-256 of ``seed:id``. ``groups``: a third of ``k`` by default.
    """
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    own = own.where((F.size("v") == dim) & finite(F.col("v")))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = own.orderBy(hashed.asc_nulls_last(), "v").limit(k).collect()  # k rows
    if not first:
        return None
    centroids = floors(pa.array([r["v"] for r in first], pa.list_(pa.float64())), scale, dim)
    group = grouped(centroids, groups or -(-k // 3))
    n, sums = [0] * len(centroids), [[0] * dim for _ in centroids]
    now, drift = own, None
    for r in range(rounds):
        state = written(now.mapInArrow(lambda it, c=centroids, d=drift: _pass(it, c, group, d, scale, False), _STATE), f"yinyang_{r}")
        if drift is not None:
            discard(now_table)
        now_table = state
        # One row a centroid.
        for row in state.where("n IS NOT NULL").groupBy("cluster").agg(F.sum("n"), *(F.sum(F.col("sums")[i]) for i in range(dim))).collect():
            n[row[0]] += row[1]
            sums[row[0]] = [a + b for a, b in zip(sums[row[0]], row[2:], strict=True)]
        moved = np.array([[s // m for s in total] if m else list(c) for m, total, c in zip(n, sums, centroids.tolist(), strict=True)], np.int64)
        drift = above(np.sqrt(squares(moved, centroids).astype(np.float64)))
        centroids, now = moved, state.where("n IS NULL").select("id", "point", "cluster", "upper", "lower")
        if not drift.any():
            break  # no centroid moves any more, so no later round changes anything
    found = now.mapInArrow(lambda it, c=centroids, d=drift: _pass(it, c, group, d, scale, True), _FOUND)
    found = written(found, "yinyang")
    if drift is not None:
        discard(now_table)
    return Clusters(found, centroids)
