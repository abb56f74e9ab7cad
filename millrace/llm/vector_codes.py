"""Vector codes: each part of a vector as the number of its nearest codebook entry, learned by Elkan's bounds.

Vectors are integers cut into equal parts; each part position has a codebook of its own. Every vector keeps, for each
part, its entry, an upper bound of the distance to it and one lower bound for each entry. After a round the bounds are shifted by
how far the entries have moved. By the triangle inequality an entry cannot be nearest, nor as near, if the upper bound is
strictly under its lower bound or under half its distance from the own entry; a part whose upper bound is under half the distance
to the nearest other entry is left alone as a whole. What is left is decided by exact integer distances, ties included: the smaller
index wins. Bounds are stored short (upper ones in 32 bits, lower ones in 16) and rounded outwards, so they stay bounds.

A round is one pass of tasks over rows of state in the shared folder, without a shuffle: each task writes the new state and
what its moved parts change in the sums of entries, which Spark adds up. The driver holds the codebooks and their sums, of fixed
size. A lost executor repeats its own tasks; the round before is deleted when the next is written.

Defined cases: vectors that are null or hold null or non-finite components take no part. All others have to be of one length that
``parts`` divides: ``length``, or by default that of the kept vector of the smallest id for which this holds; vectors of other lengths take
no part. Rows that repeat an id are vectors of their own; null ids sort last; vectors of one id start in the order of their components;
with fewer vectors than entries there are as many entries as vectors; entries that are alike, or unused, stay; an empty table gives no
rows. Other columns come along unless their names clash with the results'. A component beyond 2**27 after scaling is an error.
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

_FAR = np.iinfo(np.int64).max


@dataclass
class Codes:
    """``rows``: the vectors' columns with ``code`` (two hex digits a part) and ``error`` (squared); ``codebooks``: part, entry, component."""

    rows: DataFrame
    codebooks: np.ndarray


def shorter(upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper bounds in 32 bits, rounded up, and lower ones in 16 bits, rounded down."""
    u = upper.astype("<f4")
    u = np.where(u < upper, np.nextafter(u, np.float32(np.inf)), u).astype("<f4")
    clipped = np.clip(lower, 0, 65504)
    low = clipped.astype("<f2")
    return u, np.where(low > clipped, np.nextafter(low, np.float16(0)), low).astype("<f2")


def assign(x: np.ndarray, entries: np.ndarray, state: tuple | None = None, drift: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest entry of each part in ``x``, its upper bound, a lower bound for each entry, and how many distances were computed.

    ``state``: those of the round before; ``drift``: how far each entry has moved since.
    """
    if state is None:
        exact = np.stack([squares(x, c) for c in entries], axis=1)
        root = np.sqrt(exact.astype(np.float64))
        own = exact.argmin(axis=1)
        return own, above(root[np.arange(len(x)), own]), below(root), exact.size
    own, upper, lower = state[0].copy(), above(state[1] + drift[state[0]]), np.maximum(below(state[2] - drift), 0)
    half = below(np.sqrt(squares(entries[:, None], entries[None]).astype(np.float64)) / 2)
    np.fill_diagonal(half, np.inf)
    rows = np.flatnonzero(~(upper < half.min(axis=1)[own]))
    near = np.maximum(lower[rows], half[own[rows]])  # an entry is out if the upper bound is under this
    near[np.arange(len(rows)), own[rows]] = np.inf
    some = (~(upper[rows][:, None] < near)).any(axis=1)
    rows, near = rows[some], near[some]
    exact = squares(x[rows], entries[own[rows]])
    root = np.sqrt(exact.astype(np.float64))
    upper[rows] = above(root)
    at, c = np.nonzero(~(upper[rows][:, None] < near))
    distance = np.full((len(rows), len(entries)), _FAR)
    distance[np.arange(len(rows)), own[rows]] = exact
    lower[rows, own[rows]] = below(root)
    distance[at, c] = squares(x[rows[at]], entries[c])
    lower[rows[at], c] = below(np.sqrt(distance[at, c].astype(np.float64)))
    own[rows] = distance.argmin(axis=1)
    upper[rows] = above(np.sqrt(distance.min(axis=1).astype(np.float64))) if len(rows) else upper[rows]
    return own, upper, lower, len(rows) + len(at)


def _pass(batches: Iterator[pa.RecordBatch], books: np.ndarray, drift: np.ndarray | None, scale: int, last: bool) -> Iterator[pa.RecordBatch]:
    """One assignment of all parts, over rows of vectors (the first time) or of state; ``last`` gives codes instead of state."""
    parts, entries, width = books.shape
    for batch in batches:
        if not len(batch):
            continue
        n = len(batch)
        if drift is None:
            x = floors(batch.column("v"), scale, parts * width)
            was = None
        else:
            x = unpacked(batch.column("point"), "<i4", parts * width).astype(np.int64)
            was = unpacked(batch.column("own"), "u1", parts).astype(np.int64)
            upper, lower = unpacked(batch.column("upper"), "<f4", parts).astype(np.float64), unpacked(batch.column("lower"), "<f2", parts * entries).astype(np.float64).reshape(n, parts, entries)
        cut = x.reshape(n, parts, width)
        found = [assign(cut[:, p], books[p], None if was is None else (was[:, p], upper[:, p], lower[:, p]), None if drift is None else drift[p]) for p in range(parts)]
        own = np.stack([f[0] for f in found], axis=1)
        if last:
            error = sum(squares(cut[:, p], books[p][own[:, p]]) for p in range(parts))
            code = [row.tobytes().hex() for row in own.astype("u1")]
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["rest", "code", "error"])
            continue
        u, low = shorter(np.stack([f[1] for f in found], axis=1), np.stack([f[2] for f in found], axis=1))
        none = pa.nulls(n, pa.int32())
        yield _row(batch.column("rest"), packed(x.astype("<i4")), packed(own.astype("u1")), packed(u), packed(low.reshape(n, -1)), none, none, pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())))
        for p in range(parts):
            new = np.arange(n) if was is None else np.flatnonzero(own[:, p] != was[:, p])
            keys, signs, rows = own[new, p], np.ones(len(new), np.int64), cut[new, p]
            if was is not None:
                keys, signs, rows = np.concatenate((keys, was[new, p])), np.concatenate((signs, -signs)), np.concatenate((rows, rows))
            there, count, sums = sums_by(keys, rows, signs)
            gone = [pa.nulls(len(there), kind) for kind in (batch.column("rest").type, pa.binary(), pa.binary(), pa.binary(), pa.binary())]
            yield _row(*gone, pa.array(np.full(len(there), p), pa.int32()), pa.array(there, pa.int32()), pa.array(count, pa.int64()), pa.array(list(sums), pa.list_(pa.int64())))


def _row(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), ["rest", "point", "own", "upper", "lower", "part", "entry", "n", "sums"])


def encode(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, length: int | None = None,
) -> Codes | None:
    """The vectors' other columns with ``code`` and ``error`` after ``rounds`` rounds of learning; None where no vector is left.

    Codebooks start as the parts of the ``entries`` (at most 256) smallest ids.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part: between 1 and 256 entries")
    keep = [c for c in vectors.columns if c not in (vector_col, "code", "error")]
    own = vectors.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("rest"), F.col(f"`{id_col}`").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(finite(F.col("v")))
    own = own.where((F.size("v") > 0) & (F.size("v") % parts == 0))
    order = (F.col("id").asc_nulls_last(), F.col("v").asc())
    if length is None:
        first = own.orderBy(*order).select(F.size("v")).first()
        if first is None:
            return None
        length = first[0]
    own = own.where(F.size("v") == length)
    first = own.orderBy(*order).select("v").limit(entries).collect()  # a row an entry
    if not first:
        return None
    start = floors(pa.array([r["v"] for r in first], pa.list_(pa.float64())), scale, length)
    books = np.ascontiguousarray(start.reshape(len(first), parts, length // parts).transpose(1, 0, 2))
    n, sums = np.zeros(books.shape[:2], object), np.zeros(books.shape, object)
    kind = own.schema["rest"].dataType.simpleString()
    schema = f"rest {kind}, point binary, own binary, upper binary, lower binary, part int, entry int, n long, sums array<long>"
    now, table, drift = own.select("rest", "v"), None, None
    for r in range(rounds):
        state = written(now.mapInArrow(lambda it, c=books, d=drift: _pass(it, c, d, scale, False), schema), f"codes_{r}")
        if table is not None:
            discard(table)
        table = state
        # One row an entry.
        for row in state.where("n IS NOT NULL").groupBy("part", "entry").agg(F.sum("n"), *(F.sum(F.col("sums")[i]) for i in range(length // parts))).collect():
            n[row[0], row[1]] += row[2]
            sums[row[0], row[1]] += np.array(row[3:], object)
        used = n > 0
        moved = books.copy()
        moved[used] = (sums[used] // n[used][:, None]).astype(np.int64)
        drift = above(np.sqrt(squares(moved, books).astype(np.float64)))
        books, now = moved, state.where("n IS NULL").select("rest", "point", "own", "upper", "lower")
        if not drift.any():
            break  # no entry moves any more, so no later round changes anything
    found = written(now.mapInArrow(lambda it, c=books, d=drift: _pass(it, c, d, scale, True), f"rest {kind}, code string, error long"), "codes")
    if table is not None:
        discard(table)
    return Codes(found.select(*(F.col("rest")[c].alias(c) for c in keep), "code", "error"), books)
