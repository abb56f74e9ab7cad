"""Vectors as exact integers, and bounds on their distances that hold whatever floating point rounds away."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components beyond this leave no room for squared distances in 64 bits.
LARGEST = 1 << 27
_SLACK = 2.0**-40


def finite(vector: Column) -> Column:
    """True for vectors all of whose components are numbers; an empty vector has none that is not."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def floors(column: pa.Array, scale: int, dim: int) -> np.ndarray:
    """``floor(scale * x)`` of each component of a column of vectors of ``dim`` components."""
    x = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, dim)
    if x.size and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component times {scale} is beyond {LARGEST}: squared distances would not fit into 64 bits")
    return x.astype(np.int64)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = x - y
    return np.einsum("...i,...i->...", d, d)


def above(x: np.ndarray) -> np.ndarray:
    """No less than what ``x`` stands for."""
    return x + np.abs(x) * _SLACK


def below(x: np.ndarray) -> np.ndarray:
    """No more than what ``x`` stands for."""
    return x - np.where(np.isinf(x), 0, np.abs(x)) * _SLACK


def packed(rows: np.ndarray) -> pa.Array:
    """A row of the matrix as one binary value."""
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * rows.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def unpacked(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """The matrix of ``packed`` values, none of which is null."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def sums_by(keys: np.ndarray, x: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys that occur, and for each the sum of ``signs`` and of the rows of ``x`` times their sign."""
    order = np.argsort(keys, kind="stable")
    there, first = np.unique(keys[order], return_index=True)
    if not len(there):
        return there, np.zeros(0, np.int64), np.zeros((0, x.shape[1]), np.int64)
    return there, np.add.reduceat(signs[order], first), np.add.reduceat(x[order] * signs[order][:, None], first, axis=0)
