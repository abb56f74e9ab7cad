"""Vectorised word and window hashes over batches of documents, and blobs of hashes dealt out by bucket.

Texts are handled as UTF-8 bytes. Words are cut at ASCII white space, ``[\\x20\\x09-\\x0D]``; a byte above 0x7F is never
white space. All arithmetic is modulo 2**64 in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15)
_Q1, _Q2 = U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)
#: A batch of documents is closed at so many bytes of text; one longer document is a batch of its own.
BATCH_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def inverse(odd: np.uint64) -> np.uint64:
    return U64(pow(int(odd), -1, 1 << 64))


class Words:
    """The words of a batch of texts: ``start``/``end`` byte offsets into ``buf``, ``hash``, and each text's slice ``first``."""

    def __init__(self, texts: Sequence[bytes], lower: bool = False):
        self.n = len(texts)
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, self.n)
        ends = np.cumsum(lengths)
        buf = self.buf
        if lower:
            buf = np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)
        self.bytes = buf
        space = (buf == 32) | ((buf >= 9) & (buf <= 13))
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
        self.start, self.end = edge[0::2], edge[1::2]  # the buffer ends with white space, so edges pair up
        #: Words of text i are first[i] to first[i + 1].
        self.first = np.searchsorted(self.start, np.concatenate(([0], ends)))
        self.hash = self._hashes(space)

    def _hashes(self, space: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, U64)
        length = self.end - self.start
        inside = np.flatnonzero(~space)
        begins = np.cumsum(length) - length
        offset = np.arange(len(inside)) - np.repeat(begins, length)
        value = (self.bytes[inside].astype(U64) + U64(1)) * powers(_P, int(length.max()))[offset]
        return mix(np.add.reduceat(value, begins) + mix(length.astype(U64)))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, width: int, lanes: int = 2) -> tuple[np.ndarray, list[np.ndarray]]:
        """Where each window of ``width`` words within one text starts, and its Rabin-Karp hashes, one array a lane."""
        n = len(self.hash)
        if n < width:
            return np.zeros(0, np.int64), [np.zeros(0, U64)] * lanes
        fits = np.zeros(n + 1, np.int32)
        count = self.counts()
        some = count >= width
        np.add.at(fits, self.first[:-1][some], 1)
        np.add.at(fits, self.first[1:][some] - width + 1, -1)
        at = np.flatnonzero(np.cumsum(fits[:-1]) > 0)
        out = []
        for q in (_Q1, _Q2)[:lanes]:
            sums = np.concatenate((np.zeros(1, U64), np.cumsum(self.hash * powers(q, n), dtype=U64)))
            out.append(mix((sums[at + width] - sums[at]) * powers(inverse(q), n)[at] + U64(width)))
        return at, out


def batches(rows: Iterator[tuple[object, bytes]], size: int = BATCH_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Rows of (key, text) in groups of about ``size`` bytes."""
    keys, texts, held = [], [], 0
    for key, text in rows:
        if texts and held + len(text) > size:
            yield keys, texts
            keys, texts, held = [], [], 0
        keys.append(key)
        texts.append(text)
        held += len(text) + 1
    if texts:
        yield keys, texts


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indices in their order) for every bucket that occurs."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    ordered = bucket[order]
    cuts = np.flatnonzero(np.diff(ordered, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(ordered)], strict=True):
        yield int(ordered[a]), order[a:b]


def bucket_count(size_in_bytes: int, least: int, each: int = 4 << 20) -> int:
    """Buckets so that each holds the hashes of about ``each`` bytes of input: their number grows with the input."""
    return int(min(max(least, size_in_bytes // each), 1 << 24))


def table_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of ``df``, or where it has none, the bytes of its texts; only used to choose numbers of buckets."""
    guess = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if guess < 1 << 50:
        return guess
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    return int(df.agg(F.sum(sum(texts, F.lit(0)))).first()[0] or 0)
