"""Removal of repeated word passages.

A window is ``width`` consecutive words of one document. A word goes if a window that covers it also starts anywhere
else, in the same document or another. Windows are judged on the input.

Plan: documents are packed into chunks of a few MB, written once to the shared folder. Each chunk hashes all its windows
(two Rabin-Karp lanes: one names the bucket, the other is stored). A window that occurs again within its chunk is known
to repeat, so a chunk sends each hash once, in order of first occurrence, as one array by bucket: no window, however
frequent, puts more than one hash a chunk into its bucket. Spark counts the hashes where they lie by bucket, a row a hash
that is never shuffled as one; the repeated ones meet the arrays again in the same place, and every chunk is answered
with one bit for each hash that it sent. Chunks meet their answers, hash their windows again, merge the repeated ones into
maximal intervals and drop these.

Buckets grow in number with the input and hold about ``1 << 20`` hashes each. Two windows of unequal words are taken for
equal only if 64 stored bits and the bucket agree.

Defined cases: null, empty and short texts have no windows and lose nothing (null reads as empty); rows that repeat, in
whole or by id, are documents of their own, so an exact copy of at least ``width`` words loses every word; empty tables
give no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.hashing import BATCH_BYTES, Words, batches, bucket_count, by_bucket, table_bytes
from millrace.llm.scratch import written

WIDTH = 35
#: Bytes of input to a bucket: its hashes, and those of the few that share its partition, are counted in memory.
BUCKET_BYTES = 1 << 20


def _pack(batch_iter: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) to chunk rows: chunk, ids, lengths, bodies compressed."""

    def rows():
        for batch in batch_iter:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield key, (text.as_py() or "").encode()

    part, pack = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=1)
    for i, (keys, texts) in enumerate(batches(rows(), size)):
        yield pa.RecordBatch.from_pydict({
            "chunk": pa.array([part + i], pa.int64()),
            "ids": pa.array([keys], pa.list_(pa.int64())),
            "lengths": pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
            "body": pa.array([pack.compress(b"".join(texts))], pa.binary()),
        })


def _texts(lengths: list[int], body: bytes) -> list[bytes]:
    whole, ends = zstandard.ZstdDecompressor().decompress(body, max_output_size=max(1, sum(lengths))) if lengths else b"", np.cumsum(lengths)
    return [whole[e - n : e] for e, n in zip(ends.tolist(), lengths, strict=True)]


def _dealt(words: Words, width: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: windows' starts, whether each repeats within the chunk, and of each distinct one first place, bucket and stored hash."""
    at, (named, stored) = words.windows(width)
    _, first, back, count = np.unique(stored ^ (named * np.uint64(3)), return_index=True, return_inverse=True, return_counts=True)
    again = count[back] > 1
    place = np.sort(first)
    return at, again, place, (named[place] % np.uint64(buckets)).astype(np.int64), stored[place]


def _send(batch_iter: Iterator[pa.RecordBatch], width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batch_iter:
        for row in batch.to_pylist():
            _, _, _, bucket, stored = _dealt(Words(_texts(row["lengths"], row["body"])), width, buckets)
            out = [(b, stored[i].view(np.int64)) for b, i in by_bucket(bucket)]
            if out:
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([b for b, _ in out], pa.int64()),
                    "chunk": pa.array([row["chunk"]] * len(out), pa.int64()),
                    "hashes": pa.array([h for _, h in out], pa.list_(pa.int64())),
                })


def _answer(sent: pa.Table, repeated: pa.Table) -> pa.Table:
    """Of one bucket: for each chunk a bit for each of its hashes, set if another chunk sent the hash too."""
    known = np.sort(repeated.column("hash").to_numpy()) if len(repeated) else np.zeros(0, np.int64)
    out: dict[str, list] = {"chunk": [], "bucket": [], "bits": []}
    for i in range(len(sent) if len(known) else 0):
        mine = sent.column("hashes")[i].values.to_numpy()
        bits = known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine
        if bits.any():
            out["chunk"].append(sent.column("chunk")[i].as_py())
            out["bucket"].append(sent.column("bucket")[i].as_py())
            out["bits"].append(np.packbits(bits).tobytes())
    return pa.table(out, schema=pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())]))


def _intervals(words: Words, at: np.ndarray, repeats: np.ndarray, width: int) -> np.ndarray:
    """Of every word, whether a repeated window covers it."""
    edges = np.zeros(len(words.hash) + 1, np.int32)
    hit = at[repeats]
    np.add.at(edges, hit, 1)
    np.add.at(edges, hit + width, -1)
    return np.cumsum(edges[:-1]) > 0


def _remove(chunks: pa.Table, answers: pa.Table, width: int, buckets: int) -> pa.Table:
    out: dict[str, list] = {"id": [], "n_words": [], "n_removed": [], "kept_text": [], "removed": []}
    got = {b: np.frombuffer(x, np.uint8) for b, x in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True)}
    for row in chunks.to_pylist():
        words = Words(_texts(row["lengths"], row["body"]))
        at, repeats, place, bucket, _ = _dealt(words, width, buckets)
        for b, i in by_bucket(bucket):
            if b in got:
                repeats[place[i[np.unpackbits(got[b], count=len(i)).astype(bool)]]] = True
        gone = _intervals(words, at, repeats, width)
        whole, starts, ends = words.buf.tobytes(), words.start.tolist(), words.end.tolist()
        for k, key in enumerate(row["ids"]):
            a, b = int(words.first[k]), int(words.first[k + 1])
            lost = gone[a:b]
            cuts = np.flatnonzero(np.diff(lost.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
            out["id"].append(key)
            out["n_words"].append(b - a)
            out["n_removed"].append(int(lost.sum()))
            out["kept_text"].append(b" ".join(whole[starts[i] : ends[i]] for i in (a + np.flatnonzero(~lost)).tolist()).decode())
            out["removed"].append([{"start": int(x), "end": int(y)} for x, y in zip(cuts[0::2], cuts[1::2], strict=True)])
    return pa.table(out, schema=pa.schema([
        ("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()),
        ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, chunk_bytes: int = BATCH_BYTES) -> DataFrame:
    """``id, n_words, n_removed, kept_text`` (kept words joined by one space) and ``removed``, the maximal word intervals that went."""
    buckets = bucket_count(table_bytes(docs), 16, BUCKET_BYTES)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    chunks = written(
        own.mapInArrow(lambda it: _pack(it, chunk_bytes), "chunk long, ids array<long>, lengths array<long>, body binary"), "passages"
    )
    # Dealt out once: the counting and the answering read the same shuffle, so both have to ask for all its columns and rows (an
    # inner explode would filter before it).
    sent = chunks.mapInArrow(lambda it: _send(it, width, buckets), "bucket long, chunk long, hashes array<long>").repartition(buckets, "bucket")
    counted = sent.select("bucket", "chunk", F.explode_outer("hashes").alias("hash")).groupBy("bucket", "hash").agg(F.count("chunk").alias("n"))
    repeated = counted.where("n > 1").select("bucket", "hash")
    answers = sent.groupBy("bucket").cogroup(repeated.groupBy("bucket")).applyInArrow(_answer, "chunk long, bucket long, bits binary")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        lambda c, a: _remove(c, a, width, buckets),
        "id long, n_words long, n_removed long, kept_text string, removed array<struct<start:long,end:long>>",
    )
