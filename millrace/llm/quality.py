"""Quality selection by importance resampling.

Two generative models of hashed word unigrams and bigrams are estimated, one of target text and one of raw text. A
document's log importance weight is the sum of its n-grams' log ratios; Gumbel noise, seeded by the document's id, is
added and the largest sums are selected, which samples without replacement in proportion to the weights.

The raw model counts every document. The target model counts documents of known good quality: all ids in ``target``, a
bounded sample. Count vectors have a fixed number of slots, are summed per task and then in two steps, so what reaches
the driver has a fixed size. The selection threshold is found by repeated histograms over the scores, not by a sort.

Defined cases: null and wordless texts have weight 0; rows that repeat an id have one noise value; scores equal to the
threshold are all selected; an empty target makes both models equal, so every weight is 0; empty tables give no rows;
columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.hashing import U64, Words, batches, mix
from millrace.llm.scratch import written

SLOTS = 10_000
_PARTS = 8


def _grams(texts: list[bytes], slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of every unigram and bigram."""
    words = Words(texts, lower=True)
    owner = np.repeat(np.arange(len(texts)), words.counts())
    pairs, (hashed,) = words.windows(2, lanes=1)
    slot = np.concatenate((mix(words.hash), hashed)) % U64(slots)
    return np.concatenate((owner, owner[pairs])), slot.astype(np.int64)


def _rows(batch_iter: Iterator[pa.RecordBatch]):
    for batch in batch_iter:
        flags = batch.column("good").to_pylist() if "good" in batch.schema.names else [None] * len(batch)
        for key, text, good in zip(batch.column("id").to_pylist(), batch.column("text"), flags, strict=True):
            yield (key, good), (text.as_py() or "").encode()


def _count(batch_iter: Iterator[pa.RecordBatch], slots: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, slots), np.int64)
    for keys, texts in batches(_rows(batch_iter)):
        owner, slot = _grams(texts, slots)
        good = np.array([bool(g) for _, g in keys])
        counts[0] += np.bincount(slot, minlength=slots)
        counts[1] += np.bincount(slot[good[owner]], minlength=slots)
    parts = np.array_split(counts.ravel(), _PARTS)
    yield pa.RecordBatch.from_pydict({
        "salt": pa.array([TaskContext.get().partitionId() % 64] * _PARTS, pa.int32()), "part": pa.array(range(_PARTS), pa.int32()),
        "counts": pa.array([p.tobytes() for p in parts], pa.binary()),
    })


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("counts"))
    return pa.table({"salt": table.column("salt")[:1], "part": table.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def log_ratios(docs: DataFrame, target: DataFrame, *, slots: int = SLOTS, smooth: float = 1.0) -> np.ndarray:
    """By slot, the log of target over raw probability. ``docs``: id, text; ``target``: one column of ids, of bounded size."""
    marked = docs.join(F.broadcast(target.select(F.col(target.columns[0]).alias("id"), F.lit(True).alias("good")).distinct()), "id", "left")
    schema = "salt int, part int, counts binary"
    sums = marked.mapInArrow(lambda it: _count(it, slots), schema).groupBy("part", "salt").applyInArrow(_add, schema).groupBy("part").applyInArrow(_add, schema)
    parts = {r["part"]: np.frombuffer(r["counts"], np.int64) for r in sums.collect()}  # _PARTS rows of fixed size
    if not parts:
        return np.zeros(slots)
    raw, good = np.concatenate([parts[i] for i in range(_PARTS)]).reshape(2, slots)
    if not good.sum():
        return np.zeros(slots)
    share = lambda c: np.log(c + smooth) - np.log(c.sum() + smooth * slots)
    return share(good) - share(raw)


def _weigh(batch_iter: Iterator[pa.RecordBatch], ratio: np.ndarray) -> Iterator[pa.RecordBatch]:
    for keys, texts in batches(_rows(batch_iter)):
        owner, slot = _grams(texts, len(ratio))
        yield pa.RecordBatch.from_pydict({
            "id": pa.array([k for k, _ in keys], pa.int64()), "n_grams": pa.array(np.bincount(owner, minlength=len(texts)), pa.int64()),
            "log_weight": pa.array(np.bincount(owner, weights=ratio[slot], minlength=len(texts)), pa.float64()),
        })


def gumbel(id_col: Column, seed: int) -> Column:
    """Standard Gumbel noise that depends on the id and the seed alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col), 11).cast("double")
    return -F.log(-F.log((bits + 0.5) / float(1 << 53)))


def threshold(scored: DataFrame, column: str, wanted: int, bins: int = 4096, few: int = 5000) -> float | None:
    """The ``wanted``-th largest value: histograms narrow its bin until few rows are left. None selects nothing."""
    low, high, rows = scored.agg(F.min(column), F.max(column), F.count(column)).first()
    if not rows or wanted <= 0:
        return None
    if wanted >= rows:
        return low
    for _ in range(40):
        inside = scored.where(F.col(column).between(low, high))
        width = (high - low) / bins
        if width <= 0 or low + width <= low or inside.count() <= few:
            break
        spot = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
        cells = {r["b"]: r for r in inside.groupBy(spot.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()}
        above = scored.where(F.col(column) > high).count()
        for b in sorted(cells, reverse=True):
            if above + cells[b]["n"] >= wanted:
                low, high = cells[b]["lo"], cells[b]["hi"]
                break
            above += cells[b]["n"]
    above = scored.where(F.col(column) > high).count()
    # Distinct values of the last bin, each with its count: few, or all but equal.
    left = scored.where(F.col(column).between(low, high)).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc(column)).limit(few).collect()
    for r in left:
        above += r["n"]
        if above >= wanted:
            return r[column]
    return low


def resample(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: float = 0.8, seed: int = 11, slots: int = SLOTS,
) -> DataFrame:
    """``id, n_grams, log_weight, score`` (weight plus noise) and ``selected``, true for ``share`` of the documents."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ratio = log_ratios(own, target, slots=slots)
    weighed = own.mapInArrow(lambda it: _weigh(it, ratio), "id long, n_grams long, log_weight double")
    scored = written(weighed.withColumn("score", F.col("log_weight") + gumbel(F.col("id"), seed)), "weights")
    edge = threshold(scored, "score", round(share * scored.count()))
    return scored.withColumn("selected", F.lit(False) if edge is None else F.col("score") >= F.lit(edge))


def sample_ids(labels: DataFrame, *, id_col: str = "doc_id", rows: int = 20_000) -> DataFrame:
    """At most ``rows`` distinct ids of ``labels``: of each of ``rows`` hash buckets the id with the least hash."""
    h = F.xxhash64(F.col(id_col))
    return labels.where(F.col(id_col).isNotNull()).groupBy(F.pmod(h, F.lit(rows)).alias("b")).agg(F.min_by(id_col, h).alias("id")).select("id")
