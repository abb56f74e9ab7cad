"""Best-fit packing of documents into sequences of tokens, large ones by linear grouping.

Texts are tokenized in tasks, a token that ends a document is put behind each, and only documents longer than a sequence are cut.
What has to be decided depends on lengths alone, of which there are as many as a sequence has tokens, so the plan is made on
the driver from a histogram of fixed size, whatever the number of documents:

1. Large lengths, sorted, are cut into groups of equal cardinality, each rounded up to its largest length.
2. Configurations (how many of each rounded size share a sequence) are optimised for these few sizes: a linear program solved by
   column generation, a knapsack each step. Whole multiples of its solution are used.
3. The actual documents, in order of their lengths, take the places of their group, which leaves more room than the rounded sizes.
4. The large ones that are left over, then the small ones, longest first, go where they leave the least room: best fit over
   runs of sequences that have the same room.

The plan says which ranks (in order of falling length) go to which run of sequences. Every piece's rank comes from counts by
task and length, and its place from the plan; sequences then add up their offsets. Neither a hot length nor a hot document
is gathered anywhere: a sequence holds at most as many pieces as it has tokens.

Defined cases: null or empty text is the end token alone; a document is cut only if it is longer than a sequence, at multiples of
its length; rows that repeat an id are documents of their own; a null id stays; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.scratch import discard, written

_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
#: Texts of ASCII and Latin letters alone are cut into words here as the tokenizer does; any other character, or a special token, is left to it.
_ODD = re.compile(rf"[^ -~\t-\r{_LETTERS}]|<\|")
_WORD = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{_LETTERS}]+|[0-9]|[^ \t-\r{_LETTERS}0-9]+")
_GAP = re.compile(r"[ \t-\r]+")


class Encoder:
    """Token ids as little-endian bytes, with a bounded memory of the words that have been seen.

    The tokenizer in mind lower-cases, drops white space and encodes word by word, each word's last token bearing an
    end mark; so words are looked up, and those not seen before are encoded many at once and parted at the marks.
    """

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self.seen: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.by_word = bool(self.ends.any())  # else white space may count, and texts are encoded whole

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Plain words that are not yet known."""
        if len(self.seen) + len(words) > self.most:
            self.seen.clear()
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            self.seen.update((w, self._whole(w)) for w in words)
            return
        raw, at = ids.tobytes(), 0
        for word, stop in zip(words, (stops * 4).tolist(), strict=True):
            self.seen[word] = raw[at:stop]
            at = stop

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return self._whole(text)
        if _ODD.search(text):
            return b"".join(map(self._odd_word, _GAP.split(text)))
        words = _WORD.findall(text.lower())
        try:
            return b"".join(map(self.seen.__getitem__, words))
        except KeyError:
            self._learn([w for w in dict.fromkeys(words) if w not in self.seen])
        return b"".join(map(self._known, words))

    def _known(self, word: str) -> bytes:
        if (found := self.seen.get(word)) is None:
            found = self.seen[word] = self._whole(word)
        return found

    def _odd_word(self, word: str) -> bytes:
        if len(word) > 64:
            return self._whole(word)
        if (found := self.odd.get(word)) is None:
            if len(self.odd) >= self.most // 4:
                self.odd.clear()
            found = self.odd[word] = self._whole(word)
        return found


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for all tasks that a Python worker runs: words that one task has seen are known to the next."""
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, end: int = 1, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece, with its ``part`` (the task) and ``nth`` of its length there; and ``ids`` if wanted.

    ``tokenizer``: the path of a tokenizer's file, which all executors can open. Write the result before it is packed.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(lambda it: _cut(it, tokenizer, limit, np.array([end], "<u4").tobytes(), with_ids), schema)


def _cut(batches: Iterator[pa.RecordBatch], path: str, limit: int, end: bytes, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder, part, width = _encoder(path), TaskContext.get().partitionId(), 4 * limit
    known = np.zeros(limit + 1, np.int64)
    for whole in batches:
        for at in range(0, len(whole), 256):
            batch = whole.slice(at, 256)
            of, piece, length, crc, bodies = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                raw = encoder.encode(text.as_py() or "") + end
                for p in range(-(-len(raw) // width)):
                    body = raw[p * width : (p + 1) * width]
                    of.append(i)
                    piece.append(p)
                    length.append(len(body) // 4)
                    crc.append(zlib.crc32(body))
                    if with_ids:
                        bodies.append(np.frombuffer(body, "<u4").astype(np.int32))
            n = np.array(length, np.int64)
            order = np.argsort(n, kind="stable")
            there, first, count = np.unique(n[order], return_index=True, return_counts=True)
            nth = np.empty(len(n), np.int64)
            nth[order] = np.arange(len(n)) - np.repeat(first, count) + np.repeat(known[there], count)
            known[there] += count
            columns = [batch.column("doc_id").take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(np.array(piece, np.int64) * limit), pa.array(n), pa.array(crc, pa.int64()), pa.array(np.full(len(n), part), pa.int32()), pa.array(nth)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(bodies, pa.list_(pa.int32()))] * with_ids, names + ["ids"] * with_ids)


@dataclass
class Plan:
    """Ranks from ``first[i]`` on go to sequences from ``base[i]`` on, ``each[i]`` to a sequence; ranks are by falling length."""

    sequences: int = 0
    entries: list[tuple[int, int, int]] = field(default_factory=list)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = np.array(sorted(self.entries), np.int64).reshape(-1, 3)
        return found[:, 0], found[:, 1], found[:, 2]


def configurations(sizes: list[int], demand: list[int], limit: int, steps: int = 2000, gap: float = 5e-4) -> list[tuple[float, np.ndarray]]:
    """How often each configuration is used so that every size is met as its demand asks, by as few sequences as a linear program can.

    The basis has a column a size. A column enters if its sizes are worth more than a sequence at the present prices; the best one is a
    knapsack with at most as many items as fit of the smallest size. If no column is worth more than ``1 + gap``, no basis needs
    fewer sequences than this one by more than that share, and the search ends.
    """
    n, want = len(sizes), np.array(demand, float)
    basis, cost = np.diag([float(limit // s) for s in sizes]), np.ones(n)
    for _ in range(steps):
        price = np.linalg.solve(basis.T, cost)
        if price.min() < -1e-9:
            column, own = -np.eye(n)[int(price.argmin())], 0.0  # more of a size than asked costs nothing
        else:
            column, own = _knapsack(sizes, price, limit), 1.0
            if column @ price <= 1 + gap:
                break
        x, d = np.linalg.solve(basis, want), np.linalg.solve(basis, column)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        if not np.isfinite(ratio.min()):
            break
        out = int(ratio.argmin())
        basis[:, out], cost[out] = column, own
    x = np.linalg.solve(basis, want)
    return [(float(v), np.rint(basis[:, j]).astype(int)) for j, v in enumerate(x) if cost[j] and v > 1e-9]


def _knapsack(sizes: list[int], price: np.ndarray, limit: int) -> np.ndarray:
    """The most valuable choice of sizes, repeats allowed: layer by layer of one more item."""
    best, took = np.zeros(limit + 1), []
    for _ in range(limit // min(sizes)):
        new, choice = best.copy(), np.full(limit + 1, -1)
        for g, s in enumerate(sizes):
            with_it = best[: limit + 1 - s] + price[g]
            better = with_it > new[s:] + 1e-12
            new[s:][better], choice[s:][better] = with_it[better], g
        if (choice < 0).all():
            break
        took.append(choice)
        best = new
    found, room = np.zeros(len(sizes)), limit
    for choice in reversed(took):
        if choice[room] >= 0:
            found[choice[room]] += 1
            room -= sizes[choice[room]]
    return found


def plan(counts: np.ndarray, limit: int, groups: Sequence[int] = (8, 16, 32, 64), large: int | None = None) -> Plan:
    """Where the pieces go, given how many there are of each length (``counts[length]``).

    Many groups round up little, few leave few places over for small pieces to fill: of the numbers of ``groups`` given, the one with
    the fewest sequences counts.
    """
    return min((_plan(counts, limit, g, large) for g in groups), key=lambda p: p.sequences)


def _plan(counts: np.ndarray, limit: int, groups: int, large: int | None) -> Plan:
    large = large or max(1, limit // 8)
    lengths = [int(x) for x in np.flatnonzero(counts)[::-1]]
    ends, total = {}, 0  # of each length's ranks
    for x in lengths:
        ends[x] = (total, total + int(counts[x]))
        total += int(counts[x])
    stops = np.array([ends[x][1] for x in lengths], np.int64)
    length_at = lambda rank: lengths[int(np.searchsorted(stops, rank, side="right"))]
    many = sum(int(counts[x]) for x in lengths if x >= large)
    out, free = Plan(), _Rooms(limit)
    left: list[tuple[int, int]] = []
    # Linear grouping: groups of equal cardinality, joined where they round up to one size.
    bounds: dict[int, list[int]] = {}
    for i in range(min(groups, many)):
        a, b = i * many // min(groups, many), (i + 1) * many // min(groups, many)
        bounds.setdefault(length_at(a), [a, b])[1] = b
    sizes = list(bounds)
    used = {s: bounds[s][0] for s in sizes}
    for times, what in configurations(sizes, [bounds[s][1] - bounds[s][0] for s in sizes], limit) if sizes else ():
        m, base = int(times + 1e-9), out.sequences
        slots = []
        for s, copies in zip(sizes, what.tolist(), strict=True):
            for _ in range(copies):
                take = min(m, bounds[s][1] - used[s])
                if take:
                    slots.append((used[s], take))
                    out.entries.append((used[s], base, 1))
                    used[s] += take
        if not slots:
            continue
        out.sequences += max(take for _, take in slots)
        # Where a slot comes to another length or to its end, another room begins.
        cuts = {0} | {take for _, take in slots} | {int(e) - a for a, take in slots for e in stops[(stops > a) & (stops < a + take)]}
        for i, j in zip(sorted(cuts), sorted(cuts)[1:], strict=False):
            free.add(limit - sum(length_at(a + i) for a, take in slots if i < take), base + i, j - i)
    left = [(used[s], bounds[s][1]) for s in sizes if used[s] < bounds[s][1]] + ([(many, total)] if many < total else [])
    for a, b in left:
        while a < b:
            x = length_at(a)
            stop = min(b, ends[x][1])
            out.sequences = free.place(a, stop - a, x, out.entries, out.sequences)
            a = stop
    return out


class _Rooms:
    """Runs of sequences by the room that they have left."""

    def __init__(self, limit: int):
        self.limit = limit
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []

    def add(self, room: int, base: int, count: int) -> None:
        if room and count:
            if room not in self.runs:
                self.runs[room] = []
                insort(self.rooms, room)
            self.runs[room].append((base, count))

    def _pop(self, length: int) -> tuple[int, int, int] | None:
        """A run of the least room that holds the length."""
        at = bisect_left(self.rooms, length)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        base, count = self.runs[room].pop()
        if not self.runs[room]:
            del self.runs[room], self.rooms[at]
        return room, base, count

    def place(self, rank: int, n: int, length: int, entries: list, sequences: int) -> int:
        """Best fit for ``n`` pieces of one length; a sequence takes more of them while they fit, as its room is then the least."""
        while n:
            found = self._pop(length)
            if found is None:
                each = self.limit // length
                found = self.limit, sequences, -(-n // each)
                sequences += found[2]
            room, base, count = found
            each = min(room // length, n)
            take = min(count, n // each)
            entries.append((rank, base, each))
            self.add(room - each * length, base, take)
            self.add(room, base + take, count - take)
            rank, n = rank + take * each, n - take * each
        return sequences


def pack(found: DataFrame, *, limit: int = 4096, groups: Sequence[int] = (8, 16, 32, 64)) -> DataFrame:
    """``found`` (written ``pieces``) with ``sequence_id`` and ``offset`` in place of ``part`` and ``nth``."""
    counts = written(found.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = np.zeros(limit + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``limit`` rows
        histogram[row["length"]] = row["n"]
    # Ranks before each length, the longest first.
    before = np.concatenate((np.cumsum(histogram[::-1])[::-1][1:], [0]))
    first, base, each = plan(histogram, limit, groups).arrays()
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("part", "length", earlier.alias("earlier"))
    ranked = found.join(starts, ["part", "length"]).withColumn("rank", F.col("earlier") + F.col("nth")).drop("part", "nth", "earlier")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy() + before[batch.column("length").to_numpy()]
            at = np.searchsorted(first, rank, side="right") - 1
            sequence = base[at] + (rank - first[at]) // each[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(rank), pa.array(sequence)], [*names, "rank", "sequence_id"])

    names = [c for c in ranked.columns if c != "rank"]
    kinds = ", ".join(f"{c} {ranked.schema[c].dataType.simpleString()}" for c in names)
    placed = ranked.mapInArrow(place, f"{kinds}, rank long, sequence_id long")
    within = Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0))).drop("rank")


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, end: int = 1, with_ids: bool = False, groups: Sequence[int] = (8, 16, 32, 64)) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of ``docs``; and ``ids`` if wanted."""
    table = written(pieces(docs, tokenizer, id_col=id_col, text_col=text_col, limit=limit, end=end, with_ids=with_ids), "pieces")
    packed = written(pack(table, limit=limit, groups=groups), "packed")
    discard(table)
    return packed


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the tokens of each sequence, of pieces that were packed with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
