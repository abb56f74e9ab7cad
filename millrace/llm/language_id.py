"""Language identification with a linear-chain conditional random field over words.

Each word is a node whose label is its language. Node potentials sum weights of affixes (the first and last 4 and 6
bytes), of byte n-grams with word boundaries, and of lexicon words; learned transitions tie neighbours, so a word
that any language could hold follows its context while a switch of language inside a text is still found. Marginals come
from the forward-backward algorithm. A document's prediction is the language with the largest mean marginal, its score
that mean; its sureness is the mean of each word's largest marginal, which a text in several languages keeps high; runs
of words with one most probable label are the text's segments.

Training takes a bounded sample: about ``sample_rows`` labelled documents, shared evenly by all labels, at least
``least_rows`` and at most ``rows_per_label`` of each (the ones whose ids hash lowest, one by hash bucket), of each a
passage of at most ``passage_chars`` code points. No label is left out; with many, the table of n-gram weights gets fewer
slots so that its size stays. Sequences are drawn from passages of one language, and spliced from several to show
switches. Prediction reads whole texts.

Words are scanned in blocks: transfer matrices of all blocks are built at once, messages pass from block to block, and
marginals are filled in within blocks, which equals the plain recursion. A text longer than a piece is scanned piece by
piece: a first pass keeps one transfer matrix a piece, a second has the messages from both sides and fills the marginals
in, so beside the text itself no more than a piece is held.

Defined cases: a null text or one without letters is ``und`` with score 0; without any labelled row everything is
``und``; null labels are not learned from; rows that repeat an id are documents of their own; empty tables give no rows;
columns other than id, text and label are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.hashing import U64, batches, mix

UNKNOWN = "und"
_SLOTS = 1 << 17
_ORDERS = (2, 3, 4)
_AFFIXES = (4, 6)
_BLOCK = 32
#: Bytes of text that are scanned at once with up to ``_FEW`` labels; with more labels they are fewer.
_PIECE, _FEW = 1 << 20, 16


class _Letters:
    """Words (runs of ASCII letters and of bytes above 0x7F) of a batch of lower-cased texts, with their n-gram slots."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        ascii_letter = (raw >= 97) & (raw <= 122)
        letter = ascii_letter | (raw >= 128)
        self.bytes = np.where(letter, raw, np.uint8(32))
        edge = np.flatnonzero(np.diff(letter.view(np.int8), prepend=np.int8(0)))
        self.start, self.end = edge[0::2], edge[1::2]
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.first = np.searchsorted(self.start, np.concatenate(([0], ends + 1)))
        self.plain = np.add.reduceat(ascii_letter.astype(np.int64), self.start) > 0 if len(self.start) else np.zeros(0, bool)
        # Each word's n-grams end at its bytes and at the boundary behind it.
        length = self.end - self.start + 1
        self.begins = np.cumsum(length) - length
        self.at = np.arange(int(length.sum())) + np.repeat(self.start - self.begins, length)
        self.length = length

    def slots(self, number: int = _SLOTS) -> list[np.ndarray]:
        """For each order the feature slot (below ``number``, a power of two) of every n-gram, by word."""
        b, out = self.bytes.astype(np.uint32), []
        inside = self.at - np.repeat(self.start, self.length)  # bytes of the word before the n-gram's last
        code = np.zeros(len(self.at), np.uint32)
        for k in range(max(_ORDERS)):
            # The byte k places back; what is before the boundary in front of the word counts as zero.
            far = b[np.maximum(self.at - k, 0)]
            far[inside + 1 < k] = 0
            code = code * np.uint32(0x01000193) + far + np.uint32(1)
            if k + 1 in _ORDERS:
                slot = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                out.append(((slot ^ (slot >> np.uint32(12))) & np.uint32(number - 1)).astype(np.int64))
        return out

    def affixes(self, number: int = _SLOTS) -> list[np.ndarray]:
        """For each affix length the feature slots of every word's prefix and suffix; a shorter word is its own affix."""
        b, out = self.bytes.astype(np.uint32), []
        for side in (0, 1):
            code = np.full(len(self.start), 0x9E3779B9 + side, np.uint32)
            for k in range(max(_AFFIXES)):
                place = self.start + k if side == 0 else self.end - 1 - k
                inside = self.start + k < self.end
                code = code * np.uint32(0x01000193) + np.where(inside, b[np.clip(place, 0, len(b) - 1)] + np.uint32(1), np.uint32(0))
                if k + 1 in _AFFIXES:
                    slot = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                    out.append(((slot ^ (slot >> np.uint32(12))) & np.uint32(number - 1)).astype(np.int64))
        return out

    def names(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.start):
            return np.zeros(0, U64)
        offset = np.arange(len(self.at)) - np.repeat(self.begins, self.length)
        base = np.full(int(self.length.max()), U64(0x9E3779B97F4A7C15), U64)
        base[0] = 1
        value = (self.bytes[self.at].astype(U64) + U64(1)) * np.multiply.accumulate(base)[offset]
        return mix(np.add.reduceat(value, self.begins))


@dataclass
class Model:
    labels: list[str]
    grams: np.ndarray  # slot, label
    lexicon: np.ndarray  # sorted word hashes
    words: np.ndarray  # lexicon word, label; the last row is that of unknown words
    moves: np.ndarray  # label before, label

    def emissions(self, text: _Letters) -> np.ndarray:
        """Log potential of every word and label."""
        if not len(text.start):
            return np.zeros((0, len(self.labels)), np.float32)
        total = np.zeros((len(text.at), len(self.labels)), np.float32)
        for slots in text.slots(len(self.grams)):
            total += self.grams[slots]
        total = np.add.reduceat(total, text.begins, axis=0) + self.words[self._known(text)]
        for slots in text.affixes(len(self.grams)):
            total += self.grams[slots]
        return total

    def _known(self, text: _Letters) -> np.ndarray:
        names = text.names()
        if not len(self.lexicon):
            return np.zeros(len(names), np.int64)
        place = np.minimum(np.searchsorted(self.lexicon, names), len(self.lexicon) - 1)
        return np.where(self.lexicon[place] == names, place, len(self.lexicon))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(axis=-1, keepdims=True), 1e-300)


def _blocks(emit: np.ndarray, first: np.ndarray, moves: np.ndarray, block: int) -> tuple:
    """The words dealt out to blocks, and the transfer matrix of each block."""
    n, labels = emit.shape
    count = np.diff(first)
    blocks = -(-count // block)
    base = np.cumsum(blocks) - blocks
    place = np.arange(n) - np.repeat(first[:-1], count) + np.repeat(base * block, count)
    total = int(blocks.sum())
    potential = np.ones((total * block, labels))
    potential[place] = np.exp(emit - emit.max(axis=1, keepdims=True)) + 1e-30
    real = np.zeros(total * block, bool)
    real[place] = True
    potential, real = potential.reshape(total, block, labels), real.reshape(total, block)
    go = np.exp(moves - moves.max())

    carry = np.broadcast_to(np.eye(labels), (total, labels, labels)).copy()
    for k in range(block):
        step = (carry @ go) * potential[:, k, None, :]
        step /= np.maximum(step.sum(axis=(1, 2), keepdims=True), 1e-300)
        carry = np.where(real[:, k, None, None], step, carry)
    return blocks, base, place, potential, real, go, carry


def transfer(emit: np.ndarray, moves: np.ndarray, block: int = _BLOCK) -> np.ndarray:
    """The product of the transfer matrices of all words of one text, up to a factor."""
    out = np.eye(emit.shape[1])
    for step in _blocks(emit, np.array([0, len(emit)]), moves, block)[-1] if len(emit) else ():
        out = out @ step
        out /= max(out.sum(), 1e-300)
    return out


def marginals(emit: np.ndarray, first: np.ndarray, moves: np.ndarray, block: int = _BLOCK, start: np.ndarray | None = None, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each word's label by forward-backward, and its distribution given only the words before.

    Words of text i are first[i] to first[i + 1]. ``start`` and ``end`` are the messages that reach every text from outside.
    """
    n, labels = emit.shape
    if not n:
        return np.zeros((0, labels)), np.zeros((0, labels))
    blocks, base, place, potential, real, go, carry = _blocks(emit, first, moves, block)
    total = len(carry)
    left, right = np.empty((total, labels)), np.empty((total, labels))
    some = np.flatnonzero(blocks > 0)
    order = some[np.argsort(-blocks[some], kind="stable")]
    even = np.full(labels, 1.0 / labels)
    state, back, most = np.tile(even if start is None else start, (len(order), 1)), np.tile(even if end is None else end, (len(order), 1)), blocks[order]
    for t in range(int(most[0])):
        live = int(np.searchsorted(-most, -t, side="left"))  # texts with more than t blocks
        ahead = base[order[:live]] + t
        left[ahead] = state[:live]
        state[:live] = _unit(np.einsum("bi,bij->bj", state[:live], carry[ahead]))
        behind = base[order[:live]] + most[:live] - 1 - t
        right[behind] = back[:live]
        back[:live] = _unit(np.einsum("bij,bj->bi", carry[behind], back[:live]))

    forward, before = np.empty((total, block, labels)), np.empty((total, block, labels))
    for k in range(block):
        before[:, k] = _unit(left @ go)
        left = np.where(real[:, k, None], _unit(before[:, k] * potential[:, k]), left)
        forward[:, k] = left
    for k in range(block - 1, -1, -1):
        forward[:, k] *= right
        right = np.where(real[:, k, None], _unit((right * potential[:, k]) @ go.T), right)
    return _unit(forward.reshape(-1, labels)[place]), before.reshape(-1, labels)[place]


def fit(samples: list[tuple[str, str]], *, seed: int = 7, length: int = 40, rounds: int = 6, rate: float = 0.3, least_count: int = 3) -> Model:
    """Train on (label, passage) pairs by stochastic gradient on the conditional likelihood."""
    labels = sorted({label for label, _ in samples})
    number = {label: i for i, label in enumerate(labels)}
    text = _Letters([t.lower().encode() for _, t in samples])
    gold_doc = np.array([number[label] for label, _ in samples], np.int64)
    names = text.names()
    found, count = np.unique(names, return_counts=True)
    lexicon = found[count >= least_count]
    n = len(labels)
    size = _SLOTS >> max(0, (n - 1).bit_length() - 6)  # at most 64 full columns of weights
    model = Model(labels, np.zeros((max(size, 1 << 10), n), np.float32), lexicon, np.zeros((len(lexicon) + 1, n), np.float32), np.zeros((n, n)))
    words_of, known, slots, affixes = np.diff(text.first), model._known(text), text.slots(len(model.grams)), text.affixes(len(model.grams))
    usable = np.flatnonzero(words_of >= 4)
    if not len(usable) or n < 2:
        return model
    rng = np.random.default_rng(seed)
    sums = [np.full_like(model.grams, 1e-2), np.full_like(model.words, 1e-2), np.full_like(model.moves, 1e-2)]
    for _ in range(rounds):
        deal = rng.permutation(usable)
        for cut in range(0, len(deal), 64):
            picks, gold = [], []
            for doc in deal[cut : cut + 64]:
                # Two of three sequences keep to one text; the rest splice a run of another in.
                runs = [(doc, length)] if rng.random() < 0.67 else [(doc, length // 2), (int(rng.choice(usable)), length - length // 2)]
                for d, want in runs:
                    size = int(min(want, words_of[d]))
                    at = int(text.first[d]) + int(rng.integers(0, words_of[d] - size + 1))
                    picks.append(np.arange(at, at + size))
                    gold.append(np.full(size, gold_doc[d]))
                picks.append(None)
            _step(model, text, known, slots, affixes, picks, gold, sums, rate)
    return model


def _step(model: Model, text: _Letters, known: np.ndarray, slots: list[np.ndarray], affixes: list[np.ndarray], picks: list, gold: list, sums: list[np.ndarray], rate: float) -> None:
    first, words = [0], []
    for p in picks:
        if p is None:
            first.append(sum(len(w) for w in words))
        else:
            words.append(p)
    word, want = np.concatenate(words), np.concatenate(gold)
    grams_of = np.concatenate([np.arange(text.begins[w], text.begins[w] + text.length[w]) for w in word])
    owner = np.repeat(np.arange(len(word)), text.length[word])
    emit = model.words[known[word]].astype(np.float64)
    for s in slots:
        np.add.at(emit, owner, model.grams[s[grams_of]])
    for s in affixes:
        emit += model.grams[s[word]]
    edges = np.array(first)
    post, before = marginals(emit, edges, model.moves)
    slope = -post
    slope[np.arange(len(word)), want] += 1
    slope /= len(first) - 1
    grad = np.zeros_like(model.grams)
    for s in slots:
        np.add.at(grad, s[grams_of], slope[owner].astype(np.float32))
    for s in affixes:
        np.add.at(grad, s[word], slope.astype(np.float32))
    lex = np.zeros_like(model.words)
    np.add.at(lex, known[word], slope.astype(np.float32))
    # Pairs of neighbours: given the label before, a label has the weight of its transition times what the words from here
    # on say of it, which is its posterior over its prior.
    inner = np.ones(len(word), bool)
    inner[edges[:-1]] = False
    here = np.flatnonzero(inner)
    says = post[here] / np.maximum(before[here], 1e-12)
    pair = np.exp(model.moves - model.moves.max()) * says[:, None, :]
    pair *= (post[here - 1] / np.maximum(pair.sum(axis=2), 1e-300))[:, :, None]
    move = -pair.sum(axis=0)
    np.add.at(move, (want[here - 1], want[here]), 1.0)
    move /= len(first) - 1
    for weight, g, total in ((model.grams, grad, sums[0]), (model.words, lex, sums[1]), (model.moves, move, sums[2])):
        total += g * g
        weight += rate * g / np.sqrt(total)


@dataclass
class Verdict:
    """What is known of a text: sums of marginals and of largest marginals over its words, and its runs of labels."""

    total: np.ndarray
    sure: float
    words: int
    letters: bool
    runs: list[list[int]]  # start, end, label

    def add(self, post: np.ndarray, letters: bool) -> None:
        best = post.argmax(axis=1)
        cuts = np.flatnonzero(np.diff(best, prepend=-1))
        for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(best)], strict=True):
            if self.runs and self.runs[-1][2] == best[s]:
                self.runs[-1][1] = self.words + e
            else:
                self.runs.append([self.words + s, self.words + e, int(best[s])])
        self.total += post.sum(axis=0)
        self.sure += float(post.max(axis=1).sum()) if len(post) else 0.0
        self.words += len(post)
        self.letters |= letters

    def row(self, labels: list[str]) -> tuple:
        if not self.words or not labels or not self.letters:
            return UNKNOWN, 0.0, 0.0, []
        mean = self.total / self.words
        runs = [{"start": s, "end": e, "lang": labels[i]} for s, e, i in self.runs]
        return labels[int(mean.argmax())], float(min(1.0, mean.max())), min(1.0, self.sure / self.words), runs


def _empty(model: Model) -> Verdict:
    return Verdict(np.zeros(max(1, len(model.labels))), 0.0, 0, False, [])


def _is_letter(text: _Letters, a: int, b: int, raw: bytes) -> bool:
    """Whether words a to b hold a letter: what is not ASCII may be a sign."""
    return bool(text.plain[a:b].any()) or any(c.isalpha() for c in raw.decode("utf-8", "ignore"))


def _judge(texts: list[bytes], model: Model) -> list[tuple]:
    """Prediction, score, sureness and segments of each of a few lower-cased texts."""
    text = _Letters(texts)
    post = marginals(model.emissions(text).astype(np.float64), text.first, model.moves)[0] if model.labels else np.zeros((len(text.start), 1))
    out = []
    for i, raw in enumerate(texts):
        a, b = int(text.first[i]), int(text.first[i + 1])
        found = _empty(model)
        if b > a:
            found.add(post[a:b], _is_letter(text, a, b, raw))
        out.append(found.row(model.labels))
    return out


def _pieces(raw: bytes, size: int) -> Iterator[bytes]:
    """A lower-cased text in pieces that end between words; a word longer than a piece is cut behind a whole character."""
    at = 0
    while at < len(raw):
        end = min(at + size, len(raw))
        cut = end
        while end < len(raw) and cut > at and (raw[cut - 1] >= 128 or 97 <= raw[cut - 1] <= 122):
            cut -= 1
        if cut == at:
            cut = end
            while cut < len(raw) and raw[cut] & 0xC0 == 0x80:
                cut += 1
        yield raw[at:cut]
        at = cut


def _judge_long(raw: bytes, model: Model, size: int) -> tuple:
    """``_judge`` of one long text, piece by piece."""
    found = _empty(model)
    if not model.labels:
        return found.row(model.labels)
    even = np.full(len(model.labels), 1.0 / len(model.labels))
    steps = [transfer(model.emissions(_Letters([p])).astype(np.float64), model.moves) for p in _pieces(raw, size)]
    behind = [even]
    for step in reversed(steps[1:]):
        behind.append(_unit(step @ behind[-1]))
    state = even
    for piece, step, back in zip(_pieces(raw, size), steps, reversed(behind), strict=True):
        text = _Letters([piece])
        if len(text.start):
            post = marginals(model.emissions(text).astype(np.float64), text.first, model.moves, start=state, end=back)[0]
            found.add(post, _is_letter(text, 0, len(text.start), piece))
        state = _unit(state @ step)
    return found.row(model.labels)


_SEGMENTS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
_ADDED = ("lang_pred", "lang_score", "lang_sure", "lang_segments")


def _annotated(batch_iter: Iterator[pa.RecordBatch], model: Model, text_col: str, size: int = _PIECE) -> Iterator[pa.RecordBatch]:
    """Each batch, in pieces, with the result columns behind its own."""
    size = max(1 << 12, size * min(_FEW * _FEW, len(model.labels) ** 2 or 1) // (len(model.labels) ** 2 or 1))
    for batch in batch_iter:
        done = 0
        for keys, texts in batches(((i, (t.as_py() or "").lower().encode()) for i, t in enumerate(batch.column(text_col))), size):
            found = [_judge_long(texts[0], model, size)] if len(texts) == 1 and len(texts[0]) > size else _judge(texts, model)
            piece = batch.slice(done, len(keys))
            done += len(keys)
            kinds = (pa.string(), pa.float64(), pa.float64(), _SEGMENTS)
            made = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*piece.columns, *made], names=[*piece.schema.names, *_ADDED])


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _untrained() -> Model:
    return Model([], np.zeros((1, 1), np.float32), np.zeros(0, U64), np.zeros((1, 1), np.float32), np.zeros((1, 1)))


def train(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample_rows: int = 19_200, rows_per_label: int = 300, least_rows: int = 20,
    passage_chars: int = 4000,
) -> Model:
    """Fit a model on the bounded sample of the labelled rows that are not held out."""
    own = docs.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"), held_out(F.col(id_col)).alias("out"), F.xxhash64(F.col(id_col)).alias("h"))
    own = own.where(~F.col("out") & F.col("label").isNotNull())
    cells = own.where(F.col("text").isNotNull()).groupBy("label", F.pmod("h", F.lit(rows_per_label)).alias("cell")).agg(F.min("h").alias("h"))
    ranked = cells.groupBy("label").agg(F.sort_array(F.collect_list("h")).alias("chosen")).orderBy("label").collect()
    if not ranked:
        return _untrained()
    each = min(rows_per_label, max(least_rows, sample_rows // len(ranked)))
    chosen = [h for r in ranked for h in r["chosen"][:each]]
    start = F.pmod("h", F.greatest(F.length("text") - passage_chars, F.lit(1)).cast("long")).cast("int")
    rows = own.where(F.col("h").isin(chosen)).select("label", F.substring(F.col("text"), start + 1, F.lit(passage_chars)).alias("text"))
    # Rows that repeat an id repeat its hash: the order and the two limits keep the sample bounded and the same in every run.
    place = F.row_number().over(Window.partitionBy("label").orderBy("text"))
    samples = [(r["label"], r["text"]) for r in rows.withColumn("n", place).where(F.col("n") <= each).orderBy("label", "text").collect() if r["text"]]
    return fit(samples) if samples else _untrained()


def annotate(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score``, ``lang_sure`` and ``lang_segments`` (runs of words of one label); columns of these names are replaced."""
    own = docs.drop(*_ADDED)
    added = T._parse_datatype_string("lang_pred string, lang_score double, lang_sure double, lang_segments array<struct<start:long,end:long,lang:string>>").fields
    return own.mapInArrow(lambda it: _annotated(it, model, text_col), T.StructType([*own.schema.fields, *added]))


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score, sure, segments``, a row a document."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return annotate(own, model).select("id", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_sure").alias("sure"), F.col("lang_segments").alias("segments"))
