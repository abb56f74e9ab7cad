"""Exact Jaccard join of documents' word shingles with a signature tree.

A document's set holds its distinct shingles of ``width`` words (A-Z lower-cased); with fewer words, the whole sequence.
Two documents link when the sets' intersection is at least ``percent`` per cent of their union.

Plan
1. Each text is hashed once; documents with equal sets form a class, named by a 128-bit digest. The classes' texts are
   packed compressed into chunks. Chunks send their shingles to buckets once each and get back a byte for each: in how
   many chunks it occurs, on a logarithmic scale. A shingle is shared if two classes have it. A class with fewer than
   ``percent`` per cent of its shingles shared links with none; from here on a class is its shared shingles, by rarity.
2. The other classes are the leaves of a tree, in the order of (size band, smallest hash), so that sets that link stand
   close together. It is cut at quantiles of that order, so that nodes are as full wherever Spark's partitions end; runs of
   at most ``node_rows`` leaves and ``node_tokens`` shingles of a cut are its nodes. Inside a node stands a
   tree of OR-combined bitmaps and size ranges; a traversal against itself drops node pairs whose largest possible
   overlap is too small, as well as those whose members are in one component already, and verifies leaf pairs on the
   sets themselves. A second order (bands and hash moved) does the same, so that a large group of near copies, cut into
   many nodes, is one component before nodes meet.
3. Above the nodes a bitmap with a bit a shingle would fit into no task, so it is kept as its set bits, dealt out by
   shingle, and cut to what decides: a pair that links shares one of the ``n - ceil(percent * n / 100) + 1`` rarest
   shingles of both, and at the first of these the rest of either set bounds the overlap. The tree is traversed from its
   top, level by level and all shingles at once: a pair of nodes stays while, at some shingle, their size ranges, the
   most that can still follow and their components allow a link. What stays of a node pair (the leaves that can link
   with the other node) is a task's group; only there are sets brought together, at most two nodes of them.
4. Links that join components are joined; each document gets the smallest id of its own.

Defined cases: null, empty and wordless texts have empty sets and link with nothing (their component is their own id);
rows that repeat an id are documents of their own with that id; a null id never becomes a component's id unless the
whole component has none; empty tables give no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import connected
from millrace.llm.hashing import U64, Words, batches, bucket_count, by_bucket, mix, table_bytes
from millrace.llm.scratch import discard, fewer, written
from millrace.operators.blocks import placed_among

WIDTH, PERCENT = 5, 80
#: Bytes of input to a chunk of classes.
CHUNK_BYTES = 5 << 18
#: Bytes of shingles, and nodes' worth of rows, to a cut of the tree's leaves.
LEAF_BYTES, CUT_NODES = 4 << 20, 2
#: Bits of a leaf's number below its node's, and of a node's below its partition's.
_LEAF_BITS, _NODE_BITS = 10, 20


def need(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least overlap with a set of ``n`` that a link needs, whatever the other set."""
    return -((-percent * n) // 100)


def shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle hash) of each distinct shingle, by text and then hash."""
    words = Words(texts, lower=True)
    at, (hashed,) = words.windows(width, lanes=1)
    owner = np.searchsorted(words.first, at, side="right") - 1
    count = words.counts()
    short = np.flatnonzero((count > 0) & (count < width))
    whole = np.fromiter((_sequence(words.hash[words.first[i] : words.first[i + 1]]) for i in short), U64, len(short))
    owner, hashed = np.concatenate((owner, short)), np.concatenate((hashed, whole))
    order = np.lexsort((hashed, owner))
    owner, hashed = owner[order], hashed[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashed[1:] != hashed[:-1])
    return owner[new], hashed[new]


def _sequence(hashes: np.ndarray) -> np.uint64:
    out = U64(len(hashes))
    for h in hashes:
        out = mix(np.array([out ^ h]))[0]
    return out


def _digests(n: int, owner: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, list[bytes | None]]:
    """Set sizes and 128-bit digests; no digest for an empty set."""
    size = np.bincount(owner, minlength=n)
    sums = []
    for salt in (0x51, 0xC3):
        value = np.zeros(n, U64)
        np.add.at(value, owner, mix(hashed ^ U64(salt * 0x0123456789ABCDEF & (1 << 64) - 1)))
        sums.append(mix(value + size.astype(U64)))
    raw = np.stack(sums, axis=1).tobytes()
    return size, [raw[16 * i : 16 * i + 16] if size[i] else None for i in range(n)]


def _classes(batch_iter: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A row a document: id and hash of its text, set size, digest, and its text compressed where its class is new in this batch."""
    pack = zstandard.ZstdCompressor(level=1)

    def rows():
        for batch in batch_iter:
            for key, text, hashed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                yield (key, hashed), (text.as_py() or "").encode()

    for keys, texts in batches(rows()):
        size, digests = _digests(len(texts), *shingles(texts, width))
        met, bodies = {None}, []
        for text, digest in zip(texts, digests, strict=True):
            bodies.append(None if digest in met else pack.compress(text))
            met.add(digest)
        yield pa.RecordBatch.from_pydict({
            "id": pa.array([k for k, _ in keys], pa.int64()), "text_hash": pa.array([h for _, h in keys], pa.int64()), "n": pa.array(size, pa.int64()),
            "digest": pa.array(digests, pa.binary()), "body": pa.array(bodies, pa.binary()),
        })


def _chunk(table: pa.Table) -> pa.Table:
    """One chunk: its classes once each, in the order of their digests."""
    found = dict(zip(table.column("digest").to_pylist(), table.column("body").to_pylist(), strict=True))
    digests = sorted(found)
    return pa.table({
        "chunk": pa.array([table.column("chunk")[0].as_py()], pa.int64()), "digests": pa.array([digests], pa.list_(pa.binary())),
        "bodies": pa.array([[found[d] for d in digests]], pa.list_(pa.binary())),
    })


def _sets(bodies: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    unpack = zstandard.ZstdDecompressor()
    return shingles([unpack.decompress(b) for b in bodies], width)


def _bucket(token: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(token) % U64(buckets)).astype(np.int64)


def _send(batch_iter: Iterator[pa.RecordBatch], width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Each chunk's distinct shingles by bucket, four bytes of each: a clash only makes a rare shingle look shared."""
    for batch in batch_iter:
        for row in batch.to_pylist():
            token = np.unique(_sets(row["bodies"], width)[1])
            out = [(b, mix(~token[i]).astype(np.uint32).tobytes()) for b, i in by_bucket(_bucket(token, buckets))]
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array([b for b, _ in out], pa.int64()), "chunk": pa.array([row["chunk"]] * len(out), pa.int64()), "parts": pa.array([x for _, x in out], pa.binary()),
            })


def _level(count: np.ndarray) -> np.ndarray:
    """How common a shingle is, on a logarithmic scale: 0 if it occurs once."""
    return np.minimum(8 * np.log2(count), 255).astype(np.uint8)


def _judge(table: pa.Table) -> pa.Table:
    """Of one bucket: for each chunk a byte for each of its shingles, eight times the binary logarithm of the chunks that have it."""
    sent = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("parts")]
    _, back, count = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
    levels = np.split(_level(count)[back], np.cumsum([len(x) for x in sent])[:-1])
    some = [i for i, x in enumerate(levels) if x.any()]
    return pa.table({
        "chunk": pa.array([table.column("chunk")[i].as_py() for i in some], pa.int64()), "bucket": pa.array([table.column("bucket")[i].as_py() for i in some], pa.int64()),
        "levels": pa.array([levels[i].tobytes() for i in some], pa.binary()),
    })


def _able(chunks: pa.Table, answers: pa.Table, width: int, percent: int, buckets: int) -> pa.Table:
    """The classes that can link at all, with their shared shingles from rare to common and two smallest hashes."""
    got = {b: np.frombuffer(x, np.uint8) for b, x in zip(answers.column("bucket").to_pylist(), answers.column("levels").to_pylist(), strict=True)}
    out: dict[str, list] = {"digest": [], "n": [], "key": [], "key2": [], "tokens": []}
    for row in chunks.to_pylist():
        owner, hashed = _sets(row["bodies"], width)
        distinct, back, count = np.unique(hashed, return_inverse=True, return_counts=True)
        # Of a shingle that no other chunk has, the classes here are all there are; else the bucket's answer is what all go by.
        level = _level(count)
        for b, i in by_bucket(_bucket(distinct, buckets)):
            if b in got:
                level[i] = np.where(got[b] > 0, got[b], level[i])
        level = level[back]
        size = np.bincount(owner, minlength=len(row["digests"]))
        common = np.bincount(owner[level > 0], minlength=len(size))
        mine = (level > 0) & np.repeat(common >= need(size, percent), size)
        owner, hashed, level = owner[mine], hashed[mine], level[mine]
        hashed = hashed[np.lexsort((hashed, level, owner))]
        for i, tokens in zip(np.unique(owner).tolist(), np.split(hashed, np.flatnonzero(np.diff(owner)) + 1), strict=True):
            out["digest"].append(row["digests"][i])
            out["n"].append(int(size[i]))
            for k, salt in (("key", 0x2545F4914F6CDD1D), ("key2", 0x369DEA0F31A53F85)):
                out[k].append(int(mix(tokens ^ U64(salt)).min() >> U64(1)))
            out["tokens"].append(tokens.tobytes())
    return pa.table(out, schema=pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("key", pa.int64()), ("key2", pa.int64()), ("tokens", pa.binary())]))


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


class SignatureTree:
    """Sets under nodes of ``fan`` children with OR-combined bitmaps and size ranges.

    ``sizes`` may be larger than the sets where these leave out what no other set has.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray | None = None, fan: int = 8):
        self.sets, self.fan = sets, fan
        own = np.array([len(s) for s in sets])
        bits = 1 << int(max(6, min(16, np.ceil(np.log2(4 * max(1, own.max()))))))
        maps = np.zeros((len(sets), bits // 64), U64)
        for row, s in zip(maps, sets, strict=True):
            flags = np.zeros(bits, bool)
            flags[(mix(s) % U64(bits)).astype(np.int64)] = True
            row[:] = np.packbits(flags).view(U64)
        low = self.sizes = own if sizes is None else np.asarray(sizes, np.int64)
        slack = own - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        #: By level, leaves first: bitmaps, least and largest size, most tokens beyond one a bit.
        self.levels = [(maps, low, low, slack)]
        while len(low) > 1:
            cuts = np.arange(0, len(low), fan)
            maps, slack = np.bitwise_or.reduceat(maps, cuts, axis=0), np.maximum.reduceat(slack, cuts)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(self.levels[-1][2], cuts)
            self.levels.append((maps, low, high, slack))

    def links(self, percent: int, forest: _Forest, sides: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
        """Linked pairs (i, j) that join two components of ``forest``; with ``sides``, only pairs from different sides.

        The sets have to be sorted.
        """
        top = len(self.levels) - 1
        stack = [(top, 0, 0)]
        while stack:
            level, a, b = stack.pop()
            if level == 0:
                if a != b and (sides is None or sides[a] != sides[b]) and forest.find(a) != forest.find(b) and self._linked(a, b, percent):
                    forest.join(a, b)
                    yield a, b
                continue
            maps, low, high, slack = self.levels[level - 1]
            left = np.arange(a * self.fan, min((a + 1) * self.fan, len(low)))
            right = left if a == b else np.arange(b * self.fan, min((b + 1) * self.fan, len(low)))
            most = np.bitwise_count(maps[left, None] & maps[None, right]).sum(axis=2, dtype=np.int64) + np.minimum(slack[left, None], slack[None, right])
            least = low[left, None] + low[None, right]
            # |x & y| >= percent / 100 * |x | y|  <=>  (100 + percent) * |x & y| >= percent * (|x| + |y|)
            fits = (100 + percent) * most >= percent * least
            fits &= (100 * high[left, None] >= percent * low[None, right]) & (100 * high[None, right] >= percent * low[left, None])
            for i, j in np.argwhere(fits).tolist():
                x, y = int(left[i]), int(right[j])
                if x <= y and not self._one(level - 1, x, y, forest):
                    stack.append((level - 1, x, y))

    def _one(self, level: int, x: int, y: int, forest: _Forest) -> bool:
        """Whether all members of both nodes are in one component already."""
        if level > 1:
            return False
        span = self.fan**level
        roots = {forest.find(i) for n in (x, y) for i in range(n * span, min((n + 1) * span, len(self.sets)))}
        return len(roots) == 1 and level + (x != y) > 0

    def _linked(self, a: int, b: int, percent: int) -> bool:
        x, y = self.sets[a], self.sets[b]
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= percent * int(self.sizes[a] + self.sizes[b] - both)


def _band(n: str, percent: int, shift: float) -> Column:
    """Sizes that can link are in one band or in neighbouring ones."""
    return F.floor(F.log(F.col(n).cast("double")) / float(np.log(max(1.05, 100 / percent))) + shift)


def _cut(rows: DataFrame, band: Column, key: str, tie: str, cuts: int) -> DataFrame:
    """``rows`` with ``cut`` and their ``band``, dealt out by cut: ranges, about equal in rows, of band, key and a hash of what breaks ties.

    The order is a number that a double holds exactly: nine bits, 24 and 20.
    """
    at = F.shiftleft(F.least(band.cast("long"), F.lit(511).cast("long")), 44) + F.shiftleft(F.shiftright(key, 39), 20) + F.pmod(F.xxhash64(tie), F.lit(1 << 20))
    rows = rows.withColumns({"band": band.cast("long"), "at": at})
    shares = F.split(F.lit(",".join(str(i / cuts) for i in range(1, cuts))), ",").cast("array<double>")
    bounds = (rows.agg(F.percentile_approx("at", shares, max(10_000, 10 * cuts))).first()[0] or []) if cuts > 1 else []
    return placed_among(rows, F.col("at"), sorted({int(b) for b in bounds}), "cut").drop("at").repartitionByRange(cuts, "cut")


def _runs(cut: pa.Table, order: tuple[str, ...], rows: int, tokens: int) -> Iterator[list[dict]]:
    """The rows of a cut in order, in runs of at most so many rows and shingles (one larger row is a run of its own)."""
    run: list[dict] = []
    held = 0
    for batch in cut.sort_by([(c, "ascending") for c in order]).to_batches(max_chunksize=1024):
        for row in batch.to_pylist():
            size = len(row["tokens"]) // 8
            if run and (len(run) >= rows or held + size > tokens):
                yield run
                run, held = [], 0
            run.append(row)
            held += size
    if run:
        yield run


def _linked(run: list[dict], percent: int, forest: _Forest | None = None, sides: list[int] | None = None) -> list[tuple[int, int]]:
    """Spanning links of a run, as places in it."""
    sets = [np.sort(np.frombuffer(r["tokens"], U64)) for r in run]
    # Neighbours in the tree share their smallest hash where they can, then come by size.
    order = sorted(range(len(run)), key=lambda i: (int(sets[i][0]) if len(sets[i]) else 0, run[i]["n"]))
    place = {i: k for k, i in enumerate(order)}
    inner = _Forest(len(run))
    if forest is not None:
        for i in range(len(run)):
            inner.join(place[i], place[forest.find(i)])
    tree = SignatureTree([sets[i] for i in order], np.array([run[i]["n"] for i in order]))
    apart = np.array([sides[i] for i in order]) if sides else None
    return [(order[x], order[y]) for x, y in tree.links(percent, inner, apart)]


def _grow(cut: pa.Table, percent: int, rows: int, tokens: int) -> pa.Table:
    """Number the leaves, ``who``, by node; a leaf has its links to others of its node."""
    part = cut.column("cut")[0].as_py()
    out: dict[str, list] = {name: [] for name in ("who", "digest", "n", "key2", "tokens", "links")}
    for seq, run in enumerate(_runs(cut, ("band", "key", "digest"), rows, tokens)):
        first = ((part << _NODE_BITS) + seq) << _LEAF_BITS
        links: list[list[int]] = [[] for _ in run]
        for i, j in _linked(run, percent):
            links[i].append(first + j)
        out["who"] += [first + i for i in range(len(run))]
        out["links"] += links
        for name in ("digest", "n", "key2", "tokens"):
            out[name] += [r[name] for r in run]
    kinds = [("who", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("key2", pa.int64()), ("tokens", pa.binary()), ("links", pa.list_(pa.int64()))]
    return pa.table(out, schema=pa.schema(kinds))


def _regrow(cut: pa.Table, percent: int, rows: int, tokens: int) -> pa.Table:
    """Links of the second order."""
    found = [(run[i]["who"], run[j]["who"]) for run in _runs(cut, ("band", "key2", "who"), rows, tokens) for i, j in _linked(run, percent)]
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _bits(batch_iter: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The deciding shingles of each leaf, with the number of its shingles behind each."""
    for batch in batch_iter:
        for row in batch.to_pylist():
            tokens, n = np.frombuffer(row["tokens"], np.int64), row["n"]
            alone = n - len(tokens)
            token = tokens[: max(0, n - need(n, percent) + 1 - alone)]
            k = len(token)
            yield pa.RecordBatch.from_pydict({
                "token": pa.array(token, pa.int64()), "who": pa.array(np.full(k, row["who"]), pa.int64()), "comp": pa.array(np.full(k, row["comp"]), pa.int64()),
                "n": pa.array(np.full(k, n), pa.int64()), "rest": pa.array(n - alone - 1 - np.arange(k), pa.int64()),
            })


def _cells(bits: DataFrame, shift: int) -> DataFrame:
    """By shingle and tree node ``shift`` bits above the nodes: size range, most that follows, and range of components."""
    cell = F.shiftright("who", _LEAF_BITS + shift).alias("cell")
    return bits.groupBy("token", cell).agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("rest"), F.min("comp").alias("c0"), F.max("comp").alias("c1")
    )


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether sets of two sides (aliases of rows with the columns of ``_cells``) can link at their shingle."""
    x, y = (lambda c, s=s: F.col(f"{s}.{c}") for s in (a, b))
    sizes = (100 * x("high") >= percent * y("low")) & (100 * y("high") >= percent * x("low"))
    most = (100 + percent) * (1 + F.least(x("rest"), y("rest"))) >= percent * (x("low") + y("low"))
    apart = (F.least(x("c0"), y("c0")) != F.greatest(x("c1"), y("c1")))
    return sizes & most & apart


def _meetings(bits: DataFrame, parts: int, percent: int) -> DataFrame:
    """``a, b, who``: of each pair of nodes (a < b) that may hold a link, the leaves that may be in one."""
    ranges = bits.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where(F.col("c0") != F.col("c1"))
    few = fewer(bits.sparkSession)
    bits = written(bits.join(ranges.select("token"), "token"), "bits", few)
    top = _NODE_BITS + max(0, (parts - 1).bit_length() - 5)
    levels = [*range(top, _NODE_BITS, -6), _NODE_BITS, 0]
    pairs, above = None, top
    for shift in levels:
        cells = _cells(bits, shift)
        if pairs is None:
            found = cells.alias("x").join(cells.alias("y"), F.col("x.token") == F.col("y.token"))
        else:
            up = F.shiftright("cell", above - shift).alias("up")
            kids = cells.select("*", up)
            half = pairs.alias("p").join(kids.alias("x"), (F.col("p.token") == F.col("x.token")) & (F.col("p.a") == F.col("x.up"))).select("p.b", "x.*")
            found = half.alias("x").join(kids.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.b") == F.col("y.up")))
        order = F.col("x.cell") < F.col("y.cell") if shift == 0 else F.col("x.cell") <= F.col("y.cell")
        found = found.where(order & _may_link("x", "y", percent))
        if shift:
            pairs, above = written(found.select("x.token", F.col("x.cell").alias("a"), F.col("y.cell").alias("b")), "node_pairs", few), shift
    met = written(found.select(
        "x.token", F.col("x.cell").alias("a"), F.col("y.cell").alias("b"), F.struct("x.low", "x.high", "x.rest", "x.c0", "x.c1").alias("x"), F.struct("y.low", "y.high", "y.rest", "y.c0", "y.c1").alias("y")
    ), "node_pairs", few)
    # Inside a pair of nodes the components meet, so that a large one that both hold does not hide the few sets apart from it.
    leaves = bits.select("token", "who", F.shiftright("who", _LEAF_BITS).alias("node"), F.col("n").alias("low"), F.col("n").alias("high"), "rest", F.col("comp").alias("c0"), F.col("comp").alias("c1"))
    groups = leaves.groupBy("token", "node", "c0").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("rest").alias("rest")).withColumn("c1", F.col("c0"))
    there = {own: met.select("token", "a", "b", F.col(own).alias("node"), f"{other}.*") for own, other in (("a", "y"), ("b", "x"))}

    def against(rows: DataFrame, others: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        """The rows that may link with what stands against them at the same shingle."""
        same = [F.col(f"l.{k}") == F.col(f"o.{k}") for k in keys]
        return rows.alias("l").join(others.alias("o"), same).where(_may_link("l", "o", percent))

    sides = {own: against(groups, there[own], ("token", "node")).select("o.a", "o.b", "l.*") for own in ("a", "b")}
    apart = written(against(sides["a"].drop("node"), sides["b"].drop("node"), ("token", "a", "b")).select(
        "l.token", "l.a", "l.b", F.struct("l.low", "l.high", "l.rest", "l.c0").alias("x"), F.struct("o.low", "o.high", "o.rest", "o.c0").alias("y")
    ), "components", few)
    out = []
    for own, mine, other in (("a", "x", "y"), ("b", "y", "x")):
        cells = apart.groupBy("token", "a", "b", F.col(f"{mine}.c0").alias("comp")).agg(
            F.min(f"{other}.low").alias("low"), F.max(f"{other}.high").alias("high"), F.max(f"{other}.rest").alias("rest"), F.min(f"{other}.c0").alias("c0"), F.max(f"{other}.c0").alias("c1")
        )
        there = cells.withColumn("node", F.col(own))
        out.append(against(leaves.withColumn("comp", F.col("c0")), there, ("token", "node", "comp")).select("o.a", "o.b", "l.who"))
    return out[0].union(out[1]).distinct()


def _meet(table: pa.Table, percent: int) -> pa.Table:
    """Links between the two nodes of each pair in one pack."""
    table = table.sort_by([("a", "ascending"), ("b", "ascending"), ("who", "ascending")])
    left, right = np.asarray(table.column("a")), np.asarray(table.column("b"))
    cuts = np.flatnonzero(np.concatenate(([True], (left[1:] != left[:-1]) | (right[1:] != right[:-1]), [True])))
    out: list[tuple[int, int]] = []
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        run = table.slice(s, e - s).to_pylist()
        forest, first = _Forest(len(run)), {}
        for i, r in enumerate(run):
            forest.join(first.setdefault(r["comp"], i), i)
        sides = [r["who"] >> _LEAF_BITS for r in run]
        out += [(run[i]["who"], run[j]["who"]) for i, j in _linked(run, percent, forest, sides)]
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _with_comp(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with ``comp``, the component of their ``who``: itself where it has no link."""
    return rows.join(groups.select(F.col("node").alias("who"), "root"), "who", "left").withColumn("comp", F.coalesce("root", "who")).drop("root")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, node_rows: int = 512, node_tokens: int = 1 << 18,
) -> DataFrame:
    """``id, n_shingles, component_id, text_hash, group``, a row a document. ``node_rows`` is at most 1024.

    ``text_hash`` is ``xxhash64`` of the text, to tell apart rows that repeat an id; ``group`` names the component, also where no
    document of it has an id, and is null for empty sets.
    """
    if not 0 < node_rows <= 1 << _LEAF_BITS:
        raise ValueError(f"node_rows must be from 1 to {1 << _LEAF_BITS}")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    size = table_bytes(docs)
    buckets = bucket_count(size, 16)
    whole = written(own.mapInArrow(lambda it: _classes(it, width), "id long, text_hash long, n long, digest binary, body binary"), "sets")
    number = bucket_count(size, 1, CHUNK_BYTES)
    packed = whole.where(F.col("body").isNotNull()).select("digest", "body", F.pmod(F.xxhash64("digest"), F.lit(number)).alias("chunk"))
    chunks = written(packed.groupBy("chunk").applyInArrow(_chunk, "chunk long, digests array<binary>, bodies array<binary>"), "chunks")
    sets = written(whole.select("id", "text_hash", "n", "digest"), "classes")
    discard(whole)
    sent = chunks.mapInArrow(lambda it: _send(it, width, buckets), "bucket long, chunk long, parts binary")
    answers = sent.groupBy("bucket").applyInArrow(_judge, "chunk long, bucket long, levels binary")
    able = written(chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        lambda c, x: _able(c, x, width, percent, buckets), "digest binary, n long, key long, key2 long, tokens binary"
    ), "able")
    discard(chunks)

    held, number = able.agg(F.coalesce(F.sum(F.octet_length("tokens")), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(bucket_count(held, 1, LEAF_BYTES), bucket_count(number, 1, CUT_NODES * node_rows))
    leaves = written(_cut(able, _band("n", percent, 0.0), "key", "digest", parts).groupBy("cut").applyInArrow(
        lambda t: _grow(t, percent, node_rows, node_tokens), "who long, digest binary, n long, key2 long, tokens binary, links array<long>"
    ), "leaves")
    discard(able)
    second = _cut(leaves.select("who", "n", "key2", "tokens"), _band("n", percent, 0.5), "key2", "who", parts).groupBy("cut").applyInArrow(
        lambda t: _regrow(t, percent, node_rows, node_tokens), "a long, b long"
    )
    groups = connected(leaves.select(F.col("who").alias("a"), F.explode("links").alias("b")).union(second), "links")

    bits = written(_with_comp(leaves.select("who", "n", "tokens"), groups).mapInArrow(lambda it: _bits(it, percent), "token long, who long, comp long, n long, rest long"), "bits")
    met = written(_meetings(bits, parts, percent), "meetings", fewer(docs.sparkSession))
    brought = _with_comp(met.join(leaves.select("who", "n", "tokens"), "who"), groups)
    weight = met.join(leaves.select("who", "n"), "who").agg(F.sum("n")).first()[0] or 0
    packs = bucket_count(8 * weight, 1, LEAF_BYTES)
    links = brought.withColumn("pack", F.pmod(F.xxhash64("a", "b"), F.lit(packs))).groupBy("pack").applyInArrow(lambda t: _meet(t, percent), "a long, b long")
    groups = connected(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links), "links")

    grouped = _with_comp(leaves.select("digest", "who"), groups).select(F.col("digest").alias("d"), "comp")
    firsts = sets.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("id").alias("first"))
    rooted = firsts.join(grouped, F.col("digest") == F.col("d"), "left").select("digest", "first", "comp")
    least = rooted.where(F.col("comp").isNotNull()).groupBy("comp").agg(F.min("first").alias("least"))
    named = rooted.join(least, "comp", "left").select(
        F.col("digest").alias("d"), F.when(F.col("comp").isNull(), F.col("first")).otherwise(F.col("least")).alias("component"),
        F.coalesce(F.col("comp").cast("string"), F.hex("digest")).alias("group"),
    )
    # A plain scan on this side, so that Spark can cut the class of a great many copies on the other.
    named = written(named, "named")
    return (
        sets.join(named, F.col("digest") == F.col("d"), "left")
        .select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), "text_hash", "group")
    )
