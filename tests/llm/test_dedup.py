"""Line, near-duplicate and substring deduplication against brute force, with the hard cases in the fixture."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from millrace.llm import components, hashing, jaccard_join, line_dedup, queries, substring_dedup
from millrace.llm.components import connected

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, n_lines string, h1 int"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", s or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocab = ["wörd", "Alpha", "beta", "ÉTÉ", "x y", "z q", "the", "\u001cfs", *(f"w{i}" for i in range(400))]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, line = make(60), "A line that Many documents hold, ÀÉ"
    base = [make(rng.randint(30, 120)) for _ in range(12)]
    texts = list(base)
    for b in base[:5]:
        w = b.split(" ")
        w[3] = "changed"
        texts.append(" ".join(w))
    for b in base[5:8]:
        texts.append(b.replace(" ", "  \n").upper())
    texts += [base[0] + " " + passage, base[9] + "\n" + passage + "\ttail", passage, base[0]]
    texts += [f"\n{line}\nx{i}\n  {lower(line)}\t\n{make(5)}" for i in range(5)] + [line + "\r"] * 2
    texts += [None, "", " \n ", "one two", "One  TWO", "one two three", "\n\n", make(4000), "same " * 80]
    out = [(i * 3, t, "clash", i) for i, t in enumerate(texts)]
    return [*out, out[0], (None, base[1], None, 1)]


@pytest.mark.parametrize("bound", [64 << 20, 0])
def test_line_dedup(spark, rows, bound):
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA), broadcast_bytes=bound).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    holders = {}
    for doc, text, *_ in rows:
        for x in (text or "").split("\n"):
            key = lower(x.strip(SPACE))
            if len(key) >= 20:
                holders.setdefault(key, set()).add(doc)
    want = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = []
        for x in lines:
            h = holders.get(lower(x.strip(SPACE)), set())
            if len(h) < 3 or doc == max(h - {None}, default=None):
                kept.append(x)
        want.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert any(r["n_dropped"] for r in got)
    bitmaps = line_dedup.keep_bitmaps(spark.createDataFrame(rows, SCHEMA)).collect()
    assert bitmaps and all(sum(x["len"] for x in r["drop_runs"]) == r["n_dropped"] for r in bitmaps)


def shingles(text):
    w = [lower(x) for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize(("node", "tokens"), [(512, 1 << 18), (3, 1 << 18), (1, 1)])
def test_near_duplicates(spark, rows, node, tokens):
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, SCHEMA), node_rows=node, node_tokens=tokens).select("id", "n_shingles", "component_id").collect()
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            up[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    want = [(r[0], len(sets[i]), min((d for d in groups[find(i)] if d is not None), default=None)) for i, r in enumerate(rows)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_signature_tree_finds_every_link():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, int(rng.integers(5, 40)), replace=False)) for _ in range(150)]
    tree, forest = jaccard_join.SignatureTree(sets, fan=4), jaccard_join._Forest(150)
    list(tree.links(50, forest))
    plain = jaccard_join._Forest(150)
    for i, j in itertools.combinations(range(150), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 100 * both >= 50 * (len(sets[i]) + len(sets[j]) - both):
            plain.join(i, j)
    assert [forest.find(i) for i in range(150)] == [plain.find(i) for i in range(150)]


@pytest.mark.parametrize("salts", [4, 16])
def test_components_of_wide_nodes(spark, monkeypatch, salts):
    monkeypatch.setattr(components, "_salts", lambda edges: salts)
    edges = spark.range(1, 120_000).selectExpr("id AS a", "0L AS b").union(spark.createDataFrame([(200_001, 200_000), (200_001, 5)], "a long, b long"))
    got = connected(edges)
    assert got.count() == 120_001 and got.where("root <> 0").isEmpty()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (100, 60), (60, 60), (None, 3), (200, 300), (300, 200)]
    got = dict(map(tuple, connected(spark.createDataFrame(edges, "a long, b long").dropna()).collect()))
    assert got == {i: 0 for i in range(1, 41)} | {100: 50, 60: 50, 300: 200}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("width", "chunk"), [(35, 1 << 21), (7, 700)])
def test_substring_dedup(spark, rows, width, chunk):
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA), width=width, chunk_bytes=chunk).collect()
    split = [words(r[1]) for r in rows]
    count = {}
    for w in split:
        for i in range(len(w) - width + 1):
            count[tuple(w[i : i + width])] = count.get(tuple(w[i : i + width]), 0) + 1
    want = []
    for (doc, *_), w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone |= set(range(i, i + width))
        want.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(want, key=key)
    assert any(r[2] for r in want)


def test_word_hashes_are_those_of_the_words():
    texts = [b"a bb  ccc\x0bdd", b"", b" bb a ", "é é".encode()]
    w = hashing.Words(texts)
    assert w.counts().tolist() == [4, 0, 2, 1]
    assert w.hash[0] == w.hash[5] and w.hash[1] == w.hash[4] and len(set(w.hash.tolist())) == 5
    at, (one, two) = hashing.Words([b"a b c a b", b"a b"]).windows(2)
    assert at.tolist() == [0, 1, 2, 3, 5] and one[0] == one[3] == one[4] != one[1] and two[0] == two[4]


@pytest.mark.parametrize("op", ["line", "jaccard", "substring"])
def test_empty_tables(spark, op):
    empty = spark.createDataFrame([], SCHEMA)
    run = {"line": line_dedup.dedup_lines, "jaccard": jaccard_join.near_duplicates, "substring": substring_dedup.remove_repeats}[op]
    assert run(empty).count() == 0


def test_registered_digest(spark, tmp_path):
    spark.createDataFrame([(1, "a\nb")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    row = queries.op2_line_dedup(spark, str(tmp_path)).first()
    assert row["kept_sha256"] == hashlib.sha256(b"a\nb").hexdigest() and row["n_lines"] == 2


def test_hot_shingles_meet_in_proportion(spark):
    """A passage in every document, copies of it included: what the nodes' meeting makes grows with the rows, not their square."""
    made = {}
    for n in (400, 1600):
        rng = random.Random(n)
        own = [" ".join(rng.choice("abcdefghijklmnop") + str(rng.randint(0, 10**6)) for _ in range(30)) for _ in range(n // 2)]
        passage = " ".join(f"p{i}" for i in range(200))
        texts = [f"{x} {passage}" for x in own] + [f"{x} {passage} {i}" for i, x in enumerate(own)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        whole, meetings = [], jaccard_join._meetings
        try:
            jaccard_join._meetings = lambda *a: whole.append(meetings(*a).cache()) or whole[-1]
            got = jaccard_join.near_duplicates(docs, node_rows=16).select("component_id").distinct().count()
        finally:
            jaccard_join._meetings = meetings
        made[n] = whole[0].count()
        assert got == n // 2  # the passage alone is 196 of some 256 shingles of two texts
    assert made[1600] <= 8 * max(made[400], 100)


def test_nodes_are_as_full_however_many_partitions_there_are(spark, monkeypatch):
    """A group of near copies, some of them apart from it: with more partitions than it needs its leaves stay in few nodes, as every pair of nodes meets."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(300):
        words = list(base)
        for at in rng.sample(range(60), 1 if i % 3 else 3):
            words[at] = f"x{i}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame = type(docs)
    plain, meetings, nodes = frame.repartitionByRange, jaccard_join._meetings, []
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, n, *by: plain(self, max(n, 40), *by))
    monkeypatch.setattr(jaccard_join, "_meetings", lambda bits, *a: nodes.append({r[0] >> 10 for r in bits.select("who").distinct().collect()}) or meetings(bits, *a))
    found = {r["id"]: r["component_id"] for r in jaccard_join.near_duplicates(docs).collect()}
    assert len(nodes[0]) == 1
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            up[max(find(i), find(j))] = min(find(i), find(j))
    assert found == {i: find(i) for i in range(len(texts))}
    assert 1 < len(set(found.values())) < 300
