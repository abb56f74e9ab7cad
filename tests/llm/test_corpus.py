"""Decontamination, mixing, quality, PII, WARC, vectors, language and the pipeline."""

import hashlib
import io
import itertools
import math
import random
import re
import string
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from millrace.llm import decontaminate, hashing, language_id, mixing, nearest, pii, quality, queries, warc


def doc_words(s):
    s = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", s)


@pytest.mark.parametrize("bound", [500_000, 0])
def test_contamination(spark, bound):
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(80)] + ["É", "the", "ünï"]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, make(n)) for i, n in enumerate((30, 14, 13, 5, 1, 20))] + [(7, None), (8, "!!"), (9, ""), (10, make(25)), (None, make(15))]
    text = {i: t for i, t in items if t}
    docs = [(1, make(50) + " " + text[0].upper() + " " + make(3)), (2, text[1] + "," + text[2]), (3, make(400) + " " + text[2] + " " + make(10)), (4, None), (5, ""), (6, text[3]), (7, text[0][:60]),
            (8, " ".join([text[5]] * 3)), (9, make(3000)), (1, text[10]), (None, text[2]), (8, " ".join([text[5]] * 3)), (11, items[-1][1])]
    got = decontaminate.contamination(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=bound)
    wins = {}
    for i, t in items:
        w = doc_words(t)
        for k in range(max(1, len(w) - 12)) if w else ():
            wins.setdefault(tuple(w[k : k + 13]), set()).add(None if i is None else str(i))
    want = []
    for doc, t in docs:
        w, hit, found = doc_words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[x]
        want.append((doc, len(w), len(hit), len(found), sorted(x for x in found if x is not None), bool(hit) and 20 * len(hit) >= len(w)))
    rows = got.select("doc_id", "n_words", "n_hit", "n_items", "item_ids", "contaminated").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), empty).where("n_hit > 0 OR contaminated").count() == 0


def test_share_out(spark):
    def shares(total, weights, limits):
        rows = spark.createDataFrame([(i, float(w), float(x)) for i, (w, x) in enumerate(zip(weights, limits, strict=True))], "i int, weight double, limit double")
        return [r["target"] for r in sorted(mixing.share_out(rows, total).collect())]

    assert shares(15, [5, 2, 1], [6, 20, 20]) == [6, 6, 3]
    assert shares(100, [5, 2], [6, 8]) == [6, 8] and shares(0, [5, 2], [6, 8]) == [0, 0] and shares(9, [1, 2], [0, 8]) == [0, 8]


def test_route():
    flow = mixing.route([100, 50, 50], [[0], [0, 1], [1]], [150, 90], 2)
    assert sum(w for (p, s), w in flow.items() if s == 0) == 150 and sum(w for (p, s), w in flow.items() if s == 1) == 90
    # Convex costs: 240 words of 200, so 40 are repeats, and no pattern goes to a third pass.
    used = {p: sum(w for (q, _), w in flow.items() if q == p) for p in range(3)}
    assert sum(max(0, used[p] - c) for p, c in enumerate((100, 50, 50))) == 40 and all(used[p] <= 2 * c for p, c in enumerate((100, 50, 50)))


def test_route_is_cheapest():
    """Against all flows of small networks: as many words as can be, with as few repeats as can be."""
    rng = random.Random(8)
    for _ in range(30):
        members = [sorted(rng.sample(range(2), rng.randint(1, 2))) for _ in range(3)]
        capacity, quotas = [rng.randint(0, 3) for _ in range(3)], [rng.randint(0, 6) for _ in range(2)]
        flow = mixing.route(capacity, members, quotas, 2)
        used = [sum(w for (p, _), w in flow.items() if p == i) for i in range(3)]
        assert all(sum(w for (_, s), w in flow.items() if s == j) <= q for j, q in enumerate(quotas)) and all(u <= 2 * c for u, c in zip(used, capacity, strict=True))
        best = None
        for taken in itertools.product(*(range(2 * c + 1) for c in capacity)):
            # Words of overlapping patterns can be split at will between their two sources.
            fixed = [sum(t for t, m in zip(taken, members, strict=True) if m == [j]) for j in range(2)]
            free = sum(t for t, m in zip(taken, members, strict=True) if len(m) == 2)
            if all(f <= q for f, q in zip(fixed, quotas, strict=True)) and free <= sum(quotas) - sum(fixed):
                cost = (-sum(taken), sum(max(0, t - c) for t, c in zip(taken, capacity, strict=True)))
                best = min(best, cost) if best else cost
        assert best == (-sum(used), sum(max(0, u - c) for u, c in zip(used, capacity, strict=True)))


def test_route_over_many_patterns():
    rng = random.Random(1)
    members = [list(x) for x in itertools.combinations(range(108), 3)]
    capacity = [rng.randint(1, 1000) for _ in members]
    quotas = [int(1.5 * sum(capacity) / 108 * rng.choice([0.2, 1, 2])) for _ in range(108)]
    assert len(members) > 200_000 and sum(mixing.route(capacity, members, quotas, 2).values()) == min(sum(quotas), 2 * sum(capacity))


def test_mix_with_many_patterns(spark):
    """More membership patterns than a driver should see, in one component and in many; each source near its target."""
    from pyspark.sql import functions as F

    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.array(*[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(60))).cast("string") for k in range(3)]).alias("of"))
    lone = spark.range(1_000).select((F.col("id") + 100_000).alias("doc_id"), F.lit("a b").alias("text"), F.array(F.concat(F.lit("s"), F.col("id").cast("string"))).alias("of"))
    out = mixing.mix(rows.union(lone), sources=F.col("of"), share=0.5, weights=(1.0,)).cache()
    assert out.select("sources").distinct().count() > 25_000
    total = out.agg(F.sum("size"), F.sum("taken")).first()
    assert abs(total[1] - 0.5 * total[0]) <= 1_100 and out.where("taken < 0 OR taken > 2 * size").isEmpty()
    alone = out.where("doc_id >= 100000").groupBy("sources").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    assert alone.where(F.abs(F.col("taken") - F.col("target")) > 1).isEmpty()


def test_every_source_is_routed(spark, monkeypatch):
    """Also sources that share no document take their words from a flow, many of them in a task."""
    flows = []
    real = mixing.route
    monkeypatch.setattr(mixing, "route", lambda *a: flows.append(a) or real(*a))
    table = pa.table({
        "group": [1, 2, 2, 2, 5], "sources": [["a"], ["b", "c"], ["b", "c"], ["c"], [None]], "words": [10, 7, 7, 4, 0], "number": [1, 2, 3, 3, 5], "quota": [15, 9, 8, 8, 0], "place": [0, 0, 1, 0, 0],
        "source_size": [10, 7, 7, 11, 0], "target": [15.0, 9.0, 9.0, 8.0, 0.0],
    })
    got = mixing._routed(table, 2).to_pylist()
    assert flows == [([10], [[0]], [15], 2), ([7, 4], [[0, 1], [1]], [9, 8], 2), ([0], [[0]], [0], 2)]
    taken = {(*r["sources"],): r["taken"] for r in got}
    assert taken[("a",)] == 15 and taken[("b", "c")] + taken[("c",)] == 17 and taken[(None,)] == 0 and taken[("b", "c")] >= 9
    monkeypatch.undo()

    def stop(table, passes):
        raise RuntimeError("routed here")

    monkeypatch.setattr(mixing, "_routed", lambda t, n: stop(t, n))
    with pytest.raises(Exception, match="routed here"):
        queries.op4_mixing(spark, "/root/testdata/sf0.001").count()


def test_mix_sorts_few_rows(spark):
    """Edges cut to finer buckets take the same words as one sort of all rows."""
    rows = spark.range(5_000).selectExpr("id AS doc_id", "repeat('w ', cast(id % 7 as int)) AS text", "cast(id % 2 as string) AS source")
    whole = [tuple(r) for r in mixing.mix(rows, bits=1).select("doc_id", "taken").orderBy("doc_id").collect()]
    for options in ({"bits": 1, "edge_rows": 3}, {"bits": 12}, {"bits": 5, "edge_rows": 20}):
        assert whole == [tuple(r) for r in mixing.mix(rows, **options).select("doc_id", "taken").orderBy("doc_id").collect()]


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "b", "b", "b", "c", None]), 1.5) for i in range(300)] + [(3, None, "a", 0.0), (3, None, "a", 0.0), (None, "x y", "d", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target double")
    out = mixing.mix(df).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert len(out) == len(rows) and sorted(map(str, out)) == sorted(map(str, mixing.mix(df.repartition(7)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()))
    taken, target = {}, {r["source"]: r["target"] for r in out}
    for r in out:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target) and math.isclose(sum(target.values()), 1.5 * sum(r["size"] for r in out))
    assert mixing.mix(spark.createDataFrame([], df.schema)).count() == 0
    from pyspark.sql import functions as F

    both = mixing.mix(df, sources=F.array(F.lit("all"), "source")).agg(F.sum("taken")).first()[0]
    assert abs(both - 1.5 * sum(r["size"] for r in out)) <= 5


def test_quality(spark):
    rng = random.Random(2)
    good, bad = ["sun", "sea", "sand"], ["spam", "spam!", "ham"]
    rows = [(i, " ".join(rng.choice(good if i % 3 else bad) for _ in range(20))) for i in range(300)] + [(400, None), (401, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(i,) for i in range(0, 300) if i % 3], "doc_id long")
    out = {r["id"]: r for r in quality.resample(docs, quality.sample_ids(target), share=0.5).collect()}
    assert sum(r["selected"] for r in out.values()) == 151 and all(out[i]["log_weight"] > 0 for i in range(300) if i % 3) and all(out[i]["log_weight"] < 0 for i in range(0, 300, 3))
    assert out[400]["log_weight"] == out[401]["log_weight"] == 0 and not any(out[i]["selected"] for i in range(0, 300, 3))
    ratio = quality.log_ratios(docs.withColumnRenamed("doc_id", "id"), quality.sample_ids(target))
    owner, slot = quality._grams([rows[1][1].encode()], len(ratio))
    assert math.isclose(out[1]["log_weight"], ratio[slot].sum())
    assert quality.resample(docs.limit(0), target).count() == 0
    scores = spark.createDataFrame([(float(x),) for x in [*range(50), 7, 7, 1e9, -1e9]], "s double")
    want = sorted([*range(50), 7, 7, 1e9, -1e9], reverse=True)
    assert all(quality.threshold(scores, "s", k, bins=4, few=3) == want[k - 1] for k in (1, 2, 20, 43, 44, 45, 53))


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def base_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 12 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15):
                out.append((m.start(), n, m.end()))
    return sorted(out)


def test_pii(spark):
    rng = random.Random(9)
    parts = ["a.b@c.de", "x@y.zz%q@r.st", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "0255.1.1.256", "4316522678525456", "4316 5226-7852 5456", "+1 (743) 555-3824", "+12", "é", "😀", " ", ",", "-", "@", "..", "9" * 25, "007.1.2.3", "%", "+", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(150)]
    texts += [None, "", "1" * 30_000, "a" * 30_000 + "@b" + ".c" * 5000, "1.2.3.4 " * 700, "mail me: joe [at] example [dot] com or call (212) 555-0147 now"]
    got = pii.find(spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, spans string")).collect()
    assert len(got) == len(texts)
    for r in got:
        want = base_spans(texts[r["id"]])
        assert [tuple(s) for s in r["base"]] == want, texts[r["id"]][:200]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == i for s in want) for i in range(4)] and set(want) <= {tuple(s) for s in r["spans"]}
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _labelled(rng):
    """(text, spans that are personal data) with true and false candidates of every kind, in and out of context."""
    digit = lambda n, first="123456789": rng.choice(first) + "".join(rng.choice(string.digits) for _ in range(n - 1))
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(3, 9)))

    def card(good):
        body = "4" + digit(14, string.digits)
        last = next(c for c in string.digits if luhn(body + c) == good)
        return body + last

    def one(kind, good, base):
        if kind == "email":
            if base:
                return f"{word()}@{word()}.com"
            return f"{word()} [at] {word()} [dot] org" if good else f"{word()} at {word()}.png"
        if kind == "ip":
            parts = [str(rng.randint(1, 223) if good else rng.randint(256, 999)) for _ in range(4)]
            return ".".join(parts) if base else "[.]".join(parts)
        if kind == "card":
            number = card(good)
            return number if base else "/".join(number[i : i + 4] for i in range(0, 16, 4))
        if base:
            return f"+44 {digit(3)} {digit(3)} {digit(4)}" if good else f"+44 {digit(3)} {digit(3)} {digit(4)} {digit(4)} {digit(4)}"
        return f"({digit(3, '23456789')}) {digit(3)}-{digit(4)}" if good else f"{digit(3, '01')}-{digit(3)}-{digit(4)}"

    naming = {"email": "contact", "ip": "host", "card": "paid by card", "phone": "call"}
    against = {"email": "look", "ip": "version", "card": "order", "phone": "invoice"}
    for n, kind in enumerate(pii.KINDS):
        for _ in range(60):
            base, good = rng.random() < 0.6, rng.random() < 0.6
            good = good or kind == "email" and base
            near = (naming if good else against)[kind] if rng.random() < 0.7 else word()
            found = one(kind, good, base)
            head = f"{word()} {word()}, {near}: "
            yield head + found + f"; {word()}", {(len(head), n, len(head) + len(found))} if good else set()


def test_pii_adds_true_spans(spark):
    rows = list(_labelled(random.Random(4)))
    got = {r["id"]: r for r in pii.find(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")).collect()}
    hit = made = true = 0
    for i, (text, want) in enumerate(rows):
        base, spans = {tuple(s) for s in got[i]["base"]}, {tuple(s) for s in got[i]["spans"]}
        assert base == set(base_spans(text)) and base <= spans, text
        added = spans - base
        hit, made, true = hit + len(added & want), made + len(added), true + len(want - base)
    assert true > 50 and hit >= 0.9 * true and hit >= 0.9 * made, (hit, made, true)


def _plain_em(items, rounds=50):
    """Expectation-maximisation over single spans, not counts: (votes) -> posterior."""
    belief = np.array([0.9 if sum(v) > 0 else 0.1 if sum(v) < 0 else 0.5 for v in items])
    votes = np.array(items)
    for _ in range(rounds):
        prior = (belief.sum() + 1) / (len(items) + 2)
        like = np.array([np.log(1 - prior), np.log(prior)])[:, None] * np.ones(len(items))
        for v in range(votes.shape[1]):
            for truth, share in ((0, 1 - belief), (1, belief)):
                said = {a: share[votes[:, v] == a].sum() + 1 + (a == (1 if truth else -1)) for a in (-1, 1)}
                rates = {0: 1.0} | {a: n / (said[-1] + said[1]) for a, n in said.items()}
                like[truth] += np.log([rates[a] for a in votes[:, v]])
        belief = 1 / (1 + np.exp(like[0] - like[1]))
    return dict(zip(items, belief.tolist(), strict=True))


def test_pii_reliabilities():
    counts = [("phone", (0, 1, 1, 0), (0, 1), 80), ("phone", (0, -1, 0, -1), (0, 1), 60), ("phone", (1, 0, 0, 0), (0, 1), 100), ("phone", (-1, 0, 0, 0), (2, 0), 40), ("phone", (0, 1, 0, 0), (0, 1), 30)]
    post = pii.estimate(counts)
    weight = pii.train(counts, post)
    score = lambda c: sum(weight.get(x, 0.0) for x in pii._inputs(*c[:3]))
    assert post[counts[0][:3]] > 0.9 > 0.1 > post[counts[1][:3]] and score(counts[0]) > 0 > score(counts[1])
    rng = random.Random(3)
    seen = [tuple(rng.choice([-1, 0, 1, good]) for _ in range(4)) for good in [rng.choice([-1, 1]) for _ in range(300)]]
    want = _plain_em(seen)
    grouped = [("card", v, (0, 0), seen.count(v)) for v in sorted(set(seen))]
    assert all(math.isclose(p, want[v], abs_tol=1e-9) for (_, v, _), p in pii.estimate(grouped).items())


def test_pii_classifier():
    """Gradient steps against a plain logistic regression of the same rate on every span by itself."""
    rng = random.Random(5)
    counts = [("ip", tuple(rng.choice([-1, 0, 1]) for _ in range(4)), (rng.randint(0, 2), rng.randint(0, 2)), rng.randint(1, 5)) for _ in range(12)]
    counts = list({c[:3]: c for c in counts}.values())
    post = pii.estimate(counts)
    names = sorted({x for c in counts for x in pii._inputs(*c[:3])})
    x = np.array([[n in pii._inputs(*c[:3]) for n in names] for c in counts for _ in range(c[3])], float)
    y = np.array([post[c[:3]] for c in counts for _ in range(c[3])])
    w = np.zeros(len(names))
    for _ in range(500):
        w = w * (1 - 1e-4) + x.T @ (y - 1 / (1 + np.exp(-x @ w))) / len(y)
    got = pii.train(counts, post)
    assert all(math.isclose(got[n], v, abs_tol=1e-9) for n, v in zip(names, w, strict=True))


@pytest.mark.parametrize("split", [64, 1 << 20])
def test_warc_round_trip(spark, split):
    rng = random.Random(4)
    noise = "".join(rng.choice(string.printable) for _ in range(3000))
    pages = [(1, "u1", noise), (2, "u2", noise), (5, None, "x" * 99), (6, "u\r\nX: y", "x" * 99), (7, "u", None), (8, "u", "é" * 60), (3, "u", "é" * 60), (9, "u", ""), (1, "u1", noise), (None, "u", noise)]
    path = warc.new_path(spark, "warc-test")
    warc.write(warc.plan_records(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)), path)
    got = warc.read(spark, path, split_bytes=split).withColumns({"page": warc.page_of("record_id"), "of": warc.page_of("refers_to")}).collect()
    text = {p[0]: (p[2] or "").encode() for p in pages}
    want = sorted((p[0] or -1, len(text[p[0]]), hashlib.sha256(text[p[0]]).hexdigest(), {2: 1, 8: 3, None: 1}.get(p[0], -1)) for p in pages)
    assert sorted((r["page"] or -1, r["payload_bytes"], r["payload_digest"], r["of"] or -1) for r in got) == want
    assert all((r["record_type"] == "revisit") == (r["of"] is not None) and (r["payload"] is None) == (r["of"] is not None) for r in got)
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_ranges_own_each_record_once():
    inner = warc._record(9, "in", b"nested", hashlib.sha256(b"nested").hexdigest(), None)
    records = [warc._record(i, "u", (b"\x1f\x8b\x08 not a member" + bytes([i])) * 40, "d", None) for i in range(6)]
    data = b"junk\x1f\x8b\x08" + b"".join(records) + b"\x1f\x8b"
    for size in (1, 37, 1000, 10_000):
        offsets = [o for s in range(0, len(data), size) for o, *_ in warc.records_in(io.BytesIO(data), s, min(s + size, len(data)))]
        assert offsets == [7 + sum(len(r) for r in records[:i]) for i in range(6)]
    assert len(inner) > 0 and list(warc.records_in(io.BytesIO(data[: len(records[0])]), 0, 10_000)) == []


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16))
    x[700:1200] = x[700]  # a third of all rows is one vector
    rows = [(int(i), v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(5000, None, 1), (5100, [0.0] * 16, 1), (5200, [1.0] * 3, 1), (5300, [float("nan")] * 16, 1), (5400, [None] * 16, 1), (5500, [float("inf")] + [1.0] * 15, 1), (None, [1.0] * 16, 1), (5600, [], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank int")
    got = nearest.search(df, df.where("vec_id % 100 = 0"), list_rows=50, block_rows=100, block_queries=3).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == set(range(0, 1500, 100))
    hits = 0
    for q, rs in by.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        true = np.lexsort((np.arange(len(x)), d))[:10]
        hits += len({r["vec_id"] for r in rs} & set(true.tolist()))
        assert [r["rank"] for r in rs] == list(range(1, 11)) and all(r["score"] == d[r["vec_id"]] for r in rs)
        assert [(r["score"], r["vec_id"]) for r in rs] == sorted((r["score"], r["vec_id"]) for r in rs)
    assert hits >= 0.9 * 150
    few = df.where("vec_id < 4")
    assert nearest.search(few, few.where("vec_id = 0")).count() == 3 and nearest.search(few.limit(0), few).count() == 0


def _nearest_of(x, ids, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    d[ids == ids[q]] = np.inf
    order = np.lexsort((ids, d))
    return [(int(ids[i]), float(d[i])) for i in order if np.isfinite(d[i])][:k]


def test_nearest_recall_on_embeddings(spark):
    """Every hundredth vector against all of a table, by brute force."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    got = {}
    for r in nearest.search(e, e.where("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    rows = e.orderBy("vec_id").toArrow()
    x, ids = np.array(rows["embedding"].to_pylist(), float), rows["vec_id"].to_numpy()
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        true = _nearest_of(x, ids, q)
        found = dict(got[int(ids[q])])
        assert len(found) == 10 and all(math.isclose(found[i], d, rel_tol=1e-12) for i, d in true if i in found)
        hits, total = hits + sum(i in found for i, _ in true), total + len(true)
    assert hits >= 0.9 * total, hits / total


def test_nearest_recall_of_queries_that_are_not_spread_as_the_rows(spark):
    """Rows in clusters, queries between them."""
    rng = np.random.default_rng(2)
    x = (3 * rng.normal(size=(20, 32)))[rng.integers(0, 20, 6000)] + rng.normal(size=(6000, 32))
    x[::100] = 3 * rng.normal(size=(60, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.search(df, df.where("vec_id % 100 = 0"), list_rows=60).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(got[q] & {i for i, _ in _nearest_of(x, np.arange(6000), q)}) for q in range(0, 6000, 100))
    assert hits >= 0.9 * 600, hits / 600


@pytest.mark.parametrize("offset", [0.0, 1e7, 1e9])
def test_nearest_of_vectors_far_from_the_origin(offset):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8)) + offset
    ids = np.arange(600)
    table = pa.table({"id": ids, "v": [v.tobytes() for v in x]})
    asked = table.slice(0, 40)
    found = nearest._match(table, asked, 10, 8).to_pylist()
    for q in range(40):
        assert [(r["vec_id"], r["score"]) for r in found if r["query_id"] == q] == _nearest_of(x, ids, q)


def test_nearest_of_repeated_short_and_odd_rows(spark):
    from pyspark.sql import functions as F

    # One row very often, so that its hash draws nothing or everything, and a few others.
    many = spark.range(3000).select(F.lit(7).cast("long").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    few = spark.createDataFrame([(i, [float(i), 2.0]) for i in (0, 8, 9)] + [(100, [1.0, 2.5]), (100, [50.0, 2.0])], many.schema)
    got = [tuple(r) for r in nearest.search(many.union(few), many.union(few).where("vec_id % 100 = 0"), sample_rows=500, list_rows=10).orderBy("query_id", "rank").collect()]
    assert [r[2] for r in got if r[0] == 0] == [7, 100, 8, 9]
    assert [r[2] for r in got if r[0] == 100][0] == 7 and len([r for r in got if r[0] == 100]) == 4
    # A query whose lists hold fewer than ten rows, and vectors of another length.
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=4) * 1e-3 + (0 if i < 5 else 100)).tolist()) for i in range(300)] + [(1000 + i, [float(i), 1.0, 1.0]) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = nearest.search(df, df.where("vec_id IN (0, 1000)"), list_rows=10, copies=1).collect()
    x, ids = np.array([v for _, v in rows[:300]]), np.arange(300)
    assert [(r["vec_id"], r["score"]) for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == 0] == _nearest_of(x, ids, 0)
    assert [r["vec_id"] for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == 1000] == [1001, 1002]


def test_warc_of_long_payloads_and_clashing_columns(spark):
    rng = random.Random(2)
    long = "".join(rng.choice(string.printable) for _ in range(400_000))
    pages = [(1, "u", long, "x", 1), (2, None, long, None, 2), (3, "u", "é" * 300_000, "y", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload string, digest long")
    got = {r["page_id"]: r for r in warc.round_trip(df).collect()}
    assert got[1]["payload"] == long.encode() and got[2]["record_type"] == "revisit" and got[2]["refers_to_page"] == 1 and bytes(got[3]["payload"]) == ("é" * 300_000).encode()
    noise = b"\x1f\x8b\x08" * 30_000 + warc._record(5, "u", b"here", "d", None)
    assert [o for o, *_ in warc.records_in(io.BytesIO(noise), 0, len(noise))] == [90_000]


def test_mix_of_long_texts(spark):
    out = mixing.mix(spark.createDataFrame([(1, "w " * 300_000, "a"), (2, "w", "a"), (3, None, "b")], "doc_id long, text string, source string")).collect()
    assert {r["doc_id"]: r["size"] for r in out} == {1: 300_000, 2: 1, 3: 0} and abs(sum(r["taken"] for r in out) - 1.5 * 300_001) <= 1


def test_language_of_repeated_rows_and_ties(spark):
    docs = spark.createDataFrame([(i, t, lang) for i in range(40) for t, lang in [("aa bb aa bb aa", "x") if i % 2 else ("cc dd cc dd cc", "y")]] + [(1, "aa bb aa bb aa", "x")] * 5 + [(900, "zz zz", None)], "doc_id long, text string, lang string")
    model = language_id.train(docs, least_rows=2)
    out = language_id.predict(docs, model).collect()
    assert len(out) == docs.count() and len({(r["id"], r["lang_pred"], r["score"]) for r in out}) == 41
    again = language_id.predict(docs.repartition(5), language_id.train(docs.repartition(3))).collect()
    assert sorted((r["id"], r["lang_pred"]) for r in again) == sorted((r["id"], r["lang_pred"]) for r in language_id.predict(docs, language_id.train(docs)).collect())


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    first, moves = np.array([0, 40, 40, 41, 173]), rng.normal(size=(3, 3))
    emit = rng.normal(size=(173, 3))
    post, before = language_id.marginals(emit, first, moves, block=8)
    go = np.exp(moves)
    for a, b in zip(first[:-1], first[1:], strict=True):
        alpha, e = [np.full(3, 1 / 3)], np.exp(emit[a:b])
        for k in range(b - a):
            ahead = alpha[-1] @ go
            assert np.allclose(before[a + k], ahead / ahead.sum())
            alpha.append(ahead * e[k])
        beta = [np.ones(3)]
        for k in range(b - a - 1, 0, -1):
            beta.append(go @ (e[k] * beta[-1]))
        for k, back in enumerate(reversed(beta[: b - a])):
            p = alpha[k + 1] * back
            assert np.allclose(post[a + k], p / p.sum())


SF = "/root/testdata/sf0.01"


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs)
    out = docs.join(language_id.predict(docs, model), docs["doc_id"] == language_id.F.col("id")).select("doc_id", "lang", "lang_pred", "score").collect()
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(out) == docs.count() and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in out)
    by = {r["lang"]: r["text"] for r in docs.where("n_chars BETWEEN 300 AND 900").collect()}
    odd = [(1, None), (2, ""), (3, "12 34 !!"), (4, "— … 。"), (5, by["en"] + " " + by["de"]), (6, by["fr"] * 300), (5, "ñ")]
    rows = language_id.annotate(spark.createDataFrame([(*o, "c") for o in odd], "doc_id long, text string, lang_pred string"), model).collect()
    assert [r["lang_pred"] for r in rows[:4]] == ["und"] * 4 and all(r["lang_score"] == 0 for r in rows[:4])
    assert {s["lang"] for s in rows[4]["lang_segments"]} >= {"en", "de"} and len(rows[4]["lang_segments"]) <= 8 and rows[5]["lang_pred"] == "fr" and rows[6]["lang_pred"] != "und"
    unlabelled = docs.withColumn("lang", language_id.F.lit(None).cast("string"))
    assert language_id.predict(docs.limit(3), language_id.train(unlabelled)).where("lang_pred <> 'und'").count() == 0


def test_every_label_can_be_predicted(spark):
    """Seventy languages of words of their own, one of them with few documents: none is left out."""
    rng = random.Random(6)
    vocab = {f"l{i:02}": ["".join(rng.choice(string.ascii_lowercase) for _ in range(6)) + chr(97 + i % 26) + chr(97 + i // 26) for _ in range(12)] for i in range(70)}
    rows = [(i, " ".join(rng.choice(vocab[label]) for _ in range(30)), label) for i, label in enumerate(label for label in vocab for _ in range(4 if label == "l69" else 14))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, sample_rows=700, least_rows=3)
    assert len(model.labels) == 70
    out = docs.join(language_id.predict(docs, model), docs["doc_id"] == language_id.F.col("id")).where(language_id.held_out(language_id.F.col("doc_id"))).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.9 * len(out)


def test_long_texts_in_pieces():
    rng = random.Random(7)
    samples = [(label, " ".join(rng.choice(words) + rng.choice(["", "é", "ung"]) for _ in range(60))) for label, words in (("a", ["ka", "mo"]), ("b", ["ti", "mo"])) for _ in range(8)]
    model = language_id.fit(samples)
    text = (" ".join(t for _, t in samples) + " — 12 " + "x" * 900 + "é" * 300 + " " + samples[3][1] + " ").encode()
    plain, pieces = language_id._judge([text], model)[0], language_id._judge_long(text, model, 1 << 20)
    assert plain[0] == pieces[0] and np.allclose(plain[1:3], pieces[1:3]) and plain[3] == pieces[3]
    cut = language_id._judge_long(text, model, 1500)
    assert b"".join(language_id._pieces(text, 100)) == text and all(p.decode() for p in language_id._pieces(text, 100))
    assert plain[0] == cut[0] and np.allclose(plain[1:3], cut[1:3]) and plain[3] == cut[3]
    assert language_id._judge_long(b"12 -- " * 500, model, 100)[:2] == ("und", 0.0)


def test_affixes_are_features():
    text = language_id._Letters([b"abcdefgh xxcdefgh abcdefzz abc"])
    heads4, heads6, tails4, tails6 = text.affixes()
    assert heads4[0] == heads4[2] and heads6[0] == heads6[2] and tails4[0] == tails4[1] and tails6[0] == tails6[1]
    assert len({heads6[1], heads6[0], heads6[3]}) == 3 and len({tails6[0], tails6[2], tails6[3]}) == 3


def _duck(sql, docs, items=None):
    import duckdb

    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    if items is not None:
        con.register("benchmark", items.toArrow())
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return [dict(zip(names, row, strict=True)) for row in cur.fetchall()]


def test_pipeline(spark):
    """Every stage over all that its predecessor kept, against SQL or, for the language, the operator's own answers."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"n_words": language_id.F.lit("clash"), "kept_text": language_id.F.col("source"), "lang_pred": language_id.F.lit(1)})
    items, before = spark.read.parquet(f"{SF}/benchmark.parquet"), docs
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.written(stage(spark, before, SF), "test_stage")
        was, now = {r["doc_id"]: r.asDict() for r in before.collect()}, {r["doc_id"]: r.asDict() for r in after.collect()}
        assert set(now) <= set(was) and len(now) == after.count()
        if name != "mixing":
            assert after.columns == docs.columns
            changed = {"language_id": {"lang"}, "line_dedup": {"text", "n_chars"}}.get(name, set())
            assert all(now[i][c] == was[i][c] for i in now for c in docs.columns if c not in changed)
        if name == "language_id":
            found = {r["id"]: r for r in language_id.predict(before, language_id.train(before)).collect()}
            sure = {i for i, r in found.items() if r["lang_pred"] != "und" and r["sure"] >= corpus_pipeline.LEAST_SURENESS}
            assert set(now) == sure and len(now) >= 0.95 * len(was) and all(now[i]["lang"] == found[i]["lang_pred"] for i in now)
        if name == "line_dedup":
            want = {r["doc_id"]: r for r in _duck(queries.OP2_SQL, before)}
            assert set(now) == set(was) and all(hashlib.sha256((now[i]["text"] or "").encode()).hexdigest() == want[i]["kept_sha256"] for i in now)
            assert any(r["n_dropped"] for r in want.values()) and all(now[i]["n_chars"] == len(now[i]["text"] or "") for i in now)
        if name == "jaccard_join":
            want = {r["doc_id"]: r["component_id"] for r in _duck(queries.OP6_SQL, before)}
            assert set(now) == {i for i, c in want.items() if i == c} and len(now) < len(was)
        if name == "decontaminate":
            want = {r["doc_id"]: r["contaminated"] for r in _duck(queries.OP3_SQL, before, items)}
            assert set(now) == {i for i, bad in want.items() if not bad} and len(now) < len(was)
        if name == "mixing":
            want = {r["doc_id"]: r for r in _duck(queries.OP4_SQL, before.select("doc_id", "text", "source"))}
            assert all(now[i][c] == want[i][c] for i in want for c in ("size", "source_size", "target", "taken"))
        before = after
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontaminate", "mixing"]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_with_odd_rows(spark):
    """Null ids, ids that repeat with one text and with others, null, empty and wordless texts, and null sources."""
    a, b = "alpha beta gamma delta epsilon zeta eta theta iota kappa", "one two three four five six seven eight nine ten"
    rows = [(1, a), (1, a), (1, b), (2, a + " ."), (None, b), (None, "un deux trois quatre cinq six"), (None, "un deux trois quatre cinq six"), (3, None), (3, None), (4, ""), (5, " \n "), (6, a.upper())]
    docs = spark.createDataFrame([(i, t, None if n % 2 else "s", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, source string, `group` long")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in corpus_pipeline.keep_one_of_each_group(spark, docs, SF).collect())
    want = [(1, a), (1, b), (3, None), (3, None), (4, ""), (5, " \n "), (None, "un deux trois quatre cinq six")]
    assert got == sorted((i is None, i or 0, t or "") for i, t in want)
    lined = corpus_pipeline.drop_repeated_lines(spark, docs, SF)
    assert lined.columns == docs.columns and lined.count() == len(rows)
    clean = corpus_pipeline.drop_contaminated(spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert corpus_pipeline.identify_language(spark, docs.withColumn("lang", language_id.F.lit("en")), SF).where("text IS NULL OR trim(text) = ''").isEmpty()
    assert corpus_pipeline.mix_sources(spark, docs.withColumn("lang", language_id.F.lit("en")), SF).count() == len(rows)


def test_a_text_in_several_languages_stays(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    parts = [r["text"] for lang in ("en", "de", "fr", "es") for r in docs.where(f"lang = '{lang}' AND n_chars BETWEEN 400 AND 600").orderBy("doc_id").limit(1).collect()]
    mixed = spark.createDataFrame([(-1, " ".join(parts), None, "x", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.identify_language(spark, docs.select(mixed.columns).union(mixed), SF)
    assert len(parts) == 4 and not kept.where("doc_id = -1").isEmpty()


def test_quality_of_a_whole_table(spark):
    """Counts, ratios, weights, noise, threshold and selection rebuilt row by row."""
    rng = random.Random(12)
    vocab = ["Sun", "sea", "ÉTÉ", "spam", "ham!", "x", "the", "y\u00a0z"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 12))) for _ in range(60)] + [None, "", " \t", "word " * 5000, "sun sea", "sun sea"]
    rows = [(i, t, "clash", 1.0) for i, t in enumerate(texts)] + [(3, texts[3], None, 0.0), (3, "other text", None, 0.0), (None, "the sun", None, 0.0)]
    target = {i for i in range(60) if i % 4 == 1}
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, selected double")
    found = quality.resample(docs, spark.createDataFrame([(i,) for i in sorted(target)], "doc_id long"), share=0.4, slots=97).collect()

    def grams(text):
        words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
        one = [int(hashing.mix(hashing.Words([w]).hash)[0]) % 97 for w in words]
        return one + [int(hashing.Words([x + b" " + y]).windows(2, lanes=1)[1][0][0]) % 97 for x, y in itertools.pairwise(words)]

    raw, good = np.zeros(97), np.zeros(97)
    for i, t, *_ in rows:
        for g in grams(t):
            raw[g] += 1
            good[g] += i in target
    ratio = np.log((good + 1) / (good.sum() + 97)) - np.log((raw + 1) / (raw.sum() + 97))

    def noise(i):
        h = xxhash.xxh64(struct.pack("<i", 11), seed=42).intdigest()
        h = h if i is None else xxhash.xxh64(struct.pack("<q", i), seed=h).intdigest()
        return -math.log(-math.log(((h >> 11) + 0.5) / 2**53))

    want = []
    for i, t, *_ in rows:
        weight = sum(ratio[g] for g in grams(t))
        want.append((i, len(grams(t)), weight, weight + noise(i)))
    edge = sorted((w[3] for w in want), reverse=True)[round(0.4 * len(want)) - 1]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    for r, w in zip(sorted(map(tuple, found), key=key), sorted(want, key=key), strict=True):
        assert r[:2] == w[:2] and math.isclose(r[2], w[2], abs_tol=1e-6) and math.isclose(r[3], w[3], abs_tol=1e-6) and r[4] == (w[3] >= edge - 1e-9)
