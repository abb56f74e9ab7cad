"""Centroid clustering and vector codes against Lloyd's rounds without bounds."""

import hashlib
import math
import random

import numpy as np
import pytest

from millrace.llm import integer_vectors, queries, vector_codes, yinyang


def lloyd(x, centres, rounds):
    """Lists of integers, plain Python."""
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    near = lambda v: min(range(len(centres)), key=lambda c: (far(v, centres[c]), c))
    for _ in range(rounds):
        own = [near(v) for v in x]
        for c in set(own):
            mine = [v for v, o in zip(x, own, strict=True) if o == c]
            centres[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    own = [near(v) for v in x]
    return own, [far(v, centres[o]) for v, o in zip(x, own, strict=True)], centres


@pytest.mark.parametrize("spread", [2, 40, 3000])
def test_yinyang_is_lloyd(spread):
    rng = np.random.default_rng(spread)
    # Few values make ties and rows that repeat.
    x = np.concatenate((rng.integers(-spread, spread, (150, 4)), rng.integers(-spread, spread, (10, 4)).repeat(5, axis=0)))
    start = np.concatenate((x[:11], x[3:4]))  # two centroids alike
    own, distance, want = lloyd(x.tolist(), start.tolist(), 8)
    group, centres, state, drift, scanned = yinyang.grouped(start, 4), start, None, None, []
    for r in range(9):
        *state, n = yinyang.assign(x, centres, group, state, drift)
        scanned.append(n)
        assert (state[1] ** 2 >= integer_vectors.squares(x, centres[state[0]])).all()
        if r < 8:
            moved = centres.copy()
            for c in np.unique(state[0]):
                moved[c] = x[state[0] == c].sum(axis=0) // (state[0] == c).sum()
            drift, centres = integer_vectors.above(np.sqrt(integer_vectors.squares(moved, centres).astype(float))), moved
    assert state[0].tolist() == own and centres.tolist() == want
    assert integer_vectors.squares(x, centres[state[0]]).tolist() == distance
    assert scanned[0] == len(x) * 12 and (spread < 40 or scanned[-1] < scanned[0] / 3)


@pytest.mark.parametrize("spread", [2, 40, 3000])
def test_elkan_is_lloyd(spread):
    rng = np.random.default_rng(spread)
    x = np.concatenate((rng.integers(-spread, spread, (150, 3)), rng.integers(-spread, spread, (10, 3)).repeat(5, axis=0)))
    start = np.concatenate((x[:9], x[2:3]))
    own, _, want = lloyd(x.tolist(), start.tolist(), 6)
    centres, state, drift, scanned = start, None, None, []
    for r in range(7):
        *state, n = vector_codes.assign(x, centres, state, drift)
        scanned.append(n)
        upper, lower = vector_codes.shorter(state[1], state[2])  # as they are stored
        state = [state[0], upper.astype(float), lower.astype(float)]
        exact = np.stack([integer_vectors.squares(x, c) for c in centres], axis=1)
        assert (state[1] ** 2 >= exact.min(axis=1)).all() and (state[2] ** 2 <= exact).all()
        if r < 6:
            moved = centres.copy()
            for c in np.unique(state[0]):
                moved[c] = x[state[0] == c].sum(axis=0) // (state[0] == c).sum()
            drift, centres = integer_vectors.above(np.sqrt(integer_vectors.squares(moved, centres).astype(float))), moved
    assert state[0].tolist() == own and centres.tolist() == want
    assert spread < 40 or scanned[-1] < scanned[0] / 3


def test_bounds_that_do_not_fit():
    upper, lower = vector_codes.shorter(np.array([1e6 + 0.123]), np.array([[1e6, -3.0, 0.1]]))
    assert upper[0] >= 1e6 + 0.123 and lower[0, 0] <= 65504 and lower[0, 1] == 0 and lower[0, 2] <= 0.1


def odd(rng, dim, n):
    rows = [(i, [rng.uniform(-1, 1) for _ in range(dim)], i % 3 if i % 5 else None) for i in range(n)]
    rows += [rows[4], rows[4], (4, rows[5][1], 7), (None, rows[6][1], 0)]  # repeated rows, one id with two vectors, a null id
    bad = [(900, None, 1), (901, [], 1), (902, rows[0][1][:-1], 1), (903, [None] + rows[0][1][1:], 1), (904, [math.nan] + rows[0][1][1:], 1), (905, [math.inf] + rows[0][1][1:], 1)]
    return rows, rows + bad


def test_clusters_of_odd_rows(spark):
    good, rows = odd(random.Random(1), 5, 60)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, cluster string, id int")
    found = yinyang.cluster(table, dim=5, k=6, rounds=10)
    ordered = sorted(good, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    ints = [[math.floor(1024 * c) for c in r[1]] for r in good]
    own, distance, centres = lloyd(ints, [[math.floor(1024 * c) for c in r[1]] for r in ordered[:6]], 10)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, found.rows.collect()), key=key) == sorted(zip([r[0] for r in good], own, distance, strict=True), key=key)
    assert found.centroids.tolist() == centres
    few = yinyang.cluster(table.where("vec_id < 3"), dim=5, k=6)
    assert sorted(r["distance"] for r in few.rows.collect()) == [0, 0, 0]
    assert yinyang.cluster(table.where("vec_id >= 900"), dim=5) is None
    with pytest.raises(Exception, match="64 bits"):
        yinyang.cluster(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"), dim=1)


def test_codes_of_odd_rows(spark):
    good, rows = odd(random.Random(2), 8, 60)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, part int")
    found = vector_codes.encode(table, parts=4, entries=5, rounds=6)
    assert found.rows.columns == ["vec_id", "label", "part", "code", "error"]
    ordered = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(4096 * c) for c in r[1]] for r in good]
    first = [[math.floor(4096 * c) for c in r[1]] for r in ordered[:5]]
    code, error = [""] * len(good), [0] * len(good)
    for p in range(4):
        own, distance, centres = lloyd([v[2 * p : 2 * p + 2] for v in ints], [v[2 * p : 2 * p + 2] for v in first], 6)
        code, error = [c + f"{o:02x}" for c, o in zip(code, own, strict=True)], [e + d for e, d in zip(error, distance, strict=True)]
        assert found.codebooks[p].tolist() == centres
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, found.rows.select("vec_id", "code", "error").collect()), key=key) == sorted(zip([r[0] for r in good], code, error, strict=True), key=key)
    assert vector_codes.encode(table.where("vec_id >= 900 AND vec_id <> 902"), parts=4) is None
    assert vector_codes.encode(table, parts=4, length=4) is None
    few = vector_codes.encode(table.where("vec_id < 3"), parts=4, entries=16)
    assert few.codebooks.shape == (4, 3, 2) and few.rows.where("error <> 0").count() == 0


@pytest.mark.parametrize("name", ["op11_yinyang", "op13_vector_codes"])
def test_queries_without_rows(spark, tmp_path, name):
    kinds = {}
    for at, rows in (("none", []), ("some", [(1, [0.5] * 64, None), (2, [0.25] * 64, None), (3, None, 4)])):
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/{at}/embeddings.parquet")
        found = queries.QUERIES[name](spark, f"{tmp_path}/{at}")
        kinds[at] = sorted(found.dtypes)
        assert found.count() == (2 if rows else 0)
    assert kinds["none"] == kinds["some"]
