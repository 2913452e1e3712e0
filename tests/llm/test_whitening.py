"""Whitening against numpy, and its exact parts against whole-number arithmetic."""

import numpy as np
import pytest

from deficit_engine.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, component string, v int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1, 2) for i, v in rows], SCHEMA)


def scatter(y):
    y = y.astype(object)
    s = y.sum(0)
    return (len(y) * (y.T @ y) - np.outer(s, s)).tolist()


def whole(rows):
    """floor(64 * c) + 1000000 of the rows that take part."""
    width = max((len(v) for _, v in rows if v is not None), default=0)
    out = []
    for i, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            x = np.floor(64 * np.array(v, np.float32).astype(np.float64)).astype(np.int64)
            out.append((i, np.concatenate([x, np.zeros(width - len(x), np.int64)]) + 1_000_000))
    return out


def check(spark, rows, **kw):
    """The contract's rows, each figure recomputed from the definition."""
    got = whitening.whiten(frame(spark, rows), **kw).collect()
    kept = whole(rows)
    x = np.array([v for _, v in kept], np.int64)
    n, sums = len(x), x.sum(0)
    deviations = {}
    for i, v in kept:
        deviations.setdefault(i, []).append(sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums)))
    cov = np.cov(x.T.astype(float), bias=True).reshape(x.shape[1], -1)
    values = np.linalg.eigvalsh(cov)[::-1]
    rank = int((values > 1e-9 * max(values.max(), 1e-300)).sum())
    shown = min(rank, kw.get("components", 32))
    assert len(got) == n * shown
    for r in got:
        assert r["n"] == n and int(r["deviation"]) in deviations[r["vec_id"]]
        assert abs(r["explained"] / (values[r["component"] - 1] / np.trace(cov)) - 1) < 1e-9
        assert r["identity_error"] < 1e-9
    # whitened values: covariance is the identity, and the lengths give back the projections
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append(r["whitened"])
    w = np.array([sorted(by[c]) for c in sorted(by)])
    assert np.allclose(w.mean(1), 0, atol=1e-9) and np.allclose((w ** 2).mean(1), 1, atol=1e-9)
    return got, x, cov


def test_matches_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * np.arange(1, 7) / 4).tolist()) for i in range(150)]
    rows += [(None, [0.5] * 6), (7, rows[7][1]), (900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6),
             (903, [float("-inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (904, [2.0]), (905, [])]
    got, x, cov = check(spark, rows)
    values, vectors = np.linalg.eigh(cov)
    ids = [i for i, _ in whole(rows)]
    for c in range(1, 7):
        mine = {}
        for r in got:
            if r["component"] == c:
                mine.setdefault(r["vec_id"], []).append(r["whitened"])
        want = (x - x.mean(0)) @ vectors[:, -c] / np.sqrt(values[-c])
        # the sign is free but the same for all rows
        sign = 1 if np.sign(want[0]) == np.sign(mine[ids[0]][0]) else -1
        for i, z in zip(ids, want * sign):
            assert min(abs(z - m) for m in mine[i]) < 1e-9


def test_fewer_rows_than_dimensions(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=40).tolist()) for i in range(9)]
    got, *_ = check(spark, rows)
    assert {r["component"] for r in got} == set(range(1, 9))


def test_most_components(spark):
    rng = np.random.default_rng(6)
    check(spark, [(i, rng.normal(size=12).tolist()) for i in range(60)], components=5)


def test_equal_roots(spark):
    rows = [(k, (np.eye(5)[k % 5] * (1 if k < 5 else -1)).tolist()) for k in range(10)]
    got, *_ = check(spark, rows)
    assert {r["component"] for r in got} == {1, 2, 3, 4, 5}


def test_one_vector_many_times(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [0.5, 0.25, -1.0]) for i in range(80)] + [(100 + i, rng.normal(size=3).tolist()) for i in range(40)]
    check(spark, rows)


def test_empty(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, []), (2, [])], [(1, [3.0]), (2, [3.0])]):
        assert whitening.whiten(frame(spark, rows)).collect() == []


def test_too_large_for_a_long(spark):
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(frame(spark, [(1, [1e30]), (2, [0.0])])).collect()


def test_large_values_stay_exact(spark):
    rows = [(i, [float(1 << 30) * (i % 3), float(i * i << 20)]) for i in range(12)]
    got = whitening.whiten(frame(spark, rows)).collect()
    x = np.array([[int(64 * c) for c in v] for _, v in rows], object)
    s = x.sum(0)
    want = {i: sum((12 * a - b) ** 2 for a, b in zip(v, s)) for (i, _), v in zip(rows, x)}
    assert {r["vec_id"]: int(r["deviation"]) for r in got} == want


def test_polynomial_is_exact(spark):
    rng = np.random.default_rng(11)
    matrix = scatter(rng.integers(-50, 50, (30, 7)))
    poly = whitening.characteristic_polynomial(spark, matrix)
    # Faddeev and LeVerrier, in whole numbers
    a, m, want = np.array(matrix, object), np.zeros((7, 7), object), [1]
    for k in range(1, 8):
        m = a @ m + want[-1] * np.eye(7, dtype=int).astype(object)
        want.append(-(a @ m).trace() // k)
    assert poly == want


def test_roots_are_isolated_and_refined():
    # (x-1)(x-2)^2(x-1000)(x-1001)
    poly = [1]
    for r in (1, 2, 2, 1000, 1001):
        poly = [a - r * b for a, b in zip(poly + [0], [0] + poly)]
    spectrum = whitening.Spectrum(poly, 2006)
    assert [(root / (1 << spectrum.bits), often) for root, often in spectrum.roots] == [(1001, 1), (1000, 1), (2, 2), (1, 1)]
    # x^2 - 3x + 1: irrational, known to all its places
    spectrum = whitening.Spectrum([1, -3, 1], 3)
    (high, _), (low, _) = spectrum.roots
    one = 1 << spectrum.bits
    assert abs(high + low - 3 * one) <= 2 and abs(high * low - one * one) <= 4 * one


def test_query(spark):
    got = queries.op13_whitening(spark, "/root/testdata/sf0.001")
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.schema["deviation"].dataType.simpleString() == "bigint" and got.count() > 0
