"""Hard negatives against the registered SQL and against brute force."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from deficit_engine.llm import hard_negatives, oracle, queries

SCHEMA = "vec_id long, embedding array<float>, label int, cell string, rank int, v int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "clash", 0, 1) for i, v, y in rows], SCHEMA)


def brute(rows, is_anchor, k_pos=5, k_neg=10, least=30, most=90):
    kept = [(i, y, tuple(int(np.floor(256 * np.float64(np.float32(x)))) for x in v)) for i, v, y in rows
            if i is not None and v is not None and y is not None and all(x is not None and np.isfinite(x) for x in v)]

    def product(a, b):
        return sum(x * y for x, y in zip(a, b))
    out = []
    for i, y, a in sorted(set(r for r in kept if is_anchor(r[0]))):
        scored = sorted((-product(a, v), j, z) for j, z, v in kept if j != i)
        for s, p, _ in [r for r in scored if r[2] == y][:k_pos]:
            fit = [(t, j) for t, j, z in scored if z != y and least * -s <= 100 * -t <= most * -s][:k_neg]
            out += [(i, p, r + 1, j, -s, -t) for r, (t, j) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, every, **kw):
    df = hard_negatives.mine(table(spark, rows), F.col("vec_id") % every == 0, **kw)
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def small_blocks(monkeypatch):
    for name, size in {"SAMPLE": 60, "BLOCK": 24, "LEAF": 5, "ASKED": 3}.items():
        monkeypatch.setattr(hard_negatives, name, size)


def clustered(n, seed, width=4):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, width))
    return [(i, (centres[i % 6] + 0.3 * draw.normal(size=width)).tolist(), int(draw.integers(0, 4))) for i in range(n)]


def test_clusters_ties_nulls_and_repeats(spark, small_blocks):
    draw = random.Random(5)
    rows = [(i, [draw.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(4)], draw.randrange(3)) for i in range(150)]
    rows += [(1000 + i, [1.0, 1.0, 0.5, 0.25], i % 3) for i in range(90)]       # one vector for many rows
    rows += [rows[3]] * 30 + [rows[10]] * 2 + [rows[20]] * 20 + [(20, [0.25] * 4, 1)]
    rows += [(None, [1.0] * 4, 1), (300, None, 1), (310, [1.0, None, 0.0, 0.0], 1), (320, [float("nan")] * 4, 2),
             (330, [float("inf"), 0.0, 0.0, 0.0], 0), (340, [1.0] * 4, None), (350, [1.0], 1), (360, [], 1)]
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 500
    assert mined(spark, rows, 10) == want


def test_many_cells(spark, small_blocks):
    rows = clustered(700, 2)
    assert mined(spark, rows, 25, positives=3, negatives=4, least=10, most=95) == \
        brute(rows, lambda i: i % 25 == 0, 3, 4, 10, 95)


def test_query_against_sql(spark, tmp_path):
    # production sizes, whole table
    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    got = queries.op12_hard_negatives(spark, "/root/testdata/sf0.01")
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = sorted(con.execute(oracle.OP12).fetchall())
    assert want and sorted(map(tuple, got.collect())) == want


def test_few_rows_and_empty(spark):
    assert mined(spark, [], 10) == []
    assert mined(spark, [(0, [1.0], 1)], 10) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 2)], 10) == []       # no positive
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2), (3, [-1.0, 0.0], 1)]
    assert mined(spark, rows, 10) == brute(rows, lambda i: i % 10 == 0) == [(0, 1, 1, 2, 65536, 32768)]


def test_long_products_and_too_long_ones(spark):
    # products beyond 2^53 are whole, and what no long holds is refused
    rows = [(i, [float((1 << 21) + i % 5), float(i * i)], i % 2) for i in range(40)]
    assert mined(spark, rows, 10) == brute(rows, lambda i: i % 10 == 0)
    with pytest.raises(ArithmeticError):
        mined(spark, [(0, [1e9], 1), (1, [1e30], 1)], 10)


def test_subtrees_are_ruled_out():
    """The ranges do eliminate, and never a row of the annulus."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.05, size=(200, 3)) for c in (0, 3, 6, 9)])
    tree = hard_negatives.Tree.grow(x, 20)
    q = x[::97]
    near, reach = np.full(len(q), 2.0), np.full(len(q), 5.5)
    asked = {(int(r), leaf) for leaf, rows in tree.walk(q, near, reach, 1e-9) for r in rows}
    far = hard_negatives.distances(q, x)
    for leaf, members in enumerate(tree.leaves):
        for r in np.flatnonzero(((far[:, members] >= 2) & (far[:, members] <= 5.5)).any(1)):
            assert (int(r), leaf) in asked
    assert len(asked) < 0.7 * len(q) * len(tree.leaves)
