"""Top-k against brute force."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from deficit_engine.llm import exact_topk, oracle


def brute(rows, k, is_query):
    vecs = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        vecs.setdefault(i, set()).add(tuple(int(np.floor(64 * np.float64(np.float32(x)))) for x in v))
    out = set()
    for q in vecs:
        if is_query(q):
            for qv in vecs[q]:
                scores = sorted((-sum(a * b for a, b in zip(qv, xv)), x) for x in vecs if x != q for xv in vecs[x])
                out |= {(q, r + 1, x, -s) for r, (s, x) in enumerate(scores[:k])}
    return out


def run(spark, rows, k):
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, block string")
    got = exact_topk.top_k(df, F.col("vec_id") % 5 == 0, k=k).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def test_ties_nulls_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "BLOCK", 16)
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 4)
    draw = random.Random(5)
    rows = [(i, [draw.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(4)]) for i in range(120)]
    rows += [(i, [1.0, 1.0, 1.0, 1.0]) for i in range(200, 240)]        # one vector many times
    rows += [(None, [1.0] * 4), (300, None), (301, [1.0, None, 0.0, 0.0]), (302, [float("nan")] * 4),
             (303, [float("inf"), 0.0, 0.0, 0.0]), (305, [2.0]), (310, []), (7, rows[7][1])]
    assert run(spark, rows, 7) == brute(rows, 7, lambda i: i % 5 == 0)


def test_few_candidates_and_empty(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]
    assert run(spark, rows, 20) == brute(rows, 20, lambda i: i % 5 == 0)
    assert run(spark, [], 20) == set()
    assert run(spark, [(5, [1.0])], 20) == set()


def test_repeated_rows_as_in_sql(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "BLOCK", 16)
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 4)
    draw = random.Random(9)
    rows = [(i, [draw.choice([-0.5, 0.25, 1.0]) for _ in range(4)]) for i in range(70)]
    rows += [rows[3]] * 30 + [rows[11]] * 4 + [rows[20]] * 2 + [rows[40]] * 25 + [(60, [1.0, 0.25, 1.0, -0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, exact_topk.top_k(df, F.col("vec_id") % 20 == 0, k=20).collect()))
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[])")
    con.executemany("insert into embeddings values (?, ?)", [list(r) for r in rows])
    assert got == sorted(con.execute(oracle.OP4).fetchall())


def test_products_beyond_double_precision(spark):
    # 64 * 2^23 in the first place: products beyond 2^53 that differ in their last digits
    rows = [(i, [float(1 << 23), float(i % 7) / 64, float(-(i % 3))]) for i in range(60)]
    assert run(spark, rows, 6) == brute(rows, 6, lambda i: i % 5 == 0)
    for x in (1e9, 1e30):
        with pytest.raises(ArithmeticError):
            run(spark, [(5, [x, x]), (6, [x, 1.0])], 3)


def by_products(ids, v, queries, k):
    out = set()
    for q in queries:
        s = v @ v[q]
        best = [x for x in np.lexsort((ids, -s)) if ids[x] != ids[q]][:k]
        out |= {(int(ids[q]), r + 1, int(ids[x]), int(s[x])) for r, x in enumerate(best)}
    return out


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_driver_gets_little(spark, monkeypatch, threshold):
    """Neither the query blocks meant for every vector block nor each task's part of the sample go to the driver."""
    monkeypatch.setattr(exact_topk, "BLOCK", 64)
    monkeypatch.setattr(exact_topk, "PIVOT_SAMPLE", 400)
    v = np.random.default_rng(3).integers(-30, 31, (6000, 64))
    df = (spark.createDataFrame([(i, (x / 64).tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
          .repartition(16, "vec_id"))
    conf, before = spark.sparkContext._jsc.sc().conf(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    conf.set("spark.driver.maxResultSize", "700k")      # the sample has 220 kB, the blocks' copies 20 MB
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = {tuple(r) for r in exact_topk.top_k(df, F.col("vec_id") % 20 == 0, k=3).collect()}
    finally:
        conf.remove("spark.driver.maxResultSize")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == by_products(np.arange(6000), v, range(0, 6000, 20), 3)


@pytest.mark.parametrize("long,size", [(4800, 1), (0, 1), (4800, 1 << 11), (0, 1 << 11), (4800, 1 << 22)])
def test_cells_and_leaves(spark, monkeypatch, long, size):
    """Many cells and leaves, in single, double and long arithmetic, with leaf bounds alone and with each vector's own."""
    for name, value in (("BLOCK", 16), ("QUERY_BLOCK", 4), ("LEAF", 4), ("HELD", 2), ("SMALL_CELL", 50), ("LONG", long)):
        monkeypatch.setattr(exact_topk, name, value)
    down, held, across = exact_topk.grid(150, 30, 4, 40, 8)
    assert held == 2 and down > 1 and across > 1
    draw = random.Random(size + long)
    rows = [(i, [draw.choice([-0.5, 0.0, 0.25, 1.0]) * size for _ in range(4)]) for i in range(110)]
    rows += [(i, [draw.gauss(3.0 * (i % 2), 0.1) * size for _ in range(3)]) for i in range(110, 140)]
    rows += [(i, [1.0 * size] * 4) for i in range(200, 230)]
    assert run(spark, rows, 5) == brute(rows, 5, lambda i: i % 5 == 0)


def test_leaves_out_of_reach_are_not_multiplied(monkeypatch):
    """Two far clusters: no bound is below a product, and queries of one never meet the other's leaves once they have k."""
    draw = np.random.default_rng(7)
    v = np.concatenate([draw.integers(90, 101, (256, 3)), draw.integers(-100, -89, (256, 3))]).astype(np.int8)
    pivots = exact_topk.choose_pivots(v.astype(float), 6)
    far = np.sqrt(((v[:, None].astype(float) - pivots[None]) ** 2).sum(2)).astype(np.float32)
    squares, products = (v.astype(float) ** 2).sum(1), v.astype(float) @ v.T
    assert (exact_topk.bounds(far, squares, far, far, squares) >= products).all()
    starts = np.arange(0, 512, 64)
    ranges = np.stack([np.minimum.reduceat(far, starts), np.maximum.reduceat(far, starts)])
    asked, met = exact_topk.Asked(np.arange(32), v[:32], far[:32], 5, np.float32), []
    multiply = exact_topk.Asked.multiply
    monkeypatch.setattr(exact_topk.Asked, "multiply", lambda self, asks, ids, x: (met.append(ids[0]), multiply(self, asks, ids, x)))
    asked.search(np.arange(512), v.astype(np.float32), squares, ranges, None, 64)
    assert met and max(met) < 256
    got = asked.found().to_pydict()
    assert sorted(zip(got["query_id"], got["vec_id"], got["score"])) == sorted(
        (q, x, s) for q, _, x, s in by_products(np.arange(512), v.astype(np.int64), range(32), 5))
