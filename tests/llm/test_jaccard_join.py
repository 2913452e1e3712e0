"""Components of the Jaccard join against brute force."""

import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deficit_engine.llm import jaccard_join as jj
from deficit_engine.llm.components import components
from deficit_engine.llm.common import Scratch

ROOT = Path(__file__).resolve().parents[2]


def sets_of(text, width):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return set()
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))}


def brute(rows, width, percent):
    sets = [sets_of(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    ids = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            ids[root(i)] = min(ids.get(root(i), name), name)
    return sorted(((name, len(sets[i]), ids.get(root(i))) for i, (name, _) in enumerate(rows)), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, node int, rid string")


def run(spark, rows, width, percent):
    got = jj.link_documents(frame(spark, rows), width=width, percent=percent).collect()
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str)


def corpus(seed, n, rate):
    """Families of copies with single words changed, at a distance around the limit."""
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, past = [], [[draw.choice(vocabulary) for _ in range(k)] for k in (4, 12, 40, 90, 400)]
    for i in range(n):
        t = list(draw.choice(past))
        kind = draw.randrange(5)
        if kind < 4:
            for _ in range(draw.randint(0, max(1, round(rate * len(t))))):
                at = draw.randrange(len(t))
                t[at:at + draw.randrange(2)] = [draw.choice(vocabulary)]
        else:
            t = [draw.choice(vocabulary) for _ in range(draw.randint(1, 150))]
        if draw.random() < 0.5 and len(t) > 3:
            past.append(t)
        rows.append((n - i, " ".join(t).upper() if draw.random() < 0.1 else "\n".join(t)))
    return rows


EDGES = [(900, None), (901, ""), (902, " \n "), (903, "one"), (904, "ONE"), (905, "one two"), (906, "one  two"), (907, "É e x"),
         (908, "é e x"), (None, "one two"), (None, "alone here now"), (909, "a b " * 400), (910, "a b " * 500), (911, "a"), (911, "b"), (911, "b")]


@pytest.mark.parametrize(("width", "percent", "rate"), [(3, 90, 0.03), (5, 80, 0.04)])
def test_brute_force(spark, width, percent, rate):
    rows = corpus(width, 220, rate) + EDGES
    assert run(spark, rows, width, percent) == brute(rows, width, percent)


def test_large_regions_are_split(spark, monkeypatch):
    monkeypatch.setattr(jj, "REGION", 12)
    monkeypatch.setattr(jj, "SMALL", 6)
    draw = random.Random(9)
    base = [f"v{k}" for k in range(120)]
    rows = []
    for i in range(160):     # copies around one text: most are linked through few others only
        t = list(base)
        for _ in range(draw.randint(1, 5)):
            t[draw.randrange(len(t))] = f"c{draw.randrange(40)}"
        rows.append((i, " ".join(t)))
    assert run(spark, rows, 3, 90) == brute(rows, 3, 90)


def test_clusters_of_shared_passages_are_cut(spark, monkeypatch):
    """Texts that share a passage meet in keys; with too few shingles in common for a link they are not one cluster."""
    monkeypatch.setattr(jj, "REGION", 12)
    passage = [f"p{k}" for k in range(300)]
    rows = [(i, " ".join(passage + [f"d{i}w{k}" for k in range(150)])) for i in range(40)]
    rows += [(100 + i, t + " end") for i, t in rows[:5]]
    seen, whole, links = {}, jj._cut_clusters, jj._region_links

    def largest(members):
        return members.groupBy("cluster").count().agg({"count": "max"}).first()[0]

    def cut(members, *rest):
        seen["before"] = largest(members)
        return whole(members, *rest)

    def region_links(members, *rest):
        seen["after"] = largest(members)
        return links(members, *rest)

    monkeypatch.setattr(jj, "_cut_clusters", cut)
    monkeypatch.setattr(jj, "_region_links", region_links)
    assert run(spark, rows, 3, 80) == brute(rows, 3, 80)
    assert seen["before"] > 12 and seen["after"] == 2


def test_blocks_of_a_region_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(jj, "REGION", 10)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = spark.range(60).selectExpr("id node", "7L region", "cast('abcdefgh' as binary) set", "id % 2 = 0 rim", "0.9D far")
        dealt = jj._dealt(rows).groupBy("region", "i", "j").applyInArrow(_task, "i int, j int, n long, task int").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len({(r["i"], r["j"]) for r in dealt}) == 18 and sum(r["n"] for r in dealt) == 30 * 6 + 60 * 3
    assert len({r["task"] for r in dealt}) > 3


def _task(block):
    from pyspark import TaskContext
    return pa.table({"i": block["i"][:1], "j": block["j"][:1], "n": [block.num_rows],
                     "task": pa.array([TaskContext.get().partitionId()], pa.int32())})


def test_keep_one(spark):
    rows = corpus(4, 120, 0.03) + EDGES
    kept = jj.keep_one(frame(spark, rows), width=5, percent=80)
    assert kept.columns == ["doc_id", "text", "node", "rid"]
    want = brute(rows, 5, 80)
    # 911 names two texts that are not linked: both stay
    stay = sorted([*({c for _, n, c in want if n and c is not None} | {900, 901, 902}), 911])
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == stay
    assert sum(r["doc_id"] is None for r in kept.collect()) == 1


def test_empty_table(spark):
    assert run(spark, [], 3, 90) == []
    assert run(spark, [(1, "")], 3, 90) == [(1, 0, 1)]


@settings(max_examples=60, deadline=None)
@given(st.integers(10, 400), st.integers(0, 2**32), st.sampled_from([80, 90, 95]))
def test_linked_sets_share_enough_keys(n, seed, percent):
    rule, draw = jj.Rule(3, percent), np.random.default_rng(seed)
    x = np.unique(draw.integers(0, 1 << 63, n).astype(np.uint64))
    most = int(len(x) * (100 - percent) / (100 + percent))
    drop = draw.integers(0, most + 1)
    y = np.unique(np.concatenate([x[drop:], draw.integers(0, 1 << 63, int(draw.integers(0, most + 1))).astype(np.uint64)]))
    if not rule.linked(np.intersect1d(x, y).size, len(x), len(y)) or np.array_equal(x, y):
        return
    of = lambda s: [(need, set(keys)) for need, keys in rule.keys(s)]
    assert any(len(a & b) >= max(p, q) for p, a in of(x) for q, b in of(y))


def test_block_join_finds_all_pairs():
    draw = np.random.default_rng(3)
    rule = jj.Rule(3, 90)
    base = np.unique(draw.integers(0, 1 << 62, 90).astype(np.uint64))
    sets = [np.unique(np.concatenate([np.delete(base, draw.integers(0, 90, 4)), draw.integers(0, 1 << 62, 3).astype(np.uint64)])) for _ in range(150)]
    want = {(i, j) for i in range(60) for j in range(150)
            if rule.linked(np.intersect1d(sets[i], sets[j]).size, len(sets[i]), len(sets[j]))}
    assert set(jj.join_block(rule, sets[:60], sets)) == want


def test_components(spark):
    draw = random.Random(8)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(0, k) for k in range(400, 460)] + [(7, 7)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t"), "x").collect()
    assert {tuple(r) for r in got} == {(x, root(x)) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t"), "x").count() == 0


def test_memory_goes_back_when_another_operator_starts():
    """Freed small objects are returned to the system, not held by an idle worker."""
    program = """
from deficit_engine.llm.units import hold_caches
def resident():
    return int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20
held, last = {}, []
hold_caches("words", held.clear)
before = resident()
for k in range(50_000):
    held[k] = bytes(2000)
last.append(bytes(2000))     # stands behind what is freed
full = resident()
hold_caches("bpe")
print(before, full, resident())
"""
    out = subprocess.run([sys.executable, "-c", program], capture_output=True, text=True, check=True, cwd=ROOT).stdout
    before, full, after = map(int, out.split())
    assert full - before > 60 and after - before < (full - before) / 4, out
