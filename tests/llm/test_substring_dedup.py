"""Repeated windows against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from deficit_engine.llm import substring_dedup as sd


def brute(rows):
    first = {}
    texts = [(-1 << 63 if i is None else i, (t or "").encode().split()) for i, t in rows]
    for name, words in texts:
        for s in range(len(words) - 19):
            key, at = tuple(words[s:s + 20]), (name, s)
            first[key] = min(first.get(key, at), at)
    out = []
    for (i, _), (name, words) in zip(rows, texts):
        gone = {p for s in range(len(words) - 19) if first[tuple(words[s:s + 20])] < (name, s) for p in range(s, s + 20)}
        out.append((i, len(words), len(gone), b" ".join(w for p, w in enumerate(words) if p not in gone).decode()))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, rid int, kept string")
    return sorted(map(tuple, sd.remove_repeats(df).collect()), key=str)


def corpus(seed, n=150):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    text = lambda k: [draw.choice(words) for _ in range(k)]
    shared = [text(draw.randint(15, 60)) for _ in range(6)]
    rows, past = [], [text(80)]
    for i in range(n):
        kind = draw.randrange(6)
        if kind == 0:                                   # exact copy
            t = list(draw.choice(past))
        elif kind == 1:                                 # near copy
            t = list(draw.choice(past))
            for _ in range(draw.randint(1, 3)):
                t[draw.randrange(len(t))] = "changed" + str(draw.randrange(3))
        elif kind == 2:                                 # passages in the middle
            t = text(30) + draw.choice(shared) + text(10) + draw.choice(shared)
        elif kind == 3:                                 # repeats itself
            t = text(5) + draw.choice(shared) * 2 + ["a", "b"] * draw.randint(5, 30)
        else:
            t = text(draw.randint(1, 90))
        past.append(t)
        rows.append((draw.randrange(10_000), draw.choice([" ", "\n", " \t "]).join(t)))
    return rows


EDGES = [(1, None), (2, ""), (3, " \n "), (4, "a " * 19), (5, "a " * 20), (6, "a " * 21), (7, "a " * 60), (None, "b " * 30),
         (0, "b " * 25), (8, " ".join(map(str, range(40)))), (8, " ".join(map(str, range(40)))), (9, " ".join(map(str, range(5, 45)))),
         (9, "x " + " ".join(map(str, range(5, 45)))), (10, "é\x1cç ö " * 30), (11, "é\x1cç ö " * 12)]


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(sd, "SHARD_ANCHORS", 5)
    rows = corpus(seed) + EDGES
    assert run(spark, rows) == brute(rows)


def test_one_text_everywhere(spark, monkeypatch):
    monkeypatch.setattr(sd, "SHARD_ANCHORS", 50)
    base = " ".join(f"v{k}" for k in range(70))
    rows = [(i, base if i % 3 else f"own{i} {base} end{i}") for i in range(120)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("most", [40, 130, 1000])
def test_first_stays_where_the_owner_fills_several_automata(most, monkeypatch):
    monkeypatch.setattr(sd.compile_passages, "__defaults__", (most,))
    draw = random.Random(6)
    text = lambda k: [f"u{draw.randrange(10**6)}" for _ in range(k)]
    passage = text(100)
    owner = text(100) + passage + text(200) + passage + text(100)
    other = text(30) + passage + passage[:50]
    # the whole owner as one passage, and its two copies alone
    for marks in ([(0, owner)], [(100, passage), (400, passage)]):
        rows = [{"owner": 1, "part": 0, "own": True, "rid": 1, "name": 1, "start": a, "text": " ".join(w)} for a, w in marks]
        rows.append({"owner": 1, "part": 0, "own": False, "rid": 2, "name": 2, "start": 0, "text": " ".join(other)})
        gone = {1: set(), 2: set()}
        for batch in sd._locate(iter([pa.RecordBatch.from_pylist(rows)])):
            for r in batch.to_pylist():
                gone[r["rid"]] |= set(r["gone"])
        assert gone == {1: set(range(400, 481)), 2: {*range(30, 111), *range(130, 161)}}


def test_empty_table(spark):
    assert run(spark, []) == []


def test_automata_are_cut_without_loss():
    draw = random.Random(4)
    words = [str(draw.randrange(50)).encode() for _ in range(500)]
    for most in (20, 37, 100, 1000):
        found = set()
        for a in sd.compile_passages([(7, words)], most):
            found |= {i for i, _ in a.find(words)}
        assert found == set(range(481))


def test_equal_windows_have_equal_anchors():
    draw = np.random.default_rng(2)
    part = draw.integers(0, 1 << 62, 60).astype(np.uint64)
    words = np.concatenate([draw.integers(0, 1 << 62, 33).astype(np.uint64), part, draw.integers(0, 1 << 62, 9).astype(np.uint64), part])
    h, _, a, b = sd.anchors(words, np.zeros(len(words), int))
    of = {s: int(x) for x, i, j in zip(h, a, b) for s in range(i, j + 1)}
    assert sorted(of) == list(range(len(words) - 19))
    for s in range(41):
        assert of[33 + s] == of[33 + 60 + 9 + s]
