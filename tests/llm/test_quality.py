"""Positive-unlabelled classifier: risk, features, held-out accuracy."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from deficit_engine.llm import quality, queries


def text(draw, good):
    words = ["".join(draw.choice("abcdefgilmnorstu") for _ in range(draw.randint(2, 8))) for _ in range(draw.randint(30, 120))]
    if good:
        return " ".join(words).capitalize() + "."
    kind = draw.randrange(3)
    return " ".join(w.upper() + "!!" for w in words) if kind == 0 else " | ".join(words) if kind == 1 else " ".join([words[0]] * len(words))


def corpus(seed, n):
    draw = random.Random(seed)
    return [(i, text(draw, i % 4 != 0), int(i % 4 != 0)) for i in range(n)]


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def run(spark, docs, labels, train=None):
    d = spark.createDataFrame(docs, "doc_id long, text string, quality int, x int")
    y = spark.createDataFrame(labels, "doc_id long, quality int, text string")
    return quality.classify(d, y, F.lit(True) if train is None else train).collect()


def test_held_out_accuracy_and_no_learning_from_held_out(spark):
    rows = corpus(1, 900)
    docs = [(i, t, 0, 0) for i, t, _ in rows]
    labels = [(i, y, "x") for i, _, y in rows if i % 3]
    scores = {r["doc_id"]: r["score"] for r in run(spark, docs, labels, ~queries.held_out())}
    assert len(scores) == 900 and all(0 <= s <= 1 for s in scores.values())
    test = [(scores[i] >= 0.3) == bool(y) for i, _, y in rows if held(i)]
    assert np.mean(test) > 0.97
    # other labels of held-out rows change nothing
    turned = [(i, 1 - y if held(i) else y, "x") for i, y, _ in labels]
    assert scores == {r["doc_id"]: r["score"] for r in run(spark, docs, turned, ~queries.held_out())}


def test_only_positives_are_labelled(spark):
    rows = corpus(3, 800)
    scores = {r["doc_id"]: r["score"] for r in run(spark, [(i, t, 0, 0) for i, t, _ in rows], [(i, 1, "x") for i, _, y in rows if y and i % 2])}
    assert np.mean([(scores[i] >= 0.3) == bool(y) for i, _, y in rows]) > 0.95


def test_share_of_a_mixture():
    draw = np.random.default_rng(4)
    good = draw.normal(size=(3000, 3))
    mixed = np.concatenate([draw.normal(size=(2100, 3)), draw.normal(5, 1, size=(900, 3))])
    assert abs(quality.mixture_share(good, mixed) - 0.7) < 0.06


def test_edge_rows(spark):
    docs = [(i, t, 0, 0) for i, t, _ in corpus(2, 200)] + [(900, None, 0, 0), (901, "", 0, 0), (902, " \n ", 0, 0), (None, "word", 0, 0),
                                                           (5, "again", 0, 0), (903, "é" * 50_000, 0, 0)]
    labels = [(i, y, "x") for i, _, y in corpus(2, 200)] + [(None, 1, "x"), (900, None, "x"), (3, 0, "x"), (3, 1, "x")]
    out = run(spark, docs, labels)
    assert len(out) == len(docs) and all(0 <= r["score"] <= 1 for r in out)
    by = {r["doc_id"]: r["score"] for r in out}
    assert by[900] == by[901]


def test_without_labels_or_rows(spark):
    docs = [(1, "a b c", 0, 0)]
    assert [r["score"] for r in run(spark, docs, [])] == [0.5]
    assert [r["score"] for r in run(spark, docs, [(1, 0, "x")])] == [0.0]
    assert run(spark, [], []) == []


def test_risk_stays_non_negative():
    """With unlabelled rows that are all positive the model must not call them negative."""
    draw = np.random.default_rng(1)
    x = draw.normal(size=(400, 5)).astype(np.float32)
    model = quality.fit(x[:200], x[200:], prior=0.9)
    assert model.score(x).mean() > 0.6


def test_features_do_not_depend_on_neighbours():
    texts = ["Ab, c!!", "", "x", "AB AB AB\nAB", "é" * 9, "a | b | c | d | e | f"]
    together = quality.features(texts)
    for t, row in zip(texts, together):
        assert np.array_equal(quality.features([t])[0], row)
