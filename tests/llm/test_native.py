"""Exact dedup, mixing and quotation linking on small cases."""

import uuid

import pytest
from pyspark.sql import functions as F

from deficit_engine.llm import chat_format, exact_dedup, mixing

DOC = "doc_id long, text string, lang string, source string, n_chars long, digest string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "clash") for i, t, s in rows], DOC)


def marks(spark, df, index=None):
    index = index or exact_dedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}")
    return {(r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.mark_duplicates(df, index).collect()}


def test_dedup_cases(spark):
    rows = [(1, "Ab", "s"), (2, "aB", "s"), (3, "É", "s"), (4, "é", "s"), (5, None, "s"), (6, "", "s"),
            (7, "x", "s"), (7, "x", "s"), (None, "ab", "s"), (None, "lone", "s")]
    assert marks(spark, docs(spark, rows)) == {
        (1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (3, 3, 1, True), (4, 4, 1, True),
        (5, 6, 2, False), (6, 6, 2, True), (7, 7, 2, True), (None, None, 1, True)}
    assert marks(spark, docs(spark, [])) == set()
    kept = exact_dedup.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 2, 3, 4, 6, 7]


def test_dedup_rest_beside_hot(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", 2)
    rows = [(i, "hot" if i % 2 else f"t{i % 7}", "s") for i in range(60)]
    got = marks(spark, docs(spark, rows))
    for i, t, _ in rows:
        same = [j for j, u, _ in rows if u == t]
        assert (i, max(same), len(same), i == max(same)) in got
    assert len(got) == 60


def test_index_grows_by_batches(spark):
    index = exact_dedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}", buckets=4)
    assert marks(spark, docs(spark, [(1, "a", "s"), (2, "b", "s")]), index) == {(1, 1, 1, True), (2, 2, 1, True)}
    assert marks(spark, docs(spark, [(9, "A", "s"), (10, "c", "s")]), index) == {(9, 1, 2, False), (10, 10, 1, True)}    # sizes count all batches
    assert index.table().count() == 3


def fill(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Targets by resharing the excess until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] >= cap * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_targets(spark):
    sizes = {"a": 100, "b": 7, None: 50, "ab": 3, "é": 400, "z": 0, "Z": 90}
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "src string, source_size long, n_units long")
    got = {r["src"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(fill(sizes))


def test_mix(spark):
    rows = [(i, "w " * (1 + i * 37 % 200), f"s{i % 5}" if i % 6 else None) for i in range(900)]
    rows += [(2000, None, "s1"), (2001, "", "s1"), (2002, " \n ", None), (3000, "r r r", "s2"), (3000, "r r r", "s2"), (None, "n n", "s3")]
    df = docs(spark, rows)
    got = mixing.mix(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=str)
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = fill(sizes)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in own} == {sizes[s]}
        assert own[0]["target"] == pytest.approx(want[s])
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 100  # half of the longest document
        assert all(r["copies"] in (0, 1, 2) and r["taken"] == r["copies"] * r["size"] for r in own)
    taken = mixing.take(docs(spark, rows[:900]))
    assert taken.columns == df.columns
    counts = {r["doc_id"]: r["n"] for r in taken.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {r["doc_id"]: r["copies"] for r in mixing.mix(docs(spark, rows[:900])).collect() if r["copies"]}


def test_take_deals_the_copies_of_each_unit(spark):
    rows = [(i, "w " * (1 + i * 37 % 50), f"s{i % 3}") for i in range(60)]
    rows += [(7, f"same{k} id", "s1") for k in range(9)] + [(7, "a longer text of it " * 9, None), (7, None, "s1")]
    rows += [(None, f"no id{k} here", "s2") for k in range(11)] + [(None, "no id and longer", "s2"), (None, "x", None), (None, "", "s0")]
    df = docs(spark, rows)
    want, got, each = {}, {}, {}
    for r in mixing.mix(df).collect():
        unit = (r["source"], r["doc_id"], r["size"])
        want.setdefault(unit, []).append(r["copies"])
    for r in mixing.take(df).collect():
        unit = (r["source"], r["doc_id"], len((r["text"] or "").split()))
        each.setdefault(unit, {}).setdefault(r["text"], []).append(1)
        got[unit] = got.get(unit, 0) + 1
    assert got == {u: sum(c) for u, c in want.items() if sum(c)}
    for unit, texts in each.items():
        dealt = sorted(len(n) for n in texts.values())
        assert dealt == sorted(c for c in want[unit] if c), unit


def test_mix_empty_and_single(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    one = mixing.mix(docs(spark, [(1, "a b c", "s")])).collect()
    assert [(r["target"], r["copies"]) for r in one] == [(4.5, 2)]
    none = mixing.mix(docs(spark, [(1, None, "s")])).collect()
    assert [(r["target"], r["taken"]) for r in none] == [(0.0, 0)]


def test_mix_is_unbiased_over_seeds(spark):
    df = docs(spark, [(i, "w " * (5 + i), "s") for i in range(40)]).cache()
    total = {}
    for seed in range(4):
        for r in mixing.mix(df, seed=seed).collect():
            total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["copies"]
    mean = sum(total.values()) / 40 / 4
    assert 1.3 < mean < 1.7
    assert len(set(total.values())) > 2  # the seed decides which document is taken twice


def test_quotations(spark):
    rows = [(1, 0, "u", "First line\nsecond  Line", 0), (1, 1, "a", "> first LINE\nanswer", 0),
            (1, 2, "u", ">> First line\n> answer\n> nowhere\nmore", 0), (1, 3, "a", "> more\n> second line\nok", 0),
            (1, 4, "u", "> later\nhm", 0), (1, 5, "a", "later", 0), (2, 0, "u", "> answer", 0),
            (2, 1, None, None, 0), (2, 2, "a", "", 0), (None, 0, "u", "> x\ny", 0), (3, None, "u", "a\n> b", 0),
            (2, 2, "a", "", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position int")
    got = {(r["conv_id"], r["turn"]): r for r in chat_format.link_quotations(df).collect()}
    assert len(chat_format.link_quotations(df).collect()) == len(rows)
    pick = lambda *k: tuple(got[k][c] for c in ("clean_text", "quoted_lines", "quote_depth", "linked_lines", "reply_to", "thread_root", "reply_depth"))
    assert pick(1, 0) == ("First line\nsecond  Line", 0, 0, 0, None, 0, 0)
    assert pick(1, 1) == ("answer", 1, 1, 1, 0, 0, 1)
    assert pick(1, 2) == ("more", 3, 2, 2, 1, 0, 2)
    assert pick(1, 3) == ("ok", 2, 1, 2, 2, 0, 3)      # two messages quoted once each: the later one
    assert pick(1, 4) == ("hm", 1, 1, 0, None, 4, 0)   # the original comes later
    assert pick(2, 0)[:4] == ("", 1, 1, 0)
    assert pick(2, 1) == ("", 0, 0, 0, None, 1, 0)
    assert pick(None, 0)[0] == "y" and pick(3, None)[0] == "a"
    assert [got[1, t]["position"] for t in range(6)] == [1, 2, 3, 4, 5, 6]
    assert chat_format.link_quotations(df.limit(0)).count() == 0
