"""The grammar by hand, the scores against a plain recomputation, and held-out accuracy."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from deficit_engine.llm import queries, toxicity
from deficit_engine.llm.toxicity import AIMED, INSULT, NEGATED, REPORTED, THREAT, Grammar, Lexicon

SYMBOL = {"insult": 1, "threat": 2, "target": 3, "negation": 4, "report": 5, "quote": 6}


def events(words):
    return sorted(Grammar().events([SYMBOL.get(w, 0) for w in words.split()]))


@pytest.mark.parametrize("words, want", [
    ("a b c", []),
    ("a insult b", [(1, INSULT)]),
    ("target a insult", [(2, INSULT | AIMED)]),
    ("target a b c d insult", [(5, INSULT)]),                   # too far from the target
    ("insult a target", [(0, INSULT | AIMED)]),                 # a target right after it
    ("insult a b target", [(0, INSULT)]),
    ("target negation a insult", [(3, INSULT | NEGATED | AIMED)]),
    ("negation a b c insult", [(4, INSULT)]),                   # beyond the negation's scope
    ("report a b c insult", [(4, INSULT | REPORTED)]),
    ("quote insult quote insult", [(1, INSULT | REPORTED), (3, INSULT)]),
    ("threat a b", []),                                         # a threat without a target is none
    ("threat target", [(0, THREAT | AIMED)]),
    ("report threat target", [(1, THREAT | REPORTED | AIMED)]),
    ("insult insult", [(0, INSULT), (1, INSULT)]),
])
def test_grammar(words, want):
    assert events(words) == want


def test_composition_equals_the_machines_one_after_another():
    draw = random.Random(3)
    grammar = Grammar()
    for _ in range(300):
        symbols = [draw.randrange(7) for _ in range(draw.randrange(1, 15))]
        marked = symbols
        for machine in (toxicity.Negation(), toxicity.Report(), toxicity.Target()):
            state, out = machine.start, []
            for s in marked:
                state, o = machine.step(state, s)
                out.append(o)
            marked = out
        for machine in (toxicity.Trailing(), toxicity.Threat()):
            state, out = machine.start, []
            for s in reversed(marked):
                state, o = machine.step(state, s)
                out.append(o)
            marked = out[::-1]
        want = [(at, o) for at, o in enumerate(marked) if o & 7 in (INSULT, THREAT)]
        assert sorted(grammar.events(symbols)) == want


def test_clauses_are_scored_not_words():
    book, grammar = Lexicon({}), Grammar()

    def score(text):
        return float(toxicity._squash(toxicity.features(text, book, grammar)[None])[0] @ toxicity.own_weights())
    assert score("You are an idiot.") > score("An idiot.") > score("She said you are an idiot.") > score("You are not an idiot.")
    assert score("They will hurt you") > score("It will hurt") == score("Nothing here") == score("")
    # a repeated clause and a repeated word count once
    assert score("An idiot idiot.") == pytest.approx(score("An idiot."), abs=0.2)
    clean = toxicity.features("An idiot. " * 50, book, grammar)
    assert clean[1] == toxicity.LISTED and clean[toxicity.N_KINDS] == 1


def test_longest_stem_decides():
    book = Lexicon({"vejuba": 5.0, "veju": 2.0, "=veju": 0.9})
    assert book.look_up("vejubakel") == (INSULT, 5.0) and book.look_up("vejupo") == (INSULT, 2.0)
    assert book.look_up("veju") == (INSULT, 0.9) and book.look_up("vej") == (0, 0.0)
    assert book.look_up("not")[0] == SYMBOL["negation"] and book.look_up("idiot") == (INSULT, toxicity.LISTED)


SYLLABLES = "ba ko li me nu ra si to ve wa du fe".split()


def corpus(n, seed):
    """Texts of invented words; toxic ones hold words that start with a stem of their own."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(draw.choice(SYLLABLES) for _ in range(draw.randrange(1, 4))) for _ in range(draw.randrange(20, 60))]
        y = int(draw.random() < 0.2)
        for _ in range(draw.randrange(2, 5) * y):
            words.insert(draw.randrange(len(words)), draw.choice(["grimbo", "zekla"]) + draw.choice(SYLLABLES))
        rows.append((i, " ".join(words) + ".", y))
    return rows


def split(rows):
    return [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5], [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]


def test_learned_stems_and_held_out_accuracy(spark):
    rows = corpus(1200, 1)
    train, held = split(rows)
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows], "doc_id long, text string, fold string, least double")
    labels = spark.createDataFrame([(i, y) for i, _, y in train] + [(i, 1 - y) for i, _, y in held], "doc_id long, toxic int")
    # the held-out labels are wrong on purpose: learning them would show
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels, ~queries.held_out()).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    assert np.mean([(got[i]["score"] >= 0.5) == y for i, _, y in held]) > 0.97


def test_defined_cases(spark):
    rows = corpus(300, 2)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    long_text = "ba ko li. " * 60_000 + "grimboba zeklako."
    odd = [(None, "grimboba zeklako"), (2000, None), (2001, ""), (2002, " \n .. "), (2003, long_text), (0, rows[0][1]), (0, rows[0][1])]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + odd, "doc_id long, text string")
    got = toxicity.classify(docs, labels, F.lit(True)).collect()
    assert len(got) == len(rows) + len(odd)
    score = {r["doc_id"]: r["score"] for r in got}
    assert score[2000] == score[2001] == score[2002] < 0.5 and score[None] > 0.5
    assert len({r["score"] for r in got if r["doc_id"] == 0}) == 1
    assert next(r["matched_clauses"] for r in got if r["doc_id"] == 2003) == 1
    # without labels, or with one kind only, the listed words decide
    plain = spark.createDataFrame([(1, "You are an idiot."), (2, "A fine day."), (3, None)], "doc_id long, text string")
    for known in ([], [(1, 1)], [(1, 0), (2, 0)], [(1, None)]):
        by = {r["doc_id"]: r["score"] for r in toxicity.classify(plain, spark.createDataFrame(known, "doc_id long, toxic int"), F.lit(True)).collect()}
        assert by[1] > 0.5 > by[2] == by[3]
    assert toxicity.classify(plain.limit(0), labels, F.lit(True)).collect() == []


def test_scores_recomputed(spark):
    """Every score again from the text alone, by machines run one after the other on each clause."""
    rows = corpus(400, 3)
    train, _ = split(rows)
    learned, kept = {}, {}
    original = toxicity._score

    def watch(lexicon, weights):
        learned.update(lexicon)
        kept["w"] = weights
        return original(lexicon, weights)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in train], "doc_id long, toxic int")
    toxicity._score, saved = watch, toxicity._score
    try:
        got = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, labels, ~queries.held_out()).collect()}
    finally:
        toxicity._score = saved
    assert any(s.startswith("grimbo") or s.startswith("gri") for s in learned)
    book, grammar = Lexicon(learned), Grammar()
    for i, t, _ in rows:
        z = float(toxicity._squash(toxicity.features(t, book, grammar)[None])[0] @ kept["w"])
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9


def test_query(spark):
    got = queries.op11_toxicity(spark, "/root/testdata/sf0.01")
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    # 70 labelled rows are held out; 45 toxic ones are learned from
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.85
