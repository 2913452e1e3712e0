"""Language identification: evidence by evidence, on small made-up languages."""

import math
import random
from collections import Counter

import numpy as np

from deficit_engine.llm import language_id as lid

SYLLABLES = {"aa": ["ba", "bo", "bi", "ke"], "bb": ["zut", "zot", "xir", "qe"], "cc": ["ñan", "lío", "ése", "né"]}


def words(draw, lang, n):
    return " ".join("".join(draw.choice(SYLLABLES[lang]) for _ in range(draw.randint(1, 3))) for _ in range(n))


def rows(seed=1, n=120):
    draw, out = random.Random(seed), []
    for i in range(n):
        lang = draw.choice(list(SYLLABLES))
        out.append((i, words(draw, lang, draw.randint(20, 60)), lang if i % 9 else None, f"h{i % 7}", "com" if i % 2 else None, lang))
    return out


def run(spark, data):
    df = spark.createDataFrame([r[:5] for r in data], "id long, text string, declared string, host string, suffix string")
    return {r["id"]: r for r in lid.identify(df).collect()}


def test_text_decides_clear_cases(spark):
    data = rows()
    data[5] = (5, data[5][1], "bb" if data[5][5] != "bb" else "aa", "h5", None, data[5][5])   # a wrong statement
    got = run(spark, data)
    assert len(got) == len(data)
    for i, *_, lang in data:
        assert got[i]["lang"] == lang and not got[i]["rejected"], i


def test_other_evidence_decides_without_text(spark):
    data = rows()
    draw = random.Random(2)
    data += [(1000 + k, words(draw, "cc", 30), "cc", "only-cc.example", "cc", "cc") for k in range(30)]
    data += [(2000, None, "cc", None, None, ""), (2001, "", None, "only-cc.example", "cc", ""), (2002, " !? ", None, None, "cc", ""),
             (2003, None, None, None, None, ""), (2004, "", "zz", "new.example", "new", "")]
    got = run(spark, data)
    assert got[2000]["lang"] == "cc" and got[2001]["lang"] == "cc" and got[2002]["lang"] == "cc"
    assert got[2001]["confidence"] > got[2002]["confidence"] - 1e-9
    assert got[2003]["rejected"]     # nothing is known of it


def test_noise_is_rejected(spark):
    draw = random.Random(3)
    noise = "".join(chr(draw.randint(0x4E00, 0x9FFF)) for _ in range(400))
    got = run(spark, [*rows(), (3000, noise, None, None, None, "")])
    assert got[3000]["lang"] == lid.UNKNOWN and got[3000]["rejected"]


def test_priors_by_hand(spark):
    """Host prior of an empty text: counts of the text votes, smoothed twice."""
    data = [(i, words(random.Random(i), "aa" if i < 30 else "bb", 30), "aa" if i < 30 else "bb", "h" if i < 12 or i >= 50 else "g", "s" if i < 40 else "t", "")
            for i in range(60)]
    got = run(spark, [*data, (99, "", None, "g", "s", "")])
    names = ["aa", "bb", "und"]
    vote = lambda keep: np.array([Counter("aa" if r[0] < 30 else "bb" for r in data if keep(r))[x] for x in names], float)
    smooth = lambda c, w: (c + lid.SMOOTH * w) / (c.sum() + lid.SMOOTH)
    own = np.array([1.0, 0, 0])  # an empty text votes for the first language: all are equally likely
    whole = smooth(vote(lambda r: True) + own, np.full(3, 1 / 3))
    suffix = smooth(vote(lambda r: r[4] == "s") + own, whole)
    host = smooth(vote(lambda r: r[3] == "g" and r[4] == "s") + own, suffix)
    want = host / host.sum()
    assert got[99]["lang"] == names[int(want.argmax())]
    assert math.isclose(got[99]["confidence"], want.max(), rel_tol=1e-9)


def test_page_rows(spark):
    html = "<!DOCTYPE html><HTML class='x' LANG=\"fr-CA\"><head><style>p{a}</style><script>var t='<p>no</p>'</script></head><!-- c --><p>été &amp; <b>x</b></p>"
    df = spark.createDataFrame([(1, "https://u:p@M.Example.CO.fr:80/a?b#c", html, "x"), (2, None, None, "y"), (3, "no url", "<p>a</p>", "z"),
                                (4, "http://localhost", "a < b", "z")],
                               "page_id long, url string, html string, text string")
    got = {r["id"]: r for r in lid.page_rows(df).collect()}
    assert (got[1]["declared"], got[1]["host"], got[1]["suffix"]) == ("fr", "m.example.co.fr", "fr")
    assert got[1]["text"].split() == ["été", "x"]
    assert tuple(got[2])[1:] == ("", None, None, None)
    assert (got[3]["host"], got[4]["host"], got[4]["suffix"]) == (None, "localhost", None)


def test_keep_identified(spark):
    draw = random.Random(3)
    noise = "".join(chr(draw.randint(0x4E00, 0x9FFF)) for _ in range(400))
    data = [(r[0], r[1], r[2], r[3], 1, 0.5) for r in rows()] + [(500, noise, None, None, 1, 0.5), (None, noise, None, None, 1, 0.5),
                                                               (7, noise, None, None, 1, 0.5)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, confidence double")
    kept = lid.keep_identified(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 500 not in ids and None in ids and ids.count(7) == 2 and len(ids) == len(data) - 1


def test_rare_languages_stay(spark):
    """Their share of the rows does not matter: 3 and 1 of 4,004 rows are under 0.1 %."""
    draw = random.Random(8)
    data = [r for k in range(20) for r in rows(seed=20 + k, n=200)]
    data = [(i, *r[1:]) for i, r in enumerate(data)]
    cyrillic = lambda n: " ".join("".join(draw.choice(["да", "не", "ко", "ру", "щи"]) for _ in range(3)) for _ in range(n))
    rare = [(9000 + k, cyrillic(200), "ru", "h1", "com", "ru") for k in range(3)]
    # too little text for a model of its own
    short = (9100, "ηθ ψω ξζ φχ", "el", "h1", "com", "el")
    got = run(spark, [*data, *rare, short])
    assert all(got[r[0]]["lang"] == "ru" and not got[r[0]]["rejected"] for r in rare)
    assert not got[9100]["rejected"]
    for i, *_, lang in data[:200]:
        assert got[i]["lang"] == lang and not got[i]["rejected"], i


def test_empty_table(spark):
    assert run(spark, []) == {}
    assert all(r["rejected"] for r in run(spark, [(1, "some text", None, None, None, "")]).values())


def test_grams_do_not_cross_texts():
    a, n = lid.grams(["abc", "", "x", "ÀÉ abc"])
    b = [lid.grams([t])[0] for t in ("abc", "", "x", "ÀÉ abc")]
    assert list(n) == [3, 0, 1, 8] and list(a) == [x for y in b for x in y]
