"""Quotations linked by whole passages, against brute force and the registered SQL."""

import random
import re

import duckdb

from deficit_engine.llm import chat_format, oracle

COLUMNS = ["conv_id", "position", "turn", "role", "clean_text", "quoted_lines", "quote_depth", "linked_lines", "reply_to", "thread_root", "reply_depth"]


def linked(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, hash string, span int")
    out = chat_format.link_quotations(df)
    assert out.columns == COLUMNS
    return out.collect()


def by_turn(spark, rows):
    return {r["turn"]: r for r in linked(spark, rows)}


def test_the_whole_quotation_decides(spark):
    rows = [(1, 1, "a", "S1\nS2\nS3\nA"), (1, 2, "b", "S1\nS2\nS3\nB1\nB2"),
            (1, 3, "a", "> S1\n> S2\n> S3\n> B1\n> B2\nyes")]
    got = by_turn(spark, rows)
    assert got[3]["reply_to"] == 2 and got[3]["linked_lines"] == 5 and got[3]["clean_text"] == "yes"


def test_another_line_width(spark):
    rows = [(1, 1, "a", "the quick brown fox\njumps over the lazy dog"), (1, 2, "b", "other"),
            (1, 3, "b", "> the quick\n> brown fox jumps\n>  over the\tlazy dog\n\nindeed")]
    got = by_turn(spark, rows)
    assert got[3]["reply_to"] == 1 and got[3]["linked_lines"] == 3


def test_the_latest_earlier_holder(spark):
    rows = [(1, t, "a", "thanks" if t % 2 else f"no {t}") for t in range(1, 3000)] + [(1, 2100, "b", "> thanks"), (1, 5000, "b", "> thanks"), (1, 1, "b", "> thanks")]
    got = {(r["turn"], r["role"]): r["reply_to"] for r in linked(spark, rows)}
    assert got[2100, "b"] == 2099 and got[5000, "b"] == 2999 and got[1, "b"] is None


def test_rare_lines_count_for_more(spark):
    # nobody holds the quoted passage whole; hello is in every message, the other line in one
    rows = [(1, t, "a", f"hello\nmore {t}") for t in range(1, 8)] + [(1, 8, "a", "hello\nrare line\nx"), (1, 9, "a", "hello\ny"),
                                                                     (1, 10, "b", "> hello\n> rare line\nok")]
    got = by_turn(spark, rows)
    assert got[10]["reply_to"] == 8 and got[10]["linked_lines"] == 2


def test_nested_levels(spark):
    rows = [(1, 1, "a", "first point"), (1, 2, "b", "> first point\nsecond point"), (1, 3, "a", "> > first point\n> second point\nthird")]
    got = by_turn(spark, rows)
    assert [got[t]["reply_to"] for t in (1, 2, 3)] == [None, 1, 2] and got[3]["linked_lines"] == 2
    assert got[3]["thread_root"] == 1 and got[3]["reply_depth"] == 2 and got[3]["quote_depth"] == 2


def conversations(seed, n):
    draw = random.Random(seed)
    rows = []
    for conv in range(6):
        said = []
        for turn in range(1, n):
            body = [draw.choice(["hi", "thanks", f"w{draw.randrange(40)} x", f"line {draw.randrange(9)}", ""]) for _ in range(draw.randrange(1, 5))]
            text = []
            if said and draw.random() < 0.7:
                quoted = draw.choice(said).split("\n")
                if draw.random() < 0.3:
                    quoted = quoted[:draw.randrange(1, len(quoted) + 1)]
                if draw.random() < 0.2:
                    quoted = " ".join(quoted).split(" x")
                text = [">" * draw.choice([1, 1, 2]) + " " + q for q in quoted]
            text = "\n".join(text + body)
            said.append(text)
            rows.append((conv, turn if draw.random() < 0.97 else draw.choice([None, turn - 1]), draw.choice(["a", "b", None]), text if draw.random() < 0.98 else None))
    return rows + [(None, 1, "a", "> hi"), (None, None, None, None), rows[3], rows[3]]


def test_equal_to_the_sql(spark):
    rows = conversations(4, 40)
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", [list(r) for r in rows])
    want = sorted(map(str, con.execute(oracle.OP8).fetchall()))
    assert sorted(str(tuple(r)) for r in linked(spark, rows)) == want


def test_reply_equals_brute_force(spark):
    rows = [r for r in conversations(9, 30) if r[0] is not None and r[1] is not None and r[3] is not None]
    rows = list({(r[0], r[1]): r for r in rows}.values())

    def passages(text):
        out = []
        for line in text.split("\n"):
            marks = re.match(r"(?:[ \t]*>)*", line)[0]
            level, body = marks.count(">"), re.sub(r"[ \t\r]+", " ", line[len(marks):].lower()).strip(" ")
            if out and out[-1][0] == level:
                out[-1][1].append(body)
            else:
                out.append((level, [body]))
        return [(lv, [b for b in bodies if b]) for lv, bodies in out if any(bodies)]
    held = {(c, t): passages(x) for c, t, _, x in rows}
    got = {(r["conv_id"], r["turn"]): r["reply_to"] for r in linked(spark, rows)}
    for (c, t), own in held.items():
        votes = {}
        for level, bodies in own:
            if level == 1:
                holders = [u for (d, u), theirs in held.items() if d == c and u < t and any(lv == 0 and " ".join(b) == " ".join(bodies) for lv, b in theirs)]
                if holders:
                    votes[max(holders)] = votes.get(max(holders), 0) + len(bodies)
        if votes:
            assert got[c, t] == max(votes, key=lambda u: (votes[u], u))


def test_very_long_message(spark):
    text = "\n".join(f"{'> ' * (k // 500 % 2)}line {k}" for k in range(60_000))
    rows = [(1, 1, "a", "line 7"), (1, 2, "b", text), (1, 3, "a", "\n".join("> " + x for x in text.split("\n")[:500]) + "\nfine")]
    got = by_turn(spark, rows)
    assert got[2]["quoted_lines"] == 30_000 and got[3]["reply_to"] == 2 and got[3]["linked_lines"] == 500
