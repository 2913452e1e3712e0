"""Pipeline stages on tables with clashing names, repeated rows, very long texts and odd column types."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from deficit_engine.llm import common, exact_dedup, jaccard_join, language_id, mixing

NAMES = ["__own", "__row", "__digest", "__kept", "__order", "__chosen", "__id", "__rejected", "__src", "__size", "__c", "__n", "__hash",
         "__span", "__rows", "__start", "__rank", "__copies", "__copy", "__src_of", "node", "component", "rid", "digest", "copies", "a.b", "own`tick"]
STAGES = {"exact": exact_dedup.keep_one, "near": jaccard_join.keep_one, "language": language_id.keep_identified, "mixing": mixing.take}


def clash(spark, rows, path):
    df = spark.createDataFrame([(i, t, lang, src, len(t or "")) for i, t, lang, src in rows],
                               "doc_id long, text string, lang string, source string, n_chars int")
    extra = {n: F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) for n in NAMES}
    df.withColumns(extra).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("day", F.lit(dt.date(2020, 1, 2))).write.parquet(path)
    return spark.read.parquet(path)


def texts(n):
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    return [" ".join(words[(i * k + k) % 12] + str((i + k) % 97) for k in range(30)) for i in range(n)]


@pytest.mark.parametrize("stage", STAGES)
def test_columns_come_through_unchanged(spark, stage, tmp_path):
    rows = [(i, t, "en", f"s{i % 2}") for i, t in enumerate(texts(40))]
    rows += [(50, rows[3][1].upper(), "en", "s0"), (None, rows[4][1], "en", None), (60, None, None, "s1"), (61, "", "en", "s1")]
    df = clash(spark, rows, str(tmp_path / "docs"))
    out = STAGES[stage](df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = out.collect()
    assert got
    whole = {str(r) for r in df.collect()}
    for r in got:
        assert str(r) in whole


@pytest.mark.parametrize("stage", ["exact", "near"])
def test_the_same_row_of_repeated_ones_every_time(spark, stage):
    t = texts(3)
    rows = [(1, t[0], "en", s) for s in ("b", "a", "c")] + [(2, t[1], "en", None), (2, t[1], "de", "x"), (3, t[2], "en", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    once = sorted(map(str, STAGES[stage](df).collect()))
    again = sorted(map(str, STAGES[stage](df.repartition(5, "source").orderBy(F.desc("source"))).collect()))
    assert once == again and len(once) == 3


def test_very_long_texts(spark):
    base = texts(1)[0]
    long_text = " ".join(f"{base} w{k}" for k in range(12_000))      # 2 MB
    rows = [(1, long_text, "en", "a"), (2, long_text.upper(), "en", "a"), (3, long_text + " end", "en", "a"), (4, base, "en", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sorted(r["doc_id"] for r in exact_dedup.keep_one(df).collect()) == [2, 3, 4]
    assert sorted(r["doc_id"] for r in jaccard_join.keep_one(df).collect()) == [1, 4]
    sizes = {r["doc_id"]: r["size"] for r in mixing.mix(df).collect()}
    assert sizes[1] == sizes[2] == 12_000 * 31 and sizes[4] == 30


def test_spare_names():
    class Frame:
        columns = ["__A", "__a_", "b"]
    assert common.spare_names(Frame, "a", "b", "a") == ["__a__", "__b", "__a___"]


# --- the digest index over batches -----------------------------------------------------

def index(spark, tmp_path, name):
    return exact_dedup.DigestIndex(spark, name, str(tmp_path / name), buckets=4)


def marked(df, ix):
    return {r["id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.mark_duplicates(df, ix).collect()}


def test_group_sizes_count_all_batches(spark, tmp_path):
    ix = index(spark, tmp_path, "digest_batches")
    batch = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    try:
        assert marked(batch([(1, "a"), (2, "A"), (3, "b")]), ix) == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True)}
        assert marked(batch([(4, "a"), (5, "c")]), ix) == {4: (2, 3, False), 5: (5, 1, True)}
        assert marked(batch([(6, "a"), (7, "a"), (8, "c")]), ix) == {6: (2, 5, False), 7: (2, 5, False), 8: (5, 2, False)}
        assert marked(batch([]), ix) == {}
    finally:
        ix.drop()
    assert not spark.catalog.tableExists("digest_batches")


def test_a_small_batch_against_a_large_index_of_repeats(spark, tmp_path, monkeypatch):
    """Only digests that are frequent in the batch are broadcast, not those of the index."""
    ix = index(spark, tmp_path, "digest_large")
    sent = []
    original = F.broadcast

    def watch(df):
        sent.append(df.count())
        return original(df)
    try:
        ix.add(spark.range(200_000).select("id", F.sha2((F.col("id") % 100_000).cast("string"), 256).alias("digest")))
        monkeypatch.setattr(exact_dedup.F, "broadcast", watch)
        rows = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 400).cast("string").alias("text"))
        got = exact_dedup.mark_duplicates(rows, ix)
        monkeypatch.undo()
        assert sent and max(sent) <= exact_dedup.HOT_SHARE
        assert got.count() == 1000 and got.agg(F.min("group_size"), F.max("group_size")).first() == (4, 5)
    finally:
        ix.drop()
