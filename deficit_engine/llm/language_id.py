"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are combined for every row:
  text       log-likelihood of its byte trigrams (hashed, letters only) under
             one model per language, learned from all rows by their declared
             language; a flat model stands for "no language" (``und``)
  declared   the language that markup or metadata states, weighed by how often
             that statement goes with each language in the text of all rows
  address    host, smoothed by its address suffix, smoothed by all rows:
             P(l | host) = (n_host,l + M * P(l | suffix)) / (n_host + M), and alike
             for the suffix over the whole
All counts come from grouped aggregation over all rows; a host that holds a
third of them is summed before the shuffle, and its rows meet the host's prior
in a many-to-one join that can be split.

A row is rejected when ``und`` is the likeliest or no language reaches
``CERTAIN``, unless it declares a language that has no model: that nothing is
known of its language says nothing against its text.

Defined cases
  null or empty text      the other evidence decides
  null declared, host or suffix   that evidence is left out
  declared language with under MIN_GRAMS trigrams of text   has no model, counted as
                          "other"; its rows are never rejected
  no declared language at all     every row is ``und``
  repeated rows           judged row by row
  empty table             an empty result
  other columns           are not read
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deficit_engine.llm.common import Scratch, ship_package, spare_names
from deficit_engine.llm.units import hold_caches, text_slices

GRAMS = 1 << 14
MIN_GRAMS = 1000        # trigrams with a letter that a language's model is learned from, at least
SMOOTH = 20.0           # M: rows that the wider level counts for
WEIGHT, MOST = 0.3, 300  # neighbouring trigrams repeat each other; text counts as at most MOST of them
CERTAIN = 0.8
UNKNOWN = "und"


def _fold() -> np.ndarray:
    """Bytes with capitals lowered and all but letters and bytes beyond ASCII as a space."""
    fold = np.full(256, 32, np.uint32)
    fold[97:123] = np.arange(97, 123)
    fold[65:91] = np.arange(97, 123)
    fold[128:] = np.arange(128, 256)
    return fold


FOLD = _fold()


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts and the number of each text's. A text of n bytes has n; it ends in spaces."""
    raws = [t.encode() + b"  " if t else b"" for t in texts]
    sizes = np.array([max(len(r) - 2, 0) for r in raws], np.int64)
    raw = FOLD[np.frombuffer(b"".join(raws) + b"  ", np.uint8)]
    every = ((raw[:-2] * np.uint32(0x9E3779B1) + raw[1:-1] * np.uint32(0x85EBCA77) + raw[2:] * np.uint32(0xC2B2AE3D))
             >> np.uint32(18)).astype(np.int64)
    inside = np.ones(len(every), bool)
    ends = np.cumsum([len(r) for r in raws])
    for back in (1, 2):
        inside[(ends - back)[sizes > 0]] = False
    return every[inside[:len(every)]] if len(every) else every, sizes


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hold_caches("language")
    held: dict[str, np.ndarray] = {}

    def flush():
        for name, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())],
                                             ["declared", "gram", "n"])
        held.clear()

    for batch in batches:
        for part in text_slices(batch, "text"):
            declared = np.array(part.column("declared").to_pylist(), object)
            texts = part.column("text").to_pylist()
            for name in set(declared):
                found, _ = grams([t or "" for t, d in zip(texts, declared) if d == name])
                held[name] = held.get(name, 0) + np.bincount(found, minlength=GRAMS)
            if len(held) > 64:
                yield from flush()
    yield from flush()


def learn_text_models(rows: DataFrame, scratch: Scratch) -> tuple[list[str], np.ndarray]:
    """Languages, and the log-probability of every trigram under each; the last row is ``und``."""
    summed = scratch.write(rows.where(F.col("declared").isNotNull()).select("declared", "text")
                           .mapInArrow(_count, "declared string, gram int, n long")
                           .groupBy("declared", "gram").agg(F.sum("n").alias("n")), "grams")
    blank = int(grams(["   "])[0][0])
    enough = (summed.where(F.col("gram") != blank).groupBy("declared").agg(F.sum("n").alias("n"))
              .where(F.col("n") >= MIN_GRAMS).select("declared"))
    names = sorted(r["declared"] for r in enough.collect())
    counts = np.zeros((len(names), GRAMS))
    if names:
        learned = summed.join(enough, "declared", "left_semi").toArrow()
        at = pc.index_in(learned.column("declared"), value_set=pa.array(names, learned.schema.field("declared").type)).to_numpy()
        counts[at, learned.column("gram").to_numpy()] = learned.column("n").to_numpy()
    flat = np.full((1, GRAMS), -np.log(GRAMS))
    models = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * GRAMS))
    return names, np.concatenate([models, flat])


def _likelihood(models: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_caches("language")
        table = np.ascontiguousarray(models.T.astype(np.float32))
        for batch in batches:
            for part in text_slices(batch, "text"):
                found, sizes = grams([t or "" for t in part.column("text").to_pylist()])
                total = np.zeros((len(sizes), table.shape[1]))
                full = np.flatnonzero(sizes)
                if len(full):
                    starts = (np.cumsum(sizes) - sizes)[full]
                    for k in range(table.shape[1]):
                        total[full, k] = np.add.reduceat(table[:, k][found].astype(np.float64), starts)
                scale = WEIGHT * np.minimum(sizes, MOST) / np.maximum(sizes, 1)
                values = pa.ListArray.from_arrays(np.arange(0, total.size + 1, total.shape[1], dtype=np.int32),
                                                  pa.array((total * scale[:, None]).reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "declared", "host", "suffix")), values],
                                                 ["id", "declared", "host", "suffix", "evidence"])
    return run


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _smooth(counts: Column, wider: Column) -> Column:
    n = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.zip_with(counts, wider, lambda c, w: (c + F.lit(SMOOTH) * w) / (n + F.lit(SMOOTH)))


def _best(names: list[str], scores: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), F.array_position(scores, F.array_max(scores)).cast("int"))


def identify(rows: DataFrame) -> DataFrame:
    """Language of every row of (id, text, declared, host, suffix).

    Returns id, lang, confidence, text_lang, declared, rejected.
    """
    ship_package(rows.sparkSession)
    scratch = Scratch(rows.sparkSession, "language")
    rows = rows.select("id", "text", "declared", "host", "suffix")
    languages, models = learn_text_models(rows, scratch)
    names = [*languages, UNKNOWN]
    seen = scratch.write(
        rows.mapInArrow(_likelihood(models), "id long, declared string, host string, suffix string, evidence array<double>")
        .withColumn("vote", _best(names, F.col("evidence")))
        .withColumn("stated", F.when(F.col("declared").isin(languages), F.col("declared"))
                    .when(F.col("declared").isNotNull(), F.lit("other"))), "evidence")
    votes = F.array(*[F.count_if(F.col("vote") == x).cast("double") for x in names])
    flat = F.array(*[F.lit(1.0 / len(names))] * len(names))
    # prior of all rows, of a suffix, of a host: each level smoothed by the wider one
    whole = seen.agg(votes.alias("c")).select(_smooth(F.col("c"), flat).alias("p")).first()["p"]
    whole = F.array(*[F.lit(float(x)) for x in whole])
    suffixes = (seen.where(F.col("suffix").isNotNull()).groupBy("suffix").agg(votes.alias("c"))
                .select(F.col("suffix").alias("of"), _smooth(F.col("c"), whole).alias("p")))
    hosts = (seen.where(F.col("host").isNotNull()).groupBy("host", "suffix").agg(votes.alias("c"))
             .join(suffixes, F.col("suffix") == F.col("of"), "left")
             .select(F.col("host").alias("at"), F.col("suffix").alias("under"),
                     _smooth(F.col("c"), F.coalesce("p", whole)).alias("by_host")))
    # how often a statement is made in each language's text
    stated = seen.where(F.col("stated").isNotNull()).groupBy("stated").agg(votes.alias("c"))
    of_lang = {r["stated"]: r["c"] for r in stated.collect()}
    kinds = [*languages, "other"]
    table = np.array([of_lang.get(k, [0.0] * len(names)) for k in kinds]) + 0.5
    table = np.log(table / table.sum(0, keepdims=True))
    # a small table, not one literal for each pair of languages
    weights = rows.sparkSession.createDataFrame(pa.table({"kind": pa.array(kinds, pa.string()), "said": pa.array(table.tolist(), pa.list_(pa.float64()))}))
    said = F.coalesce("said", F.array(*[F.lit(0.0)] * len(names)))
    placed = (seen.join(F.broadcast(weights), F.col("stated") == F.col("kind"), "left")
              .join(hosts, (F.col("host") == F.col("at")) & F.col("suffix").eqNullSafe(F.col("under")), "left")
              .join(suffixes.withColumnsRenamed({"of": "of_row", "p": "by_suffix"}), F.col("suffix") == F.col("of_row"), "left"))
    prior = F.transform(F.coalesce("by_host", "by_suffix", whole), lambda p: F.log(p))
    scores = _plus(_plus(prior, said), F.col("evidence"))
    unmodelled = F.col("declared").isNotNull() & ~F.col("declared").isin(languages)
    judged = (placed.withColumn("scores", scores).withColumn("top", F.array_max("scores"))
              .withColumn("lang", _best(names, F.col("scores")))
              .withColumn("confidence", 1 / F.aggregate("scores", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))))
    return judged.select("id", "lang", "confidence", F.col("vote").alias("text_lang"), "declared",
                         (((F.col("lang") == UNKNOWN) | (F.col("confidence") < CERTAIN)) & ~unmodelled).alias("rejected"))


def page_rows(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows for ``identify`` from raw web pages: visible text, the lang
    attribute of the html element, host and address suffix."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    text = html
    for pattern in (r"(?is)<!--.*?-->", r"(?is)<(script|style)\b.*?</\1\s*>", r"(?s)<[^>]*>"):
        text = F.regexp_replace(text, pattern, " ")
    text = F.regexp_replace(text, "&[a-zA-Z]+;|&#[0-9a-fA-FxX]+;", " ")
    declared = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    suffix = F.regexp_extract(host, r"\.([a-z0-9-]+)$", 1)
    return pages.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.nullif(declared, F.lit("")).alias("declared"),
                        F.nullif(host, F.lit("")).alias("host"), F.nullif(suffix, F.lit("")).alias("suffix"))


def document_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  source_col: str = "source") -> DataFrame:
    """Rows for ``identify`` from documents: the stated language, and the source as host."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       F.lower(F.col(lang_col).cast("string")).alias("declared"), F.col(source_col).cast("string").alias("host"),
                       F.lit(None).cast("string").alias("suffix"))


def keep_identified(docs: DataFrame, *, id_col: str = "doc_id", **columns) -> DataFrame:
    """``docs`` without those whose language is rejected, columns unchanged.

    Rows of one id go together, and only if all of them are rejected; rows
    without an id stay.
    """
    judged = identify(document_rows(docs, id_col=id_col, **columns))
    rejected, = spare_names(docs, "rejected")
    out = (judged.where(F.col("id").isNotNull()).groupBy("id").agg(F.bool_and("rejected").alias("all"))
           .where("all").select(F.col("id").alias(rejected)))
    return docs.join(out, F.col(id_col).cast("long") == F.col(rejected), "left_anti")
