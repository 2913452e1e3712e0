"""Corpus pipeline: stages over ``documents``; each is written and read again before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import col as _col
from pyspark.sql.functions import sha2 as _sha2

from deficit_engine.llm import exact_dedup as _exact
from deficit_engine.llm import bpe as _bpe
from deficit_engine.llm import jaccard_join as _jaccard
from deficit_engine.llm import language_id as _language
from deficit_engine.llm import mixing as _mixing
from deficit_engine.llm.common import Scratch, table
from deficit_engine.llm.queries import tokenizer_file as _tokenizer_file


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language."""
    return _language.keep_identified(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays."""
    return _exact.keep_one(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays."""
    return _jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return _mixing.take(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document of the mix, and the text that they give back."""
    done = _bpe.encode_and_decode(docs, _tokenizer_file("byte_bpe_50k.json"))
    return done.select("doc_id", "n_tokens", "ids", _sha2(_col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable]] = [
    ("language ID", language),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing", mix_sources),
    ("BPE", bpe),
]

# Language ID, BPE and the draws of the mixing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; only the last one's result is lazy."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = scratch.write(out, f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
