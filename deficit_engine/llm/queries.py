"""The registered queries ``opN_<name>``: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deficit_engine.llm import (bpe, chat_format, exact_dedup, exact_topk, hard_negatives, jaccard_join, language_id, mixing,
                                quality, substring_dedup, token_files, toxicity, whitening)
from deficit_engine.llm.common import Scratch, table


def tokenizer_file(name: str) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = jaccard_join.link_documents(table(spark, sf_dir, "documents"), width=3, percent=90)
    return linked.select("doc_id", "n_shingles", "component_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = language_id.identify(language_id.page_rows(table(spark, sf_dir, "pages")))
    return judged.withColumnRenamed("id", "page_id")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"digest_index_{uuid.uuid4().hex}"
    index = exact_dedup.DigestIndex(spark, name, Scratch(spark, "index").path(name), temporary=True)
    marked = exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"), index)
    return marked.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                         F.col("digest").alias("text_sha256"))


def held_out() -> Column:
    """Rows whose labels no model may learn."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out())
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.link_quotations(table(spark, sf_dir, "conversations"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "token_files").path("blocks")
    token_files.write_token_blocks(table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"))
    back = token_files.read_token_blocks(spark, path)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out())
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "matched_clauses")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=moved)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deviation is a long here: a table for which it does not fit raises."""
    white = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return white.withColumn("deviation", F.col("deviation").cast("long"))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_language_id": op3_language_id,
    "op4_exact_topk": op4_exact_topk,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality": op6_quality,
    "op7_mixing": op7_mixing,
    "op8_chat_format": op8_chat_format,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_token_files": op10_token_files,
    "op11_toxicity": op11_toxicity,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_whitening": op13_whitening,
}
