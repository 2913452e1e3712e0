"""Code sets: concept lists with lookbacks, standard-concept resolution,
drug-to-ingredient map and the exclusion set."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deficit_engine.constants import ANTIBIOTIC_ANCESTOR_ID, EXCLUSION_AS_OF


def build_code_set(codes: DataFrame, lookbacks: DataFrame, fi: str) -> DataFrame:
    """B1: code list with its per-category lookback for one index.

    Left join: a category without a lookback row gets a NULL lookback (and
    will find no events). A list that already carries ``lookback`` is used
    with its own. Output: category, concept_id, score, fi, lookback.
    """
    if "lookback" in codes.columns:
        return codes.select("category", "concept_id", "score", F.lit(fi).alias("fi"), "lookback")
    lb = lookbacks.filter(F.col("fi") == fi).select("fi", "category", "lookback")
    return codes.select("category", "concept_id", "score").join(lb, "category", "left")


def as_concept_location(code_set: DataFrame) -> DataFrame:
    """The searched code set: ``lookback`` renamed ``chronic_category``."""
    return code_set.withColumnRenamed("lookback", "chronic_category")


def _standard(concept: DataFrame) -> DataFrame:
    return concept.filter(F.col("standard_concept") == "S")


def resolve_standard(concept: DataFrame, code_set: DataFrame, with_names: bool = True,
                     tag: str | None = None) -> DataFrame:
    """B2: standard concepts of the code set with their lookback code.

    The (small) code set restricts the concept table with a semi join before
    the distinct, so the large concept table is never shuffled whole.
    Output: concept_id, [name,] chronic_category[, tag] - ``tag`` names a
    column of a union of several code sets (e.g. the index name).
    """
    codes = code_set.select("concept_id", "chronic_category", *([tag] if tag else [])).distinct()
    ids = codes.select("concept_id").distinct()
    std = _standard(concept).join(ids, "concept_id", "left_semi")
    if with_names:
        std = std.select("concept_id", F.col("concept_name").alias("name")).distinct()
    else:
        std = std.select("concept_id").distinct()
    return std.join(codes, "concept_id")


def resolve_standard_by_id(concept: DataFrame, code_set: DataFrame) -> DataFrame:
    """Standard concepts whose id is in the code set (membership only).

    Output: concept_id, name. (The search re-attaches the lookback from the
    code set, which the membership form alone cannot carry.)
    """
    ids = code_set.select("concept_id").distinct()
    return (_standard(concept).join(ids, "concept_id", "left_semi")
            .select("concept_id", F.col("concept_name").alias("name")).distinct())


def _ingredients(concept: DataFrame) -> DataFrame:
    return concept.filter((F.col("concept_class_id") == "Ingredient")
                          & (F.col("vocabulary_id") == "RxNorm"))


def ingredient_descendants(concept: DataFrame, concept_ancestor: DataFrame) -> DataFrame:
    """Drug concept -> ingredient map (RxNorm ingredients x ancestry).

    Output: ingredient_concept_id, descendant_concept_id.
    """
    ing = _ingredients(concept).select(F.col("concept_id").alias("ancestor_concept_id"))
    return (concept_ancestor.select("ancestor_concept_id", "descendant_concept_id")
            .join(ing, "ancestor_concept_id")
            .select(F.col("ancestor_concept_id").alias("ingredient_concept_id"),
                    "descendant_concept_id"))


def ancestor_exclusion_set(concept: DataFrame, concept_ancestor: DataFrame,
                           ancestor_id: int = ANTIBIOTIC_ANCESTOR_ID,
                           as_of: str | _dt.date = EXCLUSION_AS_OF) -> DataFrame:
    """RxNorm ingredients below ``ancestor_id`` that are valid on ``as_of``.

    Output: ingredient_concept_id, ingredient_concept_name, ingredient_concept_code.
    """
    day = F.lit(str(as_of)).cast("date")
    below = concept_ancestor.filter(F.col("ancestor_concept_id") == ancestor_id).select(
        F.col("descendant_concept_id").alias("concept_id"))
    return (_ingredients(concept).join(below, "concept_id")
            .filter((day >= F.col("valid_start_date")) & (day <= F.col("valid_end_date")))
            .select(F.col("concept_id").alias("ingredient_concept_id"),
                    F.col("concept_name").alias("ingredient_concept_name"),
                    F.col("concept_code").alias("ingredient_concept_code")))


def source_code_set(*lists: DataFrame) -> DataFrame:
    """Union of diagnosis / procedure source-code lists as (icd_code, deficit, codetype)."""
    out = None
    for df in lists:
        one = df.select(F.col("code").alias("icd_code"), "deficit", "codetype")
        out = one if out is None else out.unionByName(one)
    return out


def store_code_list(spark: SparkSession, csv_path: str, out_path: str) -> DataFrame:
    """Code list CSV -> stored Parquet table (declared schema, no inference)."""
    from deficit_engine.sources.io import read_code_list_csv
    df = read_code_list_csv(spark, csv_path)
    df.write.mode("overwrite").parquet(out_path)
    return spark.read.parquet(out_path)
