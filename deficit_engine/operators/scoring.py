"""Person-level index score and robust / prefrail / frail bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deficit_engine.functions.expr import band_flags

STRATA = ("age_group", "is_female")


def score_with_robust(hits: DataFrame, cohort: DataFrame, denominator: int, lb: float,
                      ub: float, boundary: str = "right_closed",
                      method: str = "union") -> DataFrame:
    """fi = sum of distinct (score, category) / denominator, banded.

    Members without any hit get fi = 0 and robust = 1. ``method="union"``
    is the specification (aggregate of hits, union-by-name with the anti
    join of the cohort). ``method="left_join"`` is the single-join fast path,
    equal when the cohort has one row per person and every hit person is in
    the cohort. Output: person_id, age_group, is_female, fi, prefrail, frail,
    robust.
    """
    flags = band_flags("fi", lb, ub, boundary)
    out_cols = ["person_id", *STRATA, "fi", "prefrail", "frail", "robust"]
    per_person = (hits.select("person_id", "is_female", "age_group", "score", "category").distinct()
                  .groupBy("person_id", *STRATA)
                  .agg((F.sum("score") / F.lit(float(denominator))).alias("fi")))
    if method == "left_join":
        sums = per_person.select("person_id", "fi")
        return (cohort.select("person_id", *STRATA).join(sums, "person_id", "left")
                .withColumn("fi", F.coalesce("fi", F.lit(0.0)))
                .select("person_id", *STRATA, "fi", *[v.alias(k) for k, v in flags.items()])
                .select(*out_cols))
    if method != "union":
        raise ValueError("method must be 'union' or 'left_join'")
    scored = per_person.select("person_id", *STRATA, "fi",
                               *[v.alias(k) for k, v in flags.items()])
    zero = (cohort.join(hits.select("person_id"), "person_id", "left_anti")
            .select("person_id", *STRATA, F.lit(0.0).alias("fi"), F.lit(0).alias("frail"),
                    F.lit(0).alias("prefrail"), F.lit(1).alias("robust")))
    return scored.unionByName(zero).select(*out_cols)
