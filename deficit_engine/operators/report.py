"""Stratified reports: band summary, category prevalence, suppression, reshapes.

Reports aggregate to a handful of strata; every aggregate is partial
(map-side) first, so a stratum holding a third of the cohort costs nothing
extra.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deficit_engine.constants import INDEX_NAMES, SUPPRESS_BELOW
from deficit_engine.functions.expr import if_else, percent_label, thousands_label

STRATA = ("age_group", "is_female")


def summarize_bands(scores: DataFrame) -> DataFrame:
    """N, band counts and band fractions by age_group x is_female."""
    n = F.count(F.lit(1))
    return scores.groupBy(*STRATA).agg(
        n.cast("long").alias("N"),
        F.sum("prefrail").cast("long").alias("n_prefrail"),
        F.sum("frail").cast("long").alias("n_frail"),
        F.sum("robust").cast("long").alias("n_robust"),
        (F.sum("prefrail") / n).alias("prefrail"),
        (F.sum("frail") / n).alias("frail"),
        (F.sum("robust") / n).alias("robust"))


def category_frame(categories: Sequence[str] | DataFrame, like: DataFrame) -> DataFrame:
    """Distinct categories as a one-column DataFrame (a list is uploaded)."""
    if isinstance(categories, DataFrame):
        return categories.select("category").where(F.col("category").isNotNull()).distinct()
    names = sorted({c for c in categories if c is not None})
    return like.sparkSession.createDataFrame([(c,) for c in names], "category string")


def _null_safe_on(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> Column:
    cond = None
    for c in cols:
        e = left[c].eqNullSafe(right[c])
        cond = e if cond is None else cond & e
    return cond


def summarize_categories(hits: DataFrame, cohort: DataFrame,
                         categories: Sequence[str] | DataFrame,
                         unit_score: bool = False) -> DataFrame:
    """Per stratum x category: N, count = sum(score), percent = count / N.

    Equivalent to expanding every cohort row to every category and left
    joining the hits on (person_id, category), without building that grid:
    N = cohort rows of the stratum plus, for a (person, category) with k > 1
    hit rows, the k - 1 extra rows the left join would create. Hits of
    unlisted categories or of persons outside the cohort are ignored.
    Output: age_group, is_female, category, N, count, percent.
    """
    cats = category_frame(categories, cohort)
    score = F.lit(1.0) if unit_score else F.col("score").cast("double")
    members = cohort.select("person_id", *STRATA)
    per_pc = (hits.select("person_id", "category", score.alias("score"))
              .groupBy("person_id", "category")
              .agg(F.count(F.lit(1)).alias("k"), F.sum("score").alias("s")))
    counts = (members.join(per_pc, "person_id")
              .groupBy(*STRATA, "category")
              .agg(F.sum(F.col("k") - 1).alias("extra"), F.sum("s").alias("cnt")))
    # the strata are a few counted rows: one array, in a scalar subquery, given to each category
    strata = (members.groupBy(*STRATA).agg(F.count(F.lit(1)).alias("n0"))
              .select(F.struct(*STRATA, "n0").alias("s")).agg(F.collect_list("s").alias("all"))).scalar()
    grid = cats.select("category", F.explode(strata).alias("s")).select("category", "s.*")
    j = grid.join(counts, _null_safe_on(grid, counts, [*STRATA, "category"]), "left")
    n = (grid["n0"] + F.coalesce(counts["extra"], F.lit(0))).cast("long")
    cnt = F.coalesce(counts["cnt"], F.lit(0.0))
    return j.select(grid["age_group"], grid["is_female"], grid["category"], n.alias("N"),
                    cnt.alias("count"), (cnt / n).alias("percent"))


def suppress_small_cells(df: DataFrame, min_count: int = SUPPRESS_BELOW,
                         count: str = "count", percent: str = "percent") -> DataFrame:
    """Counts below ``min_count`` and their percent are set to 0."""
    small = F.col(count) < min_count
    return (df.withColumn(percent, if_else(small, F.lit(0.0), F.col(percent)))
            .withColumn(count, if_else(small, F.lit(0.0).cast(df.schema[count].dataType),
                                       F.col(count))))


def suppress_band_cells(summary: DataFrame, min_count: int = SUPPRESS_BELOW) -> DataFrame:
    """E6 as an opt-in for band summaries: a band count below ``min_count``
    and its fraction are set to 0 (N is kept)."""
    out = summary
    for band in ("prefrail", "frail", "robust"):
        small = F.col(f"n_{band}") < min_count
        out = (out.withColumn(band, if_else(small, F.lit(0.0), F.col(band)))
               .withColumn(f"n_{band}", if_else(small, F.lit(0).cast("long"), F.col(f"n_{band}"))))
    return out


def complementary_cells(cells: Column, min_count: int = SUPPRESS_BELOW) -> Column:
    """Which counts of an array are hidden, as an array of booleans, when their sum is published.

    Counts from 1 to ``min_count`` - 1 are hidden. If that hides a single one, it
    could be found from the sum and the others, so the smallest other count is
    hidden too: the cheapest set, as any second cell does. Where all the
    others are 0 (or there are none), the sum itself tells the count; then
    everything is hidden, and so must the sum be (see ``hide_total``).
    """
    small = F.transform(cells, lambda n: (n > 0) & (n < min_count))
    n_small = F.size(F.filter(small, lambda s: s))
    # the smallest count that is not small; of equal ones the first
    other = F.array_min(F.filter(cells, lambda n: n >= min_count))
    at = F.array_position(cells, other) - 1
    paired = F.transform(small, lambda s, i: s | (i == at))
    return F.when(n_small != 1, small).when(other.isNotNull(), paired).otherwise(F.transform(cells, lambda n: F.lit(True)))


def hide_total(cells: Column, min_count: int = SUPPRESS_BELOW) -> Column:
    """Whether the published sum would tell a hidden count."""
    return (F.size(F.filter(cells, lambda n: (n > 0) & (n < min_count))) == 1) & (F.size(F.filter(cells, lambda n: n >= min_count)) == 0)


def suppress_bands_complementary(summary: DataFrame, min_count: int = SUPPRESS_BELOW) -> DataFrame:
    """E6 with complementary suppression for band summaries: hidden counts and
    their fractions are NULL, and no hidden count can be solved for from N and
    the rest of its row. N is NULL where it would tell one."""
    bands = ("prefrail", "frail", "robust")
    cells = F.array(*[F.col(f"n_{b}") for b in bands])
    out = summary.withColumn("__hidden", complementary_cells(cells, min_count)).withColumn("__total", hide_total(cells, min_count))
    return out.select(
        *STRATA, F.when(~F.col("__total"), F.col("N")).alias("N"),
        *[F.when(~F.col("__hidden")[k], F.col(f"n_{b}")).alias(f"n_{b}") for k, b in enumerate(bands)],
        *[F.when(~F.col("__hidden")[k], F.col(b)).alias(b) for k, b in enumerate(bands)])


def age_lower(c: str = "age_group") -> Column:
    """Lower bound of an ``[lo,hi)`` label, for numeric ordering."""
    return F.regexp_extract(F.col(c), r"^\[(\d+)", 1).cast("int")


def order_and_drop_incomplete(df: DataFrame) -> DataFrame:
    """Order by category, age band (numerically), sex; drop rows with NULLs."""
    return df.dropna("any").orderBy("category", age_lower(), "is_female")


def category_report(hits: DataFrame, cohort: DataFrame, categories, *, unit_score: bool,
                    suppress: bool = True, min_count: int = SUPPRESS_BELOW) -> DataFrame:
    """E4 + E7 (+ E6): the published category table."""
    out = order_and_drop_incomplete(summarize_categories(hits, cohort, categories, unit_score))
    return suppress_small_cells(out, min_count) if suppress else out


def attrition_labels(counts: DataFrame) -> DataFrame:
    """Text of a flow diagram's boxes from (source, stage, label, n, excluded): source,
    stage, label, remaining and excluded with thousands separators, share of the first stage."""
    first = F.first("n").over(Window.partitionBy("source").orderBy("stage"))     # a handful of stages
    return counts.select("source", "stage", "label", thousands_label("n").alias("remaining"), thousands_label("excluded").alias("excluded"),
                         percent_label(F.col("n") / first, 1).alias("share"))


def percent_category(hits: DataFrame, cohort: DataFrame, category: str, index: str | None = None,
                     categories: Sequence[str] | None = None) -> DataFrame:
    """E5: share of each stratum with a hit in one category.

    Output: age_group, is_female, category, n_yes, prop_yes.
    """
    if index is not None and index not in INDEX_NAMES[:4]:
        raise ValueError(f"no category shares for index {index!r}; known: {', '.join(INDEX_NAMES[:4])}")
    if categories is not None and category not in categories:
        raise ValueError(f"no category {category!r} in this index")
    has = hits.filter(F.col("category") == category).select("person_id")
    zero = (cohort.join(has, "person_id", "left_anti")
            .select("person_id", *STRATA, F.lit(0.0).alias("score"),
                    F.lit(category).alias("category")))
    yes = (hits.select("person_id", "is_female", "age_group", "score", "category").distinct()
           .filter(F.col("category") == category)
           .select("person_id", *STRATA, F.col("score").cast("double").alias("score"), "category"))
    return (yes.unionByName(zero).groupBy(*STRATA, "category")
            .agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("n_yes"),
                 F.avg("score").alias("prop_yes")))


def band_check(summary: DataFrame) -> DataFrame:
    """Per row, the sum of the fractions and of the counts over N; both should be 1."""
    return summary.withColumn("fraction_sum", F.col("prefrail") + F.col("frail") + F.col("robust")) \
        .withColumn("count_share", (F.col("n_prefrail") + F.col("n_frail") + F.col("n_robust")) / F.col("N"))


def band_long(summary: DataFrame) -> DataFrame:
    """Long form (age_group, is_female, name, value) of the three fractions."""
    cols = ["N", "n_prefrail", "n_frail", "n_robust", "prefrail", "frail", "robust"]
    wide = summary.select(*STRATA, *[F.col(c).cast("double").alias(c) for c in cols])
    return (wide.unpivot(list(STRATA), cols, "name", "value")
            .filter(F.col("name").isin("prefrail", "frail", "robust")))


def attach_categories(hits: DataFrame, code_list: DataFrame) -> DataFrame:
    """Re-attach categories to concept-level hits (many-to-many), drop
    concept_id, deduplicate, drop rows without an age band."""
    cats = code_list.select("concept_id", "category", "score")
    return (hits.select("person_id", *STRATA, "concept_id", "person_start_date", "person_end_date")
            .join(cats, "concept_id", "left").drop("concept_id").distinct()
            .dropna(subset=["age_group"]))
