"""Polypharmacy: ingredient-level exposures in the year before index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deficit_engine.constants import (
    ANTIBIOTIC_ANCESTOR_ID, DECILE_PROBS, EXCLUSION_AS_OF, POLYPHARMACY_CATEGORY,
    PERSISTENCE_DAYS, POLYPHARMACY_THRESHOLD)
from deficit_engine.functions.dates import add_years
from deficit_engine.functions.expr import if_else
from deficit_engine.operators.codes import ancestor_exclusion_set, ingredient_descendants
from deficit_engine.operators.skew import redistribute


def rebuild_drug_era(drug_exposure: DataFrame, concept: DataFrame, concept_ancestor: DataFrame,
                     *, exclude: bool = True, ancestor_id: int = ANTIBIOTIC_ANCESTOR_ID,
                     as_of: str = EXCLUSION_AS_OF, strict_supply: bool = False,
                     ingredient_map: DataFrame | None = None,
                     exclusions: DataFrame | None = None) -> DataFrame:
    """D1 (D4 with ``strict_supply``): exposures mapped to ingredients.

    Drops concept 0 and negative supply (NULL supply kept unless strict),
    removes excluded ingredients, and fills the end date: end, else start +
    supply when supply > 0, else start + 1 day. Output: drug_exposure_id,
    person_id, ingredient_concept_id, drug_exposure_start_date,
    drug_exposure_end_date, days_supply.
    """
    supply = F.col("days_supply")
    keep_supply = (supply >= 0) if strict_supply else ((supply >= 0) | supply.isNull())
    ing = ingredient_map if ingredient_map is not None else \
        ingredient_descendants(concept, concept_ancestor)
    if exclude:  # taken out of the map, not out of the exposures
        ex = exclusions if exclusions is not None else \
            ancestor_exclusion_set(concept, concept_ancestor, ancestor_id, as_of).select("ingredient_concept_id")
        ing = ing.join(ex, "ingredient_concept_id", "left_anti")
    era = (drug_exposure.filter((F.col("drug_concept_id") != 0) & keep_supply)
           .join(ing, F.col("drug_concept_id") == F.col("descendant_concept_id"))
           .select("drug_exposure_id", "person_id", "ingredient_concept_id",
                   "drug_exposure_start_date", "drug_exposure_end_date", "days_supply"))
    start = F.col("drug_exposure_start_date")
    end = (F.when(F.col("drug_exposure_end_date").isNotNull(), F.col("drug_exposure_end_date"))
           .when(supply.isNotNull() & (supply > 0), F.date_add(start, supply))
           .otherwise(F.date_add(start, 1)))
    return era.withColumn("drug_exposure_end_date", end).select(
        "drug_exposure_id", "person_id", "ingredient_concept_id", "drug_exposure_start_date",
        "drug_exposure_end_date", "days_supply")


def _islands(spans: DataFrame, within: Sequence[str], days: int) -> DataFrame:
    """Merge spans (start, end, n, gap) whose start is at most ``days`` after the
    latest end before it, per ``within``."""
    before = F.max("end").over(Window.partitionBy(*within).orderBy("start", "end")
                               .rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.datediff("start", "before"), F.lit(0))
    seen = spans.withColumn("before", before)
    # the distance to what came before is a gap inside the island, unless the island starts here
    seen = seen.withColumn("new", (F.col("before").isNull() | (apart > days)).cast("int")) \
        .withColumn("inner", F.when(F.col("new") == 0, F.greatest(apart, F.lit(0))).otherwise(0))
    island = F.sum("new").over(Window.partitionBy(*within).orderBy("start", "end"))
    return (seen.withColumn("island", island).groupBy(*within, "island")
            .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"),
                 F.sum(F.col("gap") + F.col("inner")).alias("gap"))
            .drop("island"))


def build_drug_eras(exposures: DataFrame, *, item: str = "ingredient_concept_id",
                    start: str = "drug_exposure_start_date", end: str = "drug_exposure_end_date",
                    persistence: int = PERSISTENCE_DAYS, tasks: int | None = None) -> DataFrame:
    """Drug eras: exposures of one person to one item, merged while the next
    starts at most ``persistence`` days after the latest end so far.

    The days that exposures cover may be united in any grouping, so that is done
    twice: first inside a year of start dates, then over what is left of all
    years, where a span still open at the year's end meets the next ones. Spans
    that are apart by no more than ``persistence`` days then make an era.

    There are two shuffles: by (person, item, year), where exposures that start on
    one day are reduced to the longest of them and a year's are united, and by
    (person, item) for the rest, of which each has at most one span a day. So a person with a
    third of all exposures is spread over (item, year). Both have ``tasks``
    partitions (as many as shuffles have, if not given): the sorts of a task hold
    all its rows, so ``tasks`` has to grow with the exposures, see
    :func:`deficit_engine.operators.skew.task_count`.

    An end before its start counts as the start; rows without a person, item
    or start are left out. Output: person_id, ``item``, drug_era_start_date,
    drug_era_end_date, drug_exposure_count, gap_days (days of the era between
    exposures).
    """
    over = (tasks,) if tasks else ()
    spans = (exposures.where(F.col("person_id").isNotNull() & F.col(item).isNotNull() & F.col(start).isNotNull())
             .select("person_id", item, F.year(start).alias("year"), F.col(start).alias("start"), F.col(end).alias("end"))
             .repartition(*over, "person_id", item, "year")
             .groupBy("person_id", item, "year", "start")
             .agg(F.greatest(F.max("end"), F.col("start")).alias("end"), F.count(F.lit(1)).alias("n"))
             .withColumn("gap", F.lit(0).cast("long")))
    yearly = _islands(spans, ["person_id", item, "year"], 0).drop("year").repartition(*over, "person_id", item)
    eras = _islands(_islands(yearly, ["person_id", item], 0), ["person_id", item], persistence)
    return eras.select("person_id", item, F.col("start").alias("drug_era_start_date"), F.col("end").alias("drug_era_end_date"),
                       F.col("n").cast("long").alias("drug_exposure_count"), F.col("gap").cast("long").alias("gap_days"))


def exposures_in_window(era: DataFrame, cohort: DataFrame, *, item: str = "ingredient_concept_id",
                        start: str = "drug_exposure_start_date", end: str = "drug_exposure_end_date",
                        duration_from: str = "start", min_days: int = 1, strict: bool = False,
                        latest: object | None = None, earliest: object | None = None) -> DataFrame:
    """Exposures starting or ending in [index - 1 year, index].

    An exposure that only spans the window does not qualify. The duration is
    end - start (``duration_from="start"``) or end - window start
    (``"window_start"``); it must be >= ``min_days`` (> with ``strict``).
    ``latest``, ``earliest``: the cohort's last index date and first window
    start. Under a positive duration no exposure that starts after the one or
    ends before the other can qualify, so the scan is cut there; each person's
    own window stays exact. Output: person_id, ``item``, start, end.
    """
    if duration_from == "start" and min_days >= 0:
        if latest is not None:
            era = era.filter(F.col(start) <= F.lit(latest))
        if earliest is not None:
            era = era.filter(F.col(end) >= F.lit(earliest))
    pid = cohort.select("person_id", F.col("visit_lookback_date").alias("person_start_date"),
                        F.col("index_date").alias("person_end_date"))
    j = era.select("person_id", item, start, end).join(pid, "person_id")
    lo = add_years("person_end_date", -1)
    hi = F.col("person_end_date")
    s, e = F.col(start), F.col(end)
    dur = F.datediff(e, s) if duration_from == "start" else F.datediff(e, F.col("person_start_date"))
    ok_dur = (dur > min_days) if strict else (dur >= min_days)
    return j.filter((((s >= lo) & (s <= hi)) | ((e >= lo) & (e <= hi))) & ok_dur) \
        .select("person_id", item, start, end)


def ingredient_counts(in_window: DataFrame, item: str = "ingredient_concept_id") -> DataFrame:
    """Distinct items per person: (person_id, n).

    The distinct shuffles on (person, item), so a heavy person is spread
    before the per-person count (itself a partial aggregation), and AQE may cut
    the join below.
    """
    return (redistribute(in_window.select("person_id", item), ["person_id", item]).distinct()
            .groupBy("person_id").agg(F.count(F.lit(1)).cast("long").alias("n")))


def polypharmacy(in_window: DataFrame, cohort: DataFrame, threshold: int = POLYPHARMACY_THRESHOLD,
                 item: str = "ingredient_concept_id") -> DataFrame:
    """D3: persons with >= ``threshold`` distinct items, as deficit rows.

    Output: person_id, is_female, age_group, score, category.
    """
    flagged = ingredient_counts(in_window, item).filter(F.col("n") >= threshold)
    return (flagged.join(cohort.select("person_id", "is_female", "age_group"), "person_id")
            .select("person_id", "is_female", "age_group", F.lit(1.0).alias("score"),
                    F.lit(POLYPHARMACY_CATEGORY).alias("category")))


def polypharmacy_prevalence(poly: DataFrame, cohort: DataFrame) -> DataFrame:
    """Flagged count and share per stratum.

    Output: score, is_female, age_group, n, total, pct (flagged rows only).
    """
    flag = poly.select("person_id", F.lit(1).alias("flag")).distinct()
    counts = (cohort.select("person_id", "is_female", "age_group").join(flag, "person_id", "left")
              .withColumn("score", if_else(F.col("flag").isNull(), 0, 1))
              .groupBy("score", "is_female", "age_group").agg(F.count(F.lit(1)).cast("long").alias("n")))
    w = Window.partitionBy("is_female", "age_group")  # over a few aggregated rows per stratum
    return (counts.withColumn("total", F.sum("n").over(w).cast("long"))
            .filter(F.col("score") == 1)
            .withColumn("pct", F.col("n") / F.col("total")))


def ingredient_deciles(in_window: DataFrame, cohort: DataFrame,
                       probs: Sequence[float] = DECILE_PROBS,
                       item: str = "ingredient_concept_id", approximate: bool = False,
                       accuracy: int = 10000) -> DataFrame:
    """Quantiles of the 0-filled per-person item count (linear interpolation).

    ``percentile`` keeps a value -> frequency map, so memory is bounded by
    the number of distinct counts, not persons. ``approximate=True`` uses
    ``percentile_approx`` (a mergeable sketch; returns observed values, no
    interpolation). Output: prob, value.
    """
    counts = ingredient_counts(in_window, item)
    filled = (cohort.select("person_id").join(counts, "person_id", "left")
              .select(F.coalesce("n", F.lit(0)).alias("n")))
    arr = F.array(*[F.lit(float(p)) for p in probs])
    if approximate:
        q = filled.agg(F.percentile_approx("n", arr, accuracy).cast("array<double>").alias("q"))
    else:
        q = filled.agg(F.percentile("n", arr).alias("q"))
    return q.select(F.explode(F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("prob"),
                                           F.col("q").alias("value"))).alias("z")) \
        .select(F.col("z.prob").alias("prob"), F.col("z.value").alias("value"))


def add_polypharmacy(deficits: DataFrame, poly: DataFrame) -> DataFrame:
    """Union (by name) of deficit rows and polypharmacy rows, distinct."""
    cols = ["person_id", "age_group", "is_female", "score", "category"]
    return deficits.select(*cols).unionByName(poly.select(*cols)).distinct()
