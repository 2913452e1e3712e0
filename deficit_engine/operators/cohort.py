"""Cohort building (random index visit, history, age, clean-up, survey cohort).

All per-person selections use aggregations (``min`` of a struct) rather than
sorting windows, so a person with very many visits is reduced map-side before
any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deficit_engine.constants import (
    AGE_BREAKS_CLAIMS, AGE_BREAKS_RESEARCH, BASICS_SURVEY, IMPUTE_BIRTH_YEAR_BEFORE,
    IMPUTED_AGE, MALE_CONCEPT_ID, MALE_TEXT, MIN_AGE, MIN_HISTORY_DAYS)
from deficit_engine.functions.dates import add_years, completed_years
from deficit_engine.functions.expr import age_band, flag_unless_equal, if_else


def random_visit_key(person_id, visit_id, seed) -> F.Column:
    """Reproducible per-visit random key: ``md5('person-visit-seed')``.

    Unlike ``rand()`` it is identical on recompute (lost executors) and across
    engines, so the chosen index visit never changes.
    """
    return F.md5(F.concat_ws("-", F.col(person_id).cast("string"),
                             F.col(visit_id).cast("string"), F.lit(str(seed))))


def index_dates(visit: DataFrame, seed: int = 42) -> DataFrame:
    """(person_id, index_date): the date of one random visit per person."""
    pick = (visit.select("person_id", "visit_occurrence_id", "visit_start_date")
            .groupBy("person_id")
            .agg(F.min(F.struct(random_visit_key("person_id", "visit_occurrence_id", seed).alias("k"),
                                F.col("visit_occurrence_id").alias("v"),
                                F.col("visit_start_date").alias("d"))).alias("m")))
    return pick.select("person_id", F.col("m.d").alias("index_date"))


def random_index_visit(person: DataFrame, visit: DataFrame, seed: int = 42) -> DataFrame:
    """A1: one random visit per person as ``index_date``.

    Output: person_id, index_date, year_of_birth, gender_concept_id.
    """
    return (person.select("person_id", "year_of_birth", "gender_concept_id")
            .join(index_dates(visit, seed), "person_id")
            .select("person_id", "index_date", "year_of_birth", "gender_concept_id"))


def require_history(index: DataFrame, observation_period: DataFrame,
                    days: int = MIN_HISTORY_DAYS) -> DataFrame:
    """A2: keep index dates at least ``days`` after the observation period start."""
    op = observation_period.select("person_id", "observation_period_start_date",
                                   "observation_period_end_date")
    return (index.join(op, "person_id")
            .filter(F.datediff("index_date", "observation_period_start_date") >= days))


def derive_age(cohort: DataFrame, min_age: int = MIN_AGE,
               impute_before: int = IMPUTE_BIRTH_YEAR_BEFORE) -> DataFrame:
    """A3: age at index, imputation flag, age filter."""
    return (cohort.select("person_id", "year_of_birth", "gender_concept_id", "index_date",
                          "observation_period_start_date", "observation_period_end_date")
            .withColumn("age", F.year("index_date") - F.col("year_of_birth"))
            .withColumn("yob_imputed", if_else(F.col("year_of_birth") < impute_before, 1, 0))
            .filter(F.col("age") >= min_age))


def build_cohort(person: DataFrame, visit: DataFrame, observation_period: DataFrame,
                 seed: int = 42) -> DataFrame:
    """A1-A3 chained: the raw cohort."""
    return derive_age(require_history(random_index_visit(person, visit, seed), observation_period))


def stage_bits(person: DataFrame, visit: DataFrame, observation_period: DataFrame, seed: int = 42,
               days: int = MIN_HISTORY_DAYS, min_age: int = MIN_AGE) -> DataFrame:
    """One row per person: person_id, n (rows of the person table) and bits, the
    set of cohort stages that the person reaches (bit k: ``STAGES[k + 1]``).

    Each table is read once. A person has the history if the earliest
    observation period starts early enough, so periods are reduced to that.
    """
    pick = index_dates(visit, seed).select("person_id", "index_date", F.lit(1).alias("seen"))
    periods = observation_period.groupBy("person_id").agg(F.min("observation_period_start_date").alias("since"))
    history = F.datediff("index_date", "since") >= days
    old = F.year("index_date") - F.col("year_of_birth") >= min_age
    bit = lambda k, reached: F.when(reached, 1 << k).otherwise(0)
    bits = (bit(0, F.col("seen").isNotNull()).bitwiseOR(bit(1, F.col("seen").isNotNull() & history))
            .bitwiseOR(bit(2, F.col("seen").isNotNull() & history & old)))
    return (person.select("person_id", "year_of_birth").join(pick, "person_id", "left").join(periods, "person_id", "left")
            .groupBy("person_id").agg(F.count(F.lit(1)).alias("n"), F.bit_or(bits).alias("bits")))


def merge_stage_bits(*parts: DataFrame) -> DataFrame:
    """Stage sets of several inputs (e.g. sites that share persons) as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("person_id").agg(F.max("n").alias("n"), F.bit_or("bits").alias("bits"))


STAGES = ("persons", "with a visit", "with history", "age eligible")


def count_stages(bits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A4 from stage sets: (by..., stage, label, n)."""
    reached = [F.sum("n"), *(F.count_if(F.col("person_id").isNotNull() & (F.col("bits").bitwiseAND(1 << k) != 0)) for k in range(len(STAGES) - 1))]
    one = bits.groupBy(*by).agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(f"n{k}") for k, c in enumerate(reached)])
    rows = F.array(*[F.struct(F.lit(k + 1).alias("stage"), F.lit(label).alias("label"), F.col(f"n{k}").alias("n"))
                     for k, label in enumerate(STAGES)])
    return one.select(*by, F.inline(rows))


def attrition(person: DataFrame, visit: DataFrame, observation_period: DataFrame,
              seed: int = 42) -> DataFrame:
    """A4: persons remaining at each cohort stage (stage, label, n), from one
    pass over the tables."""
    return count_stages(stage_bits(person, visit, observation_period, seed))


def attrition_exclusions(counts: DataFrame) -> DataFrame:
    """Per source, persons excluded at each stage: ``lag(n) - n``.

    ``counts`` has (source, stage, n); the window is per source, whose rows
    are the handful of stages.
    """
    w = Window.partitionBy("source").orderBy("stage")
    return counts.withColumn("excluded", (F.lag("n").over(w) - F.col("n")).cast("long"))


def clean_cohort(cohort: DataFrame, breaks: Sequence[int] = AGE_BREAKS_CLAIMS) -> DataFrame:
    """A5: impute ages, code sex, band ages, one-year lookback, earliest index.

    Output: person_id, is_female, age_group, visit_lookback_date, index_date,
    yob_imputed.
    """
    c = (cohort
         .withColumn("age", if_else(F.col("yob_imputed") == 1, F.lit(IMPUTED_AGE), F.col("age")))
         .select("person_id",
                 flag_unless_equal("gender_concept_id", MALE_CONCEPT_ID).alias("is_female"),
                 age_band("age", breaks).alias("age_group"),
                 add_years("index_date", -1).alias("visit_lookback_date"),
                 "index_date", "yob_imputed"))
    # the few distinct rows of each index date, then those of a person's least date
    rest = [x for x in c.columns if x not in ("person_id", "index_date")]
    dates = c.groupBy("person_id", "index_date").agg(F.collect_set(F.struct(*rest)).alias("rows"))
    first = (dates.where(F.col("person_id").isNotNull() & F.col("index_date").isNotNull())
             .groupBy("person_id").agg(F.min("index_date").alias("index_date"), F.min_by("rows", "index_date").alias("rows")))
    return first.select("person_id", "index_date", F.inline("rows")).select(*c.columns)


def survey_cohort_stages(ds_survey: DataFrame, cb_search_person: DataFrame,
                         observation_period: DataFrame) -> dict[str, DataFrame]:
    """A6 stages: first baseline survey, EHR participants, observed, 40+."""
    surveyed = (ds_survey.filter(F.col("survey") == BASICS_SURVEY)
                .groupBy("person_id").agg(F.min("survey_datetime").alias("survey_datetime"))
                .withColumn("survey_date", F.to_date("survey_datetime")))
    ehr = (cb_search_person.filter(F.col("has_ehr_data") == 1)
           .select("person_id", "sex_at_birth", "dob").distinct())
    op = observation_period.select("person_id", "observation_period_start_date",
                                   "observation_period_end_date")
    observed = (ehr.join(op, "person_id", "left")
                .join(surveyed, "person_id")
                .select("person_id", "sex_at_birth", "dob", "survey_date",
                        "observation_period_start_date", "observation_period_end_date")
                .withColumn("index_date", add_years("survey_date", 1))
                .withColumn("age", completed_years("dob", "index_date"))
                .filter((F.col("index_date") < F.col("observation_period_end_date"))
                        & (F.col("survey_date") > F.col("observation_period_start_date"))))
    aged = observed.filter(F.col("age") >= MIN_AGE)
    return {"surveyed": surveyed, "participants": cb_search_person, "ehr": ehr,
            "observed": observed, "aged": aged}


def survey_cohort(ds_survey: DataFrame, cb_search_person: DataFrame,
                  observation_period: DataFrame,
                  breaks: Sequence[int] = AGE_BREAKS_RESEARCH) -> DataFrame:
    """Survey-anchored cohort (index = first baseline survey + 1 year).

    Output: person_id, is_female, age_group, visit_lookback_date, index_date.
    """
    aged = survey_cohort_stages(ds_survey, cb_search_person, observation_period)["aged"]
    return aged.select(
        "person_id",
        if_else(F.col("sex_at_birth") == MALE_TEXT, 0, 1).alias("is_female"),
        age_band("age", breaks).alias("age_group"),
        F.col("survey_date").alias("visit_lookback_date"),
        "index_date")


def survey_attrition(ds_survey: DataFrame, cb_search_person: DataFrame,
                     observation_period: DataFrame) -> DataFrame:
    """A4 for the survey cohort: (stage, label, n)."""
    st = survey_cohort_stages(ds_survey, cb_search_person, observation_period)
    surveyed = st["surveyed"].select(F.count(F.lit(1))).scalar()
    # participants and those with records come from one aggregate, the last two stages from another
    people = (cb_search_person.groupBy("person_id", "sex_at_birth", "dob")
              .agg(F.count(F.lit(1)).alias("n"), F.max((F.col("has_ehr_data") == 1).cast("int")).alias("ehr"))
              .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n2"), F.count_if(F.col("ehr") == 1).alias("n3")))
    last = st["observed"].agg(F.count(F.lit(1)).alias("n4"), F.count_if(F.col("age") >= MIN_AGE).alias("n5"))
    counted = people.select("n2", "n3", last.select(F.struct("n4", "n5")).scalar().alias("l"))
    rows = F.array(*[F.struct(F.lit(i).alias("stage"), F.lit(label).alias("label"), n.cast("long").alias("n")) for i, label, n in (
        (1, "surveyed", surveyed), (2, "participants", F.col("n2")), (3, "with ehr", F.col("n3")),
        (4, "observed", F.col("l.n4")), (5, "age eligible", F.col("l.n5")))])
    return counted.select(F.inline(rows))


def enrich_race_ethnicity(cohort: DataFrame, person: DataFrame, concept: DataFrame) -> DataFrame:
    """Race and ethnicity names for cohort members (left joins).

    The ids take a handful of values. The concept names are broadcast by
    statistics, or AQE splits the members' side of the left joins.
    """
    members = cohort.select("person_id", "is_female", "age_group").join(
        person.select("person_id", "race_concept_id", "ethnicity_concept_id"), "person_id", "left")
    race = concept.select(F.col("concept_id").alias("race_concept_id"), F.col("concept_name").alias("race"))
    eth = concept.select(F.col("concept_id").alias("ethnicity_concept_id"),
                         F.col("concept_name").alias("ethnicity"))
    return (members.join(race, "race_concept_id", "left").join(eth, "ethnicity_concept_id", "left")
            .select("person_id", "is_female", "age_group", "race", "ethnicity"))


def cohort_composition(cohort: DataFrame, digits: int = 3) -> DataFrame:
    """Cohort count by age_group x is_female and share of the total.

    The total is a scalar subquery (``DataFrame.scalar``), not a window over
    all rows. Rows with no age band are dropped.
    """
    total = cohort.select(F.count(F.lit(1))).scalar()
    return (cohort.groupBy("age_group", "is_female").agg(F.count(F.lit(1)).cast("long").alias("n"))
            .withColumn("percent_group", F.round(F.col("n") / total, digits))
            .filter(F.col("age_group").isNotNull()))


def table1(cohort: DataFrame) -> DataFrame:
    """A8, published layout: n and share per age band, plus sample size and % female."""
    total = cohort.select(F.count(F.lit(1))).scalar()
    bands = (cohort.groupBy("age_group").agg(F.count(F.lit(1)).cast("long").alias("n"))
             .select("age_group", "n", (F.col("n") / total).alias("percent_group")))
    size = cohort.agg(F.count(F.lit(1)).cast("long").alias("n")).select(
        F.lit("sample size").alias("age_group"), "n", F.lit(None).cast("double").alias("percent_group"))
    female = cohort.agg(F.sum(F.col("is_female")).cast("long").alias("n")).select(
        F.lit("% female").alias("age_group"), "n", (F.col("n") / total).alias("percent_group"))
    return bands.unionByName(size).unionByName(female)
