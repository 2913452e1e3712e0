"""Query registry: one callable per operator of the inventory.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole input tables (or data Spark derives from them). Column names match the
SQL oracle in :mod:`deficit_engine.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deficit_engine.constants import EFI, VAFI, VAFI_OLD
from deficit_engine.operators import agreement, codes, cohort, drugs, events, report, scoring
from deficit_engine.plans.context import RunContext, context
from deficit_engine.session import checkpoint_dir
from deficit_engine.sources import reports
from deficit_engine.sources.io import write_report

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

PERCENT_CATEGORY = "Multi"
PROBE_CONCEPT = 1
CORR_EXCLUDE = "Brand#1"


def query(name: str):
    def deco(fn: Callable[[RunContext], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(context(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        return run
    return deco


# --- cohort -----------------------------------------------------------------
@query("cohort_index")
def _(c: RunContext):
    """A1-A3: random index visit, 365-day history, age >= 40."""
    return c.raw_cohort


@query("cohort_clean")
def _(c: RunContext):
    """A5 + C3: clean cohort with age bands and one-year lookback."""
    return c.cohort


@query("cohort_attrition")
def _(c: RunContext):
    """A4: persons per cohort stage."""
    t = c.t
    return cohort.attrition(t.person, t.visit_occurrence, t.observation_period, c.seed)


@query("survey_cohort")
def _(c: RunContext):
    """Survey-anchored cohort."""
    return c.research_cohort


@query("survey_attrition")
def _(c: RunContext):
    """A4 for the survey cohort."""
    t = c.t
    return cohort.survey_attrition(t.ds_survey, t.cb_search_person, t.observation_period)


@query("attrition_exclusions")
def _(c: RunContext):
    """Excluded persons per stage, per source."""
    t = c.t
    a = cohort.attrition(t.person, t.visit_occurrence, t.observation_period, c.seed)   # one pass
    s = cohort.survey_attrition(t.ds_survey, t.cb_search_person, t.observation_period)
    both = (a.select(F.lit("claims").alias("source"), "stage", "n")
            .unionByName(s.select(F.lit("survey").alias("source"), "stage", "n")))
    return cohort.attrition_exclusions(both)


@query("attrition_labels")
def _(c: RunContext):
    """A9 as text: remaining and excluded persons with separators, share of all."""
    t = c.t
    a = cohort.attrition(t.person, t.visit_occurrence, t.observation_period, c.seed)
    return report.attrition_labels(cohort.attrition_exclusions(a.select(F.lit("claims").alias("source"), "stage", "label", "n")))


@query("demographics")
def _(c: RunContext):
    """Race / ethnicity names for the research cohort."""
    return cohort.enrich_race_ethnicity(c.research_cohort, c.t.person, c.t.concept)


@query("cohort_composition")
def _(c: RunContext):
    """Count and share by age band x sex."""
    return cohort.cohort_composition(c.research_cohort)


@query("table1")
def _(c: RunContext):
    """A8 (published layout): by age band, sample size, % female."""
    return cohort.table1(c.cohort)


# --- code sets ----------------------------------------------------------------
@query("code_set")
def _(c: RunContext):
    """B1: VAFI code list with lookbacks."""
    return codes.build_code_set(c.t.code_list, c.t.lookbacks, "vafi")


@query("code_set_own_lookback")
def _(c: RunContext):
    """B1 on a list that carries its own lookback (the VAFI one, made so)."""
    own = codes.build_code_set(c.t.code_list, c.t.lookbacks, "vafi").drop("fi")
    return codes.build_code_set(own, c.t.lookbacks, "vafi")


@query("code_set_standard")
def _(c: RunContext):
    """B2: standard concepts of the code set with lookback code."""
    return codes.resolve_standard(c.t.concept, c.code_set("vafi"))


@query("code_set_by_id")
def _(c: RunContext):
    """Standard concepts by id membership."""
    return codes.resolve_standard_by_id(c.t.concept, c.code_set("vafi"))


@query("ingredient_map")
def _(c: RunContext):
    """Drug concept -> RxNorm ingredient."""
    return codes.ingredient_descendants(c.t.concept, c.t.concept_ancestor)


@query("exclusion_set")
def _(c: RunContext):
    """Excluded ingredients valid on the as-of date."""
    return codes.ancestor_exclusion_set(c.t.concept, c.t.concept_ancestor)


@query("source_code_set")
def _(c: RunContext):
    """Diagnosis + procedure source-code lists."""
    sc = c.t.source_codes
    return codes.source_code_set(sc.filter(F.col("codetype") == "ICD10CM"),
                                 sc.filter(F.col("codetype") != "ICD10CM"))


@query("code_list_roundtrip")
def _(c: RunContext):
    """Code list written as CSV, read back with its schema, stored as Parquet."""
    base = f"{checkpoint_dir(c.spark)}/tables/{c.tag}/code_list"
    c.t.code_list.write.mode("overwrite").option("header", True).csv(base + "_csv")
    return codes.store_code_list(c.spark, base + "_csv", base + "_parquet")


# --- event search --------------------------------------------------------------
def _domain_hits(c: RunContext, domain: str) -> DataFrame:
    return c.search(c.slices(only=domain), join_now=False)


@query("hits_condition")
def _(c: RunContext):
    """C4: condition search (per-domain distinct rows)."""
    return _domain_hits(c, "condition")


@query("hits_observation")
def _(c: RunContext):
    """Observation search."""
    return _domain_hits(c, "observation")


@query("hits_procedure")
def _(c: RunContext):
    """Procedure search."""
    return _domain_hits(c, "procedure")


@query("hits_device")
def _(c: RunContext):
    """Device search."""
    return _domain_hits(c, "device")


@query("hits_all")
def _(c: RunContext):
    """C8 + C9: all domains, categories attached (multiset)."""
    return c.search(c.slices())


@query("hits_unique")
def _(c: RunContext):
    """Unique categories, windows (1,1)."""
    return c.search(c.slices(), unique_categories=True)


@query("hits_unique_1_3")
def _(c: RunContext):
    """C10 with acute 1 / chronic 3 years."""
    return c.search(c.slices(), acute=1, chronic=3, unique_categories=True)


@query("hits_by_id_unique")
def _(c: RunContext):
    """C10 through the id-membership concept form (B3), lookback re-attached."""
    return c.search(c.slices(), unique_categories=True, join_to_concept=False)


@query("deficits_1y")
def _(c: RunContext):
    """C11: deficit rows, one-year windows."""
    return c.deficits("vafi", 1, 1)


@query("deficits_1y_seed7")
def _(c: RunContext):
    """C11 with another seed of the index visit."""
    return context(c.spark, c.sf_dir, seed=7).deficits("vafi", 1, 1)


@query("deficits_3y")
def _(c: RunContext):
    """C11: deficit rows, three-year windows."""
    return c.deficits("vafi", 3, 3)


@query("source_code_hits")
def _(c: RunContext):
    """C12 + C13: source-value search to deficit rows."""
    return events.source_deficits(c.source_events())


@query("source_code_events")
def _(c: RunContext):
    """Source-value search rows (per-domain distinct, union-all)."""
    return c.source_events()


@query("probe_concept")
def _(c: RunContext):
    """head(n) probe: first two source-value hits of one concept (ordered)."""
    return events.probe_concept(c.source_events(), PROBE_CONCEPT, 2)


# --- polypharmacy --------------------------------------------------------------
def _era(c: RunContext, strict_supply: bool = False) -> DataFrame:
    return c.drug_era(strict_supply)


def _in_window(c: RunContext, strict_supply: bool = False) -> DataFrame:
    return c.in_window(strict_supply)


@query("drug_era_rebuilt")
def _(c: RunContext):
    """Exposures mapped to ingredients, exclusions removed, end filled."""
    return _era(c)


@query("drug_era")
def _(c: RunContext):
    """D1 + D2: ingredient exposures inside the one-year window."""
    return _in_window(c)


@query("drug_era_window_start")
def _(c: RunContext):
    """D2 with duration counted from the window start (second warehouse rule)."""
    return drugs.exposures_in_window(_era(c), c.cohort, duration_from="window_start")


@query("polypharmacy")
def _(c: RunContext):
    """D3: >= 10 ingredients."""
    return drugs.polypharmacy(_in_window(c), c.cohort, 10)


@query("polypharmacy_t5")
def _(c: RunContext):
    """D3 at threshold 5."""
    return drugs.polypharmacy(_in_window(c), c.cohort, 5)


@query("polypharmacy_strict")
def _(c: RunContext):
    """NULL days_supply rows dropped, threshold 5."""
    return drugs.polypharmacy(_in_window(c, strict_supply=True), c.cohort, 5)


@query("polypharmacy_era")
def _(c: RunContext):
    """From the drug_era table, duration > 1 day, no exclusions."""
    w = drugs.exposures_in_window(c.t.drug_era, c.cohort, item="drug_concept_id",
                                  start="drug_era_start_date", end="drug_era_end_date", strict=True,
                                  **c.exposure_bounds())
    return drugs.polypharmacy(w, c.cohort, 10, item="drug_concept_id")


@query("drug_era_built")
def _(c: RunContext):
    """Drug eras of all rebuilt exposures: ingredients merged over gaps of up to 30 days."""
    return c.built_eras(c.drug_era())


@query("polypharmacy_era_built")
def _(c: RunContext):
    """D5 on built eras: duration > 1 day, no exclusions, threshold 5."""
    t = c.t
    eras = c.built_eras(drugs.rebuild_drug_era(t.drug_exposure, t.concept, t.concept_ancestor, exclude=False,
                                               ingredient_map=c.ingredient_map()))
    w = drugs.exposures_in_window(eras, c.cohort, start="drug_era_start_date", end="drug_era_end_date", strict=True,
                                  **c.exposure_bounds())
    return drugs.polypharmacy(w, c.cohort, 5)


@query("poly_prevalence")
def _(c: RunContext):
    """Polypharmacy (>= 5) share per stratum."""
    return drugs.polypharmacy_prevalence(drugs.polypharmacy(_in_window(c), c.cohort, 5), c.cohort)


@query("poly_deciles")
def _(c: RunContext):
    """Deciles of the 0-filled ingredient count."""
    return drugs.ingredient_deciles(_in_window(c), c.cohort)


@query("polypharmacy_survey")
def _(c: RunContext):
    """D3 for the survey cohort: durations from the window start, >= 10 ingredients."""
    return drugs.polypharmacy(c.in_window(of="survey"), c.research_cohort, 10)


def _efi_with_poly(c: RunContext, years: int = 1, threshold: int = 10) -> DataFrame:
    """EFI deficits plus the polypharmacy flag (always the one-year window)."""
    return drugs.add_polypharmacy(c.deficits("efi", years, years),
                                  drugs.polypharmacy(_in_window(c), c.cohort, threshold))


@query("index_with_polypharmacy")
def _(c: RunContext):
    """EFI deficits plus polypharmacy rows, distinct."""
    return _efi_with_poly(c)


@query("index_with_polypharmacy_t5")
def _(c: RunContext):
    """D8 at threshold 5."""
    return _efi_with_poly(c, threshold=5)


# --- scoring and reports --------------------------------------------------------
def _scores(c: RunContext, acute: int = 1, chronic: int = 1, **kw) -> DataFrame:
    return scoring.score_with_robust(c.deficits("vafi", acute, chronic), c.cohort,
                                     VAFI["denominator"], VAFI["lb"], VAFI["ub"], **kw)


@query("score_bands")
def _(c: RunContext):
    """Person scores and bands (VAFI, one year)."""
    return _scores(c)


@query("score_bands_fast")
def _(c: RunContext):
    """E1 through the single left-join fast path."""
    return _scores(c, method="left_join")


@query("score_bands_left_closed")
def _(c: RunContext):
    """Inclusive-lower-bound bands (older rule, 0.11 / 0.21)."""
    return scoring.score_with_robust(c.deficits("vafi", 1, 1), c.cohort, VAFI_OLD["denominator"],
                                     VAFI_OLD["lb"], VAFI_OLD["ub"], boundary="left_closed")


@query("band_summary_1y")
def _(c: RunContext):
    """Band summary, one-year windows."""
    return report.summarize_bands(_scores(c, 1, 1))


@query("band_summary_3y")
def _(c: RunContext):
    """Band summary, three-year windows."""
    return report.summarize_bands(_scores(c, 3, 3))


@query("band_summary_suppressed")
def _(c: RunContext):
    """E3 + opt-in E6 on band counts."""
    return report.suppress_band_cells(report.summarize_bands(_scores(c, 1, 1)))


def _efi_bands(c: RunContext, **kw) -> DataFrame:
    return report.summarize_bands(scoring.score_with_robust(
        _efi_with_poly(c, **kw), c.cohort, EFI["denominator"], EFI["lb"], EFI["ub"]))


@query("band_summary_efi")
def _(c: RunContext):
    """E3 for EFI with polypharmacy (36 categories, 0.12 / 0.24)."""
    return _efi_bands(c)


@query("band_summary_efi_t5")
def _(c: RunContext):
    """E3 for EFI with polypharmacy at threshold 5."""
    return _efi_bands(c, threshold=5)


@query("band_summary_efi_3y")
def _(c: RunContext):
    """E3 for EFI, three-year windows (polypharmacy stays one year)."""
    return _efi_bands(c, years=3)


def _survey_bands(c: RunContext, years: int) -> DataFrame:
    return report.summarize_bands(scoring.score_with_robust(
        c.deficits("vafi", years, years, of="survey"), c.research_cohort,
        VAFI["denominator"], VAFI["lb"], VAFI["ub"]))


@query("band_summary_survey_1y")
def _(c: RunContext):
    """E3 for the survey cohort ([80,120] as last age band), one-year windows."""
    return _survey_bands(c, 1)


@query("band_summary_survey_3y")
def _(c: RunContext):
    """E3 for the survey cohort, three-year windows."""
    return _survey_bands(c, 3)


@query("score_bands_source")
def _(c: RunContext):
    """E1 over source-value deficits (0.11 / 0.21)."""
    return scoring.score_with_robust(events.source_deficits(c.source_events()), c.cohort,
                                     VAFI_OLD["denominator"], VAFI_OLD["lb"], VAFI_OLD["ub"])


@query("category_summary")
def _(c: RunContext):
    """E4 + E7: category prevalence (unit scores), ordered, complete rows."""
    return report.category_report(c.deficits("vafi", 1, 1), c.cohort, c.category_names(),
                                  unit_score=True, suppress=False)


@query("category_summary_suppressed")
def _(c: RunContext):
    """E4 + E7 + E6: published category table with small cells zeroed."""
    return report.category_report(c.deficits("vafi", 1, 1), c.cohort, c.category_names(),
                                  unit_score=True, suppress=True)


@query("category_summary_3y")
def _(c: RunContext):
    """E4 + E7 + E6 for VAFI, three-year windows."""
    return report.category_report(c.deficits("vafi", 3, 3), c.cohort, c.category_names(), unit_score=True)


@query("category_summary_survey_1y")
def _(c: RunContext):
    """E4 + E7 + E6 for the survey cohort."""
    return report.category_report(c.deficits("vafi", 1, 1, of="survey"), c.research_cohort,
                                  c.category_names(), unit_score=True)


def _efi_categories(c: RunContext, **kw) -> DataFrame:
    return report.category_report(_efi_with_poly(c, **kw), c.cohort, c.category_names("efi"),
                                  unit_score=False, suppress=True)


@query("category_summary_efi")
def _(c: RunContext):
    """E4 with scores kept (EFI with polypharmacy among the categories), suppressed."""
    return _efi_categories(c)


@query("category_summary_efi_t5")
def _(c: RunContext):
    """The EFI category table at polypharmacy threshold 5."""
    return _efi_categories(c, threshold=5)


@query("category_summary_efi_3y")
def _(c: RunContext):
    """The EFI category table, three-year windows."""
    return _efi_categories(c, years=3)


@query("report_csv_roundtrip")
def _(c: RunContext):
    """Sink: the band summary written as a named CSV report and read back."""
    out = f"{checkpoint_dir(c.spark)}/tables/{c.tag}/reports"
    df = report.summarize_bands(_scores(c, 1, 1))
    path = write_report(df, out, index="vafi", acute=1, chronic=1, source="fixture", run_date="2024-07-15")
    return c.spark.read.csv(path, header=True, schema=df.schema, nullValue="NA")


def _written_reports(c: RunContext) -> str:
    """Folder with the band and category reports of both indices and windows.
    One band report has the header of older files (``n``)."""
    out = f"{checkpoint_dir(c.spark)}/tables/{c.tag}/report-set"
    poly = drugs.polypharmacy(_in_window(c), c.cohort, 10)
    for fi, spec, unit in (("vafi", VAFI, True), ("efi", EFI, False)):
        for years in (1, 3):
            hits = c.deficits(fi, years, years)
            if fi == "efi":
                hits = drugs.add_polypharmacy(hits, poly)
            name = dict(index=fi, acute=years, chronic=years, source="fixture_set", run_date="2025-08-14")
            bands = report.summarize_bands(scoring.score_with_robust(hits, c.cohort, spec["denominator"], spec["lb"], spec["ub"]))
            write_report(bands.withColumnRenamed("N", "n") if years == 3 else bands, out, **name)
            if years == 1:
                write_report(report.category_report(hits, c.cohort, c.category_names(fi), unit_score=unit), out, kind="categories", **name)
    return out


@query("report_set_pooled")
def _(c: RunContext):
    """Source: a set of written band reports read back and pooled over the strata."""
    return reports.pooled_bands(reports.read_band_reports(c.spark, _written_reports(c)))


@query("report_set_categories")
def _(c: RunContext):
    """Source: the written category reports read back, pooled by run and category."""
    return reports.pooled_categories(reports.read_category_reports(c.spark, _written_reports(c)))


@query("band_summary_complementary")
def _(c: RunContext):
    """E3 + E6 with complementary suppression: no hidden count follows from N and the others."""
    return report.suppress_bands_complementary(report.summarize_bands(_scores(c, 1, 1)))


@query("percent_category")
def _(c: RunContext):
    """E5: share with a hit in one category."""
    return report.percent_category(c.deficits("vafi", 1, 1), c.cohort, PERCENT_CATEGORY, "vafi")


@query("band_check")
def _(c: RunContext):
    """Fractions and counts add up per stratum."""
    return report.band_check(report.summarize_bands(_scores(c, 1, 1)))


@query("band_long")
def _(c: RunContext):
    """Band fractions in long form."""
    return report.band_long(report.summarize_bands(_scores(c, 1, 1)))


@query("posthoc_categories")
def _(c: RunContext):
    """Concept-level hits with categories attached afterwards."""
    h = c.search(c.slices(), join_now=False)
    return report.attach_categories(h, c.t.code_list)


# --- agreement --------------------------------------------------------------------
def _totals(c: RunContext) -> DataFrame:
    omop = c.deficits("vafi", 1, 1)
    src = events.source_deficits(c.source_events())
    return agreement.method_totals(omop, src)


@query("method_totals")
def _(c: RunContext):
    """Category totals by both methods."""
    return _totals(c)


@query("method_prevalence")
def _(c: RunContext):
    """Category totals over the computed cohort size."""
    return agreement.prevalence(_totals(c), c.cohort)


def _icc(totals: DataFrame) -> DataFrame:
    r = agreement.icc_oneway(agreement.to_long(totals), k=2)   # two methods
    return r.select("n", "k", "df1", "df2", F.round("msb", 4).alias("msb"),
                    F.round("msw", 4).alias("msw"), F.round("icc", 6).alias("icc"),
                    F.round("f_value", 6).alias("f_value"))


@query("method_icc")
def _(c: RunContext):
    """One-way ICC(1) and F between the methods."""
    return _icc(_totals(c))


@query("method_icc_without")
def _(c: RunContext):
    """E9 without one category."""
    return _icc(_totals(c).filter(F.col("category") != CORR_EXCLUDE))


@query("method_icc_inference")
def _(c: RunContext):
    """P-value of F and the 95 % interval of the ICC."""
    r = agreement.icc_inference(agreement.icc_oneway(agreement.to_long(_totals(c)), k=2))
    return r.select("n", "k", F.round("f_value", 6).alias("f_value"), F.round(F.log10("p_value"), 6).alias("log10_p"),
                    F.round("icc_low", 6).alias("icc_low"), F.round("icc_high", 6).alias("icc_high"))


@query("method_corr")
def _(c: RunContext):
    """Pearson correlation of totals, all and without one category."""
    return agreement.correlations(_totals(c), CORR_EXCLUDE).withColumn("corr", F.round("corr", 6))


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
