"""Event search: code-list hits inside per-person lookback windows.

Plan (one pass, whatever the number of domains or lookback settings):

1. the four domain tables are projected to (domain, person_id, concept_id,
   start_date) and unioned - one scan each, no shuffle;
2. an optional global date bound (from the cohort) is applied to the union;
   Catalyst pushes it into each Parquet scan;
3. the table of searched standard concepts is inner-joined, broadcast by
   statistics when its bytes allow: a map-side filter of the events;
4. the surviving events are joined to the cohort on person_id. Events of the
   event store (``colocated``) lie in the cohort's buckets and are not moved;
   others are shuffled, and AQE splits that where a person holds many events;
5. each lookback setting (a per-row array explode, not a join) gets its
   window start; the range filter is a join residual;
6. hits are redistributed by (person, concept) unless they are colocated by
   person, deduplicated, categories re-attached from the code set, and
   deduplicated again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deficit_engine.constants import CHRONIC_LOOKBACK_CODE
from deficit_engine.functions.dates import add_years
from deficit_engine.functions.expr import if_else
from deficit_engine.operators.codes import resolve_standard, resolve_standard_by_id
from deficit_engine.operators.skew import redistribute

DOMAIN_COLUMNS = {
    "condition": ("condition_concept_id", "condition_start_date", "condition_source_value"),
    "observation": ("observation_concept_id", "observation_date", "observation_source_value"),
    "procedure": ("procedure_concept_id", "procedure_date", "procedure_source_value"),
    "device": ("device_concept_id", "device_exposure_start_date", "device_source_value"),
}


def domain_events(condition: DataFrame | None = None, observation: DataFrame | None = None,
                  procedure: DataFrame | None = None, device: DataFrame | None = None,
                  with_source: bool = False) -> DataFrame:
    """C8 input: domain tables in one projection.

    Output: domain, person_id, concept_id, start_date[, event_year][, source_value];
    the year is there when all tables are partitioned by it.
    """
    tables = {"condition": condition, "observation": observation,
              "procedure": procedure, "device": device}
    given = {name: df for name, df in tables.items() if df is not None}
    years = all("event_year" in df.columns for df in given.values())
    out = None
    for name, df in given.items():
        cid, date, src = DOMAIN_COLUMNS[name]
        cols = [F.lit(name).alias("domain"), F.col("person_id"),
                F.col(cid).alias("concept_id"), F.to_date(date).alias("start_date")]
        if years:
            cols.append(F.col("event_year"))
        if with_source:
            cols.append(F.col(src).alias("source_value"))
        one = df.select(*cols)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("at least one domain table is required")
    return out


def search_frame(cohort: DataFrame, person_id: str = "person_id",
                 start_date: str = "visit_lookback_date", end_date: str = "index_date",
                 keep: Sequence[str] = ("age_group", "is_female")) -> DataFrame:
    """(person_id, person_start_date, person_end_date, keep...) as dates."""
    return cohort.select(F.col(person_id).alias("person_id"),
                         F.to_date(start_date).alias("person_start_date"),
                         F.to_date(end_date).alias("person_end_date"), *keep)


def shift_years(start: Column | str, lookback) -> Column:
    """Window start for a lookback of ``lookback`` years (1 = no shift)."""
    start = F.col(start) if isinstance(start, str) else start
    if isinstance(lookback, int):
        return start if lookback == 1 else add_years(start, -(lookback - 1))
    return add_years(start, -(lookback - F.lit(1)))


def window_start(start: str, chronic_category: str, acute, chronic,
                 chronic_value: int = CHRONIC_LOOKBACK_CODE) -> Column:
    """Per-row window start; NULL chronic_category gives NULL (row later dropped)."""
    return if_else(F.col(chronic_category) == chronic_value,
                   shift_years(start, chronic), shift_years(start, acute))


def date_bounds(pid: DataFrame, max_lookback: int):
    """Earliest window start and latest window end of the cohort (one tiny job)."""
    row = pid.agg(F.min(shift_years("person_start_date", max_lookback)).alias("lo"),
                  F.max("person_end_date").alias("hi")).first()
    return row["lo"], row["hi"]


def within(events: DataFrame, bound: tuple) -> DataFrame:
    """Events between two dates; the filter reaches the Parquet scans, and the
    year folders where the tables have them (column ``event_year``)."""
    lo, hi = bound
    if lo is None:
        return events
    out = events.filter(F.col("start_date").between(F.lit(lo), F.lit(hi)))
    return out.filter(F.col("event_year").between(lo.year, hi.year)) if "event_year" in events.columns else out


def find_deficits(events: DataFrame, cohort: DataFrame, concept: DataFrame,
                  code_set: DataFrame, *, person_id: str = "person_id",
                  start_date: str = "visit_lookback_date", end_date: str = "index_date",
                  keep: Sequence[str] = ("age_group", "is_female"),
                  acute: int = 1, chronic: int = 1,
                  lookbacks: Sequence[tuple[int, int]] | None = None,
                  unique_categories: bool = False, join_now: bool = True,
                  join_to_concept: bool = True, date_bound: bool | tuple = False,
                  windows: DataFrame | None = None, categories: DataFrame | None = None,
                  tag: str | None = None, colocated: bool = False,
                  chronic_value: int = CHRONIC_LOOKBACK_CODE) -> DataFrame:
    """Code-list hits of cohort members inside their lookback windows.

    ``code_set`` is the concept location: concept_id, category, score,
    chronic_category. ``events`` comes from :func:`domain_events`.

    With ``lookbacks=[(a, c), ...]`` every setting is evaluated in the same
    pass and the output carries ``acute_lookback`` / ``chronic_lookback``.

    Output (``join_now``): person_id, keep..., person_start_date (the window
    start used), person_end_date, category, [concept_id,] score, plus the
    lookback columns / ``tag`` when given. With ``unique_categories``
    concept_id is dropped and rows deduplicated.
    Without ``join_now``: person_id, keep..., concept_id, concept_name,
    start_date, person_start_date, person_end_date, chronic_category.

    ``date_bound`` (True, or precomputed ``(lo, hi)``) restricts events to
    the cohort's overall window range; the filter reaches the Parquet scans.
    ``windows`` / ``categories`` may be passed precomputed (B2 output and the
    (concept_id, category, score) table) to reuse them across searches.

    ``tag`` names a column of ``code_set`` that tells several code sets
    apart (a union of index code lists): all indices are then searched in
    the same pass, categories attach only within their own index, and the
    output carries the tag.

    ``colocated``: events and cohort are bucketed alike by person, and no
    person holds many events; nothing is redistributed.
    """
    keep = list(keep)
    settings = list(lookbacks) if lookbacks else [(acute, chronic)]
    multi = lookbacks is not None
    # columns that distinguish result sets computed in the same pass
    extra_cols = (["acute_lookback", "chronic_lookback"] if multi else []) + ([tag] if tag else [])
    pid = search_frame(cohort, person_id, start_date, end_date, keep)

    need_names = not (join_now and unique_categories)
    if windows is not None:  # precomputed by the caller
        if not need_names and "name" in windows.columns:
            windows = windows.drop("name")
    else:
        if join_to_concept:
            windows = resolve_standard(concept, code_set, with_names=need_names, tag=tag)
        else:  # B3 membership form; lookback re-attached from the code set
            windows = resolve_standard_by_id(concept, code_set).join(
                code_set.select("concept_id", "chronic_category", *([tag] if tag else [])).distinct(),
                "concept_id")
            if not need_names:
                windows = windows.drop("name")

    if date_bound:
        events = within(events, date_bound if isinstance(date_bound, tuple) else
                        date_bounds(pid, max(max(a, c) for a, c in settings)))

    joined = events.join(windows, "concept_id").join(pid, "person_id")

    if multi:
        # widest window of all settings first, so the per-setting explode
        # only duplicates rows that can still match
        widest = max(max(a, c) for a, c in settings)
        joined = joined.filter((F.col("start_date") >= shift_years("person_start_date", widest))
                               & (F.col("start_date") <= F.col("person_end_date")))
        cfg = F.array(*[F.struct(F.lit(a).alias("acute_lookback"), F.lit(c).alias("chronic_lookback"))
                        for a, c in settings])
        joined = joined.withColumn("_lb", F.explode(cfg)).select("*", "_lb.*").drop("_lb")
        start = window_start("person_start_date", "chronic_category", F.col("acute_lookback"),
                             F.col("chronic_lookback"), chronic_value)
    else:
        start = window_start("person_start_date", "chronic_category", acute, chronic, chronic_value)

    hits = (joined.withColumn("person_start_date", start)
            .filter((F.col("start_date") >= F.col("person_start_date"))
                    & (F.col("start_date") <= F.col("person_end_date"))))
    if not colocated:
        hits = redistribute(hits, ["person_id", "concept_id"])

    if not join_now:
        return (hits.select("domain", "person_id", *keep, "concept_id",
                            F.col("name").alias("concept_name"), "start_date",
                            "person_start_date", "person_end_date", "chronic_category", *extra_cols)
                .distinct().drop("domain"))

    cat_key = ["concept_id", *([tag] if tag else [])]
    cats = categories if categories is not None else \
        code_set.select(*cat_key, "category", "score")
    base = ["person_id", *keep, "person_start_date", "person_end_date"]
    if unique_categories:
        # distinct before the category fan-out: many events per (person, concept)
        slim = hits.select(*base, "concept_id", *extra_cols).distinct()
        return (slim.join(cats, cat_key, "left")
                .select(*base, "category", "score", *extra_cols).distinct())
    # per-domain distinct as in the four separate searches, then union-all
    per_domain = hits.select("domain", "person_id", *keep, "concept_id", "name", "start_date",
                             "person_start_date", "person_end_date", "chronic_category",
                             *extra_cols).distinct()
    return (per_domain.join(cats, cat_key, "left")
            .select(*base, "category", "concept_id", "score", *extra_cols))


def check_index(index: str) -> str:
    """Known index names only (case-insensitive); returns the lower-case name."""
    from deficit_engine.constants import INDEX_NAMES
    name = index.lower()
    if name not in INDEX_NAMES:
        raise ValueError(f"unknown index {index!r}; known: {', '.join(INDEX_NAMES)}")
    return name


def probe_concept(hits: DataFrame, concept_id: int, n: int = 2) -> DataFrame:
    """``head(n)`` probe of one concept's hits, deterministic (ordered by all
    columns; a top-n, where the limit is the feature)."""
    return hits.filter(F.col("concept_id") == concept_id).orderBy(*hits.columns).limit(n)


def deficit_rows(hits: DataFrame, keep: Sequence[str] = ("age_group", "is_female"),
                 extra: Sequence[str] = ()) -> DataFrame:
    """C11: one row per (person, strata, score, category)."""
    return hits.select("person_id", *keep, "score", "category", *extra).distinct()


def source_code_search(events: DataFrame, cohort: DataFrame, concept: DataFrame,
                       source_codes: DataFrame, *, date_bound: bool | tuple = False,
                       colocated: bool = False) -> DataFrame:
    """Events whose *source value* is in a source-code list.

    ``events`` from ``domain_events(..., with_source=True)``; ``source_codes``
    has (icd_code, deficit, codetype). Output: person_id, age_group,
    is_female, concept_id, concept_name, start_date, deficit, source_value,
    person_start_date, person_end_date, vocabulary_id (per-domain distinct,
    then union-all). Hits are distinct before names are looked up, and only
    for the concepts that they use.
    """
    pid = search_frame(cohort, keep=("age_group", "is_female"))
    if date_bound:
        events = within(events, date_bound if isinstance(date_bound, tuple) else date_bounds(pid, 1))
    ct = source_codes.select(F.col("icd_code").alias("source_value"), "deficit")
    hits = (events.join(ct, "source_value").join(pid, "person_id")
            .filter((F.col("start_date") >= F.col("person_start_date"))
                    & (F.col("start_date") <= F.col("person_end_date"))))
    rows = ((hits if colocated else redistribute(hits, ["person_id", "concept_id"]))
            .select("domain", "person_id", "age_group", "is_female", "concept_id", "start_date",
                    "deficit", "source_value", "person_start_date", "person_end_date").distinct())
    names = concept.select("concept_id", "concept_name", "vocabulary_id")
    return (rows.join(names, "concept_id", "left")
            .select("domain", "person_id", "age_group", "is_female", "concept_id",
                    "concept_name", "start_date", "deficit", "source_value",
                    "person_start_date", "person_end_date", "vocabulary_id")
            .distinct().drop("domain"))


def source_deficits(hits: DataFrame) -> DataFrame:
    """Distinct (person, strata, category := deficit) with score 1."""
    return (hits.select("person_id", "age_group", "is_female", F.col("deficit").alias("category"))
            .distinct().withColumn("score", F.lit(1.0)))
