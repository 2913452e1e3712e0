import datetime as dt

import pytest
from pyspark.sql import functions as F

from deficit_engine.operators import events as ev
from tests.conftest import SF_SMALL

D = dt.date


@pytest.fixture(scope="module")
def fx(spark):
    cohort = spark.createDataFrame(
        [(1, D(2019, 1, 1), D(2020, 1, 1), "[40,45)", 0)],
        "person_id long, visit_lookback_date date, index_date date, age_group string, is_female int")
    concept = spark.createDataFrame(
        [(i, f"c{i}", None if i == 104 else "S") for i in (100, 101, 102, 103, 104)],
        "concept_id int, concept_name string, standard_concept string")
    code_set = spark.createDataFrame(
        [(100, "A", 1.0, 1), (101, "B", 1.0, 3), (102, "N", 1.0, None), (103, "A", 1.0, 1),
         (103, "C", 1.0, 1), (104, "D", 1.0, 1)],
        "concept_id int, category string, score double, chronic_category int")
    cond = spark.createDataFrame(
        [(1, 100, D(2019, 1, 1), "x"), (1, 100, D(2020, 1, 1), "x"), (1, 100, D(2018, 12, 31), "x"),
         (1, 100, D(2020, 1, 2), "x"), (1, 101, D(2017, 6, 1), "x"), (1, 100, D(2017, 6, 1), "x"),
         (1, 102, D(2019, 6, 1), "x"), (1, 103, D(2019, 6, 1), "x"), (1, 104, D(2019, 6, 1), "x")],
        "person_id long, condition_concept_id int, condition_start_date date, "
        "condition_source_value string")
    return cohort, concept, code_set, ev.domain_events(condition=cond)


def _cats(df):
    return sorted({r.category for r in df.collect()})


def test_window_ends_null_lookback_fanout(fx):
    cohort, concept, code_set, events = fx
    h = ev.find_deficits(events, cohort, concept, code_set, unique_categories=True)
    assert _cats(h) == ["A", "C"]          # N (NULL lookback), D (non-standard), B (too old) absent
    raw = ev.find_deficits(events, cohort, concept, code_set, join_now=False)
    assert sorted(r.start_date for r in raw.filter(F.col("concept_id") == 100).collect()) == \
        [D(2019, 1, 1), D(2020, 1, 1)]


def test_chronic_lookback(fx):
    cohort, concept, code_set, events = fx
    h = ev.find_deficits(events, cohort, concept, code_set, acute=1, chronic=3,
                         unique_categories=True)
    assert _cats(h) == ["A", "B", "C"]     # chronic 2017 hit kept, acute 2017 hit dropped
    d = ev.deficit_rows(h)
    assert d.count() == 3                  # category A counted once despite two concepts


def test_multi_window_equals_separate_runs(fx, spark):
    from deficit_engine.plans.context import context
    c = context(spark, SF_SMALL)
    multi = ev.find_deficits(c.events(), c.cohort, c.t.concept, c.code_set("vafi"),
                             lookbacks=[(1, 1), (3, 3)], unique_categories=True)
    for a, ch in [(1, 1), (3, 3)]:
        one = ev.find_deficits(c.events(), c.cohort, c.t.concept, c.code_set("vafi"),
                               acute=a, chronic=ch, unique_categories=True)
        got = multi.filter((F.col("acute_lookback") == a) & (F.col("chronic_lookback") == ch)) \
            .drop("acute_lookback", "chronic_lookback")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, one.collect()))


def test_longer_lookback_contains_shorter(spark):
    from deficit_engine.plans.context import context
    c = context(spark, SF_SMALL)
    one = {(r.person_id, r.category) for r in c.deficits("vafi", 1, 1).collect()}
    three = {(r.person_id, r.category) for r in c.deficits("vafi", 3, 3).collect()}
    assert one and one <= three


def test_duplicate_events_do_not_change_unique_hits(spark):
    from deficit_engine.plans.context import context
    c = context(spark, SF_SMALL)
    e = c.events()
    a = ev.find_deficits(e, c.cohort, c.t.concept, c.code_set("vafi"), unique_categories=True)
    b = ev.find_deficits(e.unionByName(e), c.cohort, c.t.concept, c.code_set("vafi"),
                         unique_categories=True)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_date_bound_prunes_without_changing_hits(spark):
    from deficit_engine.plans.context import context
    c = context(spark, SF_SMALL)
    args = (c.events(), c.cohort, c.t.concept, c.code_set("vafi"))
    a = ev.find_deficits(*args, acute=3, chronic=3, unique_categories=True)
    b = ev.find_deficits(*args, acute=3, chronic=3, unique_categories=True, date_bound=True)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_all_indices_pass_equals_separate_searches(spark):
    from deficit_engine.plans.context import INDICES, STANDARD_WINDOWS, context
    c = context(spark, SF_SMALL)
    for fi in INDICES:
        for a, ch in STANDARD_WINDOWS:
            one = ev.deficit_rows(ev.find_deficits(c.events(), c.cohort, c.t.concept,
                                                   c.code_set(fi), acute=a, chronic=ch,
                                                   unique_categories=True))
            assert sorted(map(tuple, c.deficits(fi, a, ch).collect())) == \
                sorted(map(tuple, one.collect())), (fi, a, ch)


def test_scoring_over_unmaterialised_search_plans(spark):
    """E1's union over a freshly shuffled search (the nested-union shape that
    can fail in Spark 4.1 with 'Can't zip RDDs with unequal numbers of
    partitions') runs, and matches the materialised path."""
    from deficit_engine.operators import report, scoring
    from deficit_engine.plans.context import context
    c = context(spark, SF_SMALL)
    h = ev.find_deficits(c.events(), c.cohort, c.t.concept, c.code_set("vafi"))
    s = scoring.score_with_robust(ev.deficit_rows(h), c.cohort, 31, 0.10, 0.20)
    rows = report.summarize_bands(s).collect()
    assert sum(r.N for r in rows) == 90
    assert (sum(r.n_robust for r in rows), sum(r.n_prefrail for r in rows),
            sum(r.n_frail for r in rows)) == (26, 41, 23)


def test_at_scale_plan_shape_gives_same_hits(spark):
    """The all-index, all-window search planned as on a cluster (no automatic
    broadcasts, date bound) returns exactly the rows of the default plan."""
    from deficit_engine.plans.context import INDICES, STANDARD_WINDOWS, context
    c = context(spark, SF_SMALL)
    cs = c.code_set_all()

    def run(**kw):
        return ev.find_deficits(c.events(), c.cohort, c.t.concept, cs, tag="index_name",
                                lookbacks=STANDARD_WINDOWS, unique_categories=True, **kw)

    default = sorted(map(tuple, run().collect()))
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scaled = run(date_bound=True)
        plan = scaled._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "event_year" in plan.split("PartitionFilters: [", 1)[1]
        assert sorted(map(tuple, scaled.collect())) == default
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
    assert {r[-1] for r in default} == set(INDICES)


def test_source_search_at_scale_plan_shape(spark):
    from deficit_engine.operators.codes import source_code_set
    from deficit_engine.plans.context import context
    c = context(spark, SF_SMALL)
    args = (c.events(with_source=True), c.cohort, c.t.concept, source_code_set(c.t.source_codes))
    default = sorted(map(tuple, ev.source_code_search(*args).collect()))
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scaled = ev.source_code_search(*args, date_bound=True)
        assert sorted(map(tuple, scaled.collect())) == default and default
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
