"""Property tests: fast paths equal their literal specifications on random data."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deficit_engine.constants import AGE_BREAKS_RESEARCH
from deficit_engine.functions import age_band, band_flags
from deficit_engine.operators import report, scoring

SETTINGS = settings(max_examples=4, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])
CATS = ["A", "B", "C"]
STRATA = [("[40,45)", 0), ("[40,45)", 1), ("[45,50)", 0), (None, 1)]

cohort_st = st.lists(st.sampled_from(STRATA), min_size=1, max_size=25)
hits_st = st.lists(st.tuples(st.integers(0, 30), st.sampled_from(CATS + ["Z"]),
                             st.sampled_from([1.0, 2.0])), max_size=60)


def _frames(spark, strata, hits):
    cohort = spark.createDataFrame([(i, a, f) for i, (a, f) in enumerate(strata)],
                                   "person_id long, age_group string, is_female int")
    by_id = dict(enumerate(strata))
    rows = [(p, by_id[p][0], by_id[p][1], s, c) for p, c, s in hits if p in by_id]
    h = spark.createDataFrame(rows, "person_id long, age_group string, is_female int, "
                                    "score double, category string")
    return cohort, h


def _key(r):
    return tuple("" if v is None else str(v) for v in r)


@SETTINGS
@given(strata=cohort_st, hits=hits_st)
def test_category_table_equals_expanded_grid(spark, strata, hits):
    cohort, h = _frames(spark, strata, hits)
    fast = report.summarize_categories(h, cohort, CATS)
    grid = cohort.select("person_id", "age_group", "is_female").crossJoin(
        spark.createDataFrame([(c,) for c in CATS], "category string"))
    naive = (grid.join(h.select("person_id", "category", "score"), ["person_id", "category"], "left")
             .withColumn("score", F.coalesce("score", F.lit(0.0)))
             .groupBy("age_group", "is_female", "category")
             .agg(F.count(F.lit(1)).alias("N"), F.sum("score").alias("count"),
                  (F.sum("score") / F.count(F.lit(1))).alias("percent")))
    assert sorted(map(_key, fast.collect())) == \
        sorted(map(_key, naive.select(*fast.columns).collect()))


@SETTINGS
@given(strata=cohort_st, hits=hits_st)
def test_scoring_fast_path_equals_union(spark, strata, hits):
    cohort, h = _frames(spark, strata, hits)
    a = scoring.score_with_robust(h, cohort, 7, 0.1, 0.2)
    b = scoring.score_with_robust(h, cohort, 7, 0.1, 0.2, method="left_join")
    assert sorted(map(_key, a.collect())) == sorted(map(_key, b.collect()))
    bands = report.summarize_bands(a).collect()
    assert sum(r.N for r in bands) == len(strata)
    assert all(r.n_robust + r.n_prefrail + r.n_frail == r.N for r in bands)


@SETTINGS
@given(st.lists(st.integers(0, 130), min_size=1, max_size=40))
def test_age_band_matches_model(spark, ages):
    def model(a):
        b = AGE_BREAKS_RESEARCH
        for i, (lo, hi) in enumerate(zip(b[:-1], b[1:])):
            last = i == len(b) - 2
            if lo <= a and (a <= hi if last else a < hi):
                return f"[{lo},{hi}]" if last else f"[{lo},{hi})"
        return None
    df = spark.createDataFrame([(a,) for a in ages], "age int")
    assert [r[0] for r in df.select(age_band("age", AGE_BREAKS_RESEARCH)).collect()] == \
        [model(a) for a in ages]


@SETTINGS
@given(st.lists(st.floats(0, 1, allow_nan=False), min_size=1, max_size=40),
       st.sampled_from(["right_closed", "left_closed"]))
def test_band_flags_partition(spark, values, boundary):
    df = spark.createDataFrame([(v,) for v in values], "fi double")
    fl = band_flags("fi", 0.12, 0.24, boundary)
    for r in df.select(*[v.alias(k) for k, v in fl.items()]).collect():
        assert r.prefrail + r.frail + r.robust == 1


def test_results_invariant_to_partitioning(spark):
    from deficit_engine.plans.context import context
    from deficit_engine.operators import events as ev
    from tests.conftest import SF_SMALL
    c = context(spark, SF_SMALL)
    base = ev.find_deficits(c.events(), c.cohort, c.t.concept, c.code_set("vafi"),
                            unique_categories=True)
    moved = ev.find_deficits(c.events().repartition(13), c.cohort.repartition(3), c.t.concept,
                             c.code_set("vafi"), unique_categories=True)
    assert sorted(map(_key, base.collect())) == sorted(map(_key, moved.collect()))
