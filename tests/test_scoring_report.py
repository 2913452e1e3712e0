import pytest
from pyspark.sql import functions as F

from deficit_engine.operators import report, scoring


@pytest.fixture(scope="module")
def fx(spark):
    cohort = spark.createDataFrame(
        [(1, "[40,45)", 0), (2, "[40,45)", 0), (3, None, 1), (4, "[45,50)", 1)],
        "person_id long, age_group string, is_female int")
    hits = spark.createDataFrame(
        [(1, "[40,45)", 0, 1.0, "A"), (1, "[40,45)", 0, 2.0, "A"), (1, "[40,45)", 0, 1.0, "B"),
         (3, None, 1, 1.0, "A")],
        "person_id long, age_group string, is_female int, score double, category string")
    return cohort, hits


def test_two_scores_one_category_and_zero_fill(fx):
    cohort, hits = fx
    s = {r.person_id: r for r in scoring.score_with_robust(hits, cohort, 10, 0.1, 0.2).collect()}
    assert s[1].fi == pytest.approx(0.4) and s[1].frail == 1
    assert s[2].fi == 0.0 and s[2].robust == 1 and s[4].robust == 1
    assert s[3].fi == pytest.approx(0.1) and s[3].robust == 1


def test_fast_path_equals_union(fx):
    cohort, hits = fx
    a = scoring.score_with_robust(hits, cohort, 10, 0.1, 0.2)
    b = scoring.score_with_robust(hits, cohort, 10, 0.1, 0.2, method="left_join")
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_band_summary_keeps_null_stratum_and_partitions_n(fx):
    cohort, hits = fx
    rows = report.summarize_bands(scoring.score_with_robust(hits, cohort, 10, 0.1, 0.2)).collect()
    assert any(r.age_group is None for r in rows)
    for r in rows:
        assert r.n_prefrail + r.n_frail + r.n_robust == r.N
        assert r.prefrail + r.frail + r.robust == pytest.approx(1.0)


def _naive_categories(hits, cohort, cats, spark):
    grid = cohort.select("person_id", "age_group", "is_female").crossJoin(
        spark.createDataFrame([(c,) for c in cats], "category string"))
    j = grid.join(hits.select("person_id", "category", "score"), ["person_id", "category"], "left") \
        .withColumn("score", F.coalesce("score", F.lit(0.0)))
    return j.groupBy("age_group", "is_female", "category").agg(
        F.count(F.lit(1)).alias("N"), F.sum("score").alias("count"),
        (F.sum("score") / F.count(F.lit(1))).alias("percent"))


def test_category_fast_path_equals_expanded_grid(fx, spark):
    cohort, hits = fx
    cats = ["A", "B", "Z"]
    fast = report.summarize_categories(hits, cohort, cats)
    naive = _naive_categories(hits, cohort, cats, spark)
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(map(tuple, fast.collect()), key=key) == \
        sorted(map(tuple, naive.select(*fast.columns).collect()), key=key)


def test_category_report_drops_null_and_suppresses(fx, spark):
    cohort, hits = fx
    out = report.category_report(hits, cohort, ["A", "B"], unit_score=True).collect()
    assert all(r.age_group is not None for r in out)
    assert all(r["count"] == 0 and r.percent == 0 for r in out)   # every count < 20
    df = spark.createDataFrame([(19.0, 0.5), (20.0, 0.5)], "count double, percent double")
    got = [tuple(r) for r in report.suppress_small_cells(df).collect()]
    assert got == [(0.0, 0.0), (20.0, 0.5)]


def test_percent_category(fx):
    cohort, hits = fx
    rows = {(r.age_group, r.is_female): r for r in report.percent_category(hits, cohort, "B").collect()}
    assert rows[("[40,45)", 0)].n_yes == 1.0 and rows[("[40,45)", 0)].prop_yes == 0.5
    with pytest.raises(ValueError):
        report.percent_category(hits, cohort, "B", categories=["A"])


def test_band_long_and_check(fx):
    cohort, hits = fx
    s = report.summarize_bands(scoring.score_with_robust(hits, cohort, 10, 0.1, 0.2))
    assert report.band_long(s).count() == 3 * s.count()
    for r in report.band_check(s).collect():
        assert r.fraction_sum == pytest.approx(1.0) and r.count_share == pytest.approx(1.0)
