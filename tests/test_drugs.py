import datetime as dt

import pytest

from deficit_engine.operators import drugs

D = dt.date


@pytest.fixture(scope="module")
def vocab(spark):
    concept = spark.createDataFrame(
        [(900, "ing a", "RxNorm", "Ingredient", "a", D(1970, 1, 1), D(2099, 1, 1)),
         (901, "ing b", "RxNorm", "Ingredient", "b", D(1970, 1, 1), D(2020, 1, 1)),   # expired
         (902, "ing c", "RxNorm", "Ingredient", "c", D(1970, 1, 1), D(2099, 1, 1))],
        "concept_id int, concept_name string, vocabulary_id string, concept_class_id string, "
        "concept_code string, valid_start_date date, valid_end_date date")
    anc = spark.createDataFrame(
        [(900, 1), (901, 2), (902, 3), (21602796, 901), (21602796, 902)],
        "ancestor_concept_id int, descendant_concept_id int")
    return concept, anc


def test_end_date_rules_and_exclusions(spark, vocab):
    concept, anc = vocab
    de = spark.createDataFrame(
        [(1, 1, 1, D(2020, 1, 1), D(2020, 2, 1), 5),
         (2, 1, 1, D(2020, 1, 1), None, 10),
         (3, 1, 1, D(2020, 1, 1), None, 0),
         (4, 1, 1, D(2020, 1, 1), None, None),
         (5, 1, 1, D(2020, 1, 1), None, -1),
         (6, 1, 0, D(2020, 1, 1), None, 3),
         (7, 1, 2, D(2020, 1, 1), None, 3),     # expired exclusion member: kept
         (8, 1, 3, D(2020, 1, 1), None, 3)],    # valid exclusion member: removed
        "drug_exposure_id long, person_id long, drug_concept_id int, drug_exposure_start_date date, "
        "drug_exposure_end_date date, days_supply int")
    got = {r.drug_exposure_id: r.drug_exposure_end_date
           for r in drugs.rebuild_drug_era(de, concept, anc).collect()}
    assert got == {1: D(2020, 2, 1), 2: D(2020, 1, 11), 3: D(2020, 1, 2), 4: D(2020, 1, 2),
                   7: D(2020, 1, 4)}
    strict = {r.drug_exposure_id for r in drugs.rebuild_drug_era(de, concept, anc, strict_supply=True).collect()}
    assert 4 not in strict and 2 in strict


def test_window_rules_and_threshold(spark):
    cohort = spark.createDataFrame(
        [(1, D(2019, 1, 1), D(2020, 1, 1), 0, "[40,45)"), (2, D(2019, 1, 1), D(2020, 1, 1), 1, "[40,45)")],
        "person_id long, visit_lookback_date date, index_date date, is_female int, age_group string")
    rows = []
    for i in range(10):                        # person 1: 10 ingredients in window
        rows.append((1, i, D(2019, 6, 1), D(2019, 7, 1)))
    for i in range(9):                         # person 2: 9 ingredients ...
        rows.append((2, i, D(2019, 6, 1), D(2019, 7, 1)))
    rows.append((2, 50, D(2018, 1, 1), D(2021, 1, 1)))   # ... spanning the window: not counted
    rows.append((2, 51, D(2019, 6, 1), D(2019, 6, 1)))   # zero length: not counted
    era = spark.createDataFrame(rows, "person_id long, ingredient_concept_id int, "
                                      "drug_exposure_start_date date, drug_exposure_end_date date")
    win = drugs.exposures_in_window(era, cohort)
    flagged = drugs.polypharmacy(win, cohort, 10).collect()
    assert [r.person_id for r in flagged] == [1]
    assert flagged[0].category == "Polypharmacy" and flagged[0].score == 1.0
    dec = {r.prob: r.value for r in drugs.ingredient_deciles(win, cohort).collect()}
    assert dec[0.0] == 9.0 and dec[1.0] == 10.0 and dec[0.5] == pytest.approx(9.5)
    cut = drugs.exposures_in_window(era, cohort, latest=D(2020, 1, 1))
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, win.collect()))


def test_approximate_deciles_close_to_exact(spark):
    cohort = spark.range(0, 200).selectExpr("id AS person_id")
    win = spark.range(0, 2000).selectExpr("id % 200 AS person_id", "CAST(id % 37 AS INT) AS ingredient_concept_id")
    exact = {r.prob: r.value for r in drugs.ingredient_deciles(win, cohort).collect()}
    approx = {r.prob: r.value for r in drugs.ingredient_deciles(win, cohort, approximate=True).collect()}
    assert exact.keys() == approx.keys()
    assert all(abs(exact[p] - approx[p]) <= 1.0 for p in exact)


def test_polypharmacy_at_scale_plan_shape(spark):
    from deficit_engine.plans.context import context
    from tests.conftest import SF_SMALL
    c = context(spark, SF_SMALL)
    era = c.drug_era()
    default = sorted(map(tuple, drugs.polypharmacy(
        drugs.exposures_in_window(era, c.cohort), c.cohort, 3).collect()))
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        win = drugs.exposures_in_window(era, c.cohort, latest=c.date_range(1)[1])
        scaled = drugs.polypharmacy(win, c.cohort, 3)
        assert sorted(map(tuple, scaled.collect())) == default and default
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)


# --- drug eras ---------------------------------------------------------------------------

def _eras(spark, rows, **kw):
    import datetime as dt
    df = spark.createDataFrame([(p, i, dt.date.fromisoformat(s) if s else None, dt.date.fromisoformat(e) if e else None) for p, i, s, e in rows],
                               "person_id long, ingredient_concept_id int, drug_exposure_start_date date, drug_exposure_end_date date")
    return sorted((r.person_id, r.ingredient_concept_id, str(r.drug_era_start_date), str(r.drug_era_end_date), r.drug_exposure_count, r.gap_days)
                  for r in drugs.build_drug_eras(df, **kw).collect())


def test_eras_merge_over_30_days_but_not_31(spark):
    rows = [(1, 5, "2020-01-01", "2020-01-10"), (1, 5, "2020-02-09", "2020-02-12"),       # 30 days later: one era
            (2, 5, "2020-01-01", "2020-01-10"), (2, 5, "2020-02-10", "2020-02-12"),       # 31 days: two
            (3, 5, "2020-01-01", "2020-03-01"), (3, 5, "2020-01-05", "2020-01-06"), (3, 5, "2020-03-31", "2020-04-02"),   # nested, then 30
            (4, 5, "2020-01-01", "2020-01-10"), (4, 5, "2020-01-10", "2020-01-20"), (4, 5, "2020-01-21", "2020-01-22"),   # touching, next day
            (4, 6, "2020-01-15", "2020-01-16"),                                             # another ingredient
            (5, 5, "2020-05-05", "2020-05-01"), (5, 5, "2020-05-05", "2020-05-07"),       # an end before its start; one day twice
            (None, 5, "2020-01-01", "2020-01-02"), (6, None, "2020-01-01", "2020-01-02"), (6, 5, None, "2020-01-02"), (7, 5, "2020-01-01", None)]
    assert _eras(spark, rows) == [
        (1, 5, "2020-01-01", "2020-02-12", 2, 30), (2, 5, "2020-01-01", "2020-01-10", 1, 0), (2, 5, "2020-02-10", "2020-02-12", 1, 0),
        (3, 5, "2020-01-01", "2020-04-02", 3, 30), (4, 5, "2020-01-01", "2020-01-22", 3, 1), (4, 6, "2020-01-15", "2020-01-16", 1, 0),
        (5, 5, "2020-05-05", "2020-05-07", 2, 0), (7, 5, "2020-01-01", "2020-01-01", 1, 0)]
    assert _eras(spark, []) == []


def test_eras_open_at_the_end_of_a_year(spark):
    # a span of several years covers what starts in them; gaps inside it are none
    rows = [(1, 5, "2018-06-01", "2021-02-01"), (1, 5, "2019-03-01", "2019-03-05"), (1, 5, "2019-05-01", "2019-05-02"),
            (1, 5, "2020-12-30", "2021-01-15"), (1, 5, "2021-02-20", "2021-02-21"), (2, 5, "2019-12-20", "2019-12-25"), (2, 5, "2020-01-10", "2020-01-11")]
    assert _eras(spark, rows) == [(1, 5, "2018-06-01", "2021-02-21", 5, 19), (2, 5, "2019-12-20", "2020-01-11", 2, 16)]


def test_eras_of_a_heavy_person_equal_a_plain_merge(spark):
    import datetime as dt
    import random
    draw = random.Random(11)
    day = dt.date(2015, 1, 1)
    rows = []
    for _ in range(3000):
        person = 1 if draw.random() < 0.4 else draw.randrange(2, 40)
        start = day + dt.timedelta(days=draw.randrange(0, 2200))
        rows.append((person, draw.choice([5, 6]), str(start), str(start + dt.timedelta(days=draw.choice([0, 1, 5, 20, 400 if draw.random() < 0.02 else 3])))))
    want = []
    for key in sorted({r[:2] for r in rows}):
        spans = sorted((dt.date.fromisoformat(s), dt.date.fromisoformat(e)) for p, i, s, e in rows if (p, i) == key)
        first, last, n, gap = *spans[0], 1, 0
        for s, e in spans[1:]:
            if (s - last).days > 30:
                want.append((*key, str(first), str(last), n, gap))
                first, last, n, gap = s, e, 1, 0
            else:
                gap += max((s - last).days, 0)
                last, n = max(last, e), n + 1
        want.append((*key, str(first), str(last), n, gap))
    assert _eras(spark, rows) == sorted(want)


def test_eras_are_built_in_as_many_tasks_as_asked(spark):
    rows = [(p, i, f"{y}-{m:02d}-01", f"{y}-{m:02d}-04") for p in range(30) for i in (5, 6) for y in (2019, 2020) for m in (1, 2, 6, 7)]
    df = spark.createDataFrame([(p, i, D.fromisoformat(s), D.fromisoformat(e)) for p, i, s, e in rows],
                               "person_id long, ingredient_concept_id int, drug_exposure_start_date date, drug_exposure_end_date date")
    eras = drugs.build_drug_eras(df, tasks=40)
    plan = eras._jdf.queryExecution().executedPlan().toString()
    # two shuffles, of the given width; the sorts and sums above them move nothing
    assert plan.count("Exchange hashpartitioning(") == 2 and plan.count(", 40), REPARTITION_BY_NUM") == 2
    assert eras.rdd.getNumPartitions() == 40
    assert _eras(spark, rows, tasks=40) == _eras(spark, rows)
