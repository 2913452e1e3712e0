import datetime as dt

from deficit_engine.operators import cohort

D = dt.date


def _tables(spark):
    person = spark.createDataFrame(
        [(1, 1950, 8507, 1, 1), (2, 1937, 8532, 1, 1), (3, 1950, 0, 1, 1), (4, 1990, 8507, 1, 1)],
        "person_id long, year_of_birth int, gender_concept_id int, race_concept_id int, "
        "ethnicity_concept_id int")
    visit = spark.createDataFrame(
        [(10, 1, D(2015, 1, 1)), (11, 2, D(2016, 1, 1)), (12, 3, D(2016, 1, 1)),
         (13, 4, D(2016, 1, 1))], "visit_occurrence_id long, person_id long, visit_start_date date")
    op = spark.createDataFrame(
        [(1, D(2014, 1, 2), D(2020, 1, 1)),   # 364 days of history -> dropped
         (2, D(2015, 1, 1), D(2020, 1, 1)),   # 365 days -> kept
         (3, D(2010, 1, 1), D(2020, 1, 1)),
         (4, D(2010, 1, 1), D(2020, 1, 1))],  # age 26 -> dropped
        "person_id long, observation_period_start_date date, observation_period_end_date date")
    return person, visit, op


def test_history_and_age(spark):
    person, visit, op = _tables(spark)
    raw = cohort.build_cohort(person, visit, op)
    assert sorted(r.person_id for r in raw.collect()) == [2, 3]


def test_clean_cohort_imputed_age_and_lookback(spark):
    person, visit, op = _tables(spark)
    clean = {r.person_id: r for r in cohort.clean_cohort(cohort.build_cohort(person, visit, op)).collect()}
    assert clean[2].age_group == "[80,100]" and clean[2].yob_imputed == 1
    assert clean[2].visit_lookback_date == D(2015, 1, 1)
    assert clean[3].is_female == 1 and clean[3].age_group == "[65,70)"


def test_random_index_is_reproducible_and_partition_invariant(spark):
    visit = spark.range(0, 2000).selectExpr(
        "id AS visit_occurrence_id", "id % 37 AS person_id",
        "date_add(DATE '2010-01-01', CAST(id AS INT)) AS visit_start_date")
    person = spark.range(0, 37).selectExpr("id AS person_id", "1950 AS year_of_birth",
                                           "8507 AS gender_concept_id")
    a = sorted(map(tuple, cohort.random_index_visit(person, visit, 42).collect()))
    b = sorted(map(tuple, cohort.random_index_visit(person, visit.repartition(7), 42).collect()))
    c = sorted(map(tuple, cohort.random_index_visit(person, visit, 7).collect()))
    assert a == b and len(a) == 37 and a != c


def test_clean_cohort_keeps_earliest_index(spark):
    raw = spark.createDataFrame(
        [(1, 1950, 8507, D(2016, 1, 1), 70, 0), (1, 1950, 8507, D(2015, 1, 1), 65, 0)],
        "person_id long, year_of_birth int, gender_concept_id int, index_date date, age int, "
        "yob_imputed int")
    rows = cohort.clean_cohort(raw).collect()
    assert len(rows) == 1 and rows[0].index_date == D(2015, 1, 1)


def test_attrition_is_monotone(spark):
    from tests.conftest import SF_SMALL
    from deficit_engine.plans.context import context
    t = context(spark, SF_SMALL).t
    n = [r.n for r in cohort.attrition(t.person, t.visit_occurrence, t.observation_period)
         .orderBy("stage").collect()]
    assert n == sorted(n, reverse=True) and n[-1] == 90


def test_attrition_reads_each_table_once(spark):
    from deficit_engine.plans.context import context
    from tests.conftest import SF_SMALL
    t = context(spark, SF_SMALL).t
    plan = cohort.attrition(t.person, t.visit_occurrence, t.observation_period)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3


def test_attrition_counts_rows_and_persons(spark):
    person, visit, op = _tables(spark)
    # a person listed twice, one without visits, a null id, two periods of which one is early enough
    person = person.unionByName(spark.createDataFrame([(3, 1950, 0, 1, 1), (9, 1950, 0, 1, 1), (None, 1950, 0, 1, 1)], person.schema))
    op = op.unionByName(spark.createDataFrame([(1, D(2013, 1, 1), D(2013, 6, 1))], op.schema))
    got = {r.label: (r.stage, r.n) for r in cohort.attrition(person, visit, op).collect()}
    assert got == {"persons": (1, 7), "with a visit": (2, 4), "with history": (3, 4), "age eligible": (4, 3)}
    empty = cohort.attrition(person.limit(0), visit, op).collect()
    assert [r.n for r in empty] == [0, 0, 0, 0]


def test_stage_sets_of_two_sites_merge(spark):
    person, visit, op = _tables(spark)
    a = cohort.stage_bits(person, visit.where("person_id < 3"), op)
    b = cohort.stage_bits(person.where("person_id > 1"), visit.where("person_id > 2"), op)
    whole = cohort.count_stages(cohort.merge_stage_bits(a, b)).orderBy("stage").collect()
    want = cohort.attrition(person, visit, op).orderBy("stage").collect()
    assert whole == want
