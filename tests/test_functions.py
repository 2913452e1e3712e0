import datetime as dt

from pyspark.sql import functions as F

from deficit_engine.constants import AGE_BREAKS_CLAIMS
from deficit_engine.functions import add_years, age_band, band_flags, flag_unless_equal, if_else


def test_age_bands_half_open_last_closed(spark):
    df = spark.createDataFrame([(a,) for a in (40, 44, 45, 80, 100, 101, 39)], "age int")
    got = [r[0] for r in df.select(age_band("age", AGE_BREAKS_CLAIMS)).collect()]
    assert got == ["[40,45)", "[40,45)", "[45,50)", "[80,100]", "[80,100]", None, None]


def test_two_arm_if_keeps_null(spark):
    df = spark.createDataFrame([(3,), (1,), (None,)], "c int")
    got = [r[0] for r in df.select(if_else(F.col("c") == 3, "chronic", "acute")).collect()]
    assert got == ["chronic", "acute", None]


def test_sex_coding(spark):
    df = spark.createDataFrame([(8507,), (8532,), (0,), (None,)], "g int")
    assert [r[0] for r in df.select(flag_unless_equal("g", 8507)).collect()] == [0, 1, 1, None]


def test_add_years_leap_day(spark):
    df = spark.createDataFrame([(dt.date(2020, 2, 29),)], "d date")
    r = df.select(add_years("d", -1).alias("a"), add_years("d", -3).alias("b")).first()
    assert r.a == dt.date(2019, 2, 28) and r.b == dt.date(2017, 2, 28)


def _bands(spark, values, lb, ub, boundary):
    df = spark.createDataFrame([(float(v),) for v in values], "fi double")
    fl = band_flags("fi", lb, ub, boundary)
    rows = df.select(*[v.alias(k) for k, v in fl.items()]).collect()
    out = []
    for r in rows:
        assert r.prefrail + r.frail + r.robust == 1
        out.append("prefrail" if r.prefrail else "frail" if r.frail else "robust")
    return out


def test_band_edges_both_conventions(spark):
    assert _bands(spark, [0.1, 0.2], 0.1, 0.2, "right_closed") == ["robust", "prefrail"]
    assert _bands(spark, [0.1, 0.2], 0.1, 0.2, "left_closed") == ["prefrail", "frail"]


def test_integer_cuts(spark):
    assert _bands(spark, [k / 31 for k in (3, 4, 6, 7)], 0.10, 0.20, "right_closed") == \
        ["robust", "prefrail", "prefrail", "frail"]
    assert _bands(spark, [k / 36 for k in (4, 5, 8, 9)], 0.12, 0.24, "right_closed") == \
        ["robust", "prefrail", "prefrail", "frail"]


def test_display_labels(spark):
    from deficit_engine.functions import percent_label, thousands_label
    r = spark.createDataFrame([(0.1234, 34808145)], "p double, n long").select(
        percent_label("p").alias("a"), thousands_label("n").alias("b")).first()
    assert r.a == "12%" and r.b == "34,808,145"


def test_index_names():
    import pytest
    from deficit_engine.operators.events import check_index
    assert check_index("VAFI") == "vafi"
    with pytest.raises(ValueError):
        check_index("nope")
