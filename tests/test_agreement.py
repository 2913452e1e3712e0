import pytest

from deficit_engine.operators import agreement

# fixed values: published per-category totals of the two coding methods
# (category, standard-concept method, source-code method)
PUBLISHED_TOTALS = [
    ("AFIB", 283382, 283589), ("Thyroid", 638667, 627290), ("Fatigue", 573341, 573339),
    ("CAD", 507059, 472959), ("HTN", 2150393, 2150391), ("Incont", 144071, 144072),
    ("Vision", 492936, 381148), ("GaitAb", 263802, 263801), ("Diabetes", 784456, 783482),
    ("Cancer", 636061, 503838), ("Anemia", 422577, 414048), ("Kidney", 345738, 345479),
    ("Osteo", 219655, 201482), ("DuraMed", 100575, 100575), ("Falls", 228761, 187509),
    ("CVA", 217439, 197396), ("FtoThrive", 11364, 11364), ("Anxiety", 702657, 701790),
    ("Arthritis", 937342, 894285), ("Chronpain", 514135, 484886), ("PerNeuro", 256488, 219260),
    ("Lung", 616317, 608470), ("Depress", 631728, 627375), ("Dementia", 285638, 226536),
    ("Muscular", 195118, 252394), ("HF", 214550, 214517), ("PVD", 414693, 370544),
    ("Liver", 132025, 132025), ("WgtLoss", 89460, 89460), ("Hearing", 187650, 174794),
    ("PD", 78964, 57436),
]


def _rows(rows):
    return [(c, None if x is None else float(x), None if y is None else float(y)) for c, x, y in rows]


def test_icc_golden(spark):
    totals = spark.createDataFrame(_rows(PUBLISHED_TOTALS), "category string, sum_score_x double, sum_score_y double")
    r = agreement.icc_oneway(agreement.to_long(totals)).first()
    assert (r.n, r.k, r.df1, r.df2) == (31, 2, 30, 31)
    assert r.icc == pytest.approx(0.99512, abs=5e-6)
    assert r.f_value == pytest.approx(408.74, abs=5e-3)


def test_icc_drops_incomplete_and_corr(spark):
    rows = PUBLISHED_TOTALS + [("Extra", 5.0, None)]
    totals = spark.createDataFrame(_rows(rows), "category string, sum_score_x double, sum_score_y double")
    assert agreement.icc_oneway(agreement.to_long(totals)).first().n == 31
    c = agreement.method_correlation(totals).first()
    assert c.n == 31 and 0.99 < c.corr < 1.0
    assert agreement.method_correlation(totals, exclude="HTN").first().n == 30


def test_icc_with_known_rater_count(spark):
    totals = spark.createDataFrame(_rows(PUBLISHED_TOTALS), "category string, sum_score_x double, sum_score_y double")
    a = agreement.icc_oneway(agreement.to_long(totals)).first()
    b = agreement.icc_oneway(agreement.to_long(totals), k=2).first()
    assert a.icc == pytest.approx(b.icc) and a.f_value == pytest.approx(b.f_value)
