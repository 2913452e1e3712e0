"""Report sets read back, complementary suppression, F test and interval of the ICC."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from deficit_engine.functions import special
from deficit_engine.operators import agreement, report
from deficit_engine.sources import reports
from tests.test_agreement import PUBLISHED_TOTALS, _rows


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.fixture
def folder(tmp_path):
    new = '"age_group","is_female","N","n_prefrail","n_frail","n_robust","prefrail","frail","robust"\n'
    write(tmp_path / "2025-08-14_efi_acute1-chronic1_siteA.csv", new + '"[40,45)",1,100,20,5,75,0.2,0.05,0.75\n"[45,50)",0,300,60,15,225,0.2,5e-02,0.75\n')
    # an older file: other case, other column order, a missing stratum
    write(tmp_path / "old" / "2024-07-23_vafi_acute3-chronic3_siteB_202303.csv",
          '"is_female","age_group","n","n_frail","n_prefrail","n_robust","prefrail","frail","robust"\n1,"[80,120]",10,1,2,7,0.2,0.1,0.7\nNA,NA,30,3,6,21,0.2,0.1,0.7\n')
    # a report written as a folder of part files, each with its header
    for k, row in enumerate(('"[40,45)",0,50,10,10,30,0.2,0.2,0.6\n', '"[45,50)",0,50,10,10,30,0.2,0.2,0.6\n')):
        write(tmp_path / "2025-08-14_vafi_acute1-chronic1_siteA" / f"part-0000{k}.csv", new + row)
    write(tmp_path / "2025-08-14_efi_meas_acute1-chronic1_siteA.csv", new + '"[40,45)",1,7,1,1,5,0.1,0.1,0.8\n')
    write(tmp_path / "2025-08-14_vafi_categories_acute1-chronic1_siteA.csv", '"age_group","is_female","category","N","count","percent"\n"[40,45)",1,"A, B",100,25,0.25\n"[45,50)",1,"A, B",100,0,0\n')
    write(tmp_path / "Table1_siteA_202504.csv", '"age_group","n","percent_group"\n"[40,45)",5,0.1\n')
    return str(tmp_path)


def test_a_set_of_files_is_pooled(spark, folder):
    bands = reports.read_band_reports(spark, folder)
    assert bands.count() == 6
    got = {(str(r.run_date), r.index_name, r.acute, r.chronic, r.source): (r.N, round(r.robust, 6), round(r.prefrail, 6), round(r.frail, 6))
           for r in reports.pooled_bands(bands).collect()}
    assert got == {("2025-08-14", "efi", 1, 1, "siteA"): (400, 0.75, 0.2, 0.05),
                   ("2024-07-23", "vafi", 3, 3, "siteB_202303"): (40, 0.7, 0.2, 0.1),
                   ("2025-08-14", "vafi", 1, 1, "siteA"): (100, 0.6, 0.2, 0.2)}
    old = [r for r in bands.collect() if r.source == "siteB_202303"]
    assert {(r.age_group, r.is_female, r.N) for r in old} == {("[80,120]", 1, 10), (None, None, 30)}
    assert reports.read_band_reports(spark, folder, kinds=["meas"]).first().N == 7


def test_categories_and_missing_columns(spark, folder, tmp_path):
    r = reports.pooled_categories(reports.read_category_reports(spark, folder)).collect()
    assert [(x.category, x.N, x["count"], x.percent) for x in r] == [("A, B", 200, 25.0, 0.125)]
    write(tmp_path / "2025-08-15_vafi_acute1-chronic1_bad.csv", '"age_group","is_female","N"\n"[40,45)",1,5\n')
    with pytest.raises(Exception, match="no column n_prefrail"):
        reports.read_band_reports(spark, folder).collect()


def test_written_reports_come_back(spark, tmp_path):
    from deficit_engine.sources import write_report
    df = spark.createDataFrame([("[40,45)", 1, 10, 2, 1, 7, 0.2, 0.1, 0.7), (None, None, 5, 0, 0, 5, 0.0, 0.0, 1.0)],
                               "age_group string, is_female int, N long, n_prefrail long, n_frail long, n_robust long, prefrail double, frail double, robust double")
    write_report(df, str(tmp_path), index="efi", acute=1, chronic=3, source="x", run_date="2026-01-02")
    got = reports.read_band_reports(spark, str(tmp_path))
    assert sorted(map(str, got.select(df.columns).collect())) == sorted(map(str, df.collect()))
    assert got.select("index_name", "acute", "chronic", "kind").distinct().collect()[0] == ("efi", 1, 3, "")


# --- complementary suppression ----------------------------------------------------------

def solutions(row, least):
    """All counts that agree with a published row, as a reader who knows the rule can find them."""
    shown = [row[f"n_{b}"] for b in ("prefrail", "frail", "robust")]
    open_ = [k for k, n in enumerate(shown) if n is None]
    if not open_:
        return []
    if row["N"] is None:
        return None     # anything
    rest = row["N"] - sum(n for n in shown if n is not None)
    return [c for c in itertools.product(range(rest + 1), repeat=len(open_)) if sum(c) == rest]


def test_no_hidden_count_can_be_solved_for(spark):
    draw = random.Random(7)
    pick = lambda: draw.choice([0, 0, 1, 2, 5, 9, 10, 11, 12, 30])
    rows = [(f"s{i}", i % 2, *c) for i, c in enumerate(itertools.chain(
        itertools.product([0, 1, 4, 9, 10, 25], repeat=3), ((pick(), pick(), pick()) for _ in range(60))))]
    data = [(a, f, p + q + r, p, q, r, p / max(p + q + r, 1), q / max(p + q + r, 1), r / max(p + q + r, 1)) for a, f, p, q, r in rows]
    df = spark.createDataFrame(data, "age_group string, is_female int, N long, n_prefrail long, n_frail long, n_robust long, "
                                     "prefrail double, frail double, robust double")
    out = {r.age_group: r for r in report.suppress_bands_complementary(df, 10).collect()}
    for a, _, *counts in rows:
        r = out[a]
        shown = [r.n_prefrail, r.n_frail, r.n_robust]
        # small counts are hidden with their share; what is shown is true
        for n, s, share in zip(counts, shown, (r.prefrail, r.frail, r.robust)):
            assert s is None or s == n
            assert (s is None) == (share is None)
            if 0 < n < 10:
                assert s is None
        found = solutions(r, 10)
        if found:
            for k, n in enumerate([n for n, s in zip(counts, shown) if s is None]):
                if 0 < n < 10:      # more than one value is possible for it
                    assert len({c[k] for c in found}) > 1
        # and no more than needed
        small = sum(0 < n < 10 for n in counts)
        hidden = sum(s is None for s in shown)
        assert hidden <= max(small, 2 if small else 0) or r.N is None
    # the present rule stays as it is
    plain = report.suppress_band_cells(df, 10).where("age_group = 's1'").first()
    assert (plain.n_prefrail, plain.n_frail, plain.n_robust) == tuple(0 if n < 10 else n for n in rows[1][2:])


# --- F distribution ------------------------------------------------------------------------

def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def test_special_functions(spark):
    import math
    xs = (0.1, 0.5, 1.0, 2.5, 10.0, 77.7, 1e5)
    for x, got in zip(xs, one(spark, *[special.log_gamma(x) for x in xs])):
        assert got == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12)
    # I_x(1, b) = 1 - (1 - x)^b, I_x(a, 1) = x^a, I_1/2(a, a) = 1/2
    got = one(spark, special.incomplete_beta(0.3, 1, 5), special.incomplete_beta(0.7, 3, 1), special.incomplete_beta(0.5, 40, 40),
              special.incomplete_beta(0.0, 2, 3), special.incomplete_beta(1.0, 2, 3))
    assert got == pytest.approx((1 - 0.7 ** 5, 0.7 ** 3, 0.5, 0.0, 1.0), rel=1e-12)
    # F(2, n): P(F > f) = (1 + 2 f / n)^(-n / 2); the quantile inverts it
    got = one(spark, special.f_upper_tail(3.0, 2, 8), special.f_quantile(0.95, 2, 8), special.f_upper_tail(F.lit(None).cast("double"), 2, 8))
    assert got[:2] == pytest.approx(((1 + 6 / 8) ** -4, 4 * (0.05 ** -0.25 - 1)), rel=1e-10) and got[2] is None


def test_published_icc_test_and_interval(spark):
    totals = spark.createDataFrame(_rows(PUBLISHED_TOTALS), "category string, sum_score_x double, sum_score_y double")
    r = agreement.icc_inference(agreement.icc_oneway(agreement.to_long(totals), k=2)).first()
    assert f"{r.p_value:.2e}" == "5.49e-33"
    assert (round(r.icc_low, 3), round(r.icc_high, 3)) == (0.99, 0.998)


def test_perfect_agreement_has_no_test(spark):
    totals = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 2.0), ("c", 5.0, 5.0)], "category string, sum_score_x double, sum_score_y double")
    r = agreement.icc_inference(agreement.icc_oneway(agreement.to_long(totals), k=2)).first()
    assert r.icc == 1.0 and r.p_value is None and r.icc_low is None
