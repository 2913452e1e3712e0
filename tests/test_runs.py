import glob
import os

import pytest

from deficit_engine.plans.runs import run_indices
from tests.conftest import SF_SMALL


def test_run_writes_named_reports(spark, tmp_path):
    out = str(tmp_path)
    paths = run_indices(spark, SF_SMALL, out, source="fixture", run_date="2026-01-01")
    names = sorted(os.path.basename(p) for p in paths)
    assert "2026-01-01_vafi_acute1-chronic1_fixture" in names
    assert "2026-01-01_efi_categories_acute3-chronic3_fixture" in names
    assert len(names) == 8
    band = spark.read.csv(os.path.join(out, "2026-01-01_vafi_acute1-chronic1_fixture"),
                          header=True, inferSchema=True)
    assert sum(r.N for r in band.collect()) == 90
    assert all(glob.glob(os.path.join(p, "*.csv")) for p in paths)


def test_upload_and_csv_code_list(spark, tmp_path):
    from deficit_engine.sources import read_code_list_csv, upload
    df = upload(spark, [(1, "A", 1.0), (2, "B", 0.5)], "code_list")
    p = str(tmp_path / "codes")
    df.write.option("header", True).csv(p)
    back = read_code_list_csv(spark, p)
    assert dict(back.dtypes)["score"] == "double"
    assert sorted(map(tuple, back.collect())) == [(1, "A", 1.0), (2, "B", 0.5)]


def test_cli(spark, tmp_path):
    from deficit_engine.plans.runs import main
    main(["--input", SF_SMALL, "--out", str(tmp_path), "--source", "cli", "--date", "2026-02-02"])
    assert (tmp_path / "2026-02-02_vafi_acute1-chronic1_cli").is_dir()


def _rows(spark, folder):
    return sorted(map(str, spark.read.csv(folder, header=True).collect()))


def test_cli_on_omop_tables_equals_the_projected_run(spark, tmp_path):
    from deficit_engine.plans.context import context
    from deficit_engine.plans.runs import main
    for name, df in context(spark, SF_SMALL).t.as_dict().items():
        df.write.parquet(str(tmp_path / "omop" / name))
    both = ["--date", "2026-02-02", "--cohort", "claims", "--cohort", "survey"]
    main(["--input", SF_SMALL, "--out", str(tmp_path / "a"), *both])
    main(["--omop", str(tmp_path / "omop"), "--out", str(tmp_path / "b"), *both])
    names = sorted(os.listdir(tmp_path / "a"))
    assert names == sorted(os.listdir(tmp_path / "b")) and len(names) == 16
    assert "2026-02-02_vafi_acute1-chronic1_fixture-survey" in names
    for n in names:
        assert _rows(spark, str(tmp_path / "a" / n)) == _rows(spark, str(tmp_path / "b" / n)), n


def test_loader_names_what_is_missing(spark, tmp_path):
    import pytest
    from deficit_engine.sources import load_folder
    spark.range(1).write.parquet(str(tmp_path / "person"))
    with pytest.raises(ValueError, match="person is missing columns"):
        load_folder(spark, str(tmp_path))


def test_seed_and_replaced_input_make_new_tables(spark, tmp_path):
    import shutil

    from deficit_engine.plans.context import RunContext
    from deficit_engine.sources.fixtures import INPUTS
    from tests.conftest import SF_MED
    for n in INPUTS:
        shutil.copyfile(f"{SF_SMALL}/{n}.parquet", tmp_path / f"{n}.parquet")
    rows = lambda c: sorted(map(tuple, c.deficits("vafi", 1, 1).collect()))
    folder = f"file://{tmp_path}"
    first = rows(RunContext(spark, folder))
    seven = rows(RunContext(spark, folder, seed=7))
    assert seven != first
    assert seven == rows(RunContext(spark, folder, seed=7, run_id="fresh"))
    assert first == rows(RunContext(spark, folder))
    assert RunContext(spark, folder).in_window().count() == RunContext(spark, folder, run_id="fresh").in_window().count()
    for n in INPUTS:
        shutil.copyfile(f"{SF_MED}/{n}.parquet", tmp_path / f"{n}.parquet")
    assert RunContext(spark, folder).cohort.count() > 5 * 90


def test_code_list_of_one_index(spark):
    from pyspark.sql import functions as F

    from deficit_engine.plans.context import RunContext, context
    shared = context(spark, SF_SMALL)
    own = shared.t.code_list.filter(F.col("category") == "Multi").withColumn("lookback", F.lit(3))
    c = RunContext(spark, SF_SMALL, code_lists={"vafi": own})
    assert {r[0] for r in c.deficits("vafi", 1, 1).select("category").distinct().collect()} <= {"Multi"}
    assert c.tag != shared.tag
    assert sorted(map(tuple, c.deficits("efi", 1, 1).collect())) == sorted(map(tuple, shared.deficits("efi", 1, 1).collect()))


def test_category_table_has_no_category_limit(spark):
    from pyspark.sql import functions as F

    from deficit_engine.operators.report import summarize_categories
    cohort = spark.createDataFrame([(1, "[40,45)", 0), (2, "[45,50)", 1)], "person_id long, age_group string, is_female int")
    hits = spark.range(12_000).select(F.lit(1).cast("long").alias("person_id"), F.concat(F.lit("c"), "id").alias("category"), F.lit(0.5).alias("score"))
    out = summarize_categories(hits, cohort, hits.select("category"))
    assert out.count() == 24_000 and out.agg(F.sum("count")).first()[0] == 6000.0


def test_another_index_and_single_files(spark, tmp_path):
    from deficit_engine.plans.context import context
    from deficit_engine.plans.runs import main
    from deficit_engine.sources.reports import read_band_reports
    codes = context(spark, SF_SMALL).t.code_list.where("category in ('Brand#11', 'Brand#12', 'Multi')").select("concept_id", "category", "score")
    codes.coalesce(1).write.option("header", True).csv(str(tmp_path / "codes"))
    path = str(tmp_path / "hfrs.csv")
    os.rename(glob.glob(str(tmp_path / "codes" / "part-*.csv"))[0], path)
    out = tmp_path / "out"
    run = ["--input", SF_SMALL, "--out", str(out), "--date", "2026-02-02", "--code-list", f"hfrs={path}", "--single-file"]
    with pytest.raises(ValueError, match="thresholds for hfrs"):
        main(run)
    main([*run, "--index", "hfrs:3:0.2:0.5"])
    names = sorted(n for n in os.listdir(out) if not n.startswith("."))
    assert names[:2] == ["2026-02-02_efi_acute1-chronic1_fixture.csv", "2026-02-02_efi_acute3-chronic3_fixture.csv"]
    assert len(names) == 12
    bands = read_band_reports(spark, str(out)).groupBy("index_name", "acute").sum("N").collect()
    assert {(r[0], r[1]): r[2] for r in bands} == {(i, a): 90 for i in ("vafi", "efi", "hfrs") for a in (1, 3)}
