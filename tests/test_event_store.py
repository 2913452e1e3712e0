"""Event store: buckets, heavy persons, years; and hit tables brought up to date."""

import shutil
import threading

import pytest
from pyspark.sql import functions as F

from deficit_engine.operators import events
from deficit_engine.plans import incremental
from deficit_engine.plans.context import RunContext, context
from deficit_engine.sources import event_store
from deficit_engine.sources.event_store import Slices, changed_years, update_store
from deficit_engine.sources.io import files_fingerprint, latest_manifest, materialize, published, rows_fingerprint
from deficit_engine.sources.omop import event_inputs, load_folder
from tests.conftest import SF_MED, SF_SMALL


def rows(df):
    return sorted(map(str, df.collect()))


def exchanges(df):
    """Lines of the plan, top first, with how far they are indented."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return [(len(x) - len(x.lstrip(" :+-")), x) for x in text.splitlines()]


def above_event_scans(df, table):
    """Operators on the way from the plan's root to the scans of one table."""
    out, path = [], []
    for depth, line in exchanges(df):
        path = [(d, x) for d, x in path if d < depth] + [(depth, line)]
        if "FileScan" in line and table in line:
            out += [x for _, x in path]
    return out


def store_table(c):
    return c.store.slices().light.inputFiles() and c.slices().light._jdf.queryExecution().analyzed().toString().split("published_")[1][:16]


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_search_moves_no_events(spark, broadcast):
    c = context(spark, SF_MED)
    c.hits_all(), c.windows_all(), c.code_set_all(), c.date_range(3)
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        cs = c.code_set_all()
        # the code set is a few rows and told so; the cohort meets the events in their buckets
        found = c.search(c.slices(), windows=F.broadcast(c.windows_all()), categories=F.broadcast(cs.select("concept_id", "index_name", "category", "score")),
                         code_set=cs, tag="index_name", lookbacks=[(1, 1), (3, 3)], unique_categories=True)
        path = above_event_scans(found, store_table(c))
        assert path and not [x for x in path if "Exchange" in x]
        assert any("Bucketed: true" in x for x in path)
        # no report moves the published hits
        published_hits = c.hits_all()._jdf.queryExecution().analyzed().toString().split("published_")[1][:16]
        path = above_event_scans(c.deficits(), published_hits)
        assert path and not [x for x in path if "Exchange" in x]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)


def test_store_equals_the_plain_search(spark):
    c = context(spark, SF_SMALL)
    plain = RunContext(spark, SF_SMALL, materialize_tables=False)
    assert rows(c.deficits("vafi", 3, 3)) == rows(plain.deficits("vafi", 3, 3))
    assert rows(c.search(c.slices())) == rows(plain.search(plain.slices()))
    assert rows(c.source_events()) == rows(plain.source_events())


def heavy_tables(spark, c):
    """The tables of ``c``, with one person who holds a third of all events."""
    t = c.t
    person = c.cohort.select("person_id").orderBy("person_id").first()["person_id"]
    more = {}
    for name, (cid, date, src) in {"condition_occurrence": events.DOMAIN_COLUMNS["condition"], "observation": events.DOMAIN_COLUMNS["observation"]}.items():
        df = getattr(t, name)
        extra = df.withColumn("person_id", F.lit(person).cast("long"))
        more[name] = df.unionByName(extra)
    return type(t)(**(t.as_dict() | more)), person


def test_a_person_with_a_third_of_all_events(spark, monkeypatch):
    monkeypatch.setattr(event_store, "HEAVY", 200)
    small = context(spark, SF_SMALL)
    tables, person = heavy_tables(spark, small)
    c = RunContext.from_tables(spark, tables, "a third of all events")
    found = c.store.slices()
    everything = c.events(with_source=True).distinct()
    n, own = everything.count(), everything.where(F.col("person_id") == person).count()
    assert own > n / 4
    # kept apart, whole, and nobody's events twice
    assert found.heavy.where(F.col("person_id") == person).count() == own
    assert found.light.where(F.col("person_id") == person).count() == 0
    assert found.light.count() + found.heavy.count() == n
    plain = RunContext.from_tables(spark, tables, "plain", materialize_tables=False)
    for window in ((1, 1), (3, 3)):
        assert rows(c.deficits("vafi", *window)) == rows(plain.deficits("vafi", *window))
    assert rows(c.source_events()) == rows(plain.source_events())


def test_equal_events_and_missing_dates(spark):
    schema = "domain string, person_id long, concept_id int, start_date date, source_value string"
    data = [("condition", 1, 5, "2020-01-02", "a")] * 3 + [("condition", 1, 5, None, "a"), ("device", None, None, "2021-01-02", None)]
    df = spark.createDataFrame(data, "domain string, person_id long, concept_id int, start_date string, source_value string") \
        .withColumn("start_date", F.to_date("start_date")).to(spark.createDataFrame([], schema).schema)
    got = update_store(df, "test-events/equal-" + rows_fingerprint(df), {"": "x"}, buckets=3).slices()
    assert got.heavy is None and rows(got.light.drop("event_year")) == rows(df.where("start_date is not null").distinct())
    empty = update_store(df.limit(0), "test-events/empty", {"": "x"}, buckets=3).slices()
    assert empty.light.count() == 0


def test_changed_years():
    assert changed_years({"2019": "a", "2020": "b", "2021": "c"}, {"2019": "a", "2020": "x", "2022": "d"}) == (["2022"], ["2020", "2021"])


# --- growing inputs -----------------------------------------------------------------

EVENT_TABLES = ("condition_occurrence", "observation", "procedure_occurrence", "device_exposure")


@pytest.fixture
def growing(spark, tmp_path):
    """A folder of OMOP tables whose event tables have year folders, without the last two years."""
    t = context(spark, SF_SMALL).t
    for name, df in t.as_dict().items():
        if name in EVENT_TABLES:
            df.write.partitionBy("event_year").parquet(str(tmp_path / "all" / name))
        else:
            df.write.parquet(str(tmp_path / "omop" / name))
    years = sorted(p.name for p in (tmp_path / "all" / "observation").iterdir() if p.is_dir())
    for name in EVENT_TABLES:
        for year in years[:-2]:
            shutil.copytree(tmp_path / "all" / name / year, tmp_path / "omop" / name / year)
    return tmp_path, years


def run(spark, folder, home=True):
    tables, inputs = load_folder(spark, str(folder))
    years = event_inputs(spark, str(folder))
    return RunContext.from_tables(spark, tables, inputs + ("" if home else "-fresh"), event_inputs=years, home=str(folder) if home else None)


def test_a_new_year_reads_only_what_it_touches(spark, growing, monkeypatch):
    tmp, years = growing
    first = run(spark, tmp / "omop")
    before = rows(first.hits_all())
    old = first.store.manifest
    assert set(old.inputs) == {y.split("=")[1] for y in years[:-2]}
    # nothing changed: the same version is read
    again = run(spark, tmp / "omop")
    again.hits_all()
    assert latest_manifest(spark, again._store_name)[0] == 1 and latest_manifest(spark, f"{again.home}/{again.options}/hits_claims")[0] == 1
    # a year arrives
    for name in EVENT_TABLES:
        shutil.copytree(tmp / "all" / name / years[-2], tmp / "omop" / name / years[-2])
    grown = run(spark, tmp / "omop")
    searched = []
    original = RunContext.search_all

    def watch(self, found, of, members=None):
        searched.append(sorted(r[0] for r in found.light.select("event_year").distinct().collect()))
        return original(self, found, of, members)
    monkeypatch.setattr(RunContext, "search_all", watch)
    after = rows(grown.hits_all().select(first.hits_all().columns))
    new = grown.store.manifest
    assert {y: f for y, f in new.folders.items() if y in old.folders} == old.folders       # not written again
    assert searched == [[int(years[-2].split("=")[1])]]                                       # not read again
    monkeypatch.undo()
    assert after == rows(run(spark, tmp / "omop", home=False).hits_all().select(first.hits_all().columns))
    assert set(before) <= set(after) and len(after) > len(before)
    # and its first version is still whole
    assert rows(first.hits_all()) == before


def test_a_replaced_and_a_removed_year(spark, growing):
    tmp, years = growing
    run(spark, tmp / "omop").hits_all()
    # one year is replaced by another's events, one goes, one arrives
    for name in EVENT_TABLES:
        shutil.rmtree(tmp / "omop" / name / years[-4])
        shutil.rmtree(tmp / "omop" / name / years[2])
        shutil.copytree(tmp / "all" / name / years[-1], tmp / "omop" / name / years[-1])
        src = spark.read.parquet(str(tmp / "all" / name / years[-3]))
        src.where("person_id % 3 = 0").write.parquet(str(tmp / "omop" / name / years[-4]))
    got = run(spark, tmp / "omop")
    fresh = run(spark, tmp / "omop", home=False)
    assert rows(got.hits_all().select(fresh.hits_all().columns)) == rows(fresh.hits_all())


def test_changed_cohort_rows_are_searched_again(spark, growing):
    tmp, years = growing
    run(spark, tmp / "omop").hits_all()
    visits = spark.read.parquet(str(tmp / "omop" / "visit_occurrence"))
    visits.where("person_id % 5 <> 0 or visit_occurrence_id % 2 = 0").write.parquet(str(tmp / "fewer"))
    shutil.rmtree(tmp / "omop" / "visit_occurrence")
    shutil.copytree(tmp / "fewer", tmp / "omop" / "visit_occurrence")
    for name in EVENT_TABLES:
        shutil.copytree(tmp / "all" / name / years[-2], tmp / "omop" / name / years[-2])
    got, fresh = run(spark, tmp / "omop"), run(spark, tmp / "omop", home=False)
    assert not incremental.changed_people(got.cohort, run(spark, tmp / "omop", home=False).cohort).collect()
    assert rows(got.hits_all().select(fresh.hits_all().columns)) == rows(fresh.hits_all())


# --- publishing -----------------------------------------------------------------------

def test_two_writers_give_one_whole_table(spark):
    name = "test-publish/two"
    frames = [spark.range(k * 1000, k * 1000 + 500) for k in range(4)]
    got = [None] * 4
    threads = [threading.Thread(target=lambda k=k: got.__setitem__(k, rows(materialize(frames[k], name)))) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert latest_manifest(spark, name)[0] == 1
    assert got[0] in [rows(f) for f in frames] and got == [got[0]] * 4
    # skip if there; a new version on demand, while the old one can still be read
    first = published(spark, name)
    assert rows(materialize(spark.range(3), name)) == got[0]
    assert rows(materialize(spark.range(3), name, overwrite=True)) == rows(spark.range(3)) == rows(published(spark, name))
    assert rows(first) == got[0]


def test_a_failed_write_publishes_nothing(spark):
    name = "test-publish/failed"
    bad = spark.range(10).withColumn("x", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        materialize(bad, name)
    assert published(spark, name) is None
    assert rows(materialize(spark.range(2), name)) == rows(spark.range(2))


def test_bucketed_and_partitioned_tables_come_back(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).cast("int").alias("p"), F.col("id").cast("string").alias("s"))
    got = materialize(df.select("p", "id", "s"), "test-publish/bucketed", partition_by=["p"], buckets=4, bucket_by=["id"])
    assert got.columns == ["id", "s", "p"] and rows(got) == rows(df.select("id", "s", "p"))


def test_fingerprints(spark, tmp_path):
    a = str(tmp_path / "a")
    spark.range(5).write.parquet(a)
    one = files_fingerprint(spark, [a])
    assert one == files_fingerprint(spark, [a]) != files_fingerprint(spark, [a, str(tmp_path / "none")])
    spark.range(6).write.mode("overwrite").parquet(a)
    assert one != files_fingerprint(spark, [a])
    x = spark.createDataFrame([(1, None), (2, "b")], "i int, s string")
    assert rows_fingerprint(x) == rows_fingerprint(x.orderBy(F.desc("i")).repartition(3))
    assert rows_fingerprint(x) != rows_fingerprint(x.fillna("b")) != rows_fingerprint(x.limit(0))


def test_overwritten_code_list_gives_new_deficits(spark, tmp_path):
    path = str(tmp_path / "codes")
    shared = context(spark, SF_SMALL)
    lists = shared.t.code_list.withColumn("lookback", F.lit(3))
    lists.where("category = 'Multi'").write.parquet(path)
    first = RunContext(spark, SF_SMALL, code_lists={"vafi": spark.read.parquet(path)})
    assert {r[0] for r in first.deficits().select("category").distinct().collect()} == {"Multi"}
    lists.where("category = 'Brand#11' or category = 'Brand#12'").write.mode("overwrite").parquet(path)
    second = RunContext(spark, SF_SMALL, code_lists={"vafi": spark.read.parquet(path)})
    assert second.tag != first.tag
    assert {r[0] for r in second.deficits().select("category").distinct().collect()} <= {"Brand#11", "Brand#12"}


def test_slices_where():
    class Frame:
        def where(self, c):
            return c
    assert Slices(Frame(), None).where(1) == Slices(1, None) and Slices(Frame(), Frame()).where(2) == Slices(2, 2)
