"""The rows of a task stay bounded when the input grows: more rows, more tasks."""

from pyspark.sql import functions as F

from deficit_engine.operators import skew
from deficit_engine.sources.fixtures import _derived, project
from tests.conftest import SF_SMALL


def test_more_rows_more_tasks(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert skew.task_count(spark, 0) == least
    assert skew.task_count(spark, 216_000_000) == 864
    assert skew.task_count(spark, 216_000_000, 1_000_000) == 216


def test_the_projection_is_dealt_over_sized_tasks(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_ROWS", 200)
    base = project(spark, SF_SMALL)
    assert base["tasks"] > int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the join of lines and orders, and the eras per (person, drug)
    assert base["lines"].rdd.getNumPartitions() == base["tasks"]
    eras = _derived(spark, base)["drug_era"]
    plan = eras._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "HashAggregate" not in plan[plan.index("hashpartitioning(person_id"):]   # none below the shuffle
    assert eras.rdd.getNumPartitions() == base["tasks"]
    line, order = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("lineitem", "orders"))
    plain = (line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_partkey")
             .agg(F.to_date(F.min("l_shipdate")), F.date_add(F.to_date(F.max("l_shipdate")), 30)))
    assert sorted(map(tuple, eras.collect())) == sorted(map(tuple, plain.collect()))
