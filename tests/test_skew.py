"""Hot keys: AQE cuts the partitions of any number of them."""

from pyspark.sql import functions as F

from deficit_engine.operators.skew import redistribute

CONF = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0", "spark.sql.shuffle.partitions": "16"}


def _with(spark, fn):
    prev = {k: spark.conf.get(k, None) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    try:
        return fn()
    finally:
        for k, v in prev.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _joined(spark, big):
    small = spark.range(0, 2000).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    # a number of map tasks, so that a partition has pieces to be cut at
    return redistribute(big.repartition(12, "v").join(small, "k").withColumn("task", F.spark_partition_id()), ["k", "v"])


def test_one_key_with_a_third_of_all_rows_is_split(spark):
    big = spark.range(0, 60000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 997 + 1).alias("k"), F.col("id").alias("v"))

    def run():
        out = _joined(spark, big)
        rows = out.distinct().collect()
        assert len(rows) == 60000 and all(r["w"] == r["k"] * 10 for r in rows)
        return {}, [r for r in rows if r["k"] == 0]
    _, hot = _with(spark, run)
    tasks = {r["task"] for r in hot}
    assert len(hot) == 20000 and len(tasks) >= 3


def test_300_hot_keys_are_all_spread(spark):
    big = spark.range(0, 90000).select((F.col("id") % 300).alias("k"), F.col("id").alias("v"))
    rows = _with(spark, lambda: _joined(spark, big).groupBy("task").count().collect())
    assert sum(r["count"] for r in rows) == 90000
    # no task has more than its share of whole keys, and some partitions were cut
    assert len(rows) > 16 and max(r["count"] for r in rows) < 90000 / 12
