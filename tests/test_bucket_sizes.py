"""Buckets of the event store: a task that searches one stays small however many events there are."""

from deficit_engine.sources import event_store


def test_buckets_follow_the_events(spark):
    assert event_store.bucket_count(spark, 0) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    for rows in (36_000_000, 216_000_000):
        # 692 MB for a task at 300,000 events of a bucket, so under 3,600 MB at 1,000,000
        assert rows / event_store.bucket_count(spark, rows) <= 1_000_000
