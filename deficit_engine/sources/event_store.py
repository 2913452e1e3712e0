"""Event store: the events of all domains, dealt into buckets by person.

The searches join events with a cohort by person. Here that join needs no
shuffle of events: each event is placed once, when it arrives, into the bucket
of its person, in a folder for its year; cohorts and hit tables are bucketed
alike. A search reads the years of its windows, joins bucket with bucket, and
the distinct rows and per-person sums above it keep that partitioning.

A person with more than ``HEAVY`` events in a year would make one bucket
large. All events of such persons are kept apart in plain files, and are
searched by a join that Spark can split.

Every search returns distinct rows, so equal events are stored once. Events
without a date are in no window and are not stored.

The store is a published table whose parts are years. It is made again only
for the years whose input files changed.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deficit_engine.operators.skew import task_count
from deficit_engine.sources.io import (
    Manifest, _fs, commit_manifest, latest_manifest, new_folder, open_table, write_bucketed)

BUCKET_ROWS = 300_000       # events of a bucket, about: one task searches a bucket, all indices and windows in 0.7 GB
HEAVY = 1_000_000           # events of a person in a year, beyond which the person is kept apart
YEAR = "event_year"


class Slices(NamedTuple):
    """Events of most persons, bucketed by person, and those of heavy persons (None without any)."""
    light: DataFrame
    heavy: DataFrame | None

    def where(self, condition) -> Slices:
        return Slices(self.light.where(condition), self.heavy.where(condition) if self.heavy is not None else None)


def bucket_count(spark: SparkSession, rows: int) -> int:
    """Buckets of a new store: as many as shuffles have partitions, more for many events."""
    return task_count(spark, rows, BUCKET_ROWS)


def _year_folders(spark: SparkSession, folder: str) -> dict[str, str]:
    """Folders ``event_year=Y`` in ``folder``, by year."""
    fs, jpath = _fs(spark, folder)
    if not fs.exists(jpath):
        return {}
    names = [st.getPath().getName() for st in fs.listStatus(jpath) if st.isDirectory()]
    return {n.split("=", 1)[1]: f"{folder}/{n}" for n in names if n.startswith(f"{YEAR}=")}


class EventStore:
    def __init__(self, spark: SparkSession, manifest: Manifest):
        self.spark, self.manifest = spark, manifest
        self.buckets = manifest.buckets

    # --- reading ----------------------------------------------------------------
    def _heavy_rows(self) -> DataFrame | None:
        folders = self.manifest.extra["heavy"]
        if not folders:
            return None
        schema = open_table(self.spark, self.manifest).drop(YEAR).schema
        out = None
        for year, folder in sorted(folders.items()):
            one = self.spark.read.schema(schema).parquet(folder).withColumn(YEAR, F.lit(int(year)))
            out = one if out is None else out.unionByName(one)
        return out

    def slices(self, years: list[str] | None = None) -> Slices:
        """All events, or those of some years."""
        light, heavy = open_table(self.spark, self.manifest), self._heavy_rows()
        if heavy is not None:
            # a heavy person's events of quieter years belong to the heavy part as well
            persons = heavy.select("person_id").distinct()
            heavy = heavy.unionByName(light.join(persons, "person_id", "left_semi"))
            light = light.join(persons, "person_id", "left_anti")
        out = Slices(light, heavy)
        return out if years is None else out.where(F.col(YEAR).isin([int(y) for y in years]))

    def persons_of(self, years: list[str]) -> DataFrame:
        """Persons with an event in some years."""
        got = self.slices(years)
        out = got.light.select("person_id")
        return (out if got.heavy is None else out.unionByName(got.heavy.select("person_id"))).distinct()


def changed_years(old: Mapping[str, str], new: Mapping[str, str]) -> tuple[list[str], list[str]]:
    """Years that were added, and years that were replaced or removed."""
    added = sorted(y for y in new if y not in old)
    gone = sorted(y for y in old if new.get(y) != old[y])
    return added, gone


def open_store(spark: SparkSession, name: str) -> EventStore | None:
    manifest = latest_manifest(spark, name)[1]
    return EventStore(spark, manifest) if manifest is not None else None


def update_store(events: DataFrame, name: str, inputs: Mapping[str, str], *, buckets: int | None = None,
                 heavy: int | None = None) -> EventStore:
    """The store ``name`` of ``events`` (domain, person_id, concept_id, start_date,
    source_value[, event_year]).

    ``inputs``: fingerprint of the input files of each year, or of all of them
    under ``""`` if they are not split by year. Years whose fingerprint the
    store has already are left as they are; of two writers at once one wins.
    """
    spark = events.sparkSession
    given, heavy = events, HEAVY if heavy is None else heavy
    number, before = latest_manifest(spark, name)
    if before is not None and before.inputs == dict(inputs):
        return EventStore(spark, before)
    events = events.where(F.col("start_date").isNotNull())
    if YEAR not in events.columns:
        events = events.withColumn(YEAR, F.year("start_date"))
    events = events.select("domain", "person_id", "concept_id", "start_date", "source_value", F.col(YEAR).cast("int").alias(YEAR))
    keep: dict[str, str] = {}
    if before is not None and "" not in inputs and "" not in before.inputs:
        keep = {y: fp for y, fp in before.inputs.items() if inputs.get(y) == fp}
        if keep:
            events = events.where(F.col(YEAR).isin([int(y) for y in inputs if y not in keep]))
    if before is not None:
        buckets = before.buckets        # fixed for the life of a store: kept years have that many
    buckets = buckets or bucket_count(spark, events.count())
    folder = new_folder(spark, name)
    persons = (events.groupBy("person_id", YEAR).count().where(F.col("count") > heavy).select("person_id").distinct())
    persons.write.parquet(f"{folder}/heavy_persons")
    persons = spark.read.schema(persons.schema).parquet(f"{folder}/heavy_persons")
    light = events
    heavy_folders: dict[str, str] = {}
    if not persons.isEmpty():
        light = events.join(persons, "person_id", "left_anti")
        (events.join(persons, "person_id", "left_semi").repartition("person_id", "concept_id", "start_date").distinct()
         .write.partitionBy(YEAR).parquet(f"{folder}/heavy"))
        heavy_folders = _year_folders(spark, f"{folder}/heavy")
    # equal rows of a person meet in its bucket, so the distinct moves nothing
    write_bucketed(light.repartition(buckets, "person_id").distinct(), f"{folder}/light", buckets, ["person_id"],
                   ["person_id", "start_date"], [YEAR])
    old = before.folders if before is not None else {}
    old_heavy = before.extra["heavy"] if before is not None else {}
    manifest = Manifest(
        schema=json.loads(events.schema.json()),
        folders={y: f for y, f in old.items() if y in keep} | _year_folders(spark, f"{folder}/light"),
        inputs=dict(inputs), folder_column=YEAR, buckets=buckets, bucket_by=["person_id"], sort_by=["person_id", "start_date"],
        extra={"heavy": {y: f for y, f in old_heavy.items() if y in keep} | heavy_folders})
    if not commit_manifest(spark, name, number + 1, manifest):
        fs, jpath = _fs(spark, folder)
        fs.delete(jpath, True)
        return update_store(given, name, inputs, buckets=buckets, heavy=heavy)
    return EventStore(spark, manifest)
