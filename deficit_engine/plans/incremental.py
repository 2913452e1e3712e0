"""Hit tables brought up to date when their inputs grew.

A hit depends on its person's cohort row, on the person's events and on the
code sets. So when event years arrive or are replaced:

* persons whose cohort row is new, changed or gone, and persons with events in
  a year that was replaced or removed, are searched again, over all years;
* for everyone else the old hits stay, and only the added years (and the new
  version of replaced ones) are searched, as more events can only add hits;
* other code sets, or code of another version, make the table anew.

The published hit table says what it was made from: the fingerprint of each
year, the code sets, and the manifests of the cohort and of the event store,
whose old versions stay readable.
"""

from __future__ import annotations

import json
from dataclasses import asdict
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from deficit_engine.sources.event_store import EventStore, changed_years
from deficit_engine.sources.io import (
    Manifest, commit_manifest, latest_manifest, new_folder, open_table, rows_fingerprint, write_bucketed)

if TYPE_CHECKING:
    from deficit_engine.plans.context import RunContext


def changed_people(old: DataFrame, new: DataFrame) -> DataFrame:
    """Persons whose rows of two versions of a table differ."""
    return (new.exceptAll(old).select("person_id")
            .unionByName(old.exceptAll(new).select("person_id")).distinct())


def _updated(c: RunContext, of: str, before: Manifest, number: int) -> DataFrame:
    """The hits of today from those of ``before`` and what changed since."""
    cohort = c.cohort_of(of)
    was = Manifest(**before.extra["cohort"])
    added, gone = changed_years(before.inputs, c.event_inputs)
    again = changed_people(open_table(c.spark, was).select(*cohort.columns), cohort)
    if gone:
        old_store = EventStore(c.spark, Manifest(**before.extra["events"]))
        again = again.unionByName(old_store.persons_of(gone)).distinct()
    again = c._keep(again, f"searched_again_{of}_{number}")
    parts = [open_table(c.spark, before).join(again, "person_id", "left_anti")]
    fresh = added + [y for y in gone if y in c.event_inputs]
    if fresh:
        parts.append(c.search_all(c.store.slices(fresh), of, cohort.join(again, "person_id", "left_anti")))
    if not again.isEmpty():
        parts.append(c.search_all(c.store.slices(), of, cohort.join(again, "person_id", "left_semi")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def refresh_hits(c: RunContext, of: str) -> DataFrame:
    """The hit table of a cohort under the context's ``home``, up to date."""
    from deficit_engine.plans.context import HIT_FOLDERS
    name = f"{c.home}/{c.options}/hits_{of}"
    number, before = latest_manifest(c.spark, name)
    codes = rows_fingerprint(c.code_set_all()) + rows_fingerprint(c.windows_all())
    cohort = c.cohort_of(of)
    made_from = latest_manifest(c.spark, f"{c.tag}/cohort_{'clean' if of == 'claims' else of}")[1]
    same = before is not None and before.extra["codes"] == codes and before.buckets == c.buckets
    if same and before.inputs == c.event_inputs and changed_people(open_table(c.spark, Manifest(**before.extra["cohort"])).select(*cohort.columns), cohort).isEmpty():
        return open_table(c.spark, before)
    # years that are not told apart can't be compared
    known = same and "" not in before.inputs and "" not in c.event_inputs
    hits = _updated(c, of, before, number) if known else c.search_all(c.slices(), of)
    order = [x for x in hits.columns if x not in HIT_FOLDERS]
    hits = hits.select(*order, *HIT_FOLDERS).repartition(c.buckets, "person_id").distinct()
    folder = new_folder(c.spark, name)
    write_bucketed(hits, folder, c.buckets, ["person_id"], ["person_id"], HIT_FOLDERS)
    manifest = Manifest(schema=json.loads(hits.schema.json()), folders={"": folder}, inputs=c.event_inputs, buckets=c.buckets,
                        bucket_by=["person_id"], sort_by=["person_id"], partition_by=list(HIT_FOLDERS),
                        extra={"codes": codes, "cohort": asdict(made_from), "events": asdict(c.store.manifest)})
    if not commit_manifest(c.spark, name, number + 1, manifest):
        return refresh_hits(c, of)
    return open_table(c.spark, manifest)
