"""OMOP tables from a folder of Parquet tables or from a catalog schema."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

from deficit_engine.sources.fixtures import OmopTables
from deficit_engine.sources.io import files_fingerprint, partition_fingerprints, table_exists
from deficit_engine.sources.schemas import SCHEMAS, require_columns

# Tables that only some runs read; one that is missing is taken as empty.
OPTIONAL = frozenset({"drug_era", "source_codes", "ds_survey", "cb_search_person"})


def _checked(df: DataFrame, name: str) -> DataFrame:
    """The columns that the runs read (and the year folders, if there are any)."""
    require_columns(df, name)
    extra = ["event_year"] if "event_year" in df.columns else []
    return df.select(*[f.name for f in SCHEMAS[name].fields], *extra)


EVENT_TABLES = ("condition_occurrence", "observation", "procedure_occurrence", "device_exposure")


def _places(spark: SparkSession, folder: str, table: str) -> list[str]:
    return [p for p in (f"{folder.rstrip('/')}/{table}", f"{folder.rstrip('/')}/{table}.parquet")
            if table_exists(spark, p, marker="")]


def event_inputs(spark: SparkSession, folder: str) -> dict[str, str] | None:
    """Fingerprint of each year's event files, if all event tables in ``folder``
    have a folder ``event_year=Y`` for each year (for :class:`RunContext`)."""
    paths = [p for t in EVENT_TABLES for p in _places(spark, folder, t)[:1]]
    years = partition_fingerprints(spark, paths, "event_year")
    years = {y: fp for y, fp in years.items() if y != "__HIVE_DEFAULT_PARTITION__"}   # events without a date are in no window
    return years if years and "" not in years else None


def load_folder(spark: SparkSession, folder: str) -> tuple[OmopTables, str]:
    """Tables ``<folder>/<table>`` or ``<folder>/<table>.parquet``, and the
    fingerprint of their files (for :meth:`RunContext.from_tables`)."""
    found, paths = {}, []
    for f in fields(OmopTables):
        at = _places(spark, folder, f.name)
        if at:
            found[f.name] = _checked(spark.read.parquet(at[0]), f.name)
            paths.append(at[0])
        elif f.name in OPTIONAL:
            found[f.name] = spark.createDataFrame([], SCHEMAS[f.name])
        else:
            raise ValueError(f"no table {f.name} in {folder}")
    return OmopTables(**found), files_fingerprint(spark, paths)


def _location(spark: SparkSession, name: str) -> str:
    """Folder of a catalog table."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").collect()
    if not rows:
        raise ValueError(f"{name} has no folder; pass its tables to RunContext with an `inputs` name of your own")
    return rows[0]["data_type"]


def load_schema(spark: SparkSession, schema: str) -> tuple[OmopTables, str]:
    """Tables ``<schema>.<table>`` of the session's catalog, and the fingerprint of their files."""
    found, paths = {}, []
    for f in fields(OmopTables):
        name = f"{schema}.{f.name}"
        if spark.catalog.tableExists(name):
            found[f.name] = _checked(spark.table(name), f.name)
            paths.append(_location(spark, name))
        elif f.name in OPTIONAL:
            found[f.name] = spark.createDataFrame([], SCHEMAS[f.name])
        else:
            raise ValueError(f"no table {name}")
    return OmopTables(**found), files_fingerprint(spark, paths)
