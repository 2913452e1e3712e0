"""Readers, writers and materialisation points.

Materialisation writes Parquet under the shared ``spark.checkpoint.dir`` and
reads it back, which both cuts lineage (a lost executor recomputes from the
written files, not from the raw scans) and is the Spark form of the
warehouse ``compute()`` / persistent tables of the original workflow.

A table is committed in two steps: its files are written to a folder of their
own, and then a manifest that names the folder is created, which fails if
another application was first. Readers follow the manifest, so they see all of
a table or none of it, and no writer ever touches files that another reads.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from deficit_engine.session import checkpoint_dir
from deficit_engine.sources.schemas import SCHEMAS


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def table_exists(spark: SparkSession, path: str, marker: str = "/_SUCCESS") -> bool:
    """True when a committed Parquet table (``_SUCCESS`` marker) is at ``path``;
    with an empty ``marker``, when anything is."""
    fs, jpath = _fs(spark, path.rstrip("/") + marker)
    return bool(fs.exists(jpath))


def _listing(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, length, modificationTime) of all files at or below ``paths``; Spark
    lists folders in parallel and reads no content."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
            .select("path", "length", "modificationTime"))


def _folded(*columns) -> list:
    """A hash of a set of rows: count, sum and exclusive or of their hashes."""
    h = F.xxhash64(*columns)
    return [F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")]


def _digest(*values) -> str:
    return hashlib.sha1(";".join(map(str, values)).encode()).hexdigest()[:16]


def files_fingerprint(spark: SparkSession, paths: Sequence[str]) -> str:
    """Hash of the path, length and modification time of every file at or below
    ``paths``. One aggregate over a listing that Spark makes: no list of files
    reaches the driver program."""
    there = [p for p in paths if table_exists(spark, p, marker="")]
    missing = sorted(set(paths) - set(there))
    row = _listing(spark, there).agg(*_folded("path", "length", "modificationTime")).first() if there else ()
    return _digest(*row, *missing)


def partition_fingerprints(spark: SparkSession, paths: Sequence[str], column: str) -> dict[str, str]:
    """The same for each value of a partition column (folders ``column=value``);
    files outside such folders are under ``""``."""
    there = [p for p in paths if table_exists(spark, p, marker="")]
    if not there:
        return {}
    value = F.regexp_extract("path", rf"/{column}=([^/]+)/", 1)
    rows = _listing(spark, there).groupBy(value.alias("value")).agg(*_folded("path", "length", "modificationTime")).collect()
    return {r["value"]: _digest(r["n"], r["s"], r["x"]) for r in rows}


def rows_fingerprint(df: DataFrame) -> str:
    """Hash of the rows and column types of a (small) table, whatever file they
    came from and in whatever order."""
    row = df.agg(*_folded(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))).first() if df.columns else ()
    return _digest(df.schema.simpleString(), *row)


# --- published tables ------------------------------------------------------------

@dataclass
class Manifest:
    """What a published table consists of. ``folders`` maps the value of
    ``folder_column`` to the folder of that part; a table that is not made of
    parts has one folder under ``""``. ``inputs`` says what each part was made from."""
    schema: dict
    folders: dict[str, str]
    inputs: dict[str, str] = field(default_factory=dict)
    folder_column: str | None = None
    buckets: int = 0
    bucket_by: list[str] = field(default_factory=list)
    sort_by: list[str] = field(default_factory=list)
    partition_by: list[str] = field(default_factory=list)
    extra: dict = field(default_factory=dict)


def _table_root(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/tables/{name}"


def latest_manifest(spark: SparkSession, name: str) -> tuple[int, Manifest | None]:
    """Number and content of a table's newest manifest; (0, None) without one."""
    root = _table_root(spark, name)
    fs, jpath = _fs(spark, root)
    if not fs.exists(jpath):
        return 0, None
    # a handful of entries: one folder for each version and one manifest for each commit
    numbers = [int(st.getPath().getName()[10:-5]) for st in fs.listStatus(jpath) if st.getPath().getName().startswith("_manifest-")]
    if not numbers:
        return 0, None
    _, at = _fs(spark, f"{root}/_manifest-{max(numbers)}.json")
    stream = fs.open(at)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return max(numbers), Manifest(**json.loads(text))


def commit_manifest(spark: SparkSession, name: str, number: int, manifest: Manifest) -> bool:
    """Make ``manifest`` the table's version ``number``; False if there is one already."""
    fs, at = _fs(spark, f"{_table_root(spark, name)}/_manifest-{number}.json")
    try:
        stream = fs.create(at, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
            return False
        raise
    try:
        stream.write(bytearray(json.dumps(asdict(manifest)).encode()))
    finally:
        stream.close()
    return True


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of a table that no other writer uses."""
    return f"{_table_root(spark, name)}/v-{uuid.uuid4().hex}"


def write_bucketed(df: DataFrame, path: str, buckets: int, bucket_by: Sequence[str], sort_by: Sequence[str],
                   partition_by: Sequence[str] = (), append: bool = False) -> None:
    """Write ``df`` as bucketed files below ``path``. Rows that are already dealt
    out by ``bucket_by`` over ``buckets`` partitions are not moved."""
    spark = df.sparkSession
    entry = f"staged_{uuid.uuid4().hex}"
    w = df.write.format("parquet").bucketBy(buckets, *bucket_by).sortBy(*sort_by).option("path", path)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.mode("append" if append else "errorifexists").saveAsTable(entry)
    spark.sql(f"DROP TABLE {entry}")    # the entry only: files at a given path stay


def open_table(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """The table that a manifest describes. A bucketed one is entered in the
    catalog under a name made from its content, so that Spark knows its buckets."""
    schema = StructType.fromJson(manifest.schema)
    if not manifest.buckets:
        return spark.read.schema(schema).parquet(*manifest.folders.values())
    entry = "published_" + _digest(json.dumps(asdict(manifest), sort_keys=True))
    if not spark.catalog.tableExists(entry):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        buckets = (f"CLUSTERED BY ({', '.join(manifest.bucket_by)}) SORTED BY ({', '.join(manifest.sort_by)}) "
                   f"INTO {manifest.buckets} BUCKETS")
        split = [manifest.folder_column] if manifest.folder_column else manifest.partition_by
        parted = f"PARTITIONED BY ({', '.join(split)})" if split else ""
        first = next(iter(manifest.folders.values()), new_folder(spark, "empty"))
        spark.sql(f"CREATE TABLE IF NOT EXISTS {entry} ({columns}) USING parquet {parted} {buckets} LOCATION '{first}'")
        if manifest.folder_column:
            for value, folder in manifest.folders.items():
                spark.sql(f"ALTER TABLE {entry} ADD IF NOT EXISTS PARTITION ({manifest.folder_column}='{value}') LOCATION '{folder}'")
        elif split:
            spark.catalog.recoverPartitions(entry)
    return spark.table(entry)


def published(spark: SparkSession, name: str) -> DataFrame | None:
    """The newest version of a published table, or None."""
    manifest = latest_manifest(spark, name)[1]
    return open_table(spark, manifest) if manifest is not None else None


def materialize(df: DataFrame, name: str, *, overwrite: bool = False, partition_by: Sequence[str] | None = None,
                buckets: int = 0, bucket_by: Sequence[str] = (), sort_by: Sequence[str] = (),
                inputs: Mapping[str, str] | None = None) -> DataFrame:
    """Publish ``df`` under ``name`` and read it back.

    The table is reused when present (skip-if-exists), so ``name`` must say
    what it was made from; pass ``overwrite=True`` to add a new version. Of two
    applications that publish at once one wins, and both read its table.
    """
    spark = df.sparkSession
    number, manifest = latest_manifest(spark, name)
    if manifest is None or overwrite:
        folder = new_folder(spark, name)
        if buckets:
            write_bucketed(df, folder, buckets, bucket_by, sort_by or bucket_by, partition_by or ())
        else:
            w = df.write
            if partition_by:
                w = w.partitionBy(*partition_by)
            w.parquet(folder)
        # partition columns are read from the folders' names, after the others
        last = list(partition_by or ())
        schema = df.select(*[c for c in df.columns if c not in last], *last).schema
        manifest = Manifest(schema=json.loads(schema.json()), folders={"": folder}, inputs=dict(inputs or {}), buckets=buckets,
                            bucket_by=list(bucket_by), sort_by=list(sort_by or bucket_by), partition_by=last)
        if not commit_manifest(spark, name, number + 1, manifest):
            fs, jpath = _fs(spark, folder)
            fs.delete(jpath, True)
            manifest = latest_manifest(spark, name)[1]
    return open_table(spark, manifest)


def read_code_list_csv(spark: SparkSession, path: str, table: str = "code_list") -> DataFrame:
    """Read a code list CSV with its declared schema (no inference)."""
    return spark.read.csv(path, header=True, schema=SCHEMAS[table])


def read_code_list(spark: SparkSession, path: str) -> DataFrame:
    """A code list from a CSV file (``.csv``, with its declared schema) or a Parquet table."""
    return read_code_list_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)


def write_report(df: DataFrame, out_dir: str, *, index: str, acute: int, chronic: int,
                 source: str, run_date: str, kind: str = "", single_file: bool = False) -> str:
    """Write a report as CSV named ``{date}_{index}[_kind]_acute{a}-chronic{c}_{source}``.

    The write is distributed (one file per output partition of a folder). With
    ``single_file`` the (few, aggregated) rows go through one task into one file
    of that name with ``.csv``, which replaces an earlier one.
    """
    stem = f"{run_date}_{index}{'_' + kind if kind else ''}_acute{acute}-chronic{chronic}_{source}"
    path = os.path.join(out_dir, stem)
    if not single_file:
        df.write.mode("overwrite").option("header", True).option("nullValue", "NA").csv(path)
        return path
    staged = f"{path}.{uuid.uuid4().hex}"
    # a report without rows still has its header line
    rows = df.coalesce(1)
    rows.write.option("header", True).option("nullValue", "NA").csv(staged)
    fs, folder = _fs(df.sparkSession, staged)
    part = next(st.getPath() for st in fs.listStatus(folder) if st.getPath().getName().startswith("part-"))
    target = _fs(df.sparkSession, f"{path}.csv")[1]
    fs.delete(target, False)
    fs.rename(part, target)
    fs.delete(folder, True)
    return f"{path}.csv"


def upload(spark: SparkSession, rows, table: str) -> DataFrame:
    """Client-side rows (e.g. a code list) as a DataFrame with the declared schema."""
    return spark.createDataFrame(rows, SCHEMAS[table])
