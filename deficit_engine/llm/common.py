"""Helpers shared by the corpus operators: table access, scratch tables, row numbers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deficit_engine.session import checkpoint_dir

# Fixed values of the normalisation: only these letters change case.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# A word is a run of characters other than space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def word_count(col: Column) -> Column:
    """Number of words in a text; null counts as empty."""
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(WORD)).cast("long")


# Spark's setting that deletes the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that
    they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(), f"{package.name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def spare_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that ``df`` does not use, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        free = f"__{name}"
        while free.lower() in taken:
            free += "_"
        taken.add(free.lower())
        out.append(free)
    return out


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def one_of_each(df: DataFrame, keys: list[str], keep: DataFrame) -> DataFrame:
    """One row for each value of ``keys``, with the columns of ``keep``: the least
    by its other columns written as JSON, so that reruns choose alike."""
    columns = own_columns(keep)
    order, row = spare_names(df, "order", "chosen")
    least = df.withColumn(order, F.to_json(F.struct(*columns)))
    return (least.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.min_by(F.struct(*columns), F.col(order)).alias(row))
            .select(*[F.col(row)[c].alias(c) for c in keep.columns]))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """Written tables in the shared folder of ``spark.checkpoint.dir``.

    A table cuts lineage: what reads it is recomputed from the written files
    when an executor is lost. ``drop`` removes a table that nothing reads any
    more; what a lazy result still reads goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
        fs, path = self._fs(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _fs(self, path: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write and read back. What reads the table needs none of the shuffle
        files that its writing took, so Spark is told to delete them then."""
        conf = self.spark.conf
        before = conf.get(CLEANUP)
        conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(self.path(name))
        finally:
            conf.set(CLEANUP, before)
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(schema) if schema is not None else reader).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            fs, path = self._fs(self.path(name))
            fs.delete(path, True)
