"""Sets of published report files, read back as tables.

Report files are named ``{date}_{index}[_{kind}]_acute{a}-chronic{c}_{source}``,
as a CSV file of that name or as a folder of part files. Reading a set takes
run date, index, kind, windows and source from the path that Spark gives with
every row, and columns from each file's own header, whatever their order or
case: older files have ``n`` where newer ones have ``N``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_COLUMNS = 16
NAME = r"(\d{4}-\d{2}-\d{2})_([a-z0-9]+)((?:_[a-z]+)*)_acute(\d+)-chronic(\d+)_([^/]+?)(?:\.csv)?(?:/[^/]*)?$"
RUN = ("run_date", "index_name", "kind", "acute", "chronic", "source")
BAND_COLUMNS = {"age_group": "string", "is_female": "int", "N": "long", "n_prefrail": "long", "n_frail": "long", "n_robust": "long",
                "prefrail": "double", "frail": "double", "robust": "double"}
CATEGORY_COLUMNS = {"age_group": "string", "is_female": "int", "category": "string", "N": "long", "count": "double", "percent": "double"}


def read_reports(spark: SparkSession, paths: str | Sequence[str], columns: dict[str, str], kinds: Sequence[str]) -> DataFrame:
    """Rows of all report files of some ``kinds`` below ``paths``: run_date, index_name,
    kind, acute, chronic, source, then ``columns`` (name: type). Files of other
    names are not reports; ``NA`` and empty fields are NULL. A file without one
    of the columns is an error."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    fields = ", ".join(f"c{k} string" for k in range(MOST_COLUMNS))
    lines = (spark.read.option("recursiveFileLookup", "true").text(paths)
             .select("value", F.col("_metadata.file_path").alias("file")))
    part = lambda k: F.regexp_extract("file", NAME, k)
    named = (lines.where(part(1) != "")
             .select("file", part(1).cast("date").alias("run_date"), part(2).alias("index_name"), F.ltrim(part(3), F.lit("_")).alias("kind"),
                     part(4).cast("int").alias("acute"), part(5).cast("int").alias("chronic"), part(6).alias("source"),
                     F.from_csv("value", fields).alias("v"))
             .where(F.col("kind").isin(list(kinds))))
    values = F.array(*[F.col(f"v.c{k}") for k in range(MOST_COLUMNS)])
    known = [c.lower() for c in columns]
    is_header = F.lower("v.c0").isin(known)
    # one header a file: a table of as many rows as there are files
    headers = (named.where(is_header).groupBy(F.col("file").alias("of"))
               .agg(F.first(F.transform(values, lambda x: F.lower(x))).alias("header")))
    rows = named.where(~F.coalesce(is_header, F.lit(False))).withColumn("values", values).join(headers, F.col("file") == F.col("of"))

    def column(name: str, kind: str):
        at = F.array_position("header", name.lower())
        missing = F.raise_error(F.concat(F.lit(f"no column {name} in "), "file"))
        text = F.when(at == 0, missing.cast("string")).otherwise(F.element_at("values", F.greatest(at, F.lit(1)).cast("int")))
        return F.when(~text.isin("NA", ""), text).cast(kind).alias(name)
    return rows.select(*RUN, *[column(c, k) for c, k in columns.items()])


def read_band_reports(spark: SparkSession, paths: str | Sequence[str], kinds: Sequence[str] = ("",)) -> DataFrame:
    """Band summaries (kind ``""``; ``meas`` for the measurement-extended ones)."""
    return read_reports(spark, paths, BAND_COLUMNS, kinds)


def read_category_reports(spark: SparkSession, paths: str | Sequence[str], kinds: Sequence[str] = ("categories",)) -> DataFrame:
    """Category tables."""
    return read_reports(spark, paths, CATEGORY_COLUMNS, kinds)


def pooled_bands(bands: DataFrame) -> DataFrame:
    """Per run, over all strata: N and the shares of the three bands."""
    n = F.sum("N")
    return bands.groupBy(*RUN).agg(n.alias("N"), *[(F.sum(f"n_{b}") / n).alias(b) for b in ("robust", "prefrail", "frail")])


def pooled_categories(tables: DataFrame) -> DataFrame:
    """Per run and category, over all strata: N, count and percent."""
    n = F.sum("N")
    return tables.groupBy(*RUN, "category").agg(n.alias("N"), F.sum("count").alias("count"), (F.sum("count") / n).alias("percent"))
