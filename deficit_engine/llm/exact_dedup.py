"""Exact deduplication through a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is hashed once,
reduced to one row per digest (partial aggregation runs before the shuffle, so
a text that fills a third of the rows arrives as one row per task), compared
with the index by a sort-merge anti-join, and what is new is appended.

Defined cases
  null text        counts as the empty text
  empty table      an empty index and an empty result
  equal texts      the row with the largest id stays; rows without an id lose
                   against any id, and a group of such rows alone keeps them
  repeated rows    rows with the same id and text each count in group_size and
                   share one decision
  other columns    are not read; any name may occur
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deficit_engine.llm.common import Scratch, ascii_lower, one_of_each, shuffle_partitions, spare_names
from deficit_engine.session import checkpoint_dir

# At most this many digests can each hold 1/HOT_SHARE of the rows or more.
HOT_SHARE = 1000


def text_digest(text: Column) -> Column:
    """SHA-256 (lower-case hex) of the normalised text."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


class DigestIndex:
    """Digests seen so far, with the id that represents each and its group size."""

    def __init__(self, spark: SparkSession, name: str, path: str | None = None,
                 buckets: int | None = None, temporary: bool = False):
        """``name``: catalog table; ``path``: its folder (the shared checkpoint
        folder when unset); ``buckets``: number of buckets, fixed for the
        table's life (the shuffle partitions when unset); ``temporary``: the
        catalog entry goes when the driver ends."""
        self.spark, self.name = spark, name
        self.path = path or f"{checkpoint_dir(spark)}/llm/{name}"
        self.buckets = buckets or shuffle_partitions(spark)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (digest STRING, keep_id BIGINT, group_size BIGINT) "
                  f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS "
                  f"LOCATION '{self.path}'")
        if temporary:
            atexit.register(self.drop)

    def drop(self) -> None:
        """Remove the catalog entry; the files at its path stay."""
        if self.spark.sparkContext._jsc is not None:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def table(self) -> DataFrame:
        """One row for each digest. Its rows lie in one bucket, so nothing is shuffled."""
        return _reduced(self.spark.table(self.name), F.max("keep_id"), F.sum("group_size"))

    def add(self, rows: DataFrame) -> DataFrame:
        """Append the digests of ``rows`` (id, digest) that the index lacks, and
        how often those that it has occur now.

        A digest already in the index keeps its representative.
        """
        groups = _reduced(rows, F.max("id"), F.count(F.lit(1)))
        known = self.spark.table(self.name).select("digest").distinct().hint("merge")
        fresh = groups.join(known, "digest", "left_anti")
        again = groups.join(known, "digest", "left_semi").withColumn("keep_id", F.lit(None).cast("long"))
        (fresh.unionByName(again).select("digest", "keep_id", "group_size")
         .repartition(self.buckets, "digest")
         .write.mode("append").format("parquet")
         .bucketBy(self.buckets, "digest").sortBy("digest")
         .option("path", self.path).saveAsTable(self.name))
        return self.table()


def _reduced(rows: DataFrame, keep_id: Column, size: Column) -> DataFrame:
    return rows.groupBy("digest").agg(keep_id.alias("keep_id"), size.alias("group_size"))


def mark_duplicates(docs: DataFrame, index: DigestIndex, *, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Add ``docs`` to the index and return one row per document:
    id, digest, keep_id, group_size, kept.

    ``group_size`` counts the rows of all batches so far. The digests that hold
    at least one row in ``HOT_SHARE`` of this batch are at most ``HOT_SHARE`` many,
    so they are joined by broadcast, however large the index; no other digest can
    make a partition large, and the rest meets the bucketed index in a
    sort-merge join.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "digests")
    rows = scratch.write(docs.select(F.col(id_col).cast("long").alias("id"),
                                     text_digest(F.col(text_col)).alias("digest")), "rows")
    found = index.add(rows)
    total = rows.count()
    here = _reduced(rows, F.max("id"), F.count(F.lit(1)))
    heavy = here.where((F.col("group_size") * F.lit(HOT_SHARE) >= F.lit(total)) & (F.col("group_size") > 1)).select("digest")
    hot = scratch.write(found.join(F.broadcast(heavy), "digest", "left_semi")
                        .select("digest", F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size")), "hot")
    tagged = rows.join(F.broadcast(hot), "digest", "left")
    of_hot = tagged.where(F.col("hot_size").isNotNull()).select(
        "id", "digest", F.col("hot_id").alias("keep_id"), F.col("hot_size").alias("group_size"))
    rest = (tagged.where(F.col("hot_size").isNull()).select("id", "digest")
            .join(found.hint("merge"), "digest"))
    both = of_hot.unionByName(rest.select("id", "digest", "keep_id", "group_size"))
    return both.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each distinct normalised text (largest id), columns unchanged.

    Of rows with the same text and id one stays, the least by all columns. Rows
    meet the index on digest and id together, which spreads even the largest
    group of copies; the same partitioning then serves to drop repeated rows.
    """
    spark = docs.sparkSession
    name = f"digest_index_{uuid.uuid4().hex}"
    index = DigestIndex(spark, name, Scratch(spark, "keep").path(name), temporary=True)
    row = lambda digest, i: F.xxhash64(digest, i.cast("long"))
    found = index.add(docs.select(F.col(id_col).cast("long").alias("id"), text_digest(F.col(text_col)).alias("digest")))
    own, own_row, digest, kept_row = spare_names(docs, "own", "row", "digest", "kept")
    kept = found.select(F.col("digest").alias(digest), row(F.col("digest"), F.col("keep_id")).alias(kept_row))
    marked = docs.withColumn(own, text_digest(F.col(text_col)))
    marked = marked.withColumn(own_row, row(F.col(own), F.col(id_col)))
    stays = marked.join(kept, (F.col(own) == F.col(digest)) & (F.col(own_row) == F.col(kept_row)), "left_semi")
    return one_of_each(stays, [own, own_row], docs)
