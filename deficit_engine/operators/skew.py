"""Joins of a large, possibly skewed side with a one-row-per-key side.

There is one plan, whatever the sizes. The join is a plain equi-join: the
optimizer and AQE broadcast the small side when its bytes allow it, and
otherwise AQE cuts an oversized shuffle partition of the large side into
pieces, however many keys are hot. AQE only does so when nothing above the
join relies on its partitioning, so rows that are aggregated or deduplicated
per key afterwards are redistributed on a finer key first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

TASK_ROWS = 250_000     # rows of a task that keeps them all in memory, about


def redistribute(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash ``rows`` on ``keys`` (finer than the join key below): lets AQE split
    that join, and is the partitioning of the aggregates that follow."""
    return rows.repartition(*keys)


def task_count(spark: SparkSession, rows: int, per_task: int | None = None) -> int:
    """Partitions for ``rows`` that are sorted or aggregated whole: as many as
    shuffles have, more for many rows. AQE never makes more partitions than
    shuffles start with, so without this a task grows with the input and spills."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / (per_task or TASK_ROWS)))
