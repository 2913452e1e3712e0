"""Connected components by contraction; nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deficit_engine.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is the
    least node. Each round sends every node to the least of its neighbourhood
    and keeps the edges between different targets, so at least half of the
    nodes go; the rounds' maps are composed from the last to the first.

    A node with many edges is reduced by partial aggregation, and its edges
    meet its target in a many-to-one join that can be split.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()
    current = scratch.write(both, f"{name}_edges0")
    maps: list[DataFrame] = []
    while current.limit(1).count():
        k = len(maps)
        step = scratch.write(current.groupBy("u").agg(F.min("v").alias("v"))
                             .select(F.col("u").alias("node"), F.least("u", "v").alias("to")), f"{name}_map{k}")
        maps.append(step)
        left = step.select(F.col("node").alias("u"), F.col("to").alias("tu"))
        right = step.select(F.col("node").alias("v"), F.col("to").alias("tv"))
        current = scratch.write(current.join(left, "u").join(right, "v").where("tu <> tv")
                                .select(F.col("tu").alias("u"), F.col("tv").alias("v")).distinct(), f"{name}_edges{k + 1}")
        scratch.drop(f"{name}_edges{k}")
    if not maps:
        return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    # no edge is left between targets of the last round, so they are components
    out = maps[-1]
    for step in reversed(maps[:-1]):
        out = _follow(step, out)
    return scratch.write(out.select("node", F.col("to").alias("component")), f"{name}_components")


def _follow(step: DataFrame, further: DataFrame) -> DataFrame:
    """Targets of ``step`` replaced by their own targets in ``further``."""
    ends = further.select(F.col("node").alias("to"), F.col("to").alias("end"))
    return step.join(ends, "to", "left").select("node", F.coalesce("end", "to").alias("to"))
