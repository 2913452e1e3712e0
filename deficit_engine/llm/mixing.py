"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies,
target / source size. The whole part is taken outright; the fractions are
rounded by duels: two documents exchange words in a random direction (odds
such that both expectations hold) until one of them is at 0 or 1 copy, and the
other carries the residual on. A duel keeps the sum of the words that the two
are expected to give, so a source ends within half of its last document's
size of its target.

The duels form a reduction tree. Leaves are groups of about ``FAN_IN``
documents chosen by hash; each group folds to one contender, and the
contenders fold again, ``FAN_IN`` at a time, until each source has one. No task
sees more than a few groups, whatever a source's share. Random numbers are
hashes of the seed and the two documents, so reruns and retried tasks agree.

Defined cases
  null text, no words    size 0, taken 0
  null source            a source of its own, last in the order
  repeated rows          equal (source, id, size) rows form one unit, whose
                         copies are dealt out evenly over its rows
  empty table            an empty result
  other columns          are not read
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deficit_engine.llm.common import Scratch, own_columns, spare_names, word_count

FAN_IN = 32
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SPANS = 1024


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE,
                   cap: float = CAP) -> DataFrame:
    """Targets of all sources: (src, source_size, n_units, target).

    ``sizes`` has src, source_size and n_units, one row per source. Sources in
    code-point order (null last) weigh ``weights`` in turn. Filling sources by
    weight until none exceeds ``cap`` times its size caps exactly those whose
    size per weight is small: with sources in order of size / weight, the
    first k are capped, and the rest shares what is left by weight.
    """
    by_name = Window.orderBy(F.col("src").asc_nulls_last())
    ws = F.array(*[F.lit(float(w)) for w in weights])
    d = sizes.withColumn("w", F.element_at(ws, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), F.col("src").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    d = (d.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
         .withColumn("all_w", F.sum("w").over(everything))
         .withColumn("left", F.col("total") - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
         .withColumn("left_w", F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
         .withColumn("capped", F.col("left") * F.col("w") / F.col("left_w") >= F.lit(cap) * F.col("source_size")))
    # the first source in this order that is not capped fixes the words per weight of all that follow
    d = d.withColumn("level", F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("w"),
                                                                     (F.col("left") / F.col("left_w")).alias("v")))).over(everything)["v"])
    return d.select("src", "source_size", "n_units",
                    F.when(F.col("capped") | F.col("level").isNull(), F.lit(cap) * F.col("source_size"))
                    .otherwise(F.col("level") * F.col("w")).cast("double").alias("target"))


def _uniform(seed: int, a: Column, b: Column) -> Column:
    h = F.xxhash64(F.lit(seed), a["doc_id"], a["size"], b["doc_id"], b["size"])
    return F.pmod(h, F.lit(1 << 52)) / F.lit(float(1 << 52))


def _duel(seed: int, state: Column, new: Column) -> Column:
    """One duel between the contender of ``state`` and ``new``."""
    old = state["contender"]
    up = F.least((1 - old["p"]) * old["size"], new["p"] * new["size"])
    down = F.least(old["p"] * old["size"], (1 - new["p"]) * new["size"])
    rises = _uniform(seed, old, new) * (up + down) < down
    old_ends = F.when(rises, (1 - old["p"]) * old["size"] <= new["p"] * new["size"]) \
        .otherwise(old["p"] * old["size"] <= (1 - new["p"]) * new["size"])
    moved = F.when(rises, up).otherwise(-down)
    ended = F.when(old_ends, old.withField("p", F.when(rises, F.lit(1.0)).otherwise(F.lit(0.0)))) \
        .otherwise(new.withField("p", F.when(rises, F.lit(0.0)).otherwise(F.lit(1.0))))
    stays = F.when(old_ends, new.withField("p", new["p"] - moved / new["size"])) \
        .otherwise(old.withField("p", old["p"] + moved / old["size"]))
    return F.struct(stays.alias("contender"),
                    F.concat(state["done"], F.array(ended)).alias("done"))


def _fold(units: DataFrame, seed: int) -> DataFrame:
    """One level of the tree: (src, leaf, units) to the contender and those decided."""
    folded = F.aggregate(
        F.slice("members", 2, F.size("members")),
        F.struct(F.element_at("members", 1).alias("contender"),
                 F.slice("members", 1, 0).alias("done")),
        lambda state, new: _duel(seed, state, new))
    return (units.groupBy("src", "leaf").agg(F.collect_list("unit").alias("members"))
            .withColumn("members", F.array_sort("members"))
            .select("src", "leaf", folded.alias("f"))
            .select("src", "leaf", F.col("f.contender").alias("contender"), F.col("f.done").alias("done")))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", seed: int = 7, weights=WEIGHTS, share: float = SHARE,
        cap: float = CAP, fan_in: int = FAN_IN) -> DataFrame:
    """Copies that the mix takes of each document.

    Returns one row per row of ``docs``: doc_id, source, size, source_size,
    target, copies, taken (words, repeats counted).
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    units = scratch.write(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("src"),
                    word_count(F.col(text_col)).alias("size"))
        .groupBy("src", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")), "units")
    sizes = units.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"),
                                     F.count(F.lit(1)).alias("n_units"))
    targets = scratch.write(source_targets(sizes, weights, share, cap), "targets")
    named = targets.withColumnRenamed("src", "to")
    # with the whole part of the expected copies taken, the rest is what the duels decide
    expected = F.col("n") * F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    frame = (units.join(named, F.col("src").eqNullSafe(F.col("to")))
             .withColumn("whole", F.floor(expected).cast("long"))
             .withColumn("p", expected - F.col("whole"))
             .withColumn("leaf", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"),
                                        F.ceil(F.col("n_units") / F.lit(fan_in)).cast("long"))))
    unit = F.struct((-F.col("size")).alias("order"), F.xxhash64(F.lit(seed), "doc_id").alias("draw"),
                    "doc_id", "size", "n", "whole", "p")
    open_units = (F.col("p") > 0) & (F.col("size") > 0)
    settled = frame.where(~open_units).select("src", unit.withField("p", F.lit(0.0)).alias("unit"))
    level = scratch.write(_fold(frame.where(open_units).select("src", "leaf", unit.alias("unit")), seed), "level0")
    leaves = targets.agg(F.max(F.ceil(F.col("n_units") / F.lit(fan_in)))).first()[0] or 0
    parts, depth = [settled], 0
    while leaves > 1:
        parts.append(level.select("src", F.explode("done").alias("unit")))
        depth, leaves = depth + 1, -(-leaves // fan_in)
        level = scratch.write(
            _fold(level.select("src", F.floor(F.col("leaf") / F.lit(fan_in)).cast("long").alias("leaf"),
                               F.col("contender").alias("unit")), seed + depth), f"level{depth}")
    parts.append(level.select("src", F.explode("done").alias("unit")))
    # the residual of a source goes to the nearer whole number
    last = F.col("contender")
    parts.append(level.select("src", last.withField("p", F.when(last["p"] >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0))).alias("unit")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = (out.select("src", "unit.*")
           .withColumn("c", F.col("whole") + F.col("p").cast("long"))
           .select("src", "doc_id", "size", "n", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
           .withColumn("copies", F.floor(F.col("c") / F.col("n")).cast("long")
                       + (F.col("j") < F.col("c") % F.col("n")).cast("long")))
    return (out.join(named, F.col("src").eqNullSafe(F.col("to")))
            .select("doc_id", F.col("src").alias("source"), "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def take(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as the mix takes it, columns unchanged.

    Copies belong to the units that ``mix`` decides, equal (source, id, size)
    with null equal to null, and are dealt out evenly over the rows of a unit.
    """
    scratch = Scratch(docs.sparkSession, "taking")
    # the columns of the mix that travel with the rows get names that the rows don't use
    (src, own_id, size, c, n, hashed, span, span_rows, start, rank, span_of, copies, copy, *unit_of) = spare_names(
        docs, "src", "id", "size", "c", "n", "hash", "span", "rows", "start", "rank", "span_of", "copies", "copy", "src_of", "id_of", "size_of")
    mixed = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **kw)
    counts = scratch.write(
        mixed.groupBy(F.col("source").alias(src), F.col("doc_id").alias(own_id), F.col("size").alias(size))
        .agg(F.sum("copies").alias(c), F.count(F.lit(1)).alias(n)).where(F.col(c) > 0), "counts")
    # mostly few or none, so that the texts need not move for them
    shared = scratch.write(counts.where(F.col(n) > 1), "shared")

    def rows_of(units: DataFrame) -> DataFrame:
        return docs.join(units, F.col(source_col).cast("string").eqNullSafe(F.col(src))
                         & F.col(id_col).cast("long").eqNullSafe(F.col(own_id))
                         & word_count(F.col(text_col)).eqNullSafe(F.col(size)))

    # rows of a unit are numbered by hash spans, so that a large unit is not sorted in one task
    content = [column for column, (_, kind) in zip(own_columns(docs), docs.dtypes) if "map<" not in kind and "variant" not in kind]
    many = rows_of(shared).withColumn(hashed, F.xxhash64(*content)).withColumn(span, F.pmod(hashed, F.lit(SPANS)))
    unit = [src, own_id, size]
    spans = many.groupBy(*unit, span).agg(F.count(F.lit(1)).alias(span_rows))
    before = Window.partitionBy(*unit).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.select(*[F.col(u).alias(o) for u, o in zip(unit, unit_of)], F.col(span).alias(span_of),
                          F.coalesce(F.sum(span_rows).over(before), F.lit(0)).alias(start))
    ranked = many.withColumn(rank, F.row_number().over(Window.partitionBy(*unit, span).orderBy(hashed)) - 1)
    same = F.col(span) == F.col(span_of)
    for u, o in zip(unit, unit_of):
        same = same & F.col(u).eqNullSafe(F.col(o))
    dealt = (ranked.join(starts, same)
             .withColumn(copies, F.floor(F.col(c) / F.col(n)).cast("long")
                         + (F.col(start) + F.col(rank) < F.col(c) % F.col(n)).cast("long"))
             .where(F.col(copies) > 0))
    single = rows_of(counts.where(F.col(n) == 1)).withColumn(copies, F.col(c))
    every = single.select(*own_columns(docs), copies).unionByName(dealt.select(*own_columns(docs), copies))
    return every.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*own_columns(docs))
