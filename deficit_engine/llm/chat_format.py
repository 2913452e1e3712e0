"""Conversations without quotations, linked in reply order.

Lines of a message that begin with ``>`` marks quote other messages; the
number of marks is the nesting level. Neighbouring lines of one level are a
passage; its white space is folded across the lines, so another line width
makes no difference, and it is hashed. A quoted passage is linked to the latest
earlier message of the conversation that holds the same passage one level
lower. Of a quoted passage that no message holds whole, each line is linked
alike, and weighs the less the more messages hold it.

A message replies to the message that its level-1 passages quote with most
lines; if none of them is held whole, to the one with the greatest weight of
lines; the later one on a tie. Following those links gives the thread. The
quoted lines are then removed.

Whoever holds a passage before a turn is found in spans of turns: inside the
span, and by the latest holder of each span before it. So a passage that stands
in a third of all messages makes no pairs and no group larger than a span.

Defined cases
  null or empty text     no lines, clean text empty
  null conversation,     the message is kept and numbered, but neither
  null turn              quotes nor is quoted
  quotes of later text   not a link; the quote is removed all the same
  very long text         its passages are cut out in time linear in the text
  repeated rows          kept; numbered one after the other
  empty table            an empty result
  other columns          are not read
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deficit_engine.llm.common import Scratch

_MARKS = r"^(?:[ \t]*>)+"
SPAN = 1024             # turns
RARITY = 1_000_000      # weight of a line that one message holds


def _lines(text: Column) -> Column:
    """Array of (level, body, line) of a text; body is normalised."""
    def one(line):
        marks = F.regexp_extract(line, _MARKS, 0)
        body = F.regexp_replace(line, _MARKS, "")
        return F.struct((F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))).alias("level"),
                        F.trim(F.regexp_replace(F.lower(body), r"[ \t\r]+", " ")).alias("body"),
                        line.alias("line"))
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), one)


def _passages(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Passages of (conv_id, turn, text): conv_id, turn, level, hash, bodies (of
    its lines, in order). Lines are numbered inside their message; those of one
    level that follow each other keep the same distance to their rank."""
    told = rows.withColumn("message", F.monotonically_increasing_id())
    lines = scratch.write(told.select("conv_id", "turn", "message", F.posexplode(_lines(F.col("text"))).alias("at", "l"))
                          .select("conv_id", "turn", "message", "at", "l.level", "l.body"), "lines")
    rank = F.row_number().over(Window.partitionBy("message", "level").orderBy("at"))
    return (lines.withColumn("passage", F.col("at") - rank).where(F.col("body") != "")
            .groupBy("message", "level", "passage", "conv_id", "turn")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "body"))), lambda x: x["body"]).alias("bodies"))
            .select("conv_id", "turn", "level", F.md5(F.array_join("bodies", " ")).alias("hash"), "bodies"))


def _latest_holder(quotes: DataFrame, originals: DataFrame) -> DataFrame:
    """``quotes`` (conv_id, turn, level, hash) that a message before their turn
    holds one level lower, with the latest of these turns as ``held``."""
    key = ["conv_id", "hash", "level"]
    held = originals.select("conv_id", "hash", (F.col("level") + 1).alias("level"), "turn", F.col("turn").alias("holder"))
    asked = quotes.select(*key, "turn", F.lit(None).cast("long").alias("holder"))
    both = held.unionByName(asked).distinct().withColumn("span", F.floor(F.col("turn") / SPAN))
    inside = Window.partitionBy(*key, "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("held", F.max("holder").over(inside)).where(F.col("holder").isNull()).drop("holder")
    before = Window.partitionBy(*key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    far = both.groupBy(*key, "span").agg(F.max("holder").alias("last")).withColumn("far", F.max("last").over(before)).drop("last")
    return (near.join(far, [*key, "span"]).withColumn("held", F.coalesce("held", "far"))
            .where(F.col("held").isNotNull()).select(*key, "turn", "held"))


def _position(rows: DataFrame) -> DataFrame:
    """Number the messages of a conversation by turn, without sorting one
    conversation in one task: counts of turn spans first, then ranks within a span."""
    rows = rows.withColumn("span", F.floor(F.col("turn") / SPAN))
    spans = rows.groupBy("conv_id", "span").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy(F.col("span").asc_nulls_first()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.select(F.col("conv_id").alias("c"), F.col("span").alias("s"),
                          F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("conv_id", "span").orderBy(
        F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    ranked = rows.withColumn("rank", F.row_number().over(own))
    return ranked.join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("span").eqNullSafe(F.col("s"))) \
        .withColumn("position", (F.col("start") + F.col("rank")).cast("long"))


def _threads(scratch: Scratch, links: DataFrame) -> DataFrame:
    """Root and depth of every linked message by pointer doubling over the
    links (conv_id, turn, up, hops); a parent has a smaller turn, so there are no cycles."""
    links, step = scratch.write(links, "links0"), 0
    while True:
        above = links.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"),
                             F.col("up").alias("further"), F.col("hops").alias("more"))
        open_links = links.join(above, (F.col("conv_id") == F.col("c")) & (F.col("up") == F.col("t")), "left")
        step += 1
        links = scratch.write(open_links.select(
            "conv_id", "turn", F.coalesce("further", "up").alias("up"),
            (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"),
            F.col("further").isNotNull().alias("moved")), f"links{step}")
        moved = links.where("moved").limit(1).count()
        scratch.drop(f"links{step - 1}")
        links = links.drop("moved")
        if not moved:
            return links


def link_quotations(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn",
                    role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv_id, position, turn, role, clean_text,
    quoted_lines, quote_depth, linked_lines, reply_to, thread_root, reply_depth.

    ``position`` numbers the messages of a conversation from 1; parents come
    before their replies. ``linked_lines`` counts the quoted lines (any level)
    whose original was found.
    """
    scratch = Scratch(conversations.sparkSession, "chat")
    base = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = base.withColumn("lines", _lines(F.col("text")))
    told = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    passages = scratch.write(_passages(base.where(told).select("conv_id", "turn", "text"), scratch), "passages")
    quoted = passages.where("level > 0")
    key = ["conv_id", "turn", "level", "hash"]
    whole = scratch.write(_latest_holder(quoted.select(*key), passages.select(*key)), "whole")
    lines = passages.select("conv_id", "turn", "level", F.explode("bodies").alias("body")).select("conv_id", "turn", "level", F.md5("body").alias("hash"))
    # lines of the passages that nobody holds whole
    loose = (quoted.join(whole.select(*key), key, "left_anti").select("conv_id", "turn", "level", F.explode("bodies").alias("body"))
             .groupBy("conv_id", "turn", "level", F.md5("body").alias("hash")).agg(F.count(F.lit(1)).alias("n")))
    loose = scratch.write(loose, "loose")
    holders = (lines.join(loose.select("conv_id", "hash", (F.col("level") - 1).alias("level")).distinct(), ["conv_id", "hash", "level"], "left_semi")
               .distinct())
    holders = scratch.write(holders, "holders")
    rarity = (holders.groupBy("conv_id", "hash", (F.col("level") + 1).alias("level"))
              .agg(F.expr(f"{RARITY} div count(1)").alias("weight")))
    single = _latest_holder(loose.select(*key), holders).join(loose, key).join(rarity, ["conv_id", "hash", "level"])
    found = scratch.write(
        whole.join(quoted, key).select("conv_id", "turn", "level", "held", F.size("bodies").cast("long").alias("n"), F.lit(1).alias("kind"),
                                       F.size("bodies").cast("long").alias("vote"))
        .unionByName(single.select("conv_id", "turn", "level", "held", "n", F.lit(0).alias("kind"), (F.col("n") * F.col("weight")).alias("vote")))
        .groupBy("conv_id", "turn", "level", "held", "kind").agg(F.sum("n").alias("n"), F.sum("vote").alias("vote")), "found")
    # whole passages go before lines
    parents = (found.where("level = 1").groupBy("conv_id", "turn")
               .agg(F.max(F.struct("kind", "vote", "held"))["held"].alias("up")))
    linked = found.groupBy("conv_id", "turn").agg(F.sum("n").alias("linked_lines"))
    threads = _threads(scratch, parents.withColumn("hops", F.lit(1)))
    marks = (linked.join(parents, ["conv_id", "turn"], "left")
             .join(threads.withColumnRenamed("up", "root"), ["conv_id", "turn"], "left")
             .withColumnsRenamed({"conv_id": "lc", "turn": "lt"}))
    kept = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    shaped = rows.select(
        "conv_id", "turn", "role", "text", F.trim(kept, F.lit(" \n\r\t")).alias("clean_text"),
        F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("quoted_lines"),
        F.array_max(F.transform("lines", lambda x: x["level"])).cast("long").alias("quote_depth"))
    out = _position(shaped).join(marks, (F.col("conv_id") == F.col("lc")) & (F.col("turn") == F.col("lt")), "left")
    return out.select("conv_id", "position", "turn", "role", "clean_text", "quoted_lines", "quote_depth",
                      F.coalesce("linked_lines", F.lit(0)).cast("long").alias("linked_lines"),
                      F.col("up").alias("reply_to"), F.coalesce("root", "turn").alias("thread_root"),
                      F.coalesce("hops", F.lit(0)).cast("long").alias("reply_depth"))
