"""Exact Jaccard join of documents over word shingles, in metric space.

1 - Jaccard is a metric. Documents that share no shingle are all at distance 1
from each other, where no pivot tells them apart, so the space is first cut
into clusters that no link crosses:
  1. Equal shingle sets become one node.
  2. |x ^ y| <= (1-t)/(1+t) * (|x|+|y|) for a link. The empty set serves as the
     first pivot: documents fall into rings of set size, and those near a
     ring's lower edge are replicated into it. In a ring a set is cut into
     more buckets (by shingle hash) than a link may have differing ones, k;
     the contents of a bucket are hashed to a key. A document with N filled
     buckets shares at least N - k keys with any partner, so one with fewer
     recurring keys is out. The rest, joined by shared keys, forms clusters.
     A large cluster is cut again by whole shingles: linked sets share one of
     the shingles that are left in each when its most frequent ones, one less
     than a partner must share, are set aside.
  3. In a cluster the document whose keys recur most is the pivot p. Whoever is
     within the radius r = 1-t of p is linked to it, and pairs of those need no
     further look. A pair x, y beyond it is possible only in the window
     |d(x,p) - d(y,p)| <= r.
  4. A large cluster with documents beyond the radius gets more pivots. Each
     document's home is the region of its nearest pivot; it is replicated into
     every region whose pivot is at most 2r farther, so each region holds all
     partners of its own documents.
  5. Regions are joined exactly: their documents beyond the radius against all
     in the region, in blocks, each block recursively split by pivots of its
     own down to small sets that are counted directly.
Links are kept as stars and forests, which preserve the components; copies and
members of one ball are never expanded into pairs.

Defined cases
  null text, no words    an empty set, linked with nothing
  fewer words than a shingle   the whole sequence is the only shingle
  null id                linked like any other; does not name a component
                         unless all of it lacks ids
  repeated rows          rows of one component
  empty table            an empty result
  other columns          are not read
Sets and shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deficit_engine.llm.common import Scratch, one_of_each, ship_package, spare_names
from deficit_engine.llm.components import components
from deficit_engine.llm.substring_dedup import gram_hashes, hold_words, word_hashes
from deficit_engine.llm.units import hold_caches, text_slices

RING = 1.5              # ratio of a ring's edges
SLACK = 1.15            # buckets per bucket that must agree
REGION = 1600           # nodes of a block, and of a region that is not split further
REGION_SHINGLES = 1_600_000
PIVOTS = 6
SMALL = 48              # members that are counted directly
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Rule:
    """Shingle width and the least similarity, as percent / 100 in whole numbers."""

    def __init__(self, width: int, percent: int):
        if not 50 <= percent <= 100 or width < 1:
            raise ValueError("similarity must be 50 to 100 percent, the width at least 1")
        self.width, self.percent = width, percent
        self.radius = 1 - percent / 100
        ratio = max(RING, 100 / percent)
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, math.ceil(edges[-1] * ratio)))
        self.edges = edges

    def linked(self, common: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return 100 * common >= self.percent * (n + m - common)

    def shared(self, n: int) -> int:
        """Fewest shingles that a set of size n shares with a partner."""
        return -(-self.percent * n // 100)

    def differing(self, ring: int) -> int:
        """Most shingles in which two linked sets of a ring can differ."""
        return (100 - self.percent) * 2 * (self.edges[ring + 1] - 1) // (100 + self.percent)

    def rings(self, n: int) -> list[int]:
        """The ring of a set's size, and the next one if a partner may be in it."""
        own = int(np.searchsorted(self.edges, n, "right")) - 1
        return [own, own + 1] if 100 * n >= self.percent * self.edges[own + 1] else [own]

    def keys(self, s: np.ndarray) -> list[tuple[int, list[int]]]:
        """For each ring of a set: how many of its keys must recur, and the keys."""
        out = []
        for ring in self.rings(len(s)) if len(s) else []:
            k = self.differing(ring)
            if not k:
                continue  # only equal sets are linked here
            buckets = math.ceil(SLACK * (k + 1)) + 1
            at = (s >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(at, kind="stable")
            at = at[order]
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            content = np.add.reduceat((s[order] ^ (s[order] >> np.uint64(31))) * _MIX, starts)
            content = (content ^ (content >> np.uint64(29))) * _MIX + at[starts] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(ring)
            found = (content ^ (content >> np.uint64(32))).astype(np.int64).tolist()
            if len(found) <= k:  # partners with as few filled buckets may share none; they meet here
                found.append(-ring - 1)
            out.append((max(1, len(starts) - k), found))
        return out


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, A-Z lower-cased."""
    words = (text or "").encode().lower().split()  # of bytes, lower() and split() know ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(gram_hashes(word_hashes(words), min(width, len(words))) * _MIX + np.uint64(min(width, len(words))))


def _describe(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_words()
        for batch in batches:
            for part in text_slices(batch, "text"):
                sizes, nodes, rings = [], [], []
                for text in part.column("text").to_pylist():
                    s = shingles(text, rule.width)
                    sizes.append(len(s))
                    nodes.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None)
                    rings.append([{"need": need, "keys": keys} for need, keys in rule.keys(s)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("rid"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                     pa.array(rings, pa.list_(pa.struct([("need", pa.int32()), ("keys", pa.list_(pa.int64()))])))],
                    ["doc_id", "rid", "n_shingles", "node", "rings"])
    return run


def _sets(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_words()
        for batch in batches:
            for part in text_slices(batch, "text"):
                sets = [shingles(t, rule.width).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("cluster"), part.column("weight"), pa.array(sets, pa.binary())],
                                                 ["node", "cluster", "weight", "set"])
    return run


def _set_shingles(rule: Rule):
    """One row per shingle of a set, with the number of them that a partner must share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_caches("blocks")
        for batch in batches:
            for node, own in zip(batch.column("node").to_pylist(), batch.column("set").to_pylist()):
                s = np.frombuffer(own, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(s), node, np.int64)), pa.array(np.full(len(s), rule.shared(len(s)), np.int32)), pa.array(s)],
                    ["node", "need", "shingle"])
    return run


def common_counts(a: np.ndarray, values: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """|a & z| for n sets z, given by all their sorted values and whose each is."""
    low, high = np.searchsorted(values, a, "left"), np.searchsorted(values, a, "right")
    counts = high - low
    ends = np.cumsum(counts)
    if not len(ends) or not ends[-1]:
        return np.zeros(n, np.int64)
    return np.bincount(owners[np.repeat(low - (ends - counts), counts) + np.arange(ends[-1])], minlength=n)


def _postings(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    values = np.concatenate(sets)
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    return values[order], owners[order]


def join_block(rule: Rule, rim: list[np.ndarray], all_sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """All linked pairs (index in rim, index in all_sets), found by splitting
    into regions around pivots as long as the regions get smaller."""
    yield from _join(rule, rim, all_sets, np.arange(len(rim)), np.arange(len(all_sets)), 0)


def _join(rule: Rule, rim, every, a: np.ndarray, z: np.ndarray, depth: int) -> Iterator[tuple[int, int]]:
    sizes = np.array([len(every[i]) for i in z])
    if len(z) > SMALL and len(a) > 1 and depth < 8:
        pivots = [rim[i] for i in a[np.linspace(0, len(a) - 1, min(PIVOTS, len(a))).astype(int)]]
        far_z = _distances(every, z, pivots)
        far_a = _distances(rim, a, pivots)
        home = far_a.argmin(1)
        # the whole window of a region: partners of home documents are at most the radius farther from its pivot
        regions = []
        for j in range(len(pivots)):
            mine = np.flatnonzero(home == j)
            if len(mine):
                lo, hi = far_a[mine, j].min() - rule.radius - 1e-9, far_a[mine, j].max() + rule.radius + 1e-9
                regions.append((a[mine], z[(far_z[:, j] >= lo) & (far_z[:, j] <= hi)]))
        if sum(len(x) * len(y) for x, y in regions) < 0.7 * len(a) * len(z):
            for x, y in regions:
                if len(y):
                    yield from _join(rule, rim, every, x, y, depth + 1)
            return
    if not len(z):
        return
    values, owners = _postings([every[i] for i in z])
    for i in a:
        common = common_counts(rim[i], values, owners, len(z))
        for j in np.flatnonzero(rule.linked(common, len(rim[i]), sizes)):
            yield int(i), int(z[j])


def _distances(sets, rows: np.ndarray, pivots: list[np.ndarray]) -> np.ndarray:
    sizes = np.array([len(sets[i]) for i in rows])
    values, owners = _postings([sets[i] for i in rows])
    out = np.empty((len(rows), len(pivots)))
    for j, p in enumerate(pivots):
        common = common_counts(p, values, owners, len(rows))
        out[:, j] = 1 - common / (sizes + len(p) - common)
    return out


class Forest:
    """Union-find: only links that join something are kept."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _measure(rule: Rule):
    """Distances of a row's set to its cluster's pivots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_caches("blocks")
        for batch in batches:
            near, linked = [], []
            for own, pivots in zip(batch.column("set").to_pylist(), batch.column("pivots").to_pylist()):
                s = np.frombuffer(own, np.uint64)
                far, hit = [], []
                for p in pivots:
                    q = np.frombuffer(p["set"], np.uint64)
                    common = len(np.intersect1d(s, q, assume_unique=True))
                    far.append(1 - common / (len(s) + len(q) - common))
                    hit.append(bool(rule.linked(common, len(s), len(q))))
                near.append(far)
                linked.append(hit)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("node", "region", "set")),
                 pa.array([[p["node"] for p in x] for x in batch.column("pivots").to_pylist()], pa.list_(pa.int64())),
                 pa.array(near, pa.list_(pa.float64())), pa.array(linked, pa.list_(pa.bool_()))],
                ["node", "region", "set", "to", "far", "hit"])
    return run


MEASURED = "node long, region long, set binary, to array<long>, far array<double>, hit array<boolean>"


def _blocks(rule: Rule):
    def run(group: pa.Table) -> pa.Table:
        hold_caches("blocks")
        rows = group.select(["node", "rim", "far", "set"]).to_pylist()
        rim, every = [r for r in rows if r["rim"]], [r for r in rows if not r["rim"]]
        forest, out = Forest(), []
        a, z = ([np.frombuffer(r["set"], np.uint64) for r in x] for x in (rim, every))
        for i, j in join_block(rule, a, z):
            x, y = rim[i]["node"], every[j]["node"]
            if forest.join(x, y):
                out.append((x, y))
        return pa.table({"u": pa.array([x for x, _ in out], pa.int64()), "v": pa.array([y for _, y in out], pa.int64())})
    return run


def _with_pivots(rows: DataFrame, pivots: DataFrame, rule: Rule) -> DataFrame:
    """Rows (node, region, set) with distances to the pivots (region, pivots) of their region."""
    return rows.join(pivots, "region").select("node", "region", "set", "pivots").mapInArrow(_measure(rule), MEASURED)


def _cut_clusters(members: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """``members`` with every cluster that is too large for one region cut into
    finer ones; nodes that can have no partner go.

    With the shingles of a set in order of their frequency in the large clusters,
    a partner shares ``need`` of them, so the rarest shared one stands before the
    last need - 1 of both sets. Nodes meet in those shingles alone."""
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("set") / 8).alias("weight"))
    # each of these clusters has a share of the nodes or of the shingles, so they are few
    large = scratch.write(sizes.where((F.col("n") > REGION) | (F.col("weight") > REGION_SHINGLES)).select("cluster"), "large")
    if not large.limit(1).count():
        return members
    rows = (members.join(F.broadcast(large), "cluster").select("node", "set")
            .mapInArrow(_set_shingles(rule), "node long, need int, shingle long"))
    often = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # shingles of one node alone are its rarest, so ranks from the most frequent one down need only the others
    down = Window.partitionBy("node").orderBy(F.desc("n"), F.desc("shingle"))
    rare = scratch.write(rows.join(often, "shingle").withColumn("place", F.row_number().over(down)).where("place >= need")
                         .select("node", "shingle"), "rare")
    met = rare.groupBy("shingle").agg(F.min("node").alias("lo"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = rare.join(met, "shingle").select(F.col("node").alias("u"), F.col("lo").alias("v"))
    finer = components(edges, scratch, "finer")
    cut = (members.join(F.broadcast(large), "cluster").drop("cluster")
           .join(finer.withColumnRenamed("component", "cluster"), "node").select(members.columns))
    out = scratch.write(members.join(F.broadcast(large), "cluster", "left_anti").select(members.columns).unionByName(cut), "cut")
    scratch.drop("members", "large", "rare", "finer_components")
    return out


def _dealt(rows: DataFrame) -> DataFrame:
    """Regions (node, region, set, rim, far) cut into blocks (region, i, j): some of its nodes beyond the
    radius (rim) and some of all its nodes. A join deals rows by region, which would do for blocks as well
    and put all of a region's into one task, so they are dealt again."""
    load = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.count_if("rim").alias("n_rim"), F.sum(F.length("set") / 8).alias("weight"))
    mean = F.greatest(F.lit(1.0), F.col("weight") / F.col("n"))
    per_block = F.greatest(F.lit(1.0), F.least(F.lit(float(REGION)), F.lit(float(REGION_SHINGLES)) / mean))
    load = load.where("n_rim > 0").select(F.col("region").alias("of"), F.ceil(F.col("n") / per_block).cast("int").alias("all_blocks"),
                                          F.ceil(F.col("n_rim") / per_block).cast("int").alias("rim_blocks"))
    cut = rows.join(load, F.col("region") == F.col("of"))
    block = lambda n: F.pmod(F.xxhash64("node", F.lit(5)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = cut.where("rim").withColumn("i", block("rim_blocks")).withColumn("j", each("all_blocks"))
    z = cut.withColumn("j", block("all_blocks")).withColumn("i", each("rim_blocks"))
    columns = ["region", "i", "j", "node", "far", "set"]
    return (a.select(*columns, F.lit(True).alias("rim")).unionByName(z.select(*columns, F.lit(False).alias("rim")))
            .repartition("region", "i", "j"))


def _region_links(members: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """Links (u, v) among the nodes (node, cluster, weight, set) of each cluster that give its components."""
    nodes = members.select("node", F.col("cluster").alias("region"), "set")
    best = members.groupBy("cluster").agg(F.max(F.struct("weight", "node"))["node"].alias("node"))
    first = (members.join(best, ["cluster", "node"]).groupBy(F.col("cluster").alias("region"))
             .agg(F.array(F.first(F.struct("node", "set"))).alias("pivots")))
    seen = scratch.write(_with_pivots(nodes, first, rule), "measured")
    star = seen.where(F.col("hit")[0]).select(F.col("node").alias("u"), F.col("to")[0].alias("v"))
    # clusters with nodes beyond the radius of their pivot need more
    beyond = ~F.col("hit")[0]
    sizes = seen.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.count_if(beyond).alias("n_rim"),
                                       F.sum(F.length("set") / 8).alias("weight")).where("n_rim > 0")
    small = (F.col("n") <= REGION) & (F.col("weight") <= REGION_SHINGLES)
    small_rows = seen.join(sizes.where(small).select("region"), "region").select(
        "node", "region", "set", beyond.alias("rim"), F.col("far")[0].alias("far"))
    # large ones: Voronoi regions of the first pivot and some of the nodes beyond it
    large = seen.join(sizes.where(~small).select("region"), "region")
    draw = Window.partitionBy("region").orderBy("draw")
    more = (large.where(beyond).groupBy("region", F.pmod(F.xxhash64("node"), F.lit(PIVOTS - 1)).alias("slot"))
            .agg(F.min(F.struct(F.xxhash64("node").alias("draw"), "node", "set")).alias("p"))
            .select("region", "p.draw", "p.node", "p.set"))
    chosen = (more.withColumn("k", F.row_number().over(draw)).select("region", F.struct("k", "node", "set").alias("p"))
              .unionByName(first.select("region", F.struct(F.lit(0).alias("k"), F.col("pivots")[0]["node"].alias("node"),
                                                           F.col("pivots")[0]["set"].alias("set")).alias("p"))
                           .join(sizes.where(~small).select("region"), "region"))
              .groupBy("region").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: F.struct(p["node"], p["set"])).alias("pivots")))
    spread = scratch.write(_with_pivots(large.select("node", "region", "set"), chosen, rule), "spread")
    stars = spread.select("node", F.explode(F.filter(F.transform("to", lambda t, i: F.when(F.get(F.col("hit"), i), t)), lambda x: x.isNotNull())).alias("v"))
    nearest = F.array_min("far")
    # a node beyond the radius of its nearest pivot is compared in that region alone, which holds all
    # its partners; one inside that radius is compared where it is a guest, beyond the pivot's radius
    home = (F.array_position("far", F.col("nearest")) - 1).cast("int")
    placed = (spread.withColumn("nearest", nearest).withColumn("home", home).withColumn("settled", F.get("hit", F.col("home")))
              .select("node", "region", "set", "nearest", "home", "settled", F.posexplode(F.arrays_zip("to", "far", "hit")))
              .where(F.col("col.far") <= F.col("nearest") + 2 * rule.radius + 1e-9)
              .select("node", F.xxhash64("region", "col.to").alias("region"), "set",
                      (~F.col("col.hit") & ((F.col("pos") == F.col("home")) | F.col("settled"))).alias("rim"),
                      F.col("col.far").alias("far")))
    # the join of a region: nodes beyond the radius against all, in blocks
    rows = scratch.write(small_rows.unionByName(placed), "regions")
    stars = scratch.write(star.unionByName(stars.select(F.col("node").alias("u"), "v")), "stars")
    scratch.drop("members", "cut", "measured", "spread")
    found = _dealt(rows).groupBy("region", "i", "j").applyInArrow(_blocks(rule), "u long, v long")
    links = scratch.write(stars.unionByName(found).where("u <> v"), "links")
    scratch.drop("regions", "stars")
    return links


def link_documents(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, rid (hash of id and text), n_shingles, node
    (its set of shingles; null without any), component (least node reachable by
    links) and component_id (least id reachable by links)."""
    rule = Rule(width, percent)
    ship_package(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("rid", F.xxhash64("doc_id", "text"))
    described = scratch.write(rows.mapInArrow(_describe(rule), "doc_id long, rid long, n_shingles long, node long, "
                                              "rings array<struct<need: int, keys: array<long>>>"), "described")
    base = scratch.write(described.drop("rings"), "documents")
    keys = (described.select("node", F.posexplode("rings").alias("ring", "r"))
            .select("node", "ring", "r.need", F.explode("r.keys").alias("key")))
    # keys of more than one node
    recurring = scratch.write(keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key"), "recurring")
    shared = scratch.write(keys.join(recurring, "key").groupBy("node", "ring", "need", "key").agg(F.count(F.lit(1)).alias("rows")), "shared")
    scratch.drop("recurring", "described")     # the keys are by far the largest table
    able = (shared.groupBy("node", "ring").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need"))
            .where("n >= need").select("node", "ring"))
    held = scratch.write(shared.join(able, ["node", "ring"]).select("node", "key"), "held")
    met = held.groupBy("key").agg(F.min("node").alias("lo"), F.count(F.lit(1)).alias("n")).where("n > 1")
    meeting = scratch.write(held.join(met, "key").groupBy("node").agg(F.collect_set("lo").alias("los"), F.sum("n").alias("weight")), "meeting")
    scratch.drop("shared", "held")
    clusters = components(meeting.select(F.col("node").alias("u"), F.explode("los").alias("v")), scratch, "cluster")
    # one document of each node brings the set
    bearer = (clusters.join(meeting.select("node", "weight"), "node")
              .join(base.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("rid").alias("rid")), "node"))
    members = scratch.write(rows.join(bearer.select("rid", "node", F.col("component").alias("cluster"), "weight"), "rid")
                            .select("node", "cluster", "weight", "text").mapInArrow(_sets(rule), "node long, cluster long, weight long, set binary")
                            .groupBy("node", "cluster", "weight").agg(F.first("set").alias("set")), "members")
    linked = components(_region_links(_cut_clusters(members, rule, scratch), rule, scratch), scratch, "linked")
    ids = base.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least"))
    named = ids.join(linked, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = scratch.write(named.join(least, "component").select(F.col("node").alias("of"), "component", "component_id"), "nodes")
    return (base.select("doc_id", "rid", "n_shingles", "node").join(of_node, F.col("node") == F.col("of"), "left")
            .select("doc_id", "rid", "n_shingles", "node", "component",
                    F.coalesce("component_id", F.when(F.col("node").isNull(), F.col("doc_id"))).alias("component_id")))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with one row of each component (its least id), columns
    unchanged. Documents without words are linked with nothing and stay; of rows
    with the same id and text the least by all columns stays."""
    linked = link_documents(docs, id_col=id_col, text_col=text_col, **kw)
    own, chosen = spare_names(docs, "own", "chosen")
    first = (linked.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
             .groupBy("component", F.when(F.col("node").isNull(), F.col("rid"))).agg(F.min("rid").alias(chosen)))
    marked = docs.withColumn(own, F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)))
    return one_of_each(marked.join(first.select(chosen), F.col(own) == F.col(chosen), "left_semi"), [own], docs)
