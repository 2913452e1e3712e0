"""Hard negatives with a multiway hyperplane tree of distance ranges.

Scores are inner products. Every vector gets one more component that brings it
to the same length M, an anchor gets 0 there, and then the distance of an
anchor a and a row x says the score: d^2 = |a|^2 + M^2 - 2 a.x. A window of
scores is an annulus around the anchor.

Each node of the tree has a few split points; a row goes to the nearest. For
every split point i and subtree j the node keeps the least and the largest
distance from i to the rows of j. A row of the annulus [near, reach] around an
anchor at distance f of split point i lies between max(near - f, f - reach)
and f + reach from i, so a subtree whose range for any i misses that interval
is left out, with all its siblings' points as witnesses. Leaves are compared
exactly, in whole numbers.

The upper levels are split points of a bounded sample; their ranges come from
a grouped minimum and maximum over all rows. A cell of the upper tree is cut by
hash into blocks, and each block grows the lower levels itself. An anchor first
asks one block of its own cell; the k-th score found there shortens its reach,
and the upper tree then names the cells that it is sent to. Positives (the best
rows of the anchor's label) and the window of each positive are searched alike.

Defined cases
  null id, label or vector, null or non-finite component   takes no part
  vectors of different lengths   the shorter is filled with zeros
  repeated rows     each is a candidate; as anchors they are one
  rows of one id that differ     each is an anchor; none is a candidate of that id's anchors
  ties              smaller id first
  negative positive score        its window is empty
  few candidates    all that there are; an anchor without positives has no rows
  one vector for many rows       one cell, cut into blocks
  scores beyond 2^62             ArithmeticError: they are no long
  empty table       an empty result
  other columns     are not read
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deficit_engine.llm.common import Scratch, ship_package
from deficit_engine.llm.exact_topk import quantised, usable
from deficit_engine.llm.units import hold_caches

SAMPLE = 4000           # rows that the upper split points are chosen from; any choice gives exact results
FAN, LEVELS = 8, 3      # children of a node; levels of the upper tree
BLOCK, LEAF = 4096, 256  # rows of a block and of a leaf, about
ASKED = 1024            # queries sent to a block at once
SLACK = 1e-6            # rounding of distances, as a share of the longest vector
BOUND = 1 << 62         # no score is beyond


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a ** 2).sum(1)[:, None] + (b ** 2).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(squares, 0))


def lift(vectors: np.ndarray, m2: float) -> np.ndarray:
    """Vectors with the component that brings each to length sqrt(m2)."""
    x = vectors.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(m2 - (x ** 2).sum(1), 0))[:, None]], axis=1)


class Tree:
    """Nodes hold split points, ranges [split point, child] and children; a child below 0 is leaf ~child."""

    def __init__(self):
        self.points: list[np.ndarray] = []
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaves: list[np.ndarray] = []

    @classmethod
    def grow(cls, x: np.ndarray, leaf: int, levels: int = 64) -> Tree:
        tree = cls()
        tree.root = tree._grow(x, np.arange(len(x)), leaf, levels)
        return tree

    def _grow(self, x: np.ndarray, rows: np.ndarray, leaf: int, levels: int) -> int:
        if len(rows) > leaf and levels:
            chosen = self._split_points(x[rows])
            far = distances(x[rows], chosen)
            home = far.argmin(1)
            if home.min() < home.max():
                node = len(self.points)
                self.points.append(chosen)
                self.low.append(np.array([far[home == j].min(0, initial=np.inf) for j in range(len(chosen))]).T)
                self.high.append(np.array([far[home == j].max(0, initial=-np.inf) for j in range(len(chosen))]).T)
                self.children.append([])
                self.children[node] = [self._grow(x, rows[home == j], leaf, levels - 1) for j in range(len(chosen))]
                return node
        self.leaves.append(rows)
        return ~(len(self.leaves) - 1)

    @staticmethod
    def _split_points(x: np.ndarray) -> np.ndarray:
        """Points far from each other."""
        chosen = [0]
        nearest = distances(x, x[:1])[:, 0]
        while len(chosen) < min(FAN, len(x)):
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, distances(x, x[chosen[-1:]])[:, 0])
        return x[chosen]

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row."""
        leaf = np.zeros(len(x), np.int32)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                leaf[rows] = ~node
                continue
            far = distances(x[rows], self.points[node])
            home = far.argmin(1)
            todo += [(self.children[node][j], rows[home == j]) for j in np.unique(home)]
        return leaf

    def paths(self) -> list[list[tuple[int, int]]]:
        """(node, child) from the root to each leaf."""
        out: list[list[tuple[int, int]]] = [[]] * len(self.leaves)
        todo: list[tuple[int, list[tuple[int, int]]]] = [(self.root, [])]
        while todo:
            node, path = todo.pop()
            if node < 0:
                out[~node] = path
            else:
                todo += [(child, [*path, (node, j)]) for j, child in enumerate(self.children[node])]
        return out

    def walk(self, x: np.ndarray, near: np.ndarray, reach: np.ndarray, slack: float, node: int | None = None,
             rows: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, queries that it can hold rows for). ``reach`` may shrink while this runs."""
        if rows is None:
            node, rows = self.root, np.arange(len(x))
        if node < 0:
            yield ~node, rows
            return
        far = distances(x[rows], self.points[node])
        for j in np.argsort(far.mean(0)):
            most, least = reach[rows, None], near[rows, None]
            able = ((self.low[node][:, j] <= far + most + slack)
                    & (self.high[node][:, j] >= np.maximum(least - far, far - most) - slack)).all(1)
            if able.any():
                yield from self.walk(x, near, reach, slack, self.children[node][j], rows[able])


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.offsets)
    sizes = np.diff(ends)
    out = np.zeros((len(lists), width), np.int64)
    rows = np.repeat(np.arange(len(lists)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def _cells(tree: Tree, width: int, m2: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_caches("hard negatives")
        for batch in batches:
            cell = tree.place(lift(_matrix(batch.column("v"), width), m2))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], [*batch.schema.names, "cell"])
    return run


def _ranges(tree: Tree, width: int, m2: float):
    """Least and largest distance from each split point to the rows (v, cell) of each subtree, of one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        paths = tree.paths()
        for batch in batches:
            x, cell = lift(_matrix(batch.column("v"), width), m2), batch.column("cell").to_numpy()
            for leaf in np.unique(cell):
                for node, child in paths[leaf]:
                    far = distances(x[cell == leaf], tree.points[node])
                    low, high = held.get((node, child), (np.inf, -np.inf))
                    held[node, child] = np.minimum(low, far.min(0)), np.maximum(high, far.max(0))
        rows = [(node, child, i, float(low[i]), float(high[i])) for (node, child), (low, high) in held.items() for i in range(len(low))]
        yield pa.RecordBatch.from_pylist([dict(zip(("node", "child", "point", "low", "high"), r)) for r in rows],
                                         pa.schema([*((c, pa.int32()) for c in ("node", "child", "point")), ("low", pa.float64()), ("high", pa.float64())]))
    return run


def _pack(width: int, kind: str):
    """The rows of a block as one row."""
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        v = _matrix(group.column("v").chunk(0), width)
        raw = [group.column(c).to_numpy().astype(np.int64).tobytes() for c in ("vec_id", "label", "copies")]
        return pa.table({"cell": group.column("cell").slice(0, 1), "part": group.column("part").slice(0, 1),
                         **{c: pa.array([b], pa.binary()) for c, b in zip(("ids", "labels", "copies", "vectors"), [*raw, v.astype(kind).tobytes()])}})
    return run


# A query: whose it is (anchor_id, twin), which positive's window (place), the label, the least and
# largest score asked for, and the vector.
QUERY = ("anchor_id", "twin", "place", "label", "low", "high")
SENT = "cell int, part int, {}, who array<int>, v binary".format(", ".join(f"{c} array<long>" for c in QUERY))


def _annulus(q: np.ndarray, low: np.ndarray, high: np.ndarray, m2: float) -> tuple[np.ndarray, np.ndarray]:
    """Distances between which rows have scores from low to high."""
    whole = (q.astype(np.float64) ** 2).sum(1) + m2
    near = np.sqrt(np.maximum(whole - 2 * np.minimum(high.astype(np.float64), whole / 2), 0))
    return near, np.sqrt(np.maximum(whole - 2 * low.astype(np.float64), 0))


def _send(tree: Tree, parts: list[int], width: int, kind: str, m2: float, home_only: bool):
    """Queries to the blocks they must ask: to one block of their own cell, or to all that can hold an answer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_caches("hard negatives")
        names = [*QUERY, "who", "v"]
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column("v"), width)
            columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in QUERY]
            low, high = columns[4], columns[5]
            # neighbouring queries of one anchor share its vector
            new = np.concatenate([[True], (np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0)])
            anchor = np.cumsum(new) - 1
            out: dict[str, list] = {c: [] for c in ("cell", "part", *names)}

            def send(cell: int, part: int, rows: np.ndarray) -> None:
                for at in range(0, len(rows), ASKED):
                    some = rows[at:at + ASKED]
                    mine, who = np.unique(anchor[some], return_inverse=True)
                    own = np.flatnonzero(new)[mine]
                    for c, values in zip(("cell", "part", *names), (cell, part, *(x[some] for x in columns), who.astype(np.int32), q[own].astype(kind).tobytes())):
                        out[c].append(values)

            if home_only:
                cell = batch.column("cell").to_numpy(zero_copy_only=False).astype(np.int64)
                part = (columns[0] * 0x9E3779B1 + columns[1]) % np.array(parts, np.int64)[cell]
                for key in np.unique(np.stack([cell, part]), axis=1).T:
                    send(int(key[0]), int(key[1]), np.flatnonzero((cell == key[0]) & (part == key[1])))
            else:
                near, reach = _annulus(q, low, high, m2)
                lifted = np.concatenate([q.astype(np.float64), np.zeros((len(q), 1))], axis=1)
                for cell, rows in tree.walk(lifted, near, reach, SLACK * (1 + m2 ** 0.5)):
                    for part in range(parts[cell]):
                        send(cell, part, rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["cell"], pa.int32()), pa.array(out["part"], pa.int32()), *(pa.array(out[c], pa.list_(pa.int64())) for c in QUERY),
                 pa.array(out["who"], pa.list_(pa.int32())), pa.array(out["v"], pa.binary())], ["cell", "part", *names])
    return run


FOUND = "anchor_id long, twin long, place long, vec_id long, score long"


def _ask(k: int, same_label: bool, width: int, kind: str, m2: float, exact: bool):
    """The best k rows of a block for each query sent to it. Rows are sorted by
    block, a block's own row first; only that is held."""
    number = np.float64 if exact else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_caches("hard negatives")
        packed, tree = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["ids"] is not None:
                    packed, tree = row, None
                    continue
                if tree is None:
                    ids, labels, copies = (np.frombuffer(packed[c], np.int64) for c in ("ids", "labels", "copies"))
                    x = np.frombuffer(packed["vectors"], kind).reshape(-1, width)
                    tree = Tree.grow(lift(x, m2), LEAF)
                    x = x.astype(number)
                yield _answer(row, tree, ids, labels, copies, x, np.frombuffer(row["v"], kind).reshape(-1, width))

    def _answer(row, tree, ids, labels, copies, x, q) -> pa.RecordBatch:
        anchor_id, twin, place, label, low, high = (np.array(row[c], np.int64) for c in QUERY)
        who = np.array(row["who"], np.int64)
        near, reach = _annulus(q[who], low, high, m2)
        whole = (q.astype(np.float64) ** 2).sum(1)[who] + m2
        lifted = np.concatenate([q.astype(np.float64), np.zeros((len(q), 1))], axis=1)[who]
        q = q.astype(number)
        least = low.copy()
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(who)
        for leaf, rows in tree.walk(lifted, near, reach, SLACK * (1 + m2 ** 0.5)):
            members = tree.leaves[leaf]
            some, back = np.unique(who[rows], return_inverse=True)
            scores = (q[some] @ x[members].T).astype(np.int64)[back]
            fit = (labels[members][None, :] == label[rows, None]) == same_label
            fit &= (ids[members][None, :] != anchor_id[rows, None]) & (scores >= least[rows, None]) & (scores <= high[rows, None])
            for r in np.flatnonzero(fit.any(1)):
                at = np.flatnonzero(fit[r])
                often = np.minimum(copies[members[at]], k)
                s = np.concatenate([best[rows[r]][0], np.repeat(scores[r, at], often)])
                n = np.concatenate([best[rows[r]][1], np.repeat(ids[members[at]], often)])
                top = np.lexsort((n, -s))[:k]
                best[rows[r]] = s[top], n[top]
                if len(top) == k:       # only better scores, or equal ones of smaller ids, are of use now
                    j = rows[r]
                    least[j] = s[top[-1]]
                    reach[j] = np.sqrt(max(whole[j] - 2.0 * float(least[j]), 0.0))
        count = [len(s) for s, _ in best]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(c, count), pa.int64()) for c in (anchor_id, twin, place)]
            + [pa.array(np.concatenate([n for _, n in best]), pa.int64()), pa.array(np.concatenate([s for s, _ in best]), pa.int64())],
            ["anchor_id", "twin", "place", "vec_id", "score"])
    return run


class Index:
    """The rows (vec_id, label, v, is_anchor) in blocks under the upper tree."""

    def __init__(self, rows: DataFrame, scratch: Scratch):
        self.scratch = scratch
        # equal rows become one with a count, so no vector fills a block with copies of itself
        rows = scratch.write(rows.groupBy("vec_id", "label", "v").agg(F.count(F.lit(1)).alias("copies"), F.bool_or("is_anchor").alias("is_anchor")), "rows")
        square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        n, width, largest, m2 = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))),
                                         F.max(square)).first()
        self.n, self.width, self.m2 = n, max(width or 0, 1), (m2 or 0.0) * (1 + 1e-9) + 1
        largest = largest or 0.0
        if largest ** 2 * self.width >= 2.0 ** 62:
            raise ArithmeticError("scores are too large for a long")
        self.exact = largest ** 2 * self.width < 2.0 ** 52      # products in double precision are whole numbers
        self.kind = "<i4" if largest < 2.0 ** 31 else "<i8"
        drawn = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
        sample = lift(_matrix(drawn, self.width) if len(drawn) else np.zeros((0, self.width), np.int64), self.m2)
        share = 4 * BLOCK * len(sample) / max(n, 1)
        self.tree = Tree.grow(sample, max(32, int(share)), LEVELS)
        args = self.tree, self.width, self.m2
        for low, high in zip(self.tree.low, self.tree.high):    # of all rows, not of the sample
            low[:], high[:] = np.inf, -np.inf
        schema = "vec_id long, label long, v array<long>, copies long, is_anchor boolean, cell int"
        placed = scratch.write(rows.mapInArrow(_cells(*args), schema), "placed")
        found = (placed.select("v", "cell").mapInArrow(_ranges(*args), "node int, child int, point int, low double, high double")
                 .groupBy("node", "child", "point").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect())
        for r in found:
            self.tree.low[r["node"]][r["point"], r["child"]] = r["low"]
            self.tree.high[r["node"]][r["point"], r["child"]] = r["high"]
        self.parts = [1] * len(self.tree.leaves)
        for r in placed.groupBy("cell").count().collect():
            self.parts[r["cell"]] = -(-r["count"] // BLOCK)
        part = F.pmod(F.xxhash64("vec_id", "label", "v"), F.get(F.array(*[F.lit(p) for p in self.parts]), F.col("cell"))).cast("int")
        self.blocks = scratch.write(
            placed.withColumn("part", part).groupBy("cell", "part")
            .applyInArrow(_pack(self.width, self.kind), "cell int, part int, ids binary, labels binary, copies binary, vectors binary"), "blocks")
        twin = F.row_number().over(Window.partitionBy("vec_id").orderBy("label", "v")).cast("long")
        self.anchors = scratch.write(placed.where("is_anchor").select(F.col("vec_id").alias("anchor_id"), twin.alias("twin"), "label", "v", "cell"), "anchors")

    def search(self, queries: DataFrame, k: int, same_label: bool, name: str) -> DataFrame:
        """The best k rows of each query: anchor_id, twin, place, vec_id, score, rank."""
        queries = self.scratch.write(queries.sortWithinPartitions("cell", "anchor_id", "twin"), f"{name}_queries")

        def ask(asked: DataFrame, home_only: bool) -> DataFrame:
            sent = asked.mapInArrow(_send(self.tree, self.parts, self.width, self.kind, self.m2, home_only), SENT)
            rows = self.blocks.unionByName(sent, allowMissingColumns=True)
            return (rows.repartition("cell", "part").sortWithinPartitions("cell", "part", F.col("ids").isNull())
                    .mapInArrow(_ask(k, same_label, self.width, self.kind, self.m2, self.exact), FOUND))

        key = ["anchor_id", "twin", "place"]
        # the k-th score of one block of the own cell is a bound for all others
        floor = ask(queries, True).groupBy(*key).agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
        sharper = (queries.join(floor.drop("n"), key, "left")
                   .withColumn("low", F.greatest("low", F.coalesce("floor", F.col("low")))).drop("floor"))
        sharper = self.scratch.write(sharper.sortWithinPartitions("cell", "anchor_id", "twin"), f"{name}_bounded")
        order = Window.partitionBy(*key).orderBy(F.col("score").desc(), F.col("vec_id"))
        return ask(sharper, False).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Column, *, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", label: Column | None = None,
         scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor and each of its first ``positives`` rows of the same label:
    the first ``negatives`` rows of another label with least * positive_score <=
    100 * negative_score <= most * positive_score. ``anchors``: condition that
    marks them; ``label``: the label, if not the plain column.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "negatives")
    rows = (vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
            .select(F.col(id_col).cast("long").alias("vec_id"), (F.col(label_col) if label is None else label).cast("long").alias("label"),
                    quantised(F.col(vector_col), scale).alias("v"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
            .where(F.col("label").isNotNull()))
    index = Index(rows, scratch)
    unbounded = {"low": F.lit(-BOUND).cast("long"), "high": F.lit(BOUND).cast("long")}
    first = index.anchors.withColumns({"place": F.lit(0).cast("long"), **unbounded})
    best = scratch.write(index.search(first, positives, True, "positive")
                         .select("anchor_id", "twin", F.col("rank").cast("long").alias("place"), F.col("vec_id").alias("positive_id"),
                                 F.col("score").alias("positive_score")), "positives")
    windows = (index.anchors.join(best.where("positive_score >= 0"), ["anchor_id", "twin"])
               .withColumns({"low": F.expr(f"(positive_score div 100) * {least} + ((positive_score % 100) * {least} + 99) div 100"),
                             "high": F.expr(f"(positive_score div 100) * {most} + ((positive_score % 100) * {most}) div 100")})
               .select(*index.anchors.columns, "place", "low", "high"))
    found = index.search(windows, negatives, False, "negative")
    return (found.join(best, ["anchor_id", "twin", "place"])
            .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
