"""Exact top-k inner products with a pivot table.

Distances of every vector to a few dozen pivots are computed once. By the
triangle inequality |q - x| >= |d(q, p) - d(x, p)| for each pivot p, so
q.x <= (|q|^2 + |x|^2 - max_p (d(q, p) - d(x, p))^2) / 2. The origin is a pivot
too, which gives Cauchy's bound.

Vectors and queries are packed into blocks. The vectors of a block are put in
order of their nearest pivot and cut into leaves, and each leaf keeps the least
and the largest distance to every pivot: its bound for a query is the largest
that a vector of the leaf can have. Leaves come in the order of this bound, and
a query leaves out those whose bound is below its k-th best score so far. Within
a leaf, long vectors and products that need long arithmetic are taken in the
order of their own bounds, until the bound falls below the k-th score; short
ones are multiplied at once, which takes less time than 25 distances.

The pairs of blocks form a grid of cells, each a task: groups of query blocks,
which a task holds, by groups of vector blocks, which pass by. So the copies
of blocks that are shuffled follow the number of groups, not of blocks, and
nothing of them goes through the driver. The best k of a query in each of its
cells are merged by a ranking over each query.

Defined cases
  null vector, null or non-finite component, null id   takes no part
  vectors of different lengths   the shorter is filled with zeros
  repeated rows                  each is ranked, as a candidate and as a query, as in the SQL
  a query's own id               is never its candidate
  fewer than k candidates        all are returned
  products beyond 2^53           exact in long arithmetic; beyond 2^62 an ArithmeticError
  empty table                    an empty result
  other columns                  are not read
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deficit_engine.llm.common import Scratch, ship_package

PIVOTS = 24
PIVOT_SAMPLE = 2000     # rows that pivots are chosen from; any choice gives exact results
SAMPLE_SIZE = 1 << 20   # components of these rows, about
BLOCK, QUERY_BLOCK, LEAF = 4096, 1024, 512
HELD, HELD_SIZE = 128, 1 << 24              # query blocks that a task holds, and their components
CELL_BYTES = 128 << 20                      # of a cell's vectors
SMALL_CELL, LARGE_CELL = 10 ** 8, 4 * 10 ** 9   # pairs
DOWN = 16               # groups of vector blocks, unless CELL_BYTES or the cores ask for more
LONG = 4800             # bytes of a vector beyond which a product takes longer than its bound
LOW = -(1 << 62)        # below every score
# Spark's setting of the bytes that a task hands to Python at once; a cell's rows are packed blocks.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20


def quantised(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component x as a double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(False))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """The origin, then vectors far from those chosen before."""
    chosen = [np.zeros(sample.shape[1])]
    nearest = np.sqrt((sample ** 2).sum(1))
    for _ in range(min(count, len(sample))):
        at = int(nearest.argmax())
        chosen.append(sample[at])
        nearest = np.minimum(nearest, np.sqrt(((sample - sample[at]) ** 2).sum(1)))
    return np.array(chosen)


def pivot_sample(rows: DataFrame, n: int, size: int) -> DataFrame:
    """``size`` of the n rows, those of the least hashes. Rows that can't be among them are
    left out first, so that a task has few to offer."""
    place = F.xxhash64("vec_id", "v")
    near = place.cast("double") <= (4.0 * size / max(n, 1) - 0.5) * 2.0 ** 64
    return rows.where(near).orderBy(place, "vec_id").limit(size).select("v")


def _matrix(lists: pa.Array, width: int, kind: type) -> np.ndarray:
    """Rows of a list column, filled with zeros."""
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(kind), np.asarray(lists.offsets)
    sizes = np.diff(ends)
    out = np.zeros((len(lists), width), kind)
    rows = np.repeat(np.arange(len(lists)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def _lists(table: pa.Table, name: str) -> pa.Array:
    column = table.combine_chunks().column(name).combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _pack(pivots: np.ndarray, k: int, kind: type, leaf: int):
    width = pivots.shape[1]

    def run(group: pa.Table) -> pa.Table:
        vectors = _matrix(_lists(group, "v"), width, kind)
        ids = group.column("vec_id").to_numpy().astype(np.int64)
        # equal rows share a block; no ranking has room for more than k of them
        _, of, often = np.unique(ids, return_inverse=True, return_counts=True)
        seen, rows = Counter(), np.ones(len(ids), bool)
        for at in np.flatnonzero(often[of] > k):
            row = (int(ids[at]), vectors[at].tobytes())
            seen[row] += 1
            rows[at] = seen[row] <= k
        ids, vectors = ids[rows], vectors[rows]
        # a matrix product keeps this O(n * pivots) in memory
        x = vectors.astype(np.float64)
        squares = (x ** 2).sum(1)[:, None] + (pivots ** 2).sum(1)[None, :] - 2 * x @ pivots.T
        far = np.sqrt(np.maximum(squares, 0)).astype(np.float32)
        order = np.lexsort((far.min(1), far.argmin(1)))
        ids, vectors, far = ids[order], vectors[order], far[order]
        starts = np.arange(0, len(ids), leaf)
        ranges = np.stack([np.minimum.reduceat(far, starts), np.maximum.reduceat(far, starts)])
        return pa.table({"block": group.column("block").slice(0, 1)}
                        | {name: pa.array([a.tobytes()], pa.binary())
                           for name, a in (("ids", ids), ("vectors", vectors), ("far", far), ("ranges", ranges))})
    return run


def bounds(q_far: np.ndarray, q_squares: np.ndarray, low: np.ndarray, high: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """For each query and each range of distances, what no product is above; ``squares``: the largest of the range."""
    gap = np.zeros((len(q_far), len(low)), np.float32)
    for p in range(low.shape[1]):
        np.maximum(gap, low[None, :, p] - q_far[:, p, None], out=gap)
        np.maximum(gap, q_far[:, p, None] - high[None, :, p], out=gap)
    # single precision only loosens the bound by this much
    gap = np.maximum(gap - 1e-5 * (1 + float(max(high.max(initial=0), q_far.max(initial=0)))), 0).astype(np.float64)
    both = q_squares[:, None] + squares[None, :]
    return (both - gap ** 2) / 2 + 1e-6 + 1e-12 * both


def best_of_block(q: np.ndarray, own: int, bound: np.ndarray, ids: np.ndarray, vectors: np.ndarray,
                  best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k (scores, ids) after the candidates of one leaf; ``bound`` is never below their scores."""
    scores, names = best
    order = np.flatnonzero(bound >= scores[-1])
    order = order[np.argsort(-bound[order])]
    at, step = 0, 128
    while at < len(order) and bound[order[at]] >= scores[-1]:
        rows = order[at:at + step]
        rows = rows[ids[rows] != own]
        s, n = np.concatenate([scores, vectors[rows] @ q]), np.concatenate([names, ids[rows]])
        top = np.lexsort((n, -s))[:k]
        scores, names = s[top], n[top]
        at, step = at + step, step * 2
    return scores, names


class Asked:
    """A block of queries with the best k of each so far (LOW where there are fewer), and
    candidates that are yet to be merged with them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, far: np.ndarray, k: int, work: type):
        self.ids, self.q, self.far, self.k = ids, vectors.astype(work), far, k
        self.squares = (vectors.astype(np.float64) ** 2).sum(1)
        self.scores, self.names = np.full((len(ids), k), LOW, work), np.zeros((len(ids), k), np.int64)
        self.waiting, self.n_waiting = [], 0

    def merge(self) -> None:
        if not self.waiting:
            return
        rows, scores, names = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting, self.n_waiting = [], 0
        at = np.unique(rows)
        rows = np.concatenate([np.repeat(at, self.k), rows])
        scores, names = np.concatenate([self.scores[at].ravel(), scores]), np.concatenate([self.names[at].ravel(), names])
        order = np.lexsort((names, -scores, rows))
        top = order[np.searchsorted(rows[order], at)[:, None] + np.arange(self.k)]
        self.scores[at], self.names[at] = scores[top], names[top]

    def multiply(self, asks: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """All products of the queries ``asks`` with one leaf."""
        q = self.q if len(asks) == len(self.ids) else self.q[asks]
        s, known = q @ vectors.T, self.scores[asks, -1]
        least, new = known.copy(), np.flatnonzero(known == LOW)
        if len(new) and len(ids) > self.k:      # the k-th best of the leaf itself
            others = s[new]
            others[self.ids[asks[new], None] == ids[None, :]] = LOW
            least[new] = np.partition(others, -self.k, axis=1)[:, -self.k]
        hit = np.flatnonzero(s >= least[:, None])
        rows, columns = np.divmod(hit, len(ids))
        s, names, at = s.ravel()[hit], ids[columns], asks[rows]
        better = (names != self.ids[at]) & ((s > known[rows]) | (names < self.names[at, -1]))
        self.waiting.append((at[better], s[better], names[better]))
        self.n_waiting += np.count_nonzero(better)
        if self.n_waiting >= self.scores.size:
            self.merge()

    def search(self, ids: np.ndarray, vectors: np.ndarray, squares: np.ndarray, ranges: np.ndarray,
               far: np.ndarray | None, leaf: int) -> None:
        """Meet the vectors of one block; ``far``: their own distances, if they are to be used."""
        starts = np.arange(0, len(ids), leaf)
        bound = bounds(self.far, self.squares, ranges[0], ranges[1], np.maximum.reduceat(squares, starts))
        for j in np.argsort(-bound.max(0)):
            asks = np.flatnonzero(bound[:, j] >= self.scores[:, -1])
            part = slice(starts[j], starts[j] + leaf)
            if far is None:
                if len(asks):
                    self.multiply(asks, ids[part], vectors[part])
                continue
            for some in np.split(asks, range(128, len(asks), 128)):
                own = bounds(self.far[some], self.squares[some], far[part], far[part], squares[part])
                for i, limit in zip(some, own):
                    self.scores[i], self.names[i] = best_of_block(
                        self.q[i], int(self.ids[i]), limit, ids[part], vectors[part], (self.scores[i], self.names[i]), self.k)

    def found(self) -> pa.RecordBatch:
        self.merge()
        rows, at = np.nonzero(self.scores > LOW)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[rows], pa.int64()), pa.array(self.names[rows, at], pa.int64()),
             pa.array(self.scores[rows, at].astype(np.int64), pa.int64())], ["query_id", "vec_id", "score"])


def _search(k: int, width: int, pivots: int, kind: type, work: type, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked = None, []
        for batch in batches:
            for at in range(len(batch)):
                row = {name: batch.column(name)[at] for name in batch.schema.names}
                if row["cell"].as_py() != cell:
                    yield from (a.found() for a in asked)
                    cell, asked = row["cell"].as_py(), []
                ids = np.frombuffer(row["ids"].as_buffer(), np.int64)
                x = np.frombuffer(row["vectors"].as_buffer(), kind).reshape(-1, width)
                far = np.frombuffer(row["far"].as_buffer(), np.float32).reshape(-1, pivots) if row["far"].is_valid else None
                if row["asks"].as_py():
                    asked.append(Asked(ids.copy(), x, far.copy(), k, work))
                elif asked:
                    squares = (x.astype(np.float64) ** 2).sum(1)
                    ranges = np.frombuffer(row["ranges"].as_buffer(), np.float32).reshape(2, -1, pivots)
                    x = x.astype(work)
                    for a in asked:
                        a.search(ids, x, squares, ranges, far, leaf)
        yield from (a.found() for a in asked)
    return run


def grid(n: int, n_queries: int, width: int, row_bytes: int, cores: int, cost: int = 1) -> tuple[int, int, int]:
    """Groups of vector blocks, query blocks of a group, groups of query blocks."""
    n_blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    held = max(1, min(HELD, HELD_SIZE // (QUERY_BLOCK * width)))
    across = -(-query_blocks // held)
    pairs = n * n_queries * cost
    cells = min(-(-pairs // SMALL_CELL), max(2 * cores, -(-pairs // LARGE_CELL)))
    down = max(1, -(-n * row_bytes // CELL_BYTES), min(max(DOWN, -(-2 * cores // across)), -(-cells // across)))
    return min(n_blocks, down), held, across


def top_k(vectors: DataFrame, queries: Column, *, k: int = 20, id_col: str = "vec_id",
          vector_col: str = "embedding", scale: float = 64.0, pivots: int = PIVOTS) -> DataFrame:
    """The k best candidates of every query: query_id, rank (from 1), vec_id, score.

    ``queries``: condition on the id column that marks the queries.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "topk")
    rows = scratch.write(
        vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
        .select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("v"),
                queries.alias("is_query")), "vectors")
    n, n_queries, width, largest = rows.agg(F.count(F.lit(1)), F.count_if("is_query"), F.max(F.size("v")),
                                            F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()
    width, largest = max(width or 0, 1), largest or 0.0
    span = largest ** 2 * width
    if span >= 2.0 ** 62:
        raise ArithmeticError("products are too large for a long")
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if largest <= np.iinfo(t).max)
    # single and double precision are whole below 2^24 and 2^53
    work = np.float32 if span < 2.0 ** 24 else np.float64 if span < 2.0 ** 53 else np.int64
    own_bounds = work is np.int64 or width * np.dtype(work).itemsize > LONG
    drawn = pivot_sample(rows, n, max(pivots, min(PIVOT_SAMPLE, SAMPLE_SIZE // width)))
    # written, so that the driver gets the rows chosen and not each task's
    sample = _matrix(_lists(scratch.write(drawn, "sample").toArrow(), "v"), width, np.float64)
    table = choose_pivots(sample, pivots)

    def blocks(part: DataFrame, count: int, size: int) -> DataFrame:
        key = F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(1, -(-count // size)))).cast("int")
        return part.select(key.alias("block"), "vec_id", "v").groupBy("block").applyInArrow(
            _pack(table, k, kind, LEAF), "block int, ids binary, vectors binary, far binary, ranges binary")

    x = scratch.write(blocks(rows, n, BLOCK), "blocks")
    q = scratch.write(blocks(rows.where("is_query"), n_queries, QUERY_BLOCK), "query_blocks")
    row_bytes = 8 + width * np.dtype(kind).itemsize + 4 * len(table) * own_bounds
    down, held, across = grid(n, n_queries, width, row_bytes, spark.sparkContext.defaultParallelism, 50 if own_bounds else 1)

    def dealt(part: DataFrame, i: Column, j: Column, asks: bool) -> DataFrame:
        wanted = [F.col(c) if use else F.lit(None).cast("binary").alias(c)
                  for c, use in (("far", asks or own_bounds), ("ranges", not asks))]
        return part.select("block", "ids", "vectors", "far", "ranges", i.alias("i"), j.alias("j")).select(
            (F.col("i") * across + F.col("j")).alias("cell"), F.lit(asks).alias("asks"), "ids", "vectors", *wanted)

    def each(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    asked = dealt(q, each(down), F.floor(F.col("block") / held).cast("int"), True)
    offered = dealt(x, F.col("block") % down, each(across), False)
    found = (asked.unionAll(offered).repartitionById(down * across, "cell")
             .sortWithinPartitions("cell", F.desc("asks"))
             .mapInArrow(_search(k, width, len(table), kind, work, LEAF), "query_id long, vec_id long, score long"))
    ranks = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    best = (found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(BATCH_BYTES))
    try:
        best = scratch.write(best, "best")
    finally:
        spark.conf.set(BATCH, before)
    scratch.drop("vectors", "sample", "blocks", "query_blocks")
    return best
