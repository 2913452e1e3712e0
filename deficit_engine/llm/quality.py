"""Document quality from positive and unlabelled text.

Every text is reduced to a few dozen counts and ratios of its letters, marks,
words and lines. An additive model over their quantile bins is fitted by the
non-negative unbiased risk of positive-unlabelled learning: trusted positives
stand for the good class, all text of the web for the mixture of both, and
prior * risk of the positives as negatives is taken off the unlabelled risk,
never below zero. The class prior is the share of positives among the labelled
rows; where only positives are labelled it is the largest share of the
unlabelled rows that the positives can make up (least ratio of the two
frequencies over the features' tails).

The fit runs on the driver over a bounded sample (``SAMPLE`` rows of each
kind, drawn by hash); features and scores are computed for every whole text.

Defined cases
  null text       scored as the empty text
  empty text      scored like any other (all counts 0)
  null label      no label; several labels of an id: the largest
  null id         scored, never a training row
  repeated rows   scored row by row
  no positives or no rows to train on   every score is the prior (0.5 without labels)
  other columns   are not read
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deficit_engine.llm.common import Scratch, ship_package
from deficit_engine.llm.units import hold_caches, text_slices

SAMPLE = 30_000
BINS = 24
STEPS, RATE, DECAY = 400, 0.08, 1e-4

# Classes of bytes that are counted: each one of these marks, and the ranges below.
MARKS = b"!*#%&$|.,?-'\"@:;/=<>()[]{}_\\~^+"


def _byte_classes() -> tuple[np.ndarray, int]:
    """Class of every byte: 0 other, 1 small letter, 2 capital, 3 digit, 4 space, 5 line end, 6 beyond ASCII, then the marks."""
    kinds = np.zeros(256, np.uint8)
    kinds[ord("a"):ord("z") + 1] = 1
    kinds[ord("A"):ord("Z") + 1] = 2
    kinds[ord("0"):ord("9") + 1] = 3
    kinds[[ord(" "), ord("\t")]] = 4
    kinds[[10, 13]] = 5
    kinds[128:] = 6
    for k, b in enumerate(MARKS):
        kinds[b] = 7 + k
    return kinds, 7 + len(MARKS)


CLASSES, N_CLASSES = _byte_classes()


def _word_features(text: str) -> list[float]:
    words = text.lower().split()
    n = len(words)
    lines = text.split("\n")
    filled = [x for x in lines if x]
    if not n:
        return [0.0] * 9
    seen = set(words)
    pairs = set(pairwise(words))
    # the worst stretch counts: junk may fill only a part of a good text
    worst = max((sum(not w[-1:].isalpha() for w in x) / len(x) for x in (words[i:i + 20] for i in range(0, n, 20)) if len(x) > 4), default=0.0)
    poor = min((len(set(x)) / len(x) for x in (words[i:i + 20] for i in range(0, n, 20)) if len(x) > 4), default=1.0)
    return [np.log1p(n), len(seen) / n, sum(a == b for a, b in pairwise(words)) / n, 1 - len(pairs) / max(n - 1, 1),
            sum(map(len, seen)) / len(seen), max(map(len, seen)), worst, poor,
            1 - len(set(filled)) / max(len(filled), 1)]


def _ends_oddly(raw: np.ndarray, kinds: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Pairs of neighbouring bytes that tell marked-up or shouted words: mark-mark, capital-capital, mark before space."""
    same = doc[1:] == doc[:-1]
    a, b = kinds[:-1], kinds[1:]
    mark = (a >= 7)
    return np.stack([np.bincount(doc[1:][same & mark & (b >= 7)], minlength=n),
                     np.bincount(doc[1:][same & (a == 2) & (b == 2)], minlength=n),
                     np.bincount(doc[1:][same & mark & (b == 4)], minlength=n),
                     np.bincount(doc[1:][same & mark & ((b == 1) | (b == 2) | (b == 6))], minlength=n)], axis=1)


def features(texts: list[str]) -> np.ndarray:
    """One row of features per text."""
    raws = [t.encode() for t in texts]
    sizes = np.array([len(r) for r in raws], np.int64)
    raw = np.frombuffer(b"".join(raws), np.uint8)
    doc = np.repeat(np.arange(len(texts)), sizes)
    kinds = CLASSES[raw]
    n = len(texts)
    counts = np.bincount(doc * N_CLASSES + kinds, minlength=n * N_CLASSES).reshape(n, N_CLASSES).astype(float)
    length = np.maximum(sizes, 1)[:, None]
    odd = _ends_oddly(raw, kinds, doc, n) if len(raw) > 1 else np.zeros((n, 4))
    words = np.array([_word_features(t) for t in texts]).reshape(n, -1)
    return np.concatenate([counts / length, odd / length, np.log1p(sizes)[:, None], words], axis=1).astype(np.float32)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hold_caches("quality")
    for batch in batches:
        for part in text_slices(batch, "text"):
            x = features([t or "" for t in part.column("text").to_pylist()])
            values = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), values], ["doc_id", "x"])


class Additive:
    """Sum of one weight per feature and quantile bin, through the logistic function."""

    def __init__(self, edges: list[np.ndarray], weights: np.ndarray, prior: float):
        self.edges, self.weights, self.prior = edges, weights, prior

    def bins(self, x: np.ndarray) -> np.ndarray:
        width = self.weights.shape[1]
        return np.stack([np.searchsorted(e, x[:, k], "right") + k * width for k, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weights.any():
            return np.full(len(x), self.prior)
        z = self.weights.reshape(-1)[self.bins(x)].sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def mixture_share(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.1) -> float:
    """Most of the unlabelled rows that can be positives: no set of values can
    hold less of the mixture than the positives bring to it. Sets are the
    tails of each feature with at least ``least`` of the positives."""
    share = 1.0
    for k in range(positive.shape[1]):
        cuts = np.unique(np.quantile(positive[:, k], np.linspace(0, 1, 41)))
        p, u = np.sort(positive[:, k]), np.sort(unlabelled[:, k])
        for side in ("left", "right"):
            below_p, below_u = np.searchsorted(p, cuts, side) / len(p), np.searchsorted(u, cuts, side) / len(u)
            for a, b in ((below_p, below_u), (1 - below_p, 1 - below_u)):
                wide = a >= least
                share = min(share, (b[wide] / a[wide]).min(initial=1.0))
    return float(min(max(share, 0.01), 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, bins: int = BINS, steps: int = STEPS) -> Additive:
    """Minimise the non-negative risk with logistic loss:
    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))."""
    if not len(positive) or not len(unlabelled):
        return Additive([], np.zeros((1, 1)), prior)
    both = np.concatenate([positive, unlabelled])
    edges = [np.unique(np.quantile(both[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(both.shape[1])]
    model = Additive(edges, np.zeros((len(edges), bins)), prior)
    size = model.weights.size
    p, u = model.bins(positive), model.bins(unlabelled)
    w = np.zeros(size)
    m, v = np.zeros(size), np.zeros(size)

    def slope(rows: np.ndarray, per_row: np.ndarray) -> np.ndarray:
        return np.bincount(rows.reshape(-1), np.repeat(per_row, rows.shape[1]), minlength=size)

    for t in range(1, steps + 1):
        sp, su = 1 / (1 + np.exp(-w[p].sum(1))), 1 / (1 + np.exp(-w[u].sum(1)))
        negative = -np.log(np.maximum(1 - su, 1e-12)).mean() + prior * np.log(np.maximum(1 - sp, 1e-12)).mean()
        g_neg = slope(u, su / len(u)) - prior * slope(p, sp / len(p))
        if negative < 0:        # the risk of the negatives can't be below zero: undo what overfits
            g = -g_neg
        else:
            g = prior * slope(p, (sp - 1) / len(p)) + g_neg
        g += DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
    model.weights = w.reshape(len(edges), bins)
    return model


def _score(model: Additive):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            scores = model.score(x) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])
    return run


def classify(docs: DataFrame, labels: DataFrame, train_on: Column, *, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, score (how likely the label is 1).

    ``train_on``: condition on the id (column ``doc_id``); labels and texts of
    other rows are not learned from.
    """
    ship_package(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "quality")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    x = scratch.write(rows.mapInArrow(_extract, "doc_id long, x array<float>"), "features")
    known = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
             .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull()).where(train_on)
             .groupBy("doc_id").agg(F.max("y").alias("y")))
    n_good, n_known = known.agg(F.count_if(F.col("y") == 1), F.count(F.lit(1))).first()
    prior = n_good / n_known if n_known else 0.5
    usable = x.where(F.col("doc_id").isNotNull()).where(train_on)
    n_all = usable.count()

    def drawn(part: DataFrame, n: int, salt: int) -> np.ndarray:
        """About ``sample`` rows by hash of the id, never more than twice as many."""
        share = min(1.0, sample / max(n, 1))
        got = part.where(F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))) \
            .limit(2 * sample).select("x").toArrow().column("x").combine_chunks()
        return got.flatten().to_numpy(zero_copy_only=False).reshape(len(got), -1) if len(got) else np.zeros((0, 0))

    positive = drawn(usable.join(known.where("y = 1").select("doc_id"), "doc_id"), n_good, 1)
    unlabelled = drawn(usable, n_all, 2)
    if n_good and n_good == n_known and len(positive) and len(unlabelled):
        prior = mixture_share(positive, unlabelled)
    model = fit(positive, unlabelled, prior)
    return x.mapInArrow(_score(model), "doc_id long, score double")
