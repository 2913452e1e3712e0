"""Toxicity by a weighted finite-state grammar over clauses.

A text is cut into clauses and each word becomes a symbol: insult, threat,
target, negation, report, quotation mark, other. Small transducers rewrite the
symbols one after another:
  negation   an insult or threat within a few words after a negation is negated
  report     one after a verb of saying, up to the end of its clause, or
             between quotation marks, is reported
  target     one with a target (a person spoken to or of) a few words before it
             or right after it is aimed
  threat     a threat counts only with its target; alone it is another word
They are composed into one deterministic machine, whose table is computed once
on the driver; a run over the words gives the matched events of each clause
with the weights of their words. A clause with any event is a match, scored by
the sum of its events, each word once; words outside matched clauses count for
nothing, and a clause that a text repeats counts once.

The word lists below start the lexicon. Labelled rows extend it: stems (the
first 3 to 8 letters of a word, or all of it) that stand in more toxic than
clean texts become insults, weighted by their log odds less two standard
errors, and the longest stem of a word decides. Their counts come from grouped
aggregation over texts without near copies (of those with the same least hash
of a word pair one counts). How much each
kind of event weighs is fitted by logistic regression, pulled towards the
grammar's own order (aimed, plain, reported, negated). So that the fit does not
trust stems for rows they were learned from, a training row is scored with the
stems of the other folds.

Learned from at most ``SAMPLE`` rows of each label, drawn by hash, and
``LEXICON`` stems; scores cover every whole text.

Defined cases
  null text       scored as the empty text
  empty text      no clause matches: the score is that of any text without a match
  very long text  read whole, clause by clause
  null label      no label; several labels of an id: the largest
  null id         scored, never a training row
  repeated rows   scored row by row; for training an id counts with all its rows
  ties            stems of equal odds: in code-point order
  no labels, or labels of one kind only   the listed words and the grammar's own weights decide
  empty table     an empty result
  other columns   are not read
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deficit_engine.llm.common import Scratch, ship_package
from deficit_engine.llm.units import hold_caches, text_slices

SAMPLE = 10_000         # training rows of each label
LEXICON = 20_000        # learned stems
SHORT, LONG = 3, 8      # letters of a stem
FOLDS = 3
LEAST_ODDS = 0.7        # log odds of a learned stem, less two standard errors
CACHE_WORDS = 400_000   # words whose symbol a worker remembers

# The starting lexicon: words that the grammar knows without labels.
INSULTS = """idiot moron stupid dumb scum trash garbage loser pathetic worthless disgusting clown fool imbecile vermin filth
bastard bitch whore slut cunt asshole dumbass retard jerk creep coward pig parasite subhuman
dumm trottel arschloch abschaum schwein hure idiota imbécil estúpido basura cabrón puta escoria
connard salaud salope ordure crétin débile""".split()
THREATS = """kill hurt destroy murder stab shoot beat burn hang strangle crush attack punish
töten umbringen verletzen matar destruir golpear tuer frapper détruire""".split()
TARGETS = """you your yours yourself u he him his she her they them their these those people
du dich dir euch ihr sie tú te ti usted ustedes ellos tu toi vous ils elles""".split()
NEGATIONS = """not no never neither nor isn't aren't don't doesn't didn't won't can't wasn't nobody
nicht kein keine nie nunca jamás ne pas jamais""".split()
REPORTS = """said says say told wrote writes called calls claimed claims quoted reported according allegedly
sagte schrieb nannte dijo escribió llamó dit écrit appelé""".split()

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”„«»]")
CLAUSE = re.compile(r"[.!?;:\n\r]+")

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)
# marks that the transducers put on an insult or a threat
NEGATED, REPORTED, AIMED = 8, 16, 32
NEGATION_SCOPE, TARGET_BEFORE, TARGET_AFTER = 3, 4, 2
# what an event adds, before any label is seen: aimed, plain, reported, negated insults, then threats likewise
KINDS = ("aimed", "plain", "reported", "negated")
OWN_WEIGHTS = {"aimed": 1.0, "plain": 0.8, "reported": 0.3, "negated": 0.1}
LISTED = 3.0            # what a listed word weighs


# --- transducers -----------------------------------------------------------------

class Transducer:
    """A deterministic machine: step(state, symbol) gives the next state and the
    symbol that is put in place. States are any hashable values."""

    start: tuple = ()

    def step(self, state, symbol: int):
        raise NotImplementedError


def _event(symbol: int) -> bool:
    return symbol & 7 in (INSULT, THREAT)


class Negation(Transducer):
    """State: words left in the scope of the last negation."""
    start = 0

    def step(self, state, symbol):
        if symbol == NEGATION:
            return NEGATION_SCOPE, symbol
        out = symbol | NEGATED if state and _event(symbol) else symbol
        return max(state - 1, 0), out


class Report(Transducer):
    """State: (a verb of saying came before, inside quotation marks)."""
    start = (False, False)

    def step(self, state, symbol):
        said, quoted = state
        if symbol == REPORT:
            return (True, quoted), symbol
        if symbol == QUOTE:
            return (said, not quoted), symbol
        return state, symbol | REPORTED if (said or quoted) and _event(symbol) else symbol


class Target(Transducer):
    """State: words for which the last target still counts. A target that
    follows an event is told by ``Trailing``."""
    start = 0

    def step(self, state, symbol):
        if symbol == TARGET:
            return TARGET_BEFORE, symbol
        return max(state - 1, 0), symbol | AIMED if state and _event(symbol) else symbol


class Trailing(Transducer):
    """Holds an event that is not aimed for a few words, in case a target
    follows: the machine for texts read from right to left. State as in Target."""
    start = 0

    def step(self, state, symbol):
        if symbol == TARGET:
            return TARGET_AFTER, symbol
        return max(state - 1, 0), symbol | AIMED if state and _event(symbol) else symbol


class Threat(Transducer):
    """A threat without a target is another word. One state."""
    start = 0

    def step(self, state, symbol):
        return 0, OTHER if symbol & 7 == THREAT and not symbol & AIMED else symbol


class Composed(Transducer):
    """The output of the first is the input of the second."""

    def __init__(self, first: Transducer, second: Transducer):
        self.first, self.second, self.start = first, second, (first.start, second.start)

    def step(self, state, symbol):
        a, between = self.first.step(state[0], symbol)
        b, out = self.second.step(state[1], between)
        return (a, b), out


def compile_table(machine: Transducer, symbols: range) -> tuple[list[list[int]], list[list[int]]]:
    """Next state and output by [state][symbol] over all states that can be reached; state 0 is the start."""
    number, todo, after, out = {machine.start: 0}, [machine.start], [], []
    for state in todo:
        steps = [machine.step(state, s) for s in symbols]
        for new, _ in steps:
            if new not in number:
                number[new] = len(number)
                todo.append(new)
        after.append([number[new] for new, _ in steps])
        out.append([o for _, o in steps])
    return after, out


class Grammar:
    """The composed machines: one read from the left, and one from the right for
    targets that follow; the second's output goes through the threat rule."""

    def __init__(self):
        self.left = compile_table(Composed(Composed(Negation(), Report()), Target()), range(8))
        self.right = compile_table(Composed(Trailing(), Threat()), range(64))

    def events(self, symbols: list[int]) -> list[tuple[int, int]]:
        """(position, marked symbol) of the insults and threats of a clause."""
        after, out = self.left
        state, marked = 0, []
        for s in symbols:
            marked.append(out[state][s])
            state = after[state][s]
        after, out = self.right
        state, found = 0, []
        for at in range(len(marked) - 1, -1, -1):
            s = marked[at]
            o = out[state][s]
            state = after[state][s]
            if o & 7 in (INSULT, THREAT):
                found.append((at, o))
        return found


def kind(event: int) -> int:
    """Column of an event: negated before reported before aimed before plain; threats follow insults."""
    place = 3 if event & NEGATED else 2 if event & REPORTED else 0 if event & AIMED else 1
    return place + (len(KINDS) if event & 7 == THREAT else 0)


N_KINDS = 2 * len(KINDS)
# Columns: summed weight by kind, matched clauses, heaviest clause, all weight by length, then a one.
N_FEATURES = N_KINDS + 4


def own_weights() -> np.ndarray:
    """Weights of the columns before any label: a single plain insult of a listed word is enough."""
    w = np.zeros(N_FEATURES)
    for k, name in enumerate(KINDS):
        w[k] = w[k + len(KINDS)] = OWN_WEIGHTS[name]
    w[-1] = -1.0
    return w


# --- lexicon ---------------------------------------------------------------------

def stems(word: str) -> Iterator[str]:
    """The stems of a word, longest first; the whole word is marked."""
    yield "=" + word
    for n in range(min(LONG, len(word)), SHORT - 1, -1):
        yield word[:n]


class Lexicon:
    """Symbol and weight of a word: a learned stem, else a listed word."""

    def __init__(self, learned: dict[str, float]):
        self.learned = learned
        self.listed = {w: s for s, words in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS), (INSULT, INSULTS))
                       for w in words}
        self.listed.update(dict.fromkeys("\"“”„«»", QUOTE))
        self.cache: dict[str, tuple[int, float]] = {}

    def look_up(self, word: str) -> tuple[int, float]:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            found = self.cache[word] = self._look_up(word)
        return found

    def _look_up(self, word: str) -> tuple[int, float]:
        listed = self.listed.get(word, OTHER)
        if listed not in (OTHER, INSULT):
            return listed, LISTED if listed == THREAT else 0.0
        for stem in stems(word):
            if stem in self.learned:
                weight = self.learned[stem]
                return (INSULT, weight) if weight > 0 else (OTHER, 0.0)
        return (listed, LISTED) if listed else (OTHER, 0.0)


def features(text: str, lexicon: Lexicon, grammar: Grammar) -> np.ndarray:
    """What the matched clauses of a text add up to."""
    out = np.zeros(N_FEATURES)
    look_up, n_words = lexicon.look_up, 0
    heaviest = clauses = 0
    for clause in dict.fromkeys(map(str.strip, CLAUSE.split(text.lower()))):
        words = WORD.findall(clause)
        n_words += len(words)
        found = [look_up(w) for w in words]
        if not any(weight for _, weight in found):
            continue
        matched, seen = 0.0, set()
        for at, event in grammar.events([s for s, _ in found]):
            if words[at] in seen:
                continue
            seen.add(words[at])
            k = kind(event)
            out[k] += found[at][1]
            matched += found[at][1] * OWN_WEIGHTS[KINDS[k % len(KINDS)]]
        if matched:
            clauses += 1
            heaviest = max(heaviest, matched)
    total = out[:N_KINDS].sum()
    out[N_KINDS:] = clauses, heaviest, 100.0 * total / (n_words + 20), 1.0
    return out


def _squash(x: np.ndarray) -> np.ndarray:
    """Sums and counts grow with the text; their logarithm keeps long texts in reach."""
    return np.concatenate([np.log1p(x[:, :-1]), x[:, -1:]], axis=1)


# --- learning ----------------------------------------------------------------------

def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training rows with the least hash of a word pair, which near copies mostly share."""
    hold_caches("toxicity")
    for batch in batches:
        for part in text_slices(batch, "text"):
            least = []
            for text in part.column("text").to_pylist():
                words = (text or "").lower().split()
                least.append(min((xxhash.xxh3_64_intdigest(f"{a} {b}") for a, b in pairwise(words)), default=0) - (1 << 63))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(least, pa.int64())], [*part.schema.names, "least"])


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stem, fold, toxic texts, clean texts) of a task's rows."""
    hold_caches("toxicity")
    held: dict[int, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for group, counts in held.items():
            fold, y = divmod(group, 2)
            n = pa.array(list(counts.values()), pa.int64())
            none = pa.array([0] * len(counts), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([fold] * len(counts), pa.int32()),
                                              n if y else none, none if y else n], ["stem", "fold", "bad", "good"])
        held.clear()

    for batch in batches:
        for part in text_slices(batch, "text"):
            for text, y, fold in zip(*(part.column(c).to_pylist() for c in ("text", "y", "fold"))):
                own = set()
                for word in set(WORD.findall((text or "").lower())):
                    own.update(stems(word))
                held.setdefault(2 * fold + y, Counter()).update(own)
            if sum(map(len, held.values())) > 500_000:
                yield from flush()
    yield from flush()


def learn_stems(train: DataFrame, scratch: Scratch, n_bad: int, n_good: int) -> list[dict[str, float]]:
    """Learned stems with their log odds: for each fold those of the other folds, then those of all."""
    counts = (train.mapInArrow(_stem_counts, "stem string, fold int, bad long, good long").groupBy("stem")
              .agg(*(F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for c in ("bad", "good") for f in range(FOLDS))))
    bad, good = (sum((F.col(f"{c}{f}") for f in range(1, FOLDS)), F.col(f"{c}0")) for c in ("bad", "good"))
    odds = F.log((bad + 0.5) / (n_bad + 1.0)) - F.log((good + 0.5) / (n_good + 1.0))
    # the odds must be beyond what chance gives a stem of that many texts
    sure = odds - 2 / F.sqrt(bad + 0.5)
    rows = (counts.where(bad >= 3).withColumn("sure", sure).where(F.col("sure") > LEAST_ODDS)
            .orderBy(F.col("sure").desc(), F.col("stem")).limit(LEXICON).collect())
    out = []
    for left_out in [*range(FOLDS), None]:
        share = 1 if left_out is None else (FOLDS - 1) / FOLDS
        learned = {}
        for r in rows:
            b, g = (sum(r[f"{c}{f}"] for f in range(FOLDS) if f != left_out) for c in ("bad", "good"))
            weight = math.log((b + 0.5) / (n_bad * share + 1)) - math.log((g + 0.5) / (n_good * share + 1)) - 2 / math.sqrt(b + 0.5)
            if weight > LEAST_ODDS:
                learned[r["stem"]] = weight
        out.append(learned)
    return out


def _train_features(lexicons: list[dict[str, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_caches("toxicity")
        books, grammar = [Lexicon(x) for x in lexicons], Grammar()
        for batch in batches:
            for part in text_slices(batch, "text"):
                x = [features(t or "", books[f], grammar) for t, f in zip(part.column("text").to_pylist(), part.column("fold").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])
    return run


def fit_weights(x: np.ndarray, y: np.ndarray, bad_share: float, pull: float = 1.0) -> np.ndarray:
    """Logistic regression, weighed to ``bad_share`` of toxic rows, pulled
    towards the grammar's own weights (Newton steps with halving)."""
    prior = own_weights()
    if not len(x) or y.min() == y.max():
        return prior
    x = _squash(x)
    share = np.where(y == 1, bad_share / y.mean(), (1 - bad_share) / (1 - y.mean()))
    # no pull on the constant; the scale of a column does not matter to it
    scale = np.maximum(x.std(0), 1e-3) ** 2
    scale[-1] = 0.0

    def risk(w):
        z = x @ w
        return (share * (np.logaddexp(0, z) - y * z)).sum() + pull * (scale * (w - prior) ** 2).sum() / 2

    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - y)) + pull * scale * (w - prior)
        bend = (x * (share * p * (1 - p))[:, None]).T @ x + np.diag(pull * scale + 1e-6)
        step, size = np.linalg.solve(bend, slope), 1.0
        while size > 1e-4 and risk(w - size * step) > risk(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def _score(learned: dict[str, float], weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_caches("toxicity")
        lexicon, grammar = Lexicon(learned), Grammar()
        for batch in batches:
            for part in text_slices(batch, "text"):
                x = np.array([features(t or "", lexicon, grammar) for t in part.column("text").to_pylist()])
                z = _squash(x) @ weights
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))),
                                                  pa.array(x[:, N_KINDS].astype(np.int64))], ["doc_id", "score", "matched_clauses"])
    return run


def classify(docs: DataFrame, labels: DataFrame, train_on: Column, *, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, score (how likely the label is 1), matched_clauses.

    ``train_on``: condition on the id (column ``doc_id``); labels and texts of
    other rows are not learned from.
    """
    ship_package(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = scratch.write(labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
                          .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull()).where(train_on)
                          .groupBy("doc_id").agg((F.max("y") > 0).cast("int").alias("y")), "labels")
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    draw = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30))
    share = F.when(F.col("y") == 1, sample / max(totals.get(1, 0), 1)).otherwise(sample / max(totals.get(0, 0), 1))
    drawn = known.where(draw < share * (1 << 30)).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS)).cast("int"))
    texts = rows.join(drawn, "doc_id").select("doc_id", "text", "y", "fold")
    train = scratch.write(texts.mapInArrow(_signatures, "doc_id long, text string, y int, fold int, least long")
                          .groupBy("y", "least").agg(F.min(F.struct("doc_id", "text", "fold")).alias("one")).select("one.text", "y", "one.fold"), "train")
    counts = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    if len(counts) == 2:
        lexicons = learn_stems(train, scratch, counts[1], counts[0])
        seen = train.mapInArrow(_train_features(lexicons[:FOLDS]), "y int, x array<double>").toArrow()
        x = seen.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
        weights = fit_weights(x, seen.column("y").to_numpy(), totals[1] / (totals[0] + totals[1]))
        learned = lexicons[-1]
    else:
        weights, learned = own_weights(), {}
    return rows.mapInArrow(_score(learned, weights), "doc_id long, score double, matched_clauses long")
