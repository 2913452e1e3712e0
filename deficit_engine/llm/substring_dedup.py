"""Repeated passages removed with sharded Aho-Corasick automata.

A window is ``WINDOW`` consecutive words; every word covered by a window that
also starts earlier (smaller id, or same document and earlier start) goes.

Confirm  Every window has an anchor, the run of ``GRAM`` words in it with the
         least hash; equal windows have equal anchors. An anchor hash that
         occurs once rules its windows out. A recurring anchor is owned by the
         first document that has it, which therefore holds the first occurrence
         of each of its own windows with that anchor.
Compile  The candidate passages of all documents go to the shards of the
         anchors' owners. A shard compiles the owner's passages, all windows in
         them, into an automaton over word symbols.
Stream   The shard's other passages are streamed through the automaton; every
         hit is an occurrence after the owner's. Windows of a shard that its
         owner does not have (both copies changed the same way) are reduced to
         their first occurrence by a grouped minimum over window hashes.

An owner whose passages recur in a large part of the corpus has its shard
split; its own passages, one document's, go to each part. Counting and joining
by anchor are a partially aggregated count and a many-to-one join that can be
split, so no hot passage ends up in one task. Word sequences are compared as
words in the automata, and by 64-bit hashes elsewhere.

Defined cases
  null or empty text   no words, nothing removed
  fewer than WINDOW words   nothing removed
  null id              sorts before all ids
  repeated rows        rows with one id are one document: an occurrence at the
                       same start of another row of it is not earlier
  empty table          an empty result
  other columns        are not read
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deficit_engine.llm.common import Scratch, ship_package
from deficit_engine.llm.units import CACHE_UNITS, hold_caches, text_slices

WINDOW, GRAM = 20, 8
SHARD_ANCHORS = 5_000      # anchor occurrences of an owner that make one part of its shard
AUTOMATON_WORDS = 200_000   # words compiled into one automaton
NO_ID = -(1 << 63)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_WORDS = WordHashes()


def hold_words() -> None:
    """Keep the cache of word hashes in this worker, and no other operator's."""
    hold_caches("words", _WORDS.clear)


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_WORDS) > CACHE_UNITS:
        _WORDS.clear()
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words."""
    n = max(len(words) - k + 1, 0)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) ^ words[j:n + j]
        h ^= h >> np.uint64(29)
    return h


def anchors(words: np.ndarray, doc: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """(hash, document, first window, last window) for the anchors of all windows.

    ``words``: word hashes of several documents, ``doc`` the number of each
    word's document; windows are given as starts in ``words``.
    """
    n = len(words) - window + 1
    if n <= 0:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    grams = gram_hashes(words, gram)
    least, at = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window - gram + 1):
        lower = grams[j:n + j] < least
        least[lower] = grams[j:n + j][lower]
        at[lower] = j
    start = np.flatnonzero(doc[:n] == doc[window - 1:])
    place = start + at[start]
    # windows with one anchor follow each other
    new = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(start) != 1)])) if len(start) else start
    last = np.concatenate([new[1:], [len(start)]])[:len(new)] - 1
    return least[start[new]], doc[start[new]], start[new], start[last]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hold_words()
    for batch in batches:
        for part in text_slices(batch, "text"):
            texts = [(t or "").encode().split() for t in part.column("text").to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int64)
            doc = np.repeat(np.arange(len(texts)), sizes)
            begin = np.cumsum(sizes) - sizes
            words = np.concatenate([word_hashes(t) for t in texts]) if texts else np.zeros(0, np.uint64)
            h, d, a, b = anchors(words, doc)
            rid, name = (part.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "name"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.astype(np.int64)), pa.array(rid[d]), pa.array(name[d]), pa.array((a - begin[d]).astype(np.int32)),
                 pa.array((b - begin[d]).astype(np.int32))], ["hash", "rid", "name", "a", "b"])


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Normalised text and candidate passages: windows of one owner that follow each other."""
    for batch in batches:
        for part in text_slices(batch, "text"):
            kept, sizes, found = [], [], []
            for text, marks in zip(part.column("text").to_pylist(), part.column("marks").to_pylist()):
                words = (text or "").encode().split()
                kept.append(b" ".join(words).decode())
                sizes.append(len(words))
                runs = []
                for m in sorted(marks or (), key=lambda m: m["a"]):
                    if runs and runs[-1][0] == m["owner"] and runs[-1][3] + 1 >= m["a"]:
                        runs[-1][3] = max(runs[-1][3], m["b"])
                    else:
                        runs.append([m["owner"], m["parts"], m["a"], m["b"]])
                found.append([{"owner": o, "parts": p, "start": a, "text": b" ".join(words[a:b + WINDOW]).decode()} for o, p, a, b in runs] or None)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("doc_id", "name", "rid")), pa.array(sizes, pa.int64()), pa.array(kept, pa.string()),
                 pa.array(found, pa.list_(pa.struct([("owner", pa.int64()), ("parts", pa.int32()), ("start", pa.int32()), ("text", pa.string())])))],
                ["doc_id", "name", "rid", "n_words", "kept", "passages"])


PASSAGE_SCHEMA = ("doc_id long, name long, rid long, n_words long, kept string, "
                  "passages array<struct<owner: long, parts: int, start: int, text: string>>")


class Automaton:
    """The windows of one document's passages, with the first start of each."""

    def __init__(self, passages: list[tuple[int, list[bytes]]]):
        import ahocorasick

        self.symbols: dict[bytes, str] = {}
        self.trie = ahocorasick.Automaton()
        for start, words in passages:
            for w in words:
                if w not in self.symbols:
                    code = len(self.symbols) + 1
                    self.symbols[w] = chr(code if code < 0xD800 else code + 0x800)
            text = self.spell(words)
            for i in range(len(text) - WINDOW + 1):
                key = text[i:i + WINDOW]
                if key not in self.trie:
                    self.trie.add_word(key, start + i)
        self.trie.make_automaton()

    def spell(self, words: list[bytes]) -> str:
        return "".join([self.symbols.get(w, "\0") for w in words])

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(offset, first start in the document) of every window that the document has."""
        for end, first in self.trie.iter(self.spell(words)):
            yield end - WINDOW + 1, first


def compile_passages(passages: list[tuple[int, list[bytes]]], most: int = AUTOMATON_WORDS) -> list[Automaton]:
    """Automata of at most ``most`` words each; passages are cut with an overlap that loses no window."""
    pieces = [(start + i, words[i:i + most]) for start, words in sorted(passages)
              for i in range(0, max(len(words) - WINDOW + 1, 1), most - WINDOW + 1)]
    out, held, size = [], [], 0
    for piece in pieces:
        if held and size + len(piece[1]) > most:
            out.append(Automaton(held))
            held, size = [], 0
        held.append(piece)
        size += len(piece[1])
    return [*out, Automaton(held)] if held else out


def _judge(row: dict, automata: list[Automaton], out: dict[str, list]) -> None:
    """Windows of a passage that the owner has earlier, and those that it lacks."""
    words, start = row["text"].encode().split(b" "), row["start"]
    mine = row["name"] == row["owner"]
    seen, gone = set(), set()
    for automaton in automata:
        for i, first in automaton.find(words):
            seen.add(i)
            # each automaton knows the first start in its own passages only: one that is not earlier says nothing
            if not mine or first < start + i:
                gone.add(start + i)
    rest = [i for i in range(len(words) - WINDOW + 1) if i not in seen]
    if gone or rest:
        out["rid"].append(row["rid"])
        out["name"].append(row["name"])
        out["gone"].append(sorted(gone))
        out["rest"].append([start + i for i in rest])
        out["rest_hash"].append([xxhash.xxh3_64_intdigest(b" ".join(words[i:i + WINDOW])) - (1 << 63) for i in rest])


LOCATED = pa.schema([("rid", pa.int64()), ("name", pa.int64()), ("gone", pa.list_(pa.int32())),
                     ("rest", pa.list_(pa.int32())), ("rest_hash", pa.list_(pa.int64()))])


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (owner, part), the owner's passages first. Only these are held."""
    hold_caches("automata")
    shard, own, automata = None, [], None
    out: dict[str, list] = {name: [] for name in LOCATED.names}

    def compiled() -> list[Automaton]:
        found = compile_passages([(r["start"], r["text"].encode().split(b" ")) for r in own])
        if shard[1] == 0:  # in one part of the shard the owner's repeats of itself are looked for
            for r in own:
                _judge(r, found, out)
        return found

    for batch in batches:
        for row in batch.to_pylist():
            if (row["owner"], row["part"]) != shard:
                if own and automata is None:
                    compiled()
                shard, own, automata = (row["owner"], row["part"]), [], None
            if row["own"]:
                own.append(row)
            else:
                automata = compiled() if automata is None else automata
                _judge(row, automata, out)
        yield pa.RecordBatch.from_pydict(out, LOCATED)
        out.update({name: [] for name in LOCATED.names})
    if own and automata is None:
        compiled()
    yield pa.RecordBatch.from_pydict(out, LOCATED)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, removed = [], []
        for text, n, lists in zip(batch.column("kept").to_pylist(), batch.column("n_words").to_pylist(), batch.column("gone").to_pylist()):
            if not lists:
                kept.append(text)
                removed.append(0)
                continue
            starts = np.unique(np.concatenate([np.asarray(x, np.int64) for x in lists]))
            edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + WINDOW, minlength=n + 1)
            stay = np.cumsum(edge)[:n] == 0
            words = text.encode().split(b" ")
            kept.append(b" ".join([w for w, s in zip(words, stay) if s]).decode())
            removed.append(int(n - stay.sum()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                                         ["doc_id", "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (the words
    that stay, joined by one space)."""
    ship_package(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "substring")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # rid tells rows with one id and different texts apart
    rows = rows.withColumn("name", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("rid", F.xxhash64("doc_id", "text"))
    marks = scratch.write(rows.select("rid", "name", "text").mapInArrow(_anchor_rows, "hash long, rid long, name long, a int, b int"), "anchors")
    repeated = scratch.write(marks.groupBy("hash").agg(F.min("name").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
    weight = repeated.groupBy("owner").agg(F.ceil(F.sum("n") / F.lit(SHARD_ANCHORS)).cast("int").alias("parts"))
    owned = scratch.write(repeated.join(weight, "owner").select("hash", "owner", "parts"), "owned")
    # written before the texts are moved, so that what the anchors took is free by then
    candidates = scratch.write(marks.join(owned, "hash").groupBy("rid")
                               .agg(F.collect_set(F.struct("a", "b", "owner", "parts")).alias("marks")), "candidates")
    scratch.drop("anchors", "repeated", "owned")
    texts = scratch.write(rows.join(candidates, "rid", "left").select("doc_id", "name", "rid", "text", "marks")
                          .mapInArrow(_passages, PASSAGE_SCHEMA), "passages")
    scratch.drop("candidates")
    each = (texts.where(F.col("passages").isNotNull())
            .select("rid", "name", F.size("passages").alias("count"), F.posexplode("passages").alias("at", "p"))
            .select("rid", "name", "p.*", (F.col("name") == F.col("p.owner")).alias("own")))
    mine = each.where("own").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    others = each.where("not own").withColumn("part", F.pmod("rid", F.col("parts")).cast("int"))
    shards = mine.unionByName(others).select("owner", "part", "own", "rid", "name", "start", "text")
    located = scratch.write(
        shards.repartition("owner", "part").sortWithinPartitions("owner", "part", F.desc("own"), "start")
        .mapInArrow(_locate, "rid long, name long, gone array<int>, rest array<int>, rest_hash array<long>"), "located")
    left = (located.where(F.size("rest") > 0).select("rid", "name", F.explode(F.arrays_zip("rest_hash", "rest")).alias("w"))
            .select("rid", "name", F.col("w.rest_hash").alias("hash"), F.col("w.rest").alias("start")))
    first = left.groupBy("hash").agg(F.min(F.struct("name", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("hash", "first")
    later = (left.join(first, "hash").where(F.struct("name", "start") > F.col("first"))
             .groupBy("rid").agg(F.collect_set("start").alias("gone")))
    gone = (located.where(F.size("gone") > 0).select("rid", "gone").unionByName(later)
            .groupBy("rid").agg(F.collect_list("gone").alias("gone")))
    return (texts.select("doc_id", "rid", "n_words", "kept").join(gone, "rid", "left").select("doc_id", "n_words", "kept", "gone")
            .mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_text string"))
