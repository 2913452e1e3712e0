"""Token-id files: blocks of ids under an adaptive context-mixing range coder.

A block holds whole documents, about ``BLOCK_IDS`` ids (a longer document is a
block of its own). It starts from a fresh model, carries checksums, and is
read without any other block, so a lost block costs only its own documents and
tasks can read any of them.

Inside a block the ids are cut into lanes of consecutive ids that are coded
side by side, one id of every lane at a step; all lanes share the model, which
learns from a step before the next one. Three predictions drive the coder:
the id that last followed the two ids before (order 2), the one before
(order 1), and the frequencies of the block so far (order 0). How much of the
range each gets is learned for every pair of confidences, which is the mixing.
A 64-bit carry-free range coder writes 16-bit words.

The files are a Parquet table of blocks (part, block, first, n_ids, n_docs,
payload): Spark's commit protocol makes writing safe against lost executors,
and blocks can be read in any number of tasks.

Defined cases
  null or empty text   only the end id
  null document id     written first
  repeated rows        kept, one after the other
  empty table          an empty table of blocks
  other columns        are not read
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import category, normalize

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deficit_engine.llm.common import ship_package
from deficit_engine.llm.units import UnitEncoder, binary_column, hold_caches, text_slices

MAGIC, VERSION = b"TIDB", 1
HEADER = struct.Struct("<4sHHIIIII")    # magic, version, flags, ids, documents, id bound, lanes, crc of the ids
CHECK = struct.Struct("<I")             # crc of all that stands before and after it
BLOCK_IDS = 1 << 20
LANES, LANE_IDS = 16384, 64             # most lanes, and the fewest ids of a lane
END_ID = 1
BLOCK_SCHEMA = "part int, block int, first long, n_ids long, n_docs long, payload binary"

_U = np.uint64
_TOP, _LOW = _U(1 << 48), _U(1 << 32)
_W, _HIGH = _U(16), _U(48)
_MASK = _U((1 << 32) - 1)
# next confidence after a miss (0 to 15) and a hit (16 to 31)
_SURER = np.array([*(max(s, 1) - 1 for s in range(16)), *(min(s + 1, 15) for s in range(16))], np.uint8)


class _Model:
    """What a block has shown so far; coder and decoder update it alike."""

    def __init__(self, bound: int):
        self.next1, self.sure1 = np.zeros(bound + 1, np.int32), np.zeros(bound + 1, np.uint8)
        self.next2, self.sure2 = np.zeros(1 << 18, np.int32), np.zeros(1 << 18, np.uint8)
        self.mix = np.tile(np.array([2, 1, 1], np.int64), (256, 1))
        self.seen = np.ones(bound, np.int64)
        self.bound = bound
        self._sum()
        self._shares()

    def _shares(self) -> None:
        """Start and size of each outcome's share of the range, and all of it, for every context."""
        size = self.mix.astype(_U)
        self.total, self.size = size.sum(1), size.reshape(-1)
        self.upto = np.cumsum(size, 1, dtype=_U)
        self.start = (self.upto - size).reshape(-1)

    def _sum(self) -> None:
        self.below = np.zeros(self.bound + 1, np.int64)
        np.cumsum(self.seen, out=self.below[1:])

    def predict(self, last: np.ndarray, before: np.ndarray):
        """Slots, predictions and the mixing context of every lane."""
        at2 = ((last * 0x9E3779B1 + before * 0x85EBCA6B) >> 7) & 0x3FFFF
        p2, s2, p1, s1 = self.next2[at2], self.sure2[at2], self.next1[last], self.sure1[last]
        return at2, p2, s2, p1, s1, s2.astype(np.int64) * 16 + s1

    def learn(self, ids, last, state, drawn) -> None:
        """``drawn``: three times the mixing context, and the outcome."""
        at2, p2, s2, p1, s1, _ = state
        for table, sure, at, p, s in ((self.next2, self.sure2, at2, p2, s2), (self.next1, self.sure1, last, p1, s1)):
            hit = ids == p
            table[at] = np.where(hit | (s > 0), p, ids)
            sure[at] = _SURER[s + (hit.view(np.uint8) << 4)]
        self.mix += 8 * np.bincount(drawn, minlength=768).reshape(256, 3)
        if self.mix.max() > 1 << 22:
            self.mix = (self.mix >> 1) + 1
        self._shares()
        self.seen += 8 * np.bincount(ids, minlength=self.bound)
        if self.below[-1] + 8 * len(ids) > 1 << 23:
            self.seen = (self.seen + 1) >> 1
        self._sum()


def _lanes(n: int) -> tuple[int, int]:
    """Number of lanes and ids of a lane (the last may be shorter)."""
    each = max(LANE_IDS, -(-n // LANES))
    return -(-n // each), each


def encode_ids(ids: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of all lanes, one lane after another, and the number of words of each."""
    n = len(ids)
    lanes, each = _lanes(n)
    grid = np.zeros(lanes * each, np.int64)
    grid[:n] = ids
    grid = grid.reshape(lanes, each).T
    low, span = np.zeros(lanes, _U), np.full(lanes, ~_U(0), _U)
    model, at_out, out = _Model(bound), [], []

    def narrow(which, start, freq, total):
        r = span[which] // total
        lo, sp = low[which] + r * start, r * freq
        base = which if isinstance(which, np.ndarray) else np.arange(which.stop)
        live = None
        while True:
            same = (lo ^ (lo + sp)) < _TOP
            move = np.flatnonzero(same | (sp < _LOW))
            if live is None:
                low[which], span[which] = lo, sp
            if not len(move):
                return
            l2, s2 = lo[move], sp[move]
            s2 = np.where(same[move], s2, (_U(0) - l2) & _MASK)
            base = base[move]
            at_out.append(base.astype(np.uint16))
            out.append((l2 >> _HIGH).astype(np.uint16))
            lo, sp = l2 << _W, s2 << _W
            low[base], span[base] = lo, sp
            live = True

    last = before = np.zeros(lanes, np.int64)
    for step in range(each):
        active = lanes if (lanes - 1) * each + step < n else lanes - 1
        if active < len(last):
            last, before = last[:active], before[:active]
        own = grid[step, :active]
        state = model.predict(last, before)
        outcome = np.where(own == state[1], 0, np.where(own == state[3], 1, 2))
        drawn = state[5] * 3 + outcome
        narrow(slice(0, active), model.start[drawn], model.size[drawn], model.total[state[5]])
        rest = np.flatnonzero(outcome == 2)
        if len(rest):
            k = own[rest]
            narrow(rest, model.below[k].astype(_U), model.seen[k].astype(_U), _U(model.below[-1]))
        model.learn(own, last, state, drawn)
        before, last = last, own
    end = ((low + _MASK) >> _U(32))
    every = np.arange(lanes).astype(np.uint16)
    at_out += [every, every]
    out += [(end >> _W).astype(np.uint16), (end & _U(0xFFFF)).astype(np.uint16)]
    at = np.concatenate(at_out)
    order = np.argsort(at, kind="stable")
    return np.concatenate(out)[order], np.bincount(at, minlength=lanes)


def decode_ids(words: np.ndarray, counts: np.ndarray, n: int, bound: int) -> np.ndarray:
    lanes, each = _lanes(n)
    grid = np.zeros((each, lanes), np.int64)
    ends = np.cumsum(counts)
    at = ends - counts
    words = np.concatenate([words, np.zeros(1, np.uint16)]).astype(_U)
    nothing = len(words) - 1

    def word(lane):
        p = at[lane]
        at[lane] = p + 1
        return words[np.where(p < ends[lane], p, nothing)]

    low, span, code = np.zeros(lanes, _U), np.full(lanes, ~_U(0), _U), np.zeros(lanes, _U)
    everyone = np.arange(lanes)
    for _ in range(4):
        code = (code << _W) | word(everyone)
    model = _Model(bound)

    def narrow(which, r, start, freq):
        lo, sp, co = low[which] + r * start, r * freq, code[which]
        low[which], span[which] = lo, sp
        base = which if isinstance(which, np.ndarray) else np.arange(which.stop)
        while True:
            same = (lo ^ (lo + sp)) < _TOP
            move = np.flatnonzero(same | (sp < _LOW))
            if not len(move):
                return
            l2, s2 = lo[move], sp[move]
            s2 = np.where(same[move], s2, (_U(0) - l2) & _MASK)
            base = base[move]
            lo, sp, co = l2 << _W, s2 << _W, (co[move] << _W) | word(base)
            low[base], span[base], code[base] = lo, sp, co

    last = before = np.zeros(lanes, np.int64)
    for step in range(each):
        active = lanes if (lanes - 1) * each + step < n else lanes - 1
        if active < len(last):
            last, before = last[:active], before[:active]
        which = slice(0, active)
        state = model.predict(last, before)
        total = model.total[state[5]]
        r = span[which] // total
        value = np.minimum((code[which] - low[which]) // r, total - _U(1))
        outcome = (value >= model.upto[:, 0][state[5]]).astype(np.int64) + (value >= model.upto[:, 1][state[5]])
        drawn = state[5] * 3 + outcome
        narrow(which, r, model.start[drawn], model.size[drawn])
        own = np.where(outcome == 0, state[1], state[3]).astype(np.int64)
        rest = np.flatnonzero(outcome == 2)
        if len(rest):
            total = _U(model.below[-1])
            r = span[rest] // total
            value = np.minimum((code[rest] - low[rest]) // r, total - _U(1)).astype(np.int64)
            k = np.searchsorted(model.below, value, "right") - 1
            narrow(rest, r, model.below[k].astype(_U), model.seen[k].astype(_U))
            own[rest] = k
        model.learn(own, last, state, drawn)
        grid[step, :active] = own
        before, last = last, own
    return grid.T.reshape(-1)[:n]


def pack_block(doc_ids: np.ndarray, missing: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A block: header, ids of the documents and which are null, ids of each, words of each lane, words."""
    bound = int(ids.max()) + 1 if len(ids) else 1
    words, lane_words = encode_ids(ids, bound) if len(ids) else (np.zeros(0, np.uint16), np.zeros(0, np.int64))
    body = b"".join([doc_ids.astype("<i8").tobytes(), missing.astype(np.uint8).tobytes(), counts.astype("<u4").tobytes(),
                     lane_words.astype("<u4").tobytes(), words.astype("<u2").tobytes()])
    header = HEADER.pack(MAGIC, VERSION, 0, len(ids), len(doc_ids), bound, len(lane_words),
                         zlib.crc32(ids.astype("<u4").tobytes()))
    return header + CHECK.pack(zlib.crc32(body, zlib.crc32(header))) + body


def unpack_block(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, which are null, ids of each document, and all ids. Raises ValueError on damage."""
    if len(payload) < HEADER.size + CHECK.size:
        raise ValueError("block is cut short")
    magic, version, _, n, docs, bound, lanes, crc_ids = HEADER.unpack_from(payload)
    body = memoryview(payload)[HEADER.size + CHECK.size:]
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token-id block")
    if zlib.crc32(body, zlib.crc32(payload[:HEADER.size])) != CHECK.unpack_from(payload, HEADER.size)[0]:
        raise ValueError("block does not match its checksum")
    at = 0

    def part(kind, count):
        nonlocal at
        out = np.frombuffer(body, kind, count, at)
        at += out.nbytes
        return out

    doc_ids, missing, counts = part("<i8", docs), part(np.uint8, docs), part("<u4", docs).astype(np.int64)
    lane_words = part("<u4", lanes).astype(np.int64)
    ids = decode_ids(part("<u2", int(lane_words.sum())), lane_words, n, bound) if n else np.zeros(0, np.int64)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc_ids:
        raise ValueError("decoded ids do not match their checksum")
    return doc_ids, missing.astype(bool), counts, ids


def _kind(char: str) -> int:
    """1 space, 2 letter, 3 number, 4 other sign; 0 where case, contractions, special tokens or white space need the library alone."""
    if char in "'<\u0130" or category(char)[0] in "CZ" and char != " ":
        return 0
    return {"Z": 1, "L": 2, "N": 3}.get(category(char)[0], 4)


# below U+0250 no character is changed by or combines under NFC
_KINDS = np.array([*map(_kind, map(chr, range(0x250))), 0], np.uint8)


def _pieces(text: str, units: int) -> np.ndarray:
    """Number of pieces that the vocabulary's pattern cuts each unit of a text into; 0 where it can't be told here."""
    kinds = _KINDS[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 0x250)]
    unit = np.cumsum(kinds == 1)
    first = (kinds > 1) & ((kinds == 3) | (kinds != np.concatenate([[1], kinds[:-1]])))
    pieces = np.bincount(unit[first], minlength=units)
    pieces[unit[kinds == 0]] = 0
    return pieces


class WordEncoder(UnitEncoder):
    """Ids as the tokenizers library gives them. Its vocabulary drops white
    space and never joins across it, so words between ASCII white space are
    encoded once and their ids kept."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if not (steps and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
                and r"\s" not in steps[0]["pattern"]["Regex"].replace(r"[^\s", "")):
            raise ValueError("this vocabulary does not drop white space")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t["content"].lower().encode() for t in spec["added_tokens"]]
        suffix = spec["model"]["end_of_word_suffix"]
        self.ends_word = np.zeros(self.library.get_vocab_size() + 1, bool)
        self.ends_word[[i for t, i in spec["model"]["vocab"].items() if suffix and t.endswith(suffix)]] = True
        super().__init__()

    def units(self, text: str) -> list[bytes]:
        raw = text.encode()
        # the vocabulary is in lower case; only the strings of special tokens are told apart by case, and
        # capitals under combining marks (lead byte CC): some form one character in lower case alone
        low = raw.lower()
        return (raw if b"\xcc" in raw or any(t in low for t in self.special) else low).split()

    def encode_new(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The library sees many units as one text. Each piece of a unit (letters,
        one digit, other characters) ends with an id that ends a word, so the ids
        are dealt to the units by their numbers of pieces, where these are plain."""
        found = []
        for at in range(0, len(units), 2000):
            some = units[at:at + 2000]
            pieces = _pieces(b" ".join(some).decode(), len(some))
            plain = np.flatnonzero(pieces)
            text = " ".join([some[i].decode() for i in plain])
            ids = self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids
            ids = np.array(ids, np.int32)
            ends, upto = np.flatnonzero(self.ends_word[ids]) + 1, np.cumsum(pieces[plain])
            if not len(plain) or len(ends) != upto[-1]:
                plain, ids = plain[:0], ids[:0]
            own = np.zeros(len(some), np.int64)
            own[plain] = np.diff(ends[upto - 1], prepend=0) if len(plain) else 0
            other = np.ones(len(some), bool)
            other[plain] = False
            if other.any():
                words = [some[i].decode() for i in np.flatnonzero(other)]
                by_word = self.library_ids(words)
                own[other] = [len(by_word[w]) for w in words]
                both, where = np.empty(own.sum(), np.int32), np.repeat(other, own)
                both[~where], both[where] = ids, [i for w in words for i in by_word[w]]
                ids = both
            found.append((ids, own))
        return np.concatenate([ids for ids, _ in found]), np.concatenate([own for _, own in found])

    def library_ids(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of each word. Words of letters alone are one piece each, whose
        last id is one that ends a word, so many are encoded as one text."""
        plain = [w for w in words if w.isalpha() and normalize("NFC", w).lower() == w]
        out = {}
        for at in range(0, len(plain), 2000):
            some = plain[at:at + 2000]
            ids = self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(some):
                starts = [0, *ends[:-1].tolist()]
                out.update({w: ids[i:j] for w, i, j in zip(some, starts, ends.tolist())})
        rest = [w for w in words if w not in out]
        out.update({w: e.ids for w, e in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False))})
        return out


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _write_blocks(path: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_caches("token_files", word_encoder.cache_clear)
        enc, part = word_encoder(path), TaskContext.get().partitionId()
        docs, missing, counts, ids = [], [], [], []
        held = first = block = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, first, block, docs, missing, counts, ids
            each, n_docs = np.concatenate(counts), sum(map(len, docs))
            payload = pack_block(np.concatenate(docs), np.concatenate(missing), each, np.concatenate(ids))
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()),
                 pa.array([held], pa.int64()), pa.array([n_docs], pa.int64()), pa.array([payload], pa.binary())],
                ["part", "block", "first", "n_ids", "n_docs", "payload"])
            first, block, held = first + held, block + 1, 0
            docs, missing, counts, ids = [], [], [], []
            return out

        for batch in batches:
            for rows in text_slices(batch, "text"):
                flat, own = enc.encode([t or "" for t in rows.column("text").to_pylist()])
                flat = np.insert(flat, np.cumsum(own), end_id)
                own = own + 1
                names = rows.column("doc_id")
                name, none = names.fill_null(0).to_numpy(zero_copy_only=False), names.is_null().to_numpy(zero_copy_only=False)
                ends = np.cumsum(own)
                at = 0
                while at < len(own):
                    done = int(ends[at - 1]) if at else 0
                    stop = max(at + (not held), int(np.searchsorted(ends, done + block_ids - held, "right")))
                    if stop > at:
                        docs.append(name[at:stop])
                        missing.append(none[at:stop])
                        counts.append(own[at:stop])
                        ids.append(flat[done:ends[stop - 1]])
                        held += int(ends[stop - 1]) - done
                    if stop < len(own) or held >= block_ids:
                        yield flush()
                    at = stop
        if held:
            yield flush()
    return run


def write_token_blocks(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text",
                       end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all documents, in ascending id order, to token-id files under ``path``."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(_write_blocks(tokenizer, end_id, block_ids), BLOCK_SCHEMA)
     .write.option("compression", "none").parquet(path))


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hold_caches("token_files", word_encoder.cache_clear)
    for batch in batches:
        for start, payload in zip(batch.column("start").to_pylist(), batch.column("payload")):
            names, none, counts, ids = unpack_block(payload.as_py())
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64(), mask=none), pa.array(start + ends - counts, pa.int64()), pa.array(counts, pa.int64()),
                 binary_column(ids.astype("<u4"), ends * 4, pa.large_binary()).cast(pa.binary())],
                ["doc_id", "start", "n_tokens", "ids"])


def read_token_blocks(spark, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents
    before it), n_tokens, ids (little-endian unsigned 32-bit integers).

    Only one row per written partition is summed up to place the partitions.
    """
    ship_package(spark)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
             .select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    placed = blocks.join(F.broadcast(parts), F.col("part") == F.col("p"))
    return (placed.select((F.col("offset") + F.col("first")).alias("start"), "payload")
            .mapInArrow(_read_blocks, "doc_id long, start long, n_tokens long, ids binary"))
