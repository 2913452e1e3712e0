"""Byte-level BPE encoding by backtracking, and decoding by offset table.

An Aho-Corasick automaton over the vocabulary gives the longest token at a
position. Two neighbouring tokens are compatible when merging their bytes by
rank would leave the boundary between them; a sequence of tokens whose
neighbours are all compatible is the one that the merges produce. The encoder
takes longest tokens from the left, shortens a token that does not fit its
predecessor, and steps back where no token fits; a position once found dead is
never tried again, so the work is linear in the text.

Decoding looks the ids up in one byte string with an offset per id.

Defined cases
  null text       encoded as the empty text
  empty text      no ids, decodes to the empty text
  special tokens  their strings become their ids and decode to their strings
  empty table     an empty result
  other columns   are not read; repeated ids and rows are encoded row by row
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deficit_engine.llm.common import ship_package
from deficit_engine.llm.units import UnitEncoder, binary_column, gather, hold_caches, text_slices

# Fixed value: the public pre-tokenisation pattern of this vocabulary, with its
# white space written out.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
           rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable Latin-1 stays, the rest follows from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


FITS = 300_000      # pairs whose compatibility a worker remembers (about 50 MB)


class PairTable:
    """Vocabulary, merges, and which tokens may stand side by side."""

    def __init__(self, path: str):
        import ahocorasick

        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" \
                or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("not a byte-level BPE vocabulary without prefix space")
        to_byte = {c: b for b, c in enumerate(byte_symbols())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that strip or match whole words are not supported")
        vocab = model["vocab"]
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.text = [b""] * size
        for token, i in vocab.items():
            self.text[i] = bytes(to_byte[c] for c in token)
        self.made, self.left, self.right = {}, [-1] * size, [-1] * size
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            z, x, y = vocab[a + b], vocab[a], vocab[b]
            if k and z <= last:
                raise ValueError("ids must follow the merge ranks")
            last = z
            self.made[x, y], self.left[z], self.right[z] = z, x, y
        self._fits: dict[tuple[int, int], bool] = {}
        # a token that its own bytes do not merge to never occurs
        usable = [False] * size
        for i in sorted(vocab.values()):
            a, b = self.left[i], self.right[i]
            usable[i] = a < 0 or usable[a] and usable[b] and self._keeps_boundary(a, b, i)
        self.automaton = ahocorasick.Automaton()
        self.by_text = {}
        for i in vocab.values():
            if usable[i]:
                s = self.text[i].decode("latin-1")
                self.by_text[s] = i
                self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.length = [len(t) for t in self.text]
        self.shorter = [-1] * size
        for s, i in self.by_text.items():
            self.shorter[i] = next((self.by_text[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.by_text), -1)
        for content, i in self.special.items():
            self.text[i] = content.encode()
        self.offsets = np.zeros(size + 1, np.int64)
        np.cumsum([len(t) for t in self.text], out=self.offsets[1:])
        self.blob = np.frombuffer(b"".join(self.text), np.uint8)

    def _keeps_boundary(self, x: int, y: int, limit: float = float("inf")) -> bool:
        """Undo the merges on both sides of the boundary, latest first. A merge
        across it wins if it ranks before the merge that next used x or y; of
        equal ranks the left one goes first."""
        while True:
            z = self.made.get((x, y))
            if z is not None and z < limit:
                return False
            x_made = x if self.left[x] >= 0 else -1
            y_made = y if self.left[y] >= 0 else -1
            if x_made < 0 and y_made < 0:
                return True
            if x_made > y_made:
                limit, x = x, self.right[x]
            else:
                limit, y = y + 1, self.left[y]

    def fits(self, x: int, y: int) -> bool:
        found = self._fits.get((x, y))
        if found is None:
            if len(self._fits) > FITS:
                self._fits.clear()
            found = self._fits[x, y] = self._keeps_boundary(x, y)
        return found

    def encode_piece(self, s: str) -> list[int]:
        """Ids of one pre-token, given as Latin-1 text of its bytes."""
        whole = self.by_text.get(s)
        if whole is not None:
            return [whole]
        # longest tokens from the left are right for most pieces
        ids = [i for _, i in self.automaton.iter_long(s)]
        for k in range(1, len(ids)):
            if not self.fits(ids[k - 1], ids[k]):
                break
        else:
            return ids
        return self._backtrack(s, ids[:k])

    def _backtrack(self, s: str, ids: list[int]) -> list[int]:
        length, dead = self.length, set()
        at = sum(length[i] for i in ids)
        token = next(self.automaton.iter_long(s, at))[1]
        while True:
            end = at + length[token]
            if end not in dead and (not ids or self.fits(ids[-1], token)):
                ids.append(token)
                if end == len(s):
                    return ids
                at = end
                token = next(self.automaton.iter_long(s, at))[1]
                continue
            token = self.shorter[token]
            if token < 0:  # nothing fits here
                dead.add(at)
                token = ids.pop()
                at -= length[token]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a run of ids."""
        return gather(self.blob, self.offsets, ids)


class Encoder(UnitEncoder):
    """Units are stretches of text that the pre-tokenisation treats alike
    wherever they stand, mostly a word with the space before it."""

    def __init__(self, path: str):
        import regex

        self.table = PairTable(path)
        self.pieces = regex.compile(PATTERN).findall
        # a boundary at a space is only sure where no other white space is beside it
        self.odd = regex.compile(r"\s\s|^\s|\s$|[\x1c-\x1f]").search
        self.cut = regex.compile("|".join(regex.escape(t) for t in self.table.special)).split if self.table.special else None
        self.mark = list(self.table.special)
        super().__init__()

    def units(self, text: str) -> list[str]:
        """Units whose ids, one after another, are the text's."""
        parts = text.split(" ")
        if not self.odd(text):
            return [parts[0], *[" " + p for p in parts[1:]]]
        out, run = [], parts[0]
        for p in parts[1:]:
            if run and not run[-1].isspace() and p and not p[0].isspace():
                out.append(run)
                run = " " + p
            else:
                run += " " + p
        out.append(run)
        return out

    def encode_units(self, units: list[str]) -> list[list[int]]:
        return [self.encode_unit(u) for u in units]

    def encode_unit(self, unit: str) -> list[int]:
        table, out = self.table, []
        for content in self.mark:
            if content in unit:
                break
        else:
            for piece in self.pieces(unit):
                out += table.encode_piece(piece.encode().decode("latin-1"))
            return out
        at = 0
        for part in self.cut(unit):
            for piece in self.pieces(part):
                out += table.encode_piece(piece.encode().decode("latin-1"))
            at += len(part)
            for content in self.mark:
                if unit.startswith(content, at):
                    out.append(table.special[content])
                    at += len(content)
                    break
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(path)


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_caches("bpe", encoder.cache_clear)
        enc = encoder(path)
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids, counts = enc.encode([t or "" for t in part.column("text").to_pylist()])
                raw, ends = enc.table.decode(ids).tobytes(), np.concatenate([[0], np.cumsum(counts)])
                lengths = np.concatenate([[0], np.cumsum(enc.table.offsets[ids + 1] - enc.table.offsets[ids])])[ends]
                # ids need not cut a text at character bounds, so each text is decoded on its own
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(lengths[:-1], lengths[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()),
                     binary_column(ids.astype("<u4"), ends[1:] * 4, pa.large_binary()).cast(pa.binary()),
                     pa.array(texts, pa.string())],
                    ["doc_id", "n_tokens", "ids", "decoded"])
    return run


def encode_and_decode(docs: DataFrame, path: str, *, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (little-endian unsigned
    32-bit integers) and decoded (the text that the ids give back).

    ``path``: the vocabulary file, on every worker.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_round_trip(path), "doc_id long, n_tokens long, ids binary, decoded string")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_caches("bpe", encoder.cache_clear)
        table = encoder(path).table
        for batch in batches:
            texts = [None if b is None else table.decode(np.frombuffer(b, "<u4").astype(np.int64)).tobytes().decode("utf-8", "replace")
                     for b in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "decoded"])
    return run


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """Texts of (doc_id, ids), the ids as ``encode_and_decode`` returns them; null ids give null."""
    ship_package(tokens.sparkSession)
    return tokens.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, decoded string")
