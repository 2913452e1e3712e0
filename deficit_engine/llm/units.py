"""Texts encoded through the distinct units that they repeat, and Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20       # text handled at once
CACHE_UNITS = 450_000       # distinct units kept by a worker (about 100 MB); the cache restarts beyond

_HELD: dict[str, Callable[[], None]] = {}
# glibc keeps freed memory of small objects until it is asked for it
_trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def hold_caches(owner: str, release: Callable[[], None] = lambda: None) -> None:
    """Worker processes are used again by later stages. The caches of one
    operator are kept from task to task; when another operator starts in the
    process they are released, so that they never add up, and the memory goes
    back to the system: an idle worker would hold it beside its JVM."""
    others = [name for name in _HELD if name != owner]
    for other in others:
        _HELD.pop(other)()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        _trim(0)
    _HELD[owner] = release


def gather(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """values[offsets[r]:offsets[r + 1]] of all rows r, one after another."""
    starts = offsets[rows]
    counts = offsets[rows + 1] - starts
    ends = np.cumsum(counts)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1])]


class UnitCodes(dict):
    """Numbers units in order of first use and remembers the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        code = self[unit] = len(self)
        self.new.append(unit)
        return code


class UnitEncoder:
    """Encodes texts unit by unit. Units repeat, so their ids are kept in one
    array with an offset per unit, and a text is gathered from it."""

    def __init__(self):
        self.reset()

    def units(self, text: str) -> list:
        """Units whose ids, one after another, are the text's."""
        raise NotImplementedError

    def encode_units(self, units: list) -> list[list[int]]:
        raise NotImplementedError

    def encode_new(self, units: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, one after another, and the number of ids of each."""
        new = self.encode_units(units)
        return np.fromiter((i for unit in new for i in unit), np.int32), np.fromiter(map(len, new), np.int64, len(new))

    def reset(self) -> None:
        self.codes = UnitCodes()
        self.flat = np.zeros(1 << 20, np.int32)
        self.offsets = np.zeros(1 << 16, np.int64)
        self.known = 0
        self.used = np.zeros(0, np.int64)

    def make_room(self) -> None:
        """Called when the cache is full: of the units used more than once since
        the last time, the most used ones stay, at most half of the cache."""
        again = np.flatnonzero(self.used > 1)
        if len(again) > CACHE_UNITS // 2:
            again = np.sort(again[np.argsort(-self.used[again], kind="stable")[:CACHE_UNITS // 2]])
        units, ids = list(self.codes), gather(self.flat, self.offsets, again).copy()
        ends = np.cumsum(self.offsets[again + 1] - self.offsets[again])
        self.reset()
        self.codes.update(zip([units[i] for i in again.tolist()], range(len(again))))
        self.add(ids, ends)

    def add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        """Keep the ids of further units, which end at ``ends``."""
        if not len(ends):
            return
        ends = self.offsets[self.known] + ends
        while ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.known + len(ends) + 1 > len(self.offsets):
            self.offsets = np.concatenate([self.offsets, np.zeros_like(self.offsets)])
        self.flat[self.offsets[self.known]:ends[-1]] = ids
        self.offsets[self.known + 1:self.known + len(ends) + 1] = ends
        self.known += len(ends)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of ids of each."""
        if len(self.codes) > CACHE_UNITS:
            self.make_room()
        counts, codes = [], []
        for text in texts:
            own = self.units(text) if text else []
            counts.append(len(own))
            codes.append(np.fromiter(map(self.codes.__getitem__, own), np.int64, len(own)))
        if self.codes.new:
            ids, new = self.encode_new(self.codes.new)
            self.codes.new = []
            self.add(ids, np.cumsum(new))
        rows = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        used = np.bincount(rows, minlength=self.known)
        used[:len(self.used)] += self.used
        self.used = used
        out = gather(self.flat, self.offsets, rows)
        lengths = np.concatenate([[0], np.cumsum(self.offsets[rows + 1] - self.offsets[rows])])
        ends = np.cumsum(counts)
        return out, (lengths[ends] - lengths[ends - np.asarray(counts, np.int64)]).astype(np.int64) if len(texts) else ends


def text_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with about ``most`` bytes of text (a longer text alone)."""
    if not batch.num_rows:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def binary_column(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A (large) binary or string column over one buffer."""
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.Array.from_buffers(kind, len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])
