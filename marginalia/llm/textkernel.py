"""Vectorised text primitives shared by the training-data operators.

Everything works on the raw UTF-8 buffers of an Arrow string column, so a task
touches each byte a fixed number of times and never builds one Python object per
word.  Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; those bytes
never occur inside a multi-byte UTF-8 character, so byte positions are safe.

Nulls read as empty texts.  Buffers are processed in slices of about SLICE_BYTES
(always whole documents), which bounds a worker's memory whatever the batch size.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Arrays of a slice take some forty times its bytes; at this size they stay in the processor's cache.
SLICE_BYTES = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

#: True for the separators 0x20 and 0x09-0x0D.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: spreads the bits of each value."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@lru_cache(maxsize=None)
def byte_codes(lower: bool) -> np.ndarray:
    """A fixed 64-bit code per byte; with ``lower``, A-Z share the codes of a-z."""
    codes = mix64(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
    if lower:
        codes[65:91] = codes[97:123]
    return codes


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least ``n`` of each."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, dtype=_U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=_U)
    return _powers["up"], _powers["down"]


@dataclass
class Slice:
    """Whole documents of one Arrow batch: rows lo..hi, their bytes and offsets."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def size(self) -> int:
        return self.hi - self.lo

    def text_lengths(self) -> np.ndarray:
        return np.diff(self.offsets)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into slices of whole documents, about ``limit`` bytes each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=width)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield Slice(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def owner(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The document (index into ``offsets``) that holds each byte position."""
    return np.searchsorted(offsets[1:], positions, side="right")


@dataclass
class Words:
    """Word spans of a slice, in order; ``first`` has each document's first word index."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    counts: np.ndarray
    first: np.ndarray


def _spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def words(part: Slice) -> Words:
    """All words of the slice."""
    starts, ends = _spans(part.data, part.offsets, ~SEPARATOR[part.data])
    doc = owner(part.offsets, starts)
    counts = np.bincount(doc, minlength=part.size)
    first = np.concatenate(([0], np.cumsum(counts)))
    return Words(starts, ends, doc, counts, first)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each byte span: a polynomial read off prefix sums, then mixed."""
    n = len(data)
    up, down = _power_tables(n + 1)
    prefix = np.zeros(n + 1, dtype=_U)
    np.cumsum(byte_codes(lower)[data] * up[:n], out=prefix[1:])
    raw = (prefix[ends] - prefix[starts]) * down[starts]
    return mix64(raw + (ends - starts).astype(_U) * _U(0xA0761D6478BD642F))


def window_hashes(hashes: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` consecutive words inside one document.

    Returns (index of the window's first word, hash)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    total = hashes[:n] * position_code(0)
    for j in range(1, width):
        total += hashes[j : n + j] * position_code(j)
    keep = np.flatnonzero(doc[:n] == doc[width - 1 :])
    return keep, mix64(total[keep] + _U(width))


@lru_cache(maxsize=None)
def position_code(j: int) -> np.uint64:
    return mix64(np.array([j + 77], dtype=_U))[0] | _U(1)


def shingles(part: Slice, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash) of every shingle, A-Z lower-cased, repeats included.

    A document with fewer than ``width`` words has its whole sequence as its one
    shingle; one without words has none.  Rows come in document order."""
    w = words(part)
    hashes = span_hashes(part.data, w.starts, w.ends, lower=True)
    at, full = window_hashes(hashes, w.doc, width)
    doc = w.doc[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < width))
    if len(short):
        total = np.zeros(len(short), dtype=_U)
        for j in range(width - 1):
            have = w.counts[short] > j
            total[have] += hashes[w.first[short[have]] + j] * position_code(j)
        doc = np.concatenate([doc, short])
        full = np.concatenate([full, mix64(total + w.counts[short].astype(_U))])
        order = np.argsort(doc, kind="stable")
        doc, full = doc[order], full[order]
    return doc, full


def distinct_per_doc(doc: np.ndarray, values: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each document, sorted: (document, value, per-document counts)."""
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    keep = np.ones(len(doc), dtype=bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    doc, values = doc[keep], values[keep]
    return doc, values, np.bincount(doc, minlength=n_docs)


def ragged_gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... for each (start, length), concatenated."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total, dtype=np.int64) + shift


#: What a worker remembers between tasks, and the operator it ran last.
_forgetting: list[Callable[[], None]] = []
_last: list[str] = []


def forget_with(call: Callable[[], None]) -> None:
    """Register how a module's memory between tasks is dropped."""
    _forgetting.append(call)


def _hand_back() -> None:
    """Freed memory goes back to the system: Spark keeps its workers for all later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def task(operator: str, run: Callable) -> Callable:
    """``run`` over a task's batches; a worker that ran another operator before first forgets what that one remembered."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _last != [operator]:
            for call in _forgetting:
                call()
            _last[:] = [operator]
            _hand_back()
        yield from run(batches)
        _hand_back()

    return inner


def take_columns(batch: pa.RecordBatch, names: list[str]) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and a length for each row."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def binary_array(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """An Arrow binary column: ``counts`` values of a fixed-width array for each row."""
    raw = np.ascontiguousarray(values)
    offsets = np.concatenate(([0], np.cumsum(counts) * raw.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
