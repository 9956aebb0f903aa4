"""A Bloom filter over ids, of fixed size: keeps most other rows out of a map without a shuffle.

It never loses an id; when many ids fill it, it lets more other rows through."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import textkernel as tk

WORDS = 1 << 20
_U = np.uint64


def _places(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    h = tk.mix64(ids.view(_U) if ids.dtype == np.int64 else ids.astype(_U))
    return [(((h >> _U(s)) & _U(WORDS - 1)).astype(np.int64), _U(1) << ((h >> _U(s + 20)) & _U(63))) for s in (0, 28)]


def id_filter(ids: DataFrame) -> np.ndarray:
    """The filter (WORDS longs, 8 MB) of the first column's ids; each task sends its own words only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(WORDS, _U)
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for word, mask in _places(values):
                np.bitwise_or.at(words, word, mask)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].view(np.int64))], names=["word", "mask"])

    rows = ids.mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    words = np.zeros(WORDS, _U)
    words[rows["word"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).view(_U)
    return words


def may_hold(words: np.ndarray, ids: pa.Array) -> np.ndarray:
    """Which ids may be in the filter; nulls are not."""
    known = ~np.asarray(ids.is_null())
    values = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for word, mask in _places(values):
        known &= (words[word] & mask) > 0
    return known
