"""Operator 6: quality rules with a calibrated n-gram classifier.

Base counts come from the whole text.  A document that passes the base rule is kept
if a logistic regression over hashed word and character n-grams, probability-
calibrated, gives it at least MIN_PROBABILITY of being good.  The classifier is
trained on a bounded sample of the labelled rows (SAMPLE_ROWS, the smallest hashes of
doc_id: an even sample that any run repeats); four fifths fit the weights, the rest
the calibration.  Counts and scores run in Arrow batches without a shuffle.

Null and empty texts have no words and fail the base rule.  A doc_id with several
label rows counts as good if most are; null labels are ignored.  Without labels of
both kinds nothing is learned and only the base rule decides (score null).
Repeated rows and null doc_ids are judged like any other row.  Long texts are read whole.
A probability of exactly MIN_PROBABILITY keeps.  An empty table gives no rows, and teaches
nothing.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import textkernel as tk

BUCKETS = 1 << 17
SAMPLE_ROWS = 6000
MIN_PROBABILITY = 0.5
CHAR_GRAM = 3
#: Weight of a text's relative n-gram frequencies in the linear model.
SCALE = 8.0
EPOCHS = 80
REPEAT_WINDOW = 8
SYMBOLS = b"#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_U = np.uint64


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[list(members)] = 1
    return out


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[offsets[1:]] - total[offsets[:-1]]


def base_counts(part: tk.Slice, w: tk.Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each document; ``hashes`` are of the words, case kept."""
    data, offsets, n = part.data, part.offsets, part.size
    inside = ~tk.SEPARATOR[data]
    out = {
        "n_words": w.counts,
        "word_chars": _sums(inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _sums(_table(SYMBOLS)[data], offsets),
    }
    newline = data == 0x0A
    starts = np.unique(np.concatenate((offsets[:-1], np.flatnonzero(newline) + 1)))
    starts = starts[starts < len(data)]
    ends = np.concatenate((starts[1:], [len(data)])).astype(np.int64)
    if len(starts):
        ends = ends - newline[ends - 1]
        seen = np.concatenate(([0], np.cumsum(inside)))
        wordy = seen[ends] > seen[starts]
        starts, ends = starts[wordy], ends[wordy]
    line_doc = tk.owner(offsets, starts)
    key = tk.span_hashes(data, starts, ends) + line_doc.astype(_U) * _U(0x9E3779B97F4A7C15)
    out["n_dup_lines"] = np.bincount(line_doc[pd.Series(key).duplicated().to_numpy()], minlength=n)
    at, windows = tk.window_hashes(hashes, w.doc, REPEAT_WINDOW)
    code, distinct = pd.factorize(windows + w.doc[at].astype(_U) * _U(0x9E3779B97F4A7C15))
    again = at[np.bincount(code, minlength=len(distinct))[code] > 1]
    cover = np.bincount(again, minlength=len(hashes) + 1) - np.bincount(again + REPEAT_WINDOW, minlength=len(hashes) + 1)
    out["n_repeat_words"] = np.bincount(w.doc[np.cumsum(cover)[: len(hashes)] > 0], minlength=n)
    return {k: v.astype(np.int64) for k, v in out.items()}


def features(part: tk.Slice, w: tk.Words, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of all word uni- and bigrams, then of all character n-grams."""
    half = _U(BUCKETS // 2 - 1)
    at, pairs = tk.window_hashes(hashes, w.doc, 2)
    yield np.concatenate((w.doc, w.doc[at])), np.concatenate((hashes & half, pairs & half)).astype(np.int64)
    if not len(part.data):
        return
    points = np.frombuffer(part.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(_U)
    doc = np.repeat(np.arange(part.size), _sums((part.data & 0xC0) != 0x80, part.offsets))
    if len(points) >= CHAR_GRAM:
        m = len(points) - CHAR_GRAM + 1
        gram = points[:m].copy()
        for j in range(1, CHAR_GRAM):
            gram *= _U(0x100000001B3)
            gram += points[j : m + j]
        gram *= _U(0x9E3779B97F4A7C15)
        keep = doc[:m] == doc[CHAR_GRAM - 1 :]
        yield doc[:m][keep], ((gram[keep] >> _U(40)) & half).astype(np.int64) + BUCKETS // 2


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, part: tk.Slice, w: tk.Words, hashes: np.ndarray) -> np.ndarray:
        """Calibrated probability that each document is good."""
        z = np.full(part.size, self.bias)
        for doc, bucket in features(part, w, hashes):
            total = np.bincount(doc, weights=self.weights[bucket], minlength=part.size)
            z += SCALE * total / np.maximum(1, np.bincount(doc, minlength=part.size))
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -35, 35)))


def _sample(documents: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """A bounded, repeatable sample of labelled documents: good, text."""
    votes = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(F.col("quality").cast("double")) >= 0.5).alias("good"))
    chosen = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    columns = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.join(F.broadcast(chosen), "doc_id").select("doc_id", "good", "text")  # at most ``rows`` rows


def _matrix(sample: DataFrame) -> pa.Table:
    """Sparse rows of the sample (good, buckets, values): made on the executors, at most SAMPLE_ROWS of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, good, texts = tk.take_columns(batch, ["doc_id", "good", "text"])
            for part in tk.slices(texts):
                w = tk.words(part)
                hashes = tk.span_hashes(part.data, w.starts, w.ends)
                rows = []
                for doc, bucket in features(part, w, hashes):
                    key, n = np.unique(doc * BUCKETS + bucket, return_counts=True)
                    doc = key // BUCKETS
                    rows.append((doc, key % BUCKETS, n / np.bincount(doc, weights=n, minlength=part.size)[doc]))
                doc, bucket, value = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
                by = np.argsort(doc, kind="stable")
                counts = np.bincount(doc, minlength=part.size)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(part.lo, part.size), good.slice(part.lo, part.size), tk.list_array(bucket[by].astype(np.int32), counts, pa.int32()), tk.list_array(value[by].astype(np.float32), counts, pa.float32())],
                    names=["doc_id", "good", "buckets", "vals"],
                )

    return sample.mapInArrow(run, "doc_id long, good boolean, buckets array<int>, vals array<float>").toArrow()


def fit(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """Weights by gradient descent (Adam), then Platt calibration on the held-back fifth."""
    data = _matrix(_sample(documents, labels, rows))
    y = data.column("good").to_numpy().astype(np.float64)
    if len(np.unique(y)) < 2:
        return None
    buckets, vals = data.column("buckets").combine_chunks(), data.column("vals").combine_chunks()
    doc = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(buckets.offsets.to_numpy()))
    bucket = buckets.flatten().to_numpy()
    value = vals.flatten().to_numpy() * np.float32(SCALE)
    place = np.argsort(np.argsort(data.column("doc_id").to_numpy(), kind="stable"))
    del data, buckets, vals
    held = place % 5 == 4
    fitted = ~held
    w, bias = np.zeros(BUCKETS, np.float32), 0.0
    m, v, rate = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), 0.15
    for step in range(1, EPOCHS + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, weights=w[bucket] * value, minlength=len(y)) + bias, -35, 35)))
        error = np.where(fitted, p - y, 0) / fitted.sum()
        slope = np.append(np.bincount(bucket, weights=error[doc] * value, minlength=BUCKETS) + 1e-5 * w, error.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1].astype(np.float32)
        bias -= move[-1]
    z = np.bincount(doc, weights=w[bucket] * value, minlength=len(y)) + bias
    a, b = platt(z[held], y[held]) if len(np.unique(y[held])) == 2 else (1.0, 0.0)
    return Model(w.astype(np.float32), float(bias), a, b)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the calibration, by Newton's method with smoothed targets."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    theta = np.array([1.0, 0.0])
    x = np.column_stack((z, np.ones(len(z))))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -35, 35)))
        grad = x.T @ (p - target)
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta = theta - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-7:
            break
    return max(float(theta[0]), 1e-3), float(theta[1])


def judged(documents: DataFrame, model: Model | None, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and score of every document."""
    columns = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, texts = tk.take_columns(batch, ["doc_id", "text"])
            for part in tk.slices(texts):
                w = tk.words(part)
                hashes = tk.span_hashes(part.data, w.starts, w.ends)
                counts = base_counts(part, w, hashes)
                failed = (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])
                if model is None:
                    score, kept = pa.nulls(part.size, pa.float64()), ~failed
                else:
                    p = model.probability(part, w, hashes)
                    score, kept = pa.array(p), ~failed & (p >= min_probability)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(part.lo, part.size), *(pa.array(counts[c]) for c in COUNTS), pa.array(failed), pa.array(kept), score],
                    names=["doc_id", *COUNTS, "base_failed", "kept", "score"],
                )

    return columns.mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, score double")
