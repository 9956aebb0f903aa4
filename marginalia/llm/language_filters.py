"""Operator 9: language ID by bit-sliced Bloom filters over character n-grams.

Training counts every n-gram of the training texts by language.  A language contains
an n-gram if it makes up at least MIN_SHARE of the language's n-grams and at least
RELATIVE of its share in the language where it is most frequent.  All languages share
one filter of ROWS rows and HASHES probes; bit l of a row belongs to language l, so
the AND of an n-gram's rows is the bitmask of all languages that contain it.  A text's
popcount per language, less the false positives that the slice's fill implies, decides.

Letters are lower-cased; any other character is a word edge.  N-grams have GRAMS
characters, touch at least two letters, and hold edges only at their ends.

``und`` with score 0 for null texts, texts without a letter, and when nothing was
learned.  A text with letters but no known n-gram gets the most frequent language,
score 0; ties go to the alphabetically first.  Documents without a language teach
nothing.  Repeated rows and null doc_ids are handled like any other row.  Long texts are
read whole.  An empty table to predict gives no rows.  Other columns are not read by
``predict`` and pass through ``recognised``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm import textkernel as tk

GRAMS = (2, 3, 4)
ROWS = 1 << 20
HASHES = 3
MIN_SHARE = 1e-5
RELATIVE = 0.35
#: Text whose n-grams a task holds at once; they take some fifty times the bytes.
SLICE_BYTES = 1 << 18
#: Counted n-grams that a task holds before it adds them up; sums of more than half as many are passed on.
MERGE_ROWS = 500_000
#: The bits of each byte value.
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1
_U = np.uint64


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-cased code point of each letter, 0 for all else."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def grams(part: tk.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram hash) of all n-grams of a slice, and whether each document has a letter."""
    if not len(part.data):
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(part.size, bool)
    points = np.frombuffer(part.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    head = (part.data & 0xC0) != 0x80
    total = np.concatenate(([0], np.cumsum(head)))
    chars = total[part.offsets[1:]] - total[part.offsets[:-1]]
    doc = np.repeat(np.arange(part.size), chars)
    # an edge before and after each text, so that texts do not touch
    code = np.zeros(len(points) + part.size + 1, dtype=np.uint32)
    place = np.arange(len(points)) + doc + 1
    code[place] = _letters()[points]
    own = np.zeros(len(code), dtype=np.int64)
    own[place] = doc
    has_letter = np.bincount(doc, weights=code[place] > 0, minlength=part.size) > 0
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = (code[1:] > 0) | (code[:-1] > 0)  # runs of edges count as one
    code, own = code[keep].astype(_U), own[keep]
    out_doc, out_hash = [], []
    for n in GRAMS:
        m = len(code) - n + 1
        if m <= 0:
            continue
        value = code[:m].copy()
        for j in range(1, n):
            value *= _U(0x100000001B3)
            value += code[j : m + j]
        ok = (code[:m] > 0) | (code[1 : m + 1] > 0) if n > 1 else code[:m] > 0
        for j in range(1, n - 1):
            ok &= code[j : m + j] > 0
        if n == 2:
            ok = (code[:m] > 0) & (code[1 : m + 1] > 0)
        at = np.flatnonzero(ok)
        out_doc.append(np.maximum(own[at], own[at + 1]))
        out_hash.append(tk.mix64(value[at] + _U(n)))
    return np.concatenate(out_doc), np.concatenate(out_hash), has_letter


def probes(hashes: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of each n-gram, by double hashing."""
    one, two = hashes & _U(0xFFFFFFFF), (hashes >> _U(32)) | _U(1)
    for i in range(HASHES):
        yield ((one + _U(i) * two) & _U(ROWS - 1)).view(np.int64)


@dataclass
class Filters:
    """languages, sorted; rows: ROWS bytes for every 8 languages; rates: false positives; default: most frequent language."""

    languages: list[str]
    rows: np.ndarray
    rates: np.ndarray
    default: int

    def decide(self, part: tk.Slice) -> tuple[list[str], np.ndarray]:
        doc, hashes, has_letter = grams(part)
        n, k = part.size, len(self.languages)
        if not k:
            return ["und"] * n, np.zeros(n)
        masks: list[np.ndarray] = []
        for at in probes(hashes):
            found = [rows[at] for rows in self.rows]
            masks = [m & f for m, f in zip(masks, found, strict=True)] if masks else found
        by_mask = [np.bincount(doc * 256 + m, minlength=256 * n).reshape(n, 256) for m in masks]  # texts of a batch x byte values
        hits = np.concatenate([c @ _BITS for c in by_mask], axis=1)[:, :k]
        total = np.bincount(doc, minlength=n)[:, None]
        true = np.clip((hits - total * self.rates) / (1 - self.rates), 0, None)
        best = np.where(true.max(axis=1) > 0, true.argmax(axis=1), self.default)
        score = true[np.arange(n), best] / np.maximum(true.sum(axis=1), 1e-9)
        names = [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), has_letter.tolist(), strict=True)]
        return names, np.where(has_letter, np.clip(score, 0, 1), 0.0)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 1 by 3; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learn(documents: DataFrame) -> Filters:
    """Filters from the (text, lang) rows given."""
    rows = documents.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pd.DataFrame] = []
        codes: dict[str, int] = {}
        held = 0

        def merged() -> pd.DataFrame:
            return pd.concat(kept).groupby(["lang", "gram"], sort=False, as_index=False)["n"].sum()

        def counted(total: pd.DataFrame) -> pa.RecordBatch:
            names = list(codes)
            return pa.RecordBatch.from_arrays([pa.array([names[i] for i in total["lang"].tolist()], pa.string()), pa.array(total["gram"].to_numpy()), pa.array(total["n"].to_numpy(np.int64))], names=["lang", "gram", "n"])

        for batch in batches:
            texts, langs = tk.take_columns(batch, ["text", "lang"])
            code = np.array([codes.setdefault(name, len(codes)) for name in langs.to_pylist()], dtype=np.int64)
            for part in tk.slices(texts, SLICE_BYTES):
                doc, hashes, _ = grams(part)
                lang = code[part.lo + doc]
                for one in np.unique(lang).tolist():
                    number, distinct = pd.factorize(hashes[lang == one])
                    kept.append(pd.DataFrame({"lang": np.int32(one), "gram": distinct.view(np.int64), "n": np.bincount(number, minlength=len(distinct))}))
                    held += len(distinct)
                if held > MERGE_ROWS:
                    kept = [merged()]
                    held = len(kept[0])
                    if 2 * held > MERGE_ROWS:
                        yield counted(kept[0])
                        kept, held = [], 0
        if kept:
            yield counted(merged())

    counts = rows.mapInArrow(tk.task("language", run), "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    counts = counts.groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("by"))  # one entry a language
    counts = counts.persist()
    totals = {r["lang"]: r["n"] for r in counts.select(F.explode("by").alias("x")).groupBy("x.lang").agg(F.sum("x.n").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        counts.unpersist()
        return Filters([], np.zeros((1, ROWS), np.uint8), np.zeros(0), 0)
    number = F.create_map(*[F.lit(v) for pair in ((name, i) for i, name in enumerate(languages)) for v in pair])
    total = F.create_map(*[F.lit(v) for pair in totals.items() for v in pair])
    shares = F.transform("by", lambda x: F.struct(number[x["lang"]].alias("lang"), (x["n"] / total[x["lang"]]).alias("share")))
    shared = counts.select("gram", shares.alias("by")).withColumn("top", F.array_max(F.transform("by", lambda x: x["share"])))
    member = shared.select("gram", F.explode(F.filter("by", lambda x: (x["share"] >= MIN_SHARE) & (x["share"] >= RELATIVE * F.col("top")))).alias("x")).select("gram", "x.lang")
    low = F.col("gram").bitwiseAND(0xFFFFFFFF)
    high = F.shiftrightunsigned("gram", 32).bitwiseOR(F.lit(1))
    places = member.select("lang", F.explode(F.array(*[(low + i * high).bitwiseAND(ROWS - 1) for i in range(HASHES)])).alias("row"))
    bits = places.groupBy("row", F.floor(F.col("lang") / 8).alias("byte")).agg(F.expr("bit_or(shiftleft(1, cast(lang % 8 as int)))").alias("mask")).toPandas()  # at most ROWS rows a byte
    counts.unpersist()
    table = np.zeros(((len(languages) + 7) // 8, ROWS), dtype=np.uint8)
    table[bits["byte"].to_numpy(np.int64), bits["row"].to_numpy(np.int64)] = bits["mask"].to_numpy(np.uint8)
    fill = np.array([((table[i // 8] >> (i % 8)) & 1).mean() for i in range(len(languages))])
    return Filters(languages, table, np.minimum(fill**HASHES, 0.99), max(range(len(languages)), key=lambda i: (totals[languages[i]], -i)))


def predict(documents: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred and score for every document."""
    shared = documents.sparkSession.sparkContext.broadcast(filters)  # ROWS bytes for every 8 languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = tk.take_columns(batch, ["doc_id", "text"])
            for part in tk.slices(texts, SLICE_BYTES):
                lang, score = shared.value.decide(part)
                yield pa.RecordBatch.from_arrays([ids.slice(part.lo, part.size), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    columns = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(tk.task("language", run), "doc_id long, lang_pred string, score double")


def recognised(documents: DataFrame, filters: Filters, least_score: float) -> DataFrame:
    """The documents (all columns) that read as a learned language with at least ``least_score``."""
    shared = documents.sparkSession.sparkContext.broadcast(filters)
    place = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for part in tk.slices(batch.column(place), SLICE_BYTES):
                lang, score = shared.value.decide(part)
                keep[part.lo : part.hi] = (np.array(lang, dtype=object) != "und") & (score >= least_score)
            yield batch.filter(pa.array(keep))

    return documents.mapInArrow(tk.task("language", run), documents.schema)
