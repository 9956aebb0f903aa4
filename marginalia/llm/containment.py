"""Operator 3: benchmark decontamination by size-partitioned MinHash containment.

Which documents hold at least MIN_PERCENT of a test item's distinct 5-word shingles?
Items are partitioned by set size (powers of two).  An item keeps its SKETCH smallest
shingle hashes; a partition's largest retained hash is the sampling threshold for
documents: only document hashes up to it can meet a retained value, so a long document
meets each partition with a sample scaled to that partition's items, not with one
sketch of its whole length.  A pair with enough retained values in common (a bound six
standard deviations below the threshold; exact for items no larger than the sketch) is
verified by exact shingle containment on the full sets.

Small benchmarks (at most BROADCAST_SHINGLES shingles, counted first) go to every task
and documents are never shuffled; larger ones take a join on the retained values.

Items and documents with fewer than five words have their whole sequence as one
shingle.  Null, empty and blank texts have no shingles: such items are contained in
nothing, such documents contain nothing.  Repeated documents are answered each.  Items are
told apart by item_id (null is one) and shingle set: texts that share an item_id are each
searched and give a row each; rows with the same set under one item_id are one item.  Equal
retained values (ties) count for every item that holds them.  Very long documents are
sampled whole, never cut.  An empty table on either side contains nothing.  Other columns
are ignored, whatever their names; ``clean`` returns them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import textkernel as tk
from marginalia.llm.scratch import unused

WIDTH = 5
MIN_PERCENT = 75
SKETCH = 32
BROADCAST_SHINGLES = 2_000_000
PAIRS = "doc_id long, item_id long, n_item long, n_shared long"
_U = np.uint64


def least_hits(size: int, percent: int = MIN_PERCENT, sketch: int = SKETCH) -> int:
    """Retained values that a contained item shares: exact if all its values are retained."""
    if size <= sketch:
        return -(-size * percent // 100)
    share = percent / 100
    return max(1, math.floor(sketch * share - 6 * math.sqrt(sketch * share * (1 - share))))


def item_sets(items: DataFrame) -> DataFrame:
    """item_id and sorted distinct shingle hashes (int64 views) of every item."""
    one = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = tk.take_columns(batch, ["item_id", "text"])
            for part in tk.slices(texts):
                _, values, counts = tk.distinct_per_doc(*tk.shingles(part, WIDTH), part.size)
                yield pa.RecordBatch.from_arrays([ids.slice(part.lo, part.size), tk.list_array(values.view(np.int64), counts, pa.int64())], names=["item_id", "shingles"])

    return one.mapInArrow(tk.task("contained", run), "item_id long, shingles array<long>").where("size(shingles) > 0").distinct()


@dataclass
class Partition:
    """One size class: retained values (sorted), the item of each, and the sampling threshold."""

    values: np.ndarray
    items: np.ndarray
    threshold: np.uint64


@dataclass
class Index:
    ids: list
    sets: list[np.ndarray]
    need: np.ndarray
    partitions: list[Partition] = field(default_factory=list)

    @classmethod
    def build(cls, ids: list, sets: list[np.ndarray], percent: int) -> Index:
        index = cls(ids, sets, np.array([least_hits(len(s), percent) for s in sets], dtype=np.int64))
        sizes = np.array([len(s) for s in sets])
        classes = np.floor(np.log2(np.maximum(sizes, 1))).astype(int) if len(sizes) else sizes
        for c in np.unique(classes):
            members = np.flatnonzero(classes == c)
            kept = [sets[i][:SKETCH] for i in members]
            values, items = np.concatenate(kept), np.repeat(members, [len(k) for k in kept])
            by = np.argsort(values, kind="stable")
            index.partitions.append(Partition(values[by], items[by], values.max()))
        return index

    def candidates(self, doc: np.ndarray, values: np.ndarray) -> np.ndarray:
        """doc * n_items + item of the pairs with enough common retained values; rows distinct."""
        n, out = len(self.ids), [np.zeros(0, np.int64)]
        for p in self.partitions:
            sample = np.flatnonzero(values <= p.threshold)
            lo = np.searchsorted(p.values, values[sample], side="left")
            hi = np.searchsorted(p.values, values[sample], side="right")
            hit = np.flatnonzero(hi > lo)
            width = (hi - lo)[hit]
            item = p.items[tk.ragged_gather(lo[hit], width)] if len(hit) else np.zeros(0, np.int64)
            pair, count = np.unique(np.repeat(doc[sample[hit]], width) * n + item, return_counts=True)
            out.append(pair[count >= self.need[pair % n]])
        return np.concatenate(out)

    def hits(self, part: tk.Slice, percent: int) -> Iterator[tuple[int, int, int]]:
        """(document, item, shared shingles) of the contained pairs, verified on the full sets."""
        doc, values, counts = tk.distinct_per_doc(*tk.shingles(part, WIDTH), part.size)
        ends = np.cumsum(counts)
        for pair in self.candidates(doc, values).tolist() if self.ids else ():
            d, i = divmod(pair, len(self.ids))
            own, item = values[ends[d] - counts[d] : ends[d]], self.sets[i]
            at = np.minimum(np.searchsorted(own, item), len(own) - 1)
            n = int((own[at] == item).sum())
            if 100 * n >= percent * len(item):
                yield d, i, n


def _small_index(items: DataFrame, percent: int, limit: int) -> Index | None:
    """The index for every task, or None if the items have more than ``limit`` shingles."""
    sets = item_sets(items).persist()
    try:
        if (sets.agg(F.sum(F.size("shingles"))).first()[0] or 0) > limit:
            return None
        rows = sets.orderBy("item_id").toArrow()
        found = [np.asarray(s.values).view(_U) for s in rows.column("shingles")]
        return Index.build(rows.column("item_id").to_pylist(), found, percent)
    finally:
        sets.unpersist()


def contained(documents: DataFrame, items: DataFrame, percent: int = MIN_PERCENT, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """doc_id, item_id, n_item, n_shared of every contained (document row, item)."""
    index = _small_index(items, percent, broadcast_shingles)
    if index is None:
        return _by_join(documents, item_sets(items), percent).drop("doc_key")
    shared = documents.sparkSession.sparkContext.broadcast(index)
    columns = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids, texts = tk.take_columns(batch, ["doc_id", "text"])
            for part in tk.slices(texts):
                rows = [(ids[part.lo + d].as_py(), index.ids[i], len(index.sets[i]), n) for d, i, n in index.hits(part, percent)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "item_id", "n_item", "n_shared"])

    return columns.mapInArrow(tk.task("contained", run), PAIRS)


def _by_join(documents: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """For benchmarks beyond the broadcast bound: retained values meet in a join; the pairs and ``doc_key``.

    Documents are keyed by (doc_id, text hash), items by (item_id, set hash); hashes above every threshold stay behind."""
    sets = sets.withColumn("item_key", F.xxhash64("shingles"))
    need = F.when(F.size("shingles") <= SKETCH, F.ceil(F.size("shingles") * percent / 100)).otherwise(least_hits(SKETCH + 1, percent))
    flip = F.lit(-(1 << 63)).cast("long")  # orders int64 views as unsigned
    ranked = F.slice(F.array_sort(F.transform("shingles", lambda x: x.bitwiseXOR(flip))), 1, SKETCH)
    retained = sets.select("item_id", "item_key", F.size("shingles").alias("n_item"), need.alias("need"), F.explode(ranked).alias("value"))
    top = retained.agg(F.max("value")).first()[0]
    columns = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = tk.take_columns(batch, ["doc_id", "text"])
            for part in tk.slices(texts):
                _, values, counts = tk.distinct_per_doc(*tk.shingles(part, WIDTH), part.size)
                signed = (values ^ _U(1 << 63)).view(np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(part.lo, part.size), texts.slice(part.lo, part.size), tk.list_array(signed, counts, pa.int64())], names=["doc_id", "text", "vals"])

    hashed = columns.mapInArrow(tk.task("contained", run), "doc_id long, text string, vals array<long>").select("doc_id", F.xxhash64("text").alias("doc_key"), "vals")
    low = hashed.select("doc_id", "doc_key", F.explode("vals").alias("value")).where(F.col("value") <= top).distinct()
    pairs = low.join(retained, "value").groupBy("doc_id", "doc_key", "item_id", "item_key", "n_item", "need").count().where("count >= need")
    docs = hashed.alias("d").join(pairs.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.doc_key") == F.col("p.doc_key"))).select("d.doc_id", "d.doc_key", "vals", "item_id", "item_key", "n_item")
    own = sets.select(F.col("item_id").alias("own_id"), F.col("item_key").alias("own_key"), F.transform("shingles", lambda x: x.bitwiseXOR(flip)).alias("shingles"))
    same = F.col("item_id").eqNullSafe(F.col("own_id")) & (F.col("item_key") == F.col("own_key"))
    verified = docs.join(own, same).select("doc_id", "doc_key", "item_id", F.col("n_item").cast("long").alias("n_item"), F.size(F.array_intersect("vals", "shingles")).cast("long").alias("n_shared"))
    return verified.where(F.col("n_shared") * 100 >= F.col("n_item") * percent)


def clean(documents: DataFrame, items: DataFrame, percent: int = MIN_PERCENT, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """The documents (all columns) that contain no item."""
    index = _small_index(items, percent, broadcast_shingles)
    if index is None:
        leak_id, leak_key = unused(documents, "leak_id", "leak_key")
        found = _by_join(documents, item_sets(items), percent).select(F.col("doc_id").alias(leak_id), F.col("doc_key").alias(leak_key)).distinct()
        same = F.col("doc_id").cast("long").eqNullSafe(F.col(leak_id)) & (F.xxhash64(F.col("text").cast("string")) == F.col(leak_key))
        return documents.join(found, same, "left_anti")
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for part in tk.slices(batch.column(batch.schema.get_field_index("text"))):
                keep[[part.lo + d for d, _, _ in shared.value.hits(part, percent)]] = False
            yield batch.filter(pa.array(keep))

    return documents.mapInArrow(tk.task("contained", run), documents.schema)
