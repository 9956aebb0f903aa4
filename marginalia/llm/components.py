"""Connected components of an edge table.

Each partition first contracts its own edges: every node it knows points at the smallest
node it reaches there.  While the contracted table keeps fitting into fewer partitions,
that repeats; a table of one partition and at most CHUNK edges is then finished by one
more contraction.  Larger tables go on with alternating star contractions, which shuffle:
every node's larger neighbours are hung on its smallest neighbour, then its smaller ones,
until the edges stay as they are.  Every round is a written table; no link reaches the
driver, only the count and a checksum of the edges.

Nodes are numbers and are not null.  Repeated edges, both directions of one and loops change
nothing.  An empty table gives no rows.  Edges carry no texts and no other columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import scratch

#: Edges that a task contracts at once; a partition of more is contracted piece by piece.
CHUNK = 2_000_000


def smallest_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component), roots left out."""
    nodes, index = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = index[: len(u)], index[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        for side in (a, b):
            np.minimum.at(label, before[side], least)
            np.minimum.at(label, side, least)
        while not np.array_equal(jumped := label[label], label):
            label = jumped
        if np.array_equal(label, before):
            own = label != np.arange(len(nodes))
            return nodes[own], nodes[label[own]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of each partition as stars around its components' smallest nodes; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            u, v = smallest_reached(table.column(0).to_numpy(), table.column(1).to_numpy())
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK:
                yield flush()
                held = []
        if held:
            yield flush()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def _starred(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return small.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (columns a, b) but the components' smallest ids."""
    current = scratch.written(contracted(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), "edges")
    parts, before, state = None, None, None
    while True:
        before, parts = parts, current.rdd.getNumPartitions()
        last = parts <= 1 and current.count() <= CHUNK
        if last or before is None or parts < before:
            following = scratch.written(contracted(current), "edges")
        else:
            following = scratch.written(_starred(current), "edges")
            after = _state(following)
            last, state = after == state, after
        scratch.drop(current)
        current = following
        if last:
            return current.select(F.col("u").alias("id"), F.col("v").alias("component"))
