"""Substring search from an index of three-character pieces.

Rows are numbered in blocks; a posting is a piece with the places of a block's rows whose
texts hold it.  A needle's pieces (of a LIKE pattern: those of its literal parts between
``%`` and ``_``) must all be in a row that matches, so the blocks, and in them the places,
that every piece names are candidates; the caller's own predicate then decides.  Texts are
indexed lower-cased in both ways that the searches fold: as Unicode does and A-Z alone.

Scale: a task lists the pieces of the rows that it reads, and only these lists are shuffled, by bucket.  A search reads the buckets of its pieces and the blocks of its candidates; no group
is larger than a block times the needle's pieces.  A needle without a piece (shorter than
three characters, or a pattern of short parts) reads all rows, as a scan does.

Null texts and null lists hold nothing.  Rows may repeat.  An empty table finds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as X

#: Characters of a piece, rows of a block, buckets of pieces.
WIDTH, BLOCK_ROWS, BUCKETS = 3, 1024, 64


def pieces_of(needle: str) -> list[str]:
    """The distinct pieces of a needle, lower-cased as contains_folded does."""
    folded = needle.lower()
    return sorted({folded[i : i + WIDTH] for i in range(len(folded) - WIDTH + 1)})


def pattern_pieces(pattern: str) -> list[str]:
    """The distinct pieces of the literal parts of a LIKE pattern, A-Z lower-cased as like_ascii does."""
    folded = pattern.translate(str.maketrans(X.UPPER, X.LOWER))
    return sorted({part[i : i + WIDTH] for part in re.split("[%_]", folded) for i in range(len(part) - WIDTH + 1)})


def _folded(texts: Column) -> Column:
    """An array of texts, lower-cased in both ways."""
    return F.array_distinct(F.concat(F.transform(texts, F.lower), F.transform(texts, X.ascii_lower)))


def _listed(rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each piece's places in a block (block, place, texts), of as many of its rows as follow each other in a batch."""

    def lists(block: int, place: np.ndarray, texts: pa.ListArray) -> pa.RecordBatch:
        flat = texts.flatten()
        length = np.asarray(pc.utf8_length(flat)).astype(np.int64)
        points = np.frombuffer("".join(flat.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        left = np.repeat(np.cumsum(length), length) - np.arange(len(points))  # characters to the end of the text
        begin = np.flatnonzero(left >= WIDTH)
        code = sum(points[begin + i] << (21 * i) for i in range(WIDTH))
        owner = np.repeat(np.repeat(place, np.asarray(texts.value_lengths())), length)[begin]
        codes, which = np.unique(code, return_inverse=True)
        pairs = np.unique(which.astype(np.int64) * rows + owner)
        ends = np.cumsum(np.bincount(pairs // rows, minlength=len(codes)))
        letters = np.stack([(codes >> (21 * i)) & 0x1FFFFF for i in range(WIDTH)], axis=1).astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
        pieces = pa.array([letters[i : i + WIDTH] for i in range(0, len(letters), WIDTH)], pa.string())
        places = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array((pairs % rows).astype(np.int32)))
        return pa.RecordBatch.from_arrays([pieces, pa.array(np.full(len(codes), block, np.int64)), places], names=["piece", "block", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = np.asarray(batch.column(0))
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(block)])) if len(block) else np.array([0])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = batch.slice(lo, hi - lo)
                yield lists(int(block[lo]), np.asarray(part.column(1)).astype(np.int64), part.column(2))

    return run


def _bucket(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(BUCKETS)).cast("int")


@dataclass
class SubstringIndex:
    """A written index: the rows with ``_block`` and ``_place``, and postings (piece, block, places) by bucket."""

    spark: SparkSession
    path: str

    @staticmethod
    def build(rows: DataFrame, texts: Column, path: str) -> SubstringIndex:
        """Index ``rows`` by ``texts``, an array of their searchable texts, into a new folder."""
        spark, path = rows.sparkSession, path.rstrip("/")
        numbered = rows.withColumn("_row", F.monotonically_increasing_id())  # fixed by being written
        numbered = numbered.select("*", F.floor(F.col("_row") / BLOCK_ROWS).alias("_block"), (F.col("_row") % BLOCK_ROWS).cast("int").alias("_place")).drop("_row")
        numbered.write.parquet(f"{path}/rows")
        stored = spark.read.schema(numbered.schema).parquet(f"{path}/rows")
        some = F.filter(F.coalesce(texts, F.array().cast("array<string>")), lambda t: t.isNotNull())
        each = stored.select(F.col("_block").alias("block"), F.col("_place").alias("place"), _folded(some).alias("texts"))
        lists = each.mapInArrow(_listed(BLOCK_ROWS), "piece string, block long, places array<int>")  # BLOCK_ROWS at most
        lists = lists.withColumn("bucket", _bucket(F.col("piece")))
        lists.hint("rebalance", "bucket").sortWithinPartitions("bucket", "piece", "block").write.partitionBy("bucket").parquet(f"{path}/postings")
        return SubstringIndex(spark, path)

    def rows(self) -> DataFrame:
        stored = self.spark.read.parquet(f"{self.path}/rows")
        return stored.drop("_block", "_place")

    def candidates(self, pieces: list[str]) -> DataFrame:
        """The rows that hold all pieces; all rows without any piece.  The caller's predicate is still to be applied."""
        if not pieces:
            return self.rows()
        buckets = [r[0] for r in self.spark.createDataFrame([(p,) for p in pieces], "piece string").select(_bucket(F.col("piece"))).distinct().collect()]  # a needle's pieces
        postings = self.spark.read.schema("piece string, block long, places array<int>, bucket int").parquet(f"{self.path}/postings")
        mine = postings.where(F.col("bucket").isin(*buckets) & F.col("piece").isin(*pieces))
        mine = mine.groupBy("piece", "block").agg(F.flatten(F.collect_list("places")).alias("places"))  # a block's rows may lie in two batches
        blocks = mine.groupBy("block").agg(F.collect_list("places").alias("lists")).where(F.size("lists") == len(pieces))  # a needle's pieces a block
        common = F.aggregate(F.slice("lists", 2, F.size("lists")), F.get("lists", F.lit(0)), F.array_intersect)
        places = blocks.select(F.col("block").alias("_b"), F.explode(common).alias("_p"))
        stored = self.spark.read.parquet(f"{self.path}/rows")
        return stored.join(places, (F.col("_block") == F.col("_b")) & (F.col("_place") == F.col("_p")), "left_semi").drop("_block", "_place")
