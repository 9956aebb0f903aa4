"""Lexical top-k from an inverted index, reading only blocks that can reach the k-th score.

A task deals the chunks it reads into blocks of equally many tokens, of BLOCK_ROWS at most.  A block
is one row: its chunks, and its own inverted list (each token with the places that hold it).  Beside
the blocks, each token's blocks are listed by bucket of the token.  Since all chunks of a block have n
tokens, a question of q tokens of which m occur in the block scores at most m / sqrt(q * n) there.  A search counts m for every block that shares a token, scores the AHEAD
most promising blocks of each question, takes its k-th score as the bar, and then reads only the
blocks whose bound reaches it.  Results are those of ``retrieval.lexical_topk_many``.

Scale: an index is written from one pass over the texts, and only lists of blocks are shuffled.  A
search reads the buckets of its own tokens (partition pruning), moves a row a token and run of
blocks, and a count per question and block; a chosen block is read where it lies, and a task sends
its best k of each question.  Questions go to tasks by passes, as in ``lexical_topk_many``.  A token
that every chunk holds is one entry a block.

Chunks without tokens, and null texts, are found only among the zero scores, which follow in
page order, the greater chunk_id first.  Null and empty questions find the first chunks of
that order.  Rows that repeat a chunk_id are chunks of their own.  An empty index finds
nothing; an empty table of questions gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.errors import EngineError
from marginalia.functions import text as X
from marginalia.operators import retrieval

#: Chunks of a block, buckets of tokens, blocks scored first, and chunks of the zero order that an index keeps.
BLOCK_ROWS, BUCKETS, AHEAD, FIRST = 256, 64, 8, 1000
#: Chunks that a task deals into blocks at once, and bytes of a row group of blocks.
DEALT, GROUP_BYTES = 32_768, 8 << 20

_BLOCK = "run long, block long, n int, chunk_id array<string>, page array<int>, token array<string>, width array<int>, place array<int>"
_LIST = "token string, run long, block array<long>, bucket int"


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def _lists(ends: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), values)


def _dealt(rows: int, dealt: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of a task's chunks (chunk_id, page, tokens): of runs of ``dealt`` chunks, sorted by their number of tokens."""

    def blocks(held: list[pa.RecordBatch], run: int, first: int) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks()
        lengths = np.asarray(whole.column(2).combine_chunks().value_lengths())
        order = np.argsort(lengths, kind="stable")
        ends = np.append(np.flatnonzero(np.diff(lengths[order])) + 1, len(order))
        cuts = [(lo, min(lo + rows, end)) for begin, end in zip(np.append(0, ends[:-1]), ends) for lo in range(begin, end, rows)]
        for number, (lo, hi) in enumerate(cuts):
            part = whole.take(pa.array(order[lo:hi])).combine_chunks()
            tokens, n = part.column(2).combine_chunks(), int(lengths[order[lo]])
            coded = tokens.flatten().dictionary_encode()
            token, place = np.asarray(coded.indices), np.repeat(np.arange(hi - lo, dtype=np.int32), n)
            by = np.argsort(token, kind="stable")
            width = np.bincount(token, minlength=len(coded.dictionary)).astype(np.int32)
            one = lambda values: _lists(np.array([len(values)]), values)
            columns = [pa.array([run]), pa.array([first + number]), pa.array([n], pa.int32()), one(part.column(0).combine_chunks()), one(part.column(1).combine_chunks()), one(coded.dictionary), one(pa.array(width)), one(pa.array(place[by]))]
            yield pa.RecordBatch.from_arrays(columns, names=["run", "block", "n", "chunk_id", "page", "token", "width", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        held, size, runs = [], 0, 0
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                held.append(batch.slice(lo, dealt - size))
                lo, size = lo + held[-1].num_rows, size + held[-1].num_rows
                if size >= dealt:
                    yield from blocks(held, base + runs, base + runs * dealt)
                    held, size, runs = [], 0, runs + 1
        if size:
            yield from blocks(held, base + runs, base + runs * dealt)

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each token's blocks within the blocks of a run that follow each other: from run, block, token."""

    def lists(run: int, held: list[tuple[int, pa.Array]]) -> pa.RecordBatch:
        coded = pa.concat_arrays([t for _, t in held]).dictionary_encode()
        token = np.asarray(coded.indices)
        block = np.repeat(np.array([b for b, _ in held], np.int64), [len(t) for _, t in held])
        ends = np.cumsum(np.bincount(token, minlength=len(coded.dictionary)))
        return pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.full(len(ends), run, np.int64)), _lists(ends, pa.array(block[np.argsort(token, kind="stable")]))], names=["token", "run", "block"])

    last, held = None, []
    for batch in batches:
        for run, block, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), range(batch.num_rows)):
            if held and run != last:
                yield lists(last, held)
                held = []
            last = run
            held.append((block, batch.column(2)[i].values))
    if held:
        yield lists(last, held)


def _touched(shared) -> Callable[[tuple, pa.Table], pa.Table]:
    """How many tokens of each question the blocks of a run hold: place, block, m."""

    def run(_: tuple, rows: pa.Table) -> pa.Table:
        asked = retrieval.Asked(shared.value.column("asked").combine_chunks())
        lists = rows.column("block").combine_chunks()
        known, at = asked.places(rows.column("token").combine_chunks())
        at = np.repeat(at, np.asarray(lists.value_lengths())[known])
        blocks, row = np.unique(np.asarray(lists.filter(pa.array(known)).flatten()), return_inverse=True)
        parts = [(questions[place], blocks[r], counts[r, place]) for questions, counts in asked.shared(row, at, len(blocks)) for r, place in [np.nonzero(counts)]]
        place, block, m = (np.concatenate([p[i] for p in parts]) if parts else np.array([]) for i in range(3))
        return pa.table([pa.array(place.astype(np.int32)), pa.array(block.astype(np.int64)), pa.array(m.astype(np.int32))], names=["place", "block", "m"])

    return run


def _scored(shared, k: int, bars: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's best k chunks of every question within the blocks it reads; with ``bars``, where a block's bound reaches the question's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = retrieval.Asked(shared.value.column("asked").combine_chunks())
        best = retrieval._Best(len(asked.n), k)
        if bars is not None:
            best.bar = bars.copy()
        for batch in batches:
            for i in range(batch.num_rows):
                n, chunk_id, page, token, width, place = (batch.column(c)[i] for c in range(2, 8))
                n, width = max(1, n.as_py()), np.asarray(width.values)
                known, at = asked.places(token.values)
                row = np.asarray(place.values)[np.repeat(known, width)]
                chosen = asked.asking(at)[1]
                chosen, m = np.unique(chosen, return_counts=True)
                chosen = chosen[m / np.sqrt((asked.n[chosen] * n).astype(np.float64)) >= best.bar[chosen]]
                for questions, counts in asked.shared(row, np.repeat(at, width[known]), len(page.values), chosen):
                    score = counts / np.sqrt((asked.n[questions] * n).astype(np.float64))[None, :]
                    r, q = np.nonzero((counts > 0) & (score >= best.bar[questions][None, :]))
                    best.add(questions[q], chunk_id.values.take(pa.array(r)), page.values.take(pa.array(r)), score[r, q])
        found = best.cut()
        if found is not None:
            yield from found.to_batches()

    return run


@dataclass
class Found:
    """``rows``: key, chunk_id, page, score and rank.  ``work``: key, touched (blocks that share a token) and read."""

    rows: DataFrame
    work: DataFrame


@dataclass
class PostingIndex:
    """A written index: ``blocks`` (see _BLOCK), ``postings`` (token, run, blocks) by bucket, ``first``."""

    spark: SparkSession
    path: str

    @staticmethod
    def build(chunks: DataFrame, path: str) -> PostingIndex:
        """Index ``chunks`` (chunk_id, page, text) into a new folder; texts are cut into tokens once."""
        spark, path = chunks.sparkSession, path.rstrip("/")
        cut = chunks.select("chunk_id", F.col("page").cast("int").alias("page"), X.tokens(F.col("text")).alias("tokens"))
        cut.mapInArrow(_dealt(BLOCK_ROWS, max(BLOCK_ROWS, DEALT)), _BLOCK).write.option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/blocks")
        index = PostingIndex(spark, path)
        each = index._blocks().select(F.explode(F.arrays_zip("chunk_id", "page")).alias("x")).select("x.*")
        each.orderBy("page", F.desc("chunk_id")).limit(FIRST).coalesce(1).write.parquet(f"{path}/first")
        lists = index._blocks().select("run", "block", "token").mapInArrow(_listed, "token string, run long, block array<long>")
        lists = lists.withColumn("bucket", _bucket(F.col("token")))
        lists.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token", "run").write.partitionBy("bucket").parquet(f"{path}/postings")
        return index

    def _blocks(self) -> DataFrame:
        return self.spark.read.schema(_BLOCK).parquet(f"{self.path}/blocks")

    def _written(self, rows: DataFrame) -> DataFrame:
        path = f"{self.path}/_found/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _best(self, shared, blocks: DataFrame, k: int, bars: np.ndarray | None = None) -> DataFrame:
        """The k best chunks of every question within ``blocks``: place, chunk_id, page, score and rank."""
        mine = self._blocks().join(blocks.select("block").distinct(), "block", "left_semi").select(*[c.split(" ")[0] for c in _BLOCK.split(", ")])
        rows = mine.mapInArrow(_scored(shared, k, bars), "place int, chunk_id string, page int, score double")
        rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), "page", F.desc("chunk_id")))
        return self._written(rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k))

    def _pass(self, asked: DataFrame, k: int, key: str) -> Found:
        """The matches of questions whose tokens go to every task."""
        rows = asked.toArrow()  # at most about PASS_TOKENS tokens
        shared = self.spark.sparkContext.broadcast(rows)
        kind = asked.schema[key].dataType.simpleString()
        keys = self.spark.createDataFrame(list(enumerate(rows.column(key).to_pylist())), f"place int, {key} {kind}")
        tokens = asked.select(F.explode("asked").alias("token")).distinct()
        buckets = sorted(r[0] for r in tokens.select(_bucket(F.col("token"))).distinct().collect())  # BUCKETS at most
        postings = self.spark.read.schema(_LIST).parquet(f"{self.path}/postings").where(F.col("bucket").isin(*buckets))
        counted = postings.join(tokens, "token", "left_semi").select("run", "token", "block").groupBy("run").applyInArrow(_touched(shared), "place int, block long, m int")
        sizes = self._blocks().select("block", "n")
        n_asked = asked.join(keys, key).select("place", F.size("asked").alias("asked_n"))
        bound = X.token_cosine(F.col("m"), F.col("asked_n"), F.col("n"))
        touched = self._written(counted.join(sizes, "block").join(n_asked, "place").select("place", "block", bound.alias("bound")))
        placed = touched.withColumn("promise", F.row_number().over(Window.partitionBy("place").orderBy(F.desc("bound"), "block")))
        first = self._best(shared, placed.where(F.col("promise") <= AHEAD), k)
        bars = np.zeros(rows.num_rows)
        for r in first.where(F.col("rank") == k).select("place", "score").collect():  # a row a question of the pass
            bars[r["place"]] = r["score"]
        reached = touched.where(F.col("bound") >= F.element_at(F.lit(bars.tolist()), F.col("place") + 1)) if rows.num_rows else touched
        found = self._best(shared, reached, k, bars)
        read = placed.where(F.col("promise") <= AHEAD).select("place", "block").unionByName(reached.select("place", "block")).distinct().groupBy("place").agg(F.count("*").alias("read"))
        work = touched.groupBy("place").agg(F.count("*").alias("touched")).join(read, "place", "left")
        return Found(found.join(keys, "place").drop("place"), work.join(keys, "place").select(key, "touched", "read"))

    def search(self, questions: DataFrame, k: int = 5, key: str = "item_id") -> Found:
        """The k best chunks of every question (``key``, ``question``); keys are unique."""
        if k > FIRST // 2:
            raise EngineError(f"k must be {FIRST // 2} at most")
        all_asked = self._written(questions.select(key, X.tokens(F.col("question")).alias("asked")))
        passes = (all_asked.agg(F.sum(F.size("asked"))).first()[0] or 0) // retrieval.PASS_TOKENS + 1
        some = all_asked.where(F.size("asked") > 0)
        parts = [self._pass(some if passes == 1 else some.where(F.pmod(F.xxhash64(key), F.lit(passes)) == i), k, key) for i in range(passes)]
        found = reduce(DataFrame.unionByName, [p.rows for p in parts])
        # questions with fewer matches go on with the zero order; k of it may be among the matches
        short = all_asked.select(key).join(found.groupBy(F.col(key).alias("_q")).agg(F.count("*").alias("have")), F.col(key) == F.col("_q"), "left").where(F.coalesce("have", F.lit(0)) < k)
        zeros = self.spark.read.parquet(f"{self.path}/first").orderBy("page", F.desc("chunk_id")).limit(2 * k)
        fill = short.select(key, F.coalesce("have", F.lit(0)).alias("have")).join(F.broadcast(zeros))  # 2k rows
        fill = fill.join(found.select(F.col(key).alias("_q"), F.col("chunk_id").alias("_c")), (F.col(key) == F.col("_q")) & (F.col("chunk_id") == F.col("_c")), "left_anti")
        after = F.row_number().over(Window.partitionBy(key).orderBy("page", F.desc("chunk_id"))) + F.col("have")
        fill = fill.withColumn("rank", after.cast("long")).where(F.col("rank") <= k).select(key, F.lit(0.0).alias("score"), "chunk_id", "page", "rank")
        return Found(found.select(key, "chunk_id", "page", "score", "rank").unionByName(fill.select(key, "chunk_id", "page", "score", "rank")), reduce(DataFrame.unionByName, [p.work for p in parts]))

    def clear(self) -> None:
        """Delete what searches have written; their results can no longer be read."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_found")
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
