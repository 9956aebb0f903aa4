"""Operator 12: nearest neighbours by vantage-point trees, one a shard.

Largest inner product is turned into smallest distance: with M the largest norm of all
vectors, x becomes (x / M, sqrt(1 - |x / M|^2)) and a query (q / |q|, 0), all of length 1;
their distance falls as the inner product grows, and is a metric that trees can prune by.

A small vantage-point tree over a bounded sample cuts the space into cells of about a
shard's size; cells that hold more (a vector that a third of all rows share) are dealt over
several shards by hash.  Every vector is in one shard, and every shard gets a vantage-point
tree: each node splits its points at the median distance from one of them.  A block of
queries goes down a tree together.  A subtree whose points are all at least b away from a
query (triangle inequality on the node's distances) is skipped for it where b * ``factor``
exceeds the query's k-th distance so far.  At factor 1 nothing that counts is skipped and
the result is exact; a larger factor skips more and may miss neighbours.  Each query first
searches its own shard; its k-th distance there then decides by the same rule which cells
it is sent to.  A task holds one shard and one block of queries, both of bounded size, and
returns only what reaches the query's k-th score.

Scores are inner products of the original vectors, components added in order, in double
precision; equal ones go to the smaller vec_id.  Null vectors and ids, vectors with null or
non-finite components, zero vectors, and those whose squared length is not a positive finite
double take no part.  Where lengths differ, the commonest takes part (of equally common ones
the longest).  Rows that repeat a vec_id: the smallest vector (component by component)
stands for all.  With fewer than k others, all are returned.  Empty tables give no rows.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm import scratch

K, EVERY, FACTOR = 20, 20, 1.5
#: Bytes of a shard's vectors as doubles, points of a leaf, queries of a block, rows of the sample, and sample rows a cell at least.
SHARD_BYTES, LEAF, BLOCK, SAMPLE, CELL_SAMPLE = 1 << 22, 64, 4096, 20_000, 16
#: Room for rounding in distances, whose squares are near 1e-16 off.
SLACK = 1e-6
FOUND = "query_id long, vec_id long, score double"


def unit(points: np.ndarray, most: float) -> np.ndarray:
    """The vectors lifted to length 1 (see above)."""
    scaled = points / most
    return np.hstack([scaled, np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", scaled, scaled)))[:, None]])


def asked(queries: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.einsum("ij,ij->i", queries, queries))
    return np.hstack([queries / length[:, None], np.zeros((len(queries), 1))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of points of length 1."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def exact_scores(points: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products of rows, added component by component, so that equal vectors score equal wherever they stand."""
    return np.cumsum(points * queries, axis=-1)[..., -1]


@dataclass
class Tree:
    """A balanced vantage-point tree in heap order: node i has children 2i + 1 (near) and 2i + 2 (far).

    ``begin[j]`` to ``begin[j + 1]`` are the points of leaf j.  ``inner``: largest distance of a near point from the
    node's vantage, ``outer``: smallest of a far one."""

    order: np.ndarray
    vantage: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    begin: np.ndarray

    @property
    def inner_nodes(self) -> int:
        return len(self.inner)

    @staticmethod
    def build(points: np.ndarray, leaf: int) -> Tree:
        n = len(points)
        depth = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
        nodes = (1 << depth) - 1
        order = np.arange(n)
        vantage, inner, outer = np.zeros((nodes, points.shape[1])), np.zeros(nodes), np.zeros(nodes)
        spans = [(0, n)]
        for node in range(nodes):
            lo, hi = spans[node]
            own = order[lo:hi]
            tries = own[:: max(1, len(own) // 8)][:8]
            seen = own[:: max(1, len(own) // 128)]
            best = tries[int(np.argmax(distances(points[tries], points[seen]).var(axis=1)))]
            away = distances(points[best : best + 1], points[own])[0]
            mid = (hi - lo) // 2
            by = np.argsort(away, kind="stable")
            order[lo:hi], away = own[by], away[by]
            vantage[node] = points[best]
            inner[node] = away[mid - 1] if mid else 0.0
            outer[node] = away[mid]
            spans += [(lo, lo + mid), (lo + mid, hi)]
        return Tree(order, vantage, inner, outer, np.array([lo for lo, _ in spans[nodes:]] + [n]))

    def home(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each point falls in."""
        at = np.zeros(len(points), np.int64)
        while len(at) and self.inner_nodes and at[0] < self.inner_nodes:
            away = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.einsum("ij,ij->i", points, self.vantage[at])))
            at = 2 * at + 1 + (away > (self.inner[at] + self.outer[at]) / 2)
        return at - self.inner_nodes

    def bounds(self, points: np.ndarray) -> np.ndarray:
        """Of each point (row) and leaf (column): the least distance that any point which falls in the leaf can have.

        Here a node's halves meet at the middle of its two distances, as in ``home``."""
        away = distances(points, self.vantage)
        cut = (self.inner + self.outer) / 2
        level = np.zeros((len(points), 1))
        node = 0
        while node < self.inner_nodes:
            width = level.shape[1]
            over = away[:, node : node + width] - cut[node : node + width]
            level = np.stack([np.maximum(level, over), np.maximum(level, -over)], axis=2).reshape(len(points), 2 * width)
            node = 2 * node + 1
        return level


@dataclass
class Search:
    """The k best of each query of a block, while it meets the leaves of one tree."""

    tree: Tree
    ids: np.ndarray
    points: np.ndarray
    query_ids: np.ndarray
    queries: np.ndarray
    lifted: np.ndarray
    scale: np.ndarray
    least: np.ndarray
    k: int
    factor: float
    scanned: int = 0
    score: np.ndarray = field(init=False)
    vec_id: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.score = np.full((len(self.queries), self.k), -np.inf)
        self.vec_id = np.full((len(self.queries), self.k), np.iinfo(np.int64).max)

    def bar(self, rows: np.ndarray) -> np.ndarray:
        """The score that a candidate must reach."""
        return np.maximum(self.least[rows], self.score[rows, -1])

    def reach(self, rows: np.ndarray) -> np.ndarray:
        """The distance at that score."""
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * self.bar(rows) / self.scale[rows]))

    def scan(self, leaf: int, rows: np.ndarray) -> None:
        """Compare the points of a leaf with the given queries."""
        lo, hi = self.tree.begin[leaf], self.tree.begin[leaf + 1]
        self.scanned += len(rows) * int(hi - lo)
        if not len(rows) or lo == hi:
            return
        rough = self.queries[rows] @ self.points[lo:hi].T
        slack = SLACK * self.scale[rows]
        hit = (rough >= (self.bar(rows) - slack)[:, None]) & (self.ids[lo:hi][None, :] != self.query_ids[rows][:, None])
        some = np.flatnonzero(hit.any(axis=1))
        if not len(some):
            return
        rows, hit = rows[some], hit[some]
        at, place = np.nonzero(hit)
        score = np.full(hit.shape, -np.inf)
        score[at, place] = exact_scores(self.points[lo:hi][place], self.queries[rows[at]])
        score = np.hstack([self.score[rows], score])
        ids = np.hstack([self.vec_id[rows], np.where(hit, self.ids[lo:hi][None, :], np.iinfo(np.int64).max)])
        best = np.lexsort((ids, -score), axis=1)[:, : self.k]
        self.score[rows], self.vec_id[rows] = np.take_along_axis(score, best, 1), np.take_along_axis(ids, best, 1)

    def run(self, own_shard: bool) -> None:
        """Visit the tree: with ``own_shard`` each query's own leaf first, which gives it a bar to prune by."""
        home = np.full(len(self.queries), -1)
        if own_shard:
            home = self.tree.home(self.lifted)
            for leaf in np.unique(home):
                self.scan(leaf, np.flatnonzero(home == leaf))
        todo = [(0, np.arange(len(self.queries)), np.zeros(len(self.queries)))]
        while todo:
            node, rows, least = todo.pop()
            near_enough = least * self.factor <= self.reach(rows) + SLACK
            rows, least = rows[near_enough], least[near_enough]
            if not len(rows):
                continue
            if node >= self.tree.inner_nodes:
                leaf = node - self.tree.inner_nodes
                self.scan(leaf, rows[home[rows] != leaf])
                continue
            away = distances(self.lifted[rows], self.tree.vantage[node : node + 1])[:, 0]
            todo.append((2 * node + 2, rows, np.maximum(least, self.tree.outer[node] - away)))
            todo.append((2 * node + 1, rows, np.maximum(least, away - self.tree.inner[node])))

    def found(self) -> pa.RecordBatch:
        at, place = np.nonzero((self.score > -np.inf) & (self.score >= self.least[:, None]))
        return _found(self.query_ids[at], self.vec_id[at, place], self.score[at, place])


def _found(query_ids: np.ndarray, vec_ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query_ids, pa.int64()), pa.array(vec_ids, pa.int64()), pa.array(scores, pa.float64())], names=["query_id", "vec_id", "score"])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _arrays(table: pa.Table) -> tuple[Tree, np.ndarray, np.ndarray]:
    """Tree, ids and points of a shard's row."""
    read = lambda name, kind: np.frombuffer(table.column(name)[0].as_py(), kind)
    ids, begin, inner = read("ids", np.int64), read("begin", np.int64), read("inner", np.float64)
    points = read("points", np.float64).reshape(len(ids), -1)
    tree = Tree(np.arange(len(ids)), read("vantage", np.float64).reshape(len(inner), points.shape[1] + 1), inner, read("outer", np.float64), begin)
    return tree, ids, points


@dataclass
class Index:
    """Shards with their trees (a written table), the tree over cells, and what the vectors have in common."""

    shards: DataFrame
    vectors: DataFrame
    cells: Tree
    salts: dict[int, int]
    dim: int
    most: float

    def drop(self) -> None:
        scratch.drop(self.shards, self.vectors)


def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v (doubles) and norm of the rows that take part, one a vec_id and all of one length."""
    v = F.col(embedding).cast("array<double>")
    read = rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    read = read.where(F.coalesce(sound, F.lit(False))).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    read = read.where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    common = read.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    read = read.where(F.size("v") == (common["n"] if common else 0))
    return read.groupBy("vec_id").agg(F.min("v").alias("v"), F.min_by("norm", "v").alias("norm"))


def build(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> Index | None:
    """The index over all vectors of a table, or None if no vector takes part.  Two passes: one writes the vectors with
    their cells, one gathers shards."""
    vectors = scratch.written(usable(rows, vec_id, embedding), "vectors")
    spark = vectors.sparkSession
    n, most, dim = vectors.agg(F.count("*"), F.max("norm"), F.max(F.size("v"))).first()
    if not n:
        return None
    shard_rows = max(256, SHARD_BYTES // (8 * dim))
    sample = _matrix(vectors.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("v").toArrow().column(0), dim)  # bounded: SAMPLE rows
    cells = Tree.build(unit(sample, most), max(CELL_SAMPLE, -(-len(sample) * shard_rows // n)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = cells.home(unit(_matrix(batch.column(1), dim), most)) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32))], names=["vec_id", "v", "cell"])

    placed = scratch.written(vectors.select("vec_id", "v").mapInArrow(place, "vec_id long, v array<double>, cell int"), "cells")
    salts = {r["cell"]: -(-r["count"] // shard_rows) for r in placed.groupBy("cell").count().collect()}  # a row a cell, SAMPLE / CELL_SAMPLE at most

    def grown(table: pa.Table) -> pa.Table:
        ids, points = np.asarray(table.column("vec_id"), np.int64), _matrix(table.column("v"), dim)
        by = np.argsort(ids)  # whatever order the rows arrive in
        ids, points = ids[by], points[by]
        tree = Tree.build(unit(points, most), LEAF)
        raw = [ids[tree.order], points[tree.order], tree.vantage, tree.inner, tree.outer, tree.begin.astype(np.int64)]
        names = ["ids", "points", "vantage", "inner", "outer", "begin"]
        return pa.table({"cell": table.column("cell")[:1], "salt": table.column("salt")[:1]} | {name: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for name, x in zip(names, raw, strict=True)})

    dealt = placed.withColumn("salt", _salt(F.col("cell"), F.col("vec_id"), salts, spark))
    shards = dealt.groupBy("cell", "salt").applyInArrow(grown, "cell int, salt int, " + ", ".join(f"{c} binary" for c in ("ids", "points", "vantage", "inner", "outer", "begin")))
    shards = scratch.written(shards, "shards")
    scratch.drop(vectors)
    return Index(shards, dealt, cells, salts, dim, most)


def _salt(cell: Column, vec_id: Column, salts: dict[int, int], spark) -> Column:
    most = max(salts) + 1
    many = F.lit([salts.get(c, 1) for c in range(most)])
    return F.pmod(F.xxhash64(vec_id), F.element_at(many, cell + 1).cast("long")).cast("int")


def _searched(index: Index, k: int, factor: float, own_shard: bool) -> Callable:
    most = index.most

    def run(key: tuple, shard: pa.Table, block: pa.Table) -> pa.Table:
        if not shard.num_rows or not block.num_rows:
            return pa.Table.from_batches([_found(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))])
        tree, ids, points = _arrays(shard)
        queries = _matrix(block.column("v"), points.shape[1])
        scale = most * np.sqrt(np.einsum("ij,ij->i", queries, queries))
        least = np.asarray(block.column("least"), np.float64) if "least" in block.column_names else np.full(len(queries), -np.inf)
        search = Search(tree, ids, points, np.asarray(block.column("query_id"), np.int64), queries, asked(queries), scale, least, k, factor)
        search.run(own_shard)
        return pa.Table.from_batches([search.found()])

    return run


def search(index: Index, queries: DataFrame, k: int = K, factor: float = FACTOR) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of the queries: rows of ``index.vectors``."""
    if factor < 1:
        raise ValueError("factor must be 1 (exact) or more")
    order = [F.desc("score"), F.col("vec_id")]
    own = queries.select(F.col("vec_id").alias("query_id"), "v", "cell", "salt", F.lit(0).alias("block"))
    shards = index.shards
    pick = lambda rows: rows.groupBy("cell", "salt", "block")
    first = pick(shards.withColumn("block", F.lit(0))).cogroup(pick(own)).applyInArrow(_searched(index, k, factor, True), FOUND)
    first = scratch.written(first, "own-shard")

    # the k-th score of each query, or none where its own shard holds fewer
    reached = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    known = own.select("query_id", "v", F.col("cell").alias("own_cell"), F.col("salt").alias("own_salt")).join(reached, "query_id", "left")
    n = queries.count()
    routed = known.mapInArrow(_routes(index, factor, max(1, -(-n // BLOCK))), "query_id long, v array<double>, least double, cell int, salt int, block int")
    routed = scratch.written(routed, "routed")
    pairs = routed.select(F.col("cell").alias("_c"), F.col("salt").alias("_s"), F.col("block").alias("_b")).distinct()
    asked_of = shards.join(pairs, (F.col("cell") == F.col("_c")) & (F.col("salt") == F.col("_s"))).withColumn("block", F.col("_b").cast("int")).drop("_c", "_s", "_b")
    other = pick(asked_of).cogroup(pick(routed)).applyInArrow(_searched(index, k, factor, False), FOUND)

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    best = first.unionByName(other).withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _routes(index: Index, factor: float, blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each query once for every other shard that its bar does not rule out."""
    cells, salts, dim, most = index.cells, index.salts, index.dim, index.most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.array(sorted(salts), np.int64)
        cell = np.repeat(held, [salts[c] for c in held])
        salt = np.concatenate([np.arange(salts[c]) for c in held])
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                queries = _matrix(batch.column(1), dim)
                least = np.asarray(batch.column(4).fill_null(-np.inf), np.float64)
                reach = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * least / (most * np.sqrt(np.einsum("ij,ij->i", queries, queries)))))
                near = cells.bounds(asked(queries)) * factor <= (reach + SLACK)[:, None]
                sent = near[:, cell] & ~((cell[None, :] == np.asarray(batch.column(2))[:, None]) & (salt[None, :] == np.asarray(batch.column(3))[:, None]))
                row, to = np.nonzero(sent)
                ids = np.asarray(batch.column(0), np.int64)
                step = max(1, (1 << 22) // (8 * dim))
                for a in range(0, len(row), step):
                    r, t = row[a : a + step], to[a : a + step]
                    taken = batch.take(pa.array(r))
                    block = (ids[r] // 20 % blocks) if blocks > 1 else np.zeros(len(r), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [taken.column(0), taken.column(1), pa.array(least[r]), pa.array(cell[t].astype(np.int32)), pa.array(salt[t].astype(np.int32)), pa.array(block.astype(np.int32))],
                        names=["query_id", "v", "least", "cell", "salt", "block"],
                    )

    return run


def neighbours(rows: DataFrame, k: int = K, factor: float = FACTOR, every: int = EVERY) -> DataFrame:
    """The k nearest of every row whose vec_id ``every`` divides, among all other rows of the table."""
    index = build(rows)
    if index is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(index, index.vectors.where(F.col("vec_id") % every == 0), k, factor)
