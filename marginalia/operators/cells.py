"""Nearest neighbours in a persistent collection: an inverted-file index with residual codes.

Centroids fitted by Spark cut the vectors into cells; the collection's table is partitioned
by cell, and each vector has, beside itself, its distance from the centroid in one byte a
component.  A search looks at the cells with the nearest centroids only (partition pruning).
Codes give each vector's distance within a known error, so that only vectors whose least
distance is not beyond the k-th largest are read whole and ranked exactly: within the cells
that are looked at nothing is lost.  A cell's radius bounds how near any of its vectors can
be.  With ``exact``, cells that this bound does not rule out after the first pass are looked
at in a second one, so the result is that of a scan; without it, only questions that found
fewer than k rows are (filters may leave too few).

Scale: the table is read by cell; a cell larger than SLICE_ROWS (a vector that very many
rows share) is dealt over slices, questions are dealt over blocks, and a task gets one slice
and one block.  Centroids (CELLS at most) are the only thing that all tasks get.

A null or differently long vector is refused.  Zero vectors and equal ones are kept.  Ties go
by ``seq``.  An empty collection finds nothing; an empty table of questions gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.errors import EngineError
from marginalia.functions import vectors as V
from marginalia.operators.retrieval import filtered

#: Most cells; rows that centroids are fitted on (smallest hashes of seq); rows of a slice; questions of a block.
CELLS, SAMPLE, SLICE_ROWS, BLOCK = 4096, 100_000, 16_384, 1024
LEVELS = 127
#: Entries of a table of rows by centroids: it stays in the processor's cache.
NEAREST_CELLS = 131_072
FOUND = "_found"
SLACK = 1e-9


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a from all rows of b."""
    return np.maximum(0.0, (a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)[None, :])


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, by tables of NEAREST_CELLS entries (or one row) at most."""
    half, out = (centroids * centroids).sum(1) / 2, np.empty(len(points), np.int64)
    step = max(1, NEAREST_CELLS // len(centroids))
    for lo in range(0, len(points), step):
        inner = points[lo : lo + step] @ centroids.T
        inner -= half
        out[lo : lo + step] = inner.argmax(axis=1)
    return out


@dataclass
class CellIndex:
    """An open collection: its folder, centroids, and rows and radius of each cell."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    rows: np.ndarray
    radius: np.ndarray
    _listed: DataFrame | None = None

    @staticmethod
    def build(vectors: DataFrame, path: str, cells: int | None = None) -> CellIndex:
        """Fit, assign and write ``vectors`` (seq, embedding and any columns to be returned or filtered by) to a new folder.

        They are evaluated once, into a copy that is deleted at the end; so is the sample, which is dealt over all cores."""
        spark, path = vectors.sparkSession, path.rstrip("/")
        given, sampled = f"{path}/_given", f"{path}/_sample"
        vectors.write.parquet(given)
        vectors = spark.read.schema(vectors.schema).parquet(given)
        n, dim, least = vectors.agg(F.count("*"), F.max(F.size("embedding")), F.min(F.coalesce(F.size("embedding"), F.lit(-1)))).first()
        if n and dim != least:
            raise EngineError("vectors of a collection have one length", 409)
        wanted = max(1, min(CELLS, cells or round(n**0.5)))
        centroids = np.zeros((1, dim or 1))
        if n and wanted > 1:
            drawn = vectors.select("seq", "embedding").orderBy(F.xxhash64("seq")).limit(SAMPLE)
            drawn.repartition(spark.sparkContext.defaultParallelism, "seq").write.parquet(sampled)
            sample = spark.read.schema(drawn.schema).parquet(sampled).select(array_to_vector("embedding").alias("features"))
            centroids = np.array(KMeans(k=wanted, seed=1, maxIter=8).fit(sample).clusterCenters())
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
        index = CellIndex(spark, path, centroids, np.zeros(len(centroids), np.int64), np.zeros(len(centroids)))
        spark.createDataFrame([], index._stored(vectors)).coalesce(1).write.parquet(f"{path}/columns")
        index.add(vectors)
        for folder in (given, sampled):
            index._delete(folder)
        return index

    @staticmethod
    def open(spark: SparkSession, path: str) -> CellIndex:
        path = path.rstrip("/")
        stored = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # CELLS at most
        index = CellIndex(spark, path, np.array([r["centroid"] for r in stored]), np.zeros(len(stored), np.int64), np.zeros(len(stored)))
        index._count()
        return index

    def _count(self) -> None:
        self._listed = None
        for r in self.spark.read.parquet(f"{self.path}/sizes").groupBy("cell").agg(F.sum("rows").alias("rows"), F.max("radius").alias("radius")).collect():  # CELLS at most
            self.rows[r["cell"]], self.radius[r["cell"]] = r["rows"], r["radius"]

    @staticmethod
    def _stored(vectors: DataFrame) -> T.StructType:
        more = [("cell", T.IntegerType()), ("code", T.BinaryType()), ("scale", T.DoubleType()), ("away", T.DoubleType())]
        return T.StructType([*vectors.schema.fields, *[T.StructField(*x) for x in more]])

    def _delete(self, path: str) -> None:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def clear(self) -> None:
        """Delete what searches have written; their results can no longer be read."""
        self._delete(f"{self.path}/{FOUND}")

    def add(self, vectors: DataFrame) -> None:
        """Append rows to their cells; the centroids stay."""
        centroids, dim = self.centroids, self.centroids.shape[1]
        at = vectors.columns.index("embedding")

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 4096):
                    part = batch.slice(lo, 4096)
                    points = _matrix(part.column(at), dim)
                    cell = _nearest(points, centroids)
                    rest = points - centroids[cell]
                    scale = np.abs(rest).max(axis=1)
                    code = np.rint(rest * (LEVELS / np.where(scale == 0, 1.0, scale))[:, None]).astype(np.int8)
                    more = [pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array(np.sqrt((rest * rest).sum(1)))]
                    yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, "cell", "code", "scale", "away"])

        kinds = self._stored(vectors)
        refused = F.assert_true(F.coalesce(F.size("embedding") == dim, F.lit(False)), F.lit("vectors of a collection have one length"))
        sound = vectors.where(refused.isNull()) if self.rows.any() else vectors
        staged = f"{self.path}/_staged"
        sound.mapInArrow(placed, kinds).write.mode("overwrite").parquet(staged)
        written = self.spark.read.schema(kinds).parquet(staged)
        written.hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{self.path}/vectors")
        written.groupBy("cell").agg(F.count("*").alias("rows"), F.max("away").alias("radius")).coalesce(1).write.mode("append").parquet(f"{self.path}/sizes")
        self._count()

    def vectors(self, cells: list[int] | None = None) -> DataFrame:
        """The rows, or those of some cells: other cells' files are not read."""
        if self._listed is None:  # the cells' folders are listed once, not a search
            self._listed = self.spark.read.schema(self.spark.read.parquet(f"{self.path}/columns").schema).parquet(f"{self.path}/vectors")
        return self._listed if cells is None else self._listed.where(F.col("cell").isin(*cells))


def _routes(index: CellIndex, key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each question with each cell: its place by distance of the centroid, and the least distance of the cell's vectors."""
    centroids, radius, held = index.centroids, index.radius, index.rows > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.flatnonzero(held)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                away = np.sqrt(_squares(_matrix(batch.column(1), centroids.shape[1]), centroids[cells]))
                order = np.argsort(away, axis=1, kind="stable")
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.arange(len(cells))[None, :], axis=1)
                row, col = np.nonzero(np.ones_like(order, bool))
                taken = batch.take(pa.array(row))
                low = np.maximum(0.0, away - radius[cells][None, :] - SLACK)
                yield pa.RecordBatch.from_arrays([taken.column(0), pa.array(cells[col].astype(np.int32)), pa.array(place[row, col].astype(np.int32)), pa.array(low[row, col])], names=[key, "cell", "place", "low"])

    return run


def _coded(centroids: np.ndarray, k: int, names: list[str]) -> Callable:
    """Candidates of one slice: rows that the error of their codes does not rule out."""
    dim = centroids.shape[1]

    def run(_: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if rows.num_rows and asked.num_rows:
            scale = np.asarray(rows.column("scale"), np.float64)
            rest = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.int8).reshape(-1, dim) * (scale / LEVELS)[:, None]
            error = scale * (np.sqrt(dim) / (2 * LEVELS)) + SLACK
            centre = centroids[rows.column("cell")[0].as_py()]
            about = np.sqrt(_squares(_matrix(asked.column("query"), dim) - centre, rest))
            low, high = about - error, about + error
            bar = np.partition(high, k - 1, axis=1)[:, k - 1] if len(scale) > k else np.full(len(about), np.inf)
            question, row = np.nonzero(low <= bar[:, None])
            out = [asked.column(names[0]).take(pa.array(question)), rows.column("seq").take(pa.array(row)), pa.array(low[question, row]), pa.array(high[question, row])]
        else:
            out = [pa.array([], asked.schema.field(names[0]).type), pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.float64())]
        return pa.table(out, names=names)

    return run


def _ranked(index: CellIndex, queries: DataFrame, pairs: DataFrame, cells: list[int], k: int, key: str, filters: dict) -> DataFrame:
    """The exact k nearest of each question within its cells; ``pairs``: key and cell."""
    kind = queries.schema[key].dataType.simpleString()
    slices = F.lit([max(1, -(-int(r) // SLICE_ROWS)) for r in index.rows])
    blocks = max(1, -(-queries.count() // BLOCK))
    rows = filtered(index.vectors(cells), **filters)
    mine = rows.select("cell", F.pmod(F.xxhash64("seq"), F.element_at(slices, F.col("cell") + 1)).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "seq", "code", "scale")
    asked = pairs.join(queries.select(key, "query"), key).withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("slice", F.explode(F.sequence(F.lit(0), F.element_at(slices, F.col("cell") + 1) - 1)))
    group = ("cell", "slice", "block")
    names = [key, "seq", "low", "high"]
    found = mine.groupBy(*group).cogroup(asked.groupBy(*group)).applyInArrow(_coded(index.centroids, k, names), f"{key} {kind}, seq long, low double, high double")
    place = F.row_number().over(Window.partitionBy(key).orderBy("high", "seq"))
    bars = found.withColumn("place", place).where(F.col("place") <= k).groupBy(F.col(key).alias("_k")).agg(F.when(F.count("*") == k, F.max("high")).alias("bar"))
    kept = found.join(bars, F.col(key) == F.col("_k")).where(F.col("bar").isNull() | (F.col("low") <= F.col("bar"))).select(key, F.col("seq").alias("_seq"))
    whole = kept.join(rows.drop("code", "scale", "away"), F.col("_seq") == F.col("seq")).drop("_seq").join(queries.select(F.col(key).alias("_k"), "query"), F.col(key) == F.col("_k")).drop("_k")
    return _best(whole.withColumn("distance", V.squared_distance(F.col("embedding"), F.col("query"))).drop("query", "embedding"), k, key)


def _best(found: DataFrame, k: int, key: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy("distance", "seq"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def search(index: CellIndex, queries: DataFrame, k: int = 5, probes: int = 8, exact: bool = True, key: str = "item_id", **filters) -> DataFrame:
    """The k nearest of every question (``key``, ``query``) by squared distance, scored 1/(1+d): key, rank, distance, score and
    the collection's columns.  Keys are unique; ``filters`` are those of retrieval.filtered, applied before the cut."""
    queries = queries.select(key, V.as_doubles(F.col("query")).alias("query"))
    dim = index.centroids.shape[1]
    if not queries.where(F.coalesce(F.size("query"), F.lit(-1)) != dim).isEmpty() and index.rows.any():
        raise EngineError(f"the collection holds vectors of length {dim}", 409)
    kind = queries.schema[key].dataType.simpleString()
    routes = queries.mapInArrow(_routes(index, key), f"{key} {kind}, cell int, place int, low double")
    near = routes.where(F.col("place") < probes).select(key, "cell")
    cells = sorted(r["cell"] for r in near.select("cell").distinct().collect())  # CELLS at most
    first_path = f"{index.path}/{FOUND}/{uuid.uuid4().hex}"
    first = _ranked(index, queries, near, cells, k, key, filters)
    first.write.parquet(first_path)
    first = index.spark.read.schema(first.schema).parquet(first_path)
    reached = first.groupBy(F.col(key).alias("_k")).agg(F.when(F.count("*") == k, F.max("distance")).alias("reached"))
    far = routes.where(F.col("place") >= probes).join(reached, F.col(key) == F.col("_k"), "left")
    short = F.col("reached").isNull()
    still = far.where(short | (F.col("low") * F.col("low") <= F.col("reached") * (1 + SLACK)) if exact else short).select(key, "cell")
    more = sorted(r["cell"] for r in still.select("cell").distinct().collect())
    if not more:
        return _scored(first)
    second = _ranked(index, queries, still, more, k, key, filters)
    return _scored(_best(first.drop("rank").unionByName(second.drop("rank")), k, key))


def _scored(found: DataFrame) -> DataFrame:
    return found.withColumn("score", V.similarity(F.col("distance")))
