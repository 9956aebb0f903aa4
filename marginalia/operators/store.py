"""Parquet tables in buckets of their key: upserts that rewrite only the buckets they touch.

A table's folder is partitioned by ``bucket``, a hash of the first key column.  A put
evaluates its rows once into a staged table, writes the new content of the touched buckets
beside the table, and then overwrites just these partitions from it (dynamic partition
overwrite), so that the cost follows the buckets touched, not the table.  What is beside the
table is complete before anything in the table changes; a put that ends in between is
finished from it by the next one, or by ``recover``."""

from __future__ import annotations

import os
import socket
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.errors import EngineError
from marginalia.schema import KEYS, TABLES

#: Buckets of the tables of a new store; a store keeps its number.
BUCKETS = 16
PENDING, SIZE = "_pending", "_BUCKETS."


def latest_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the greatest by ``order``; aggregated before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_x"))
    return best.select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest]).select(*rows.columns)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows whose key is not new, and the new rows."""
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new)


def upsert_migrations(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert that keeps a migration's first start, profile and collections; it completes only by complete or failed."""
    firsts = ["started_at", "profile_key", "source_collection", "target_collection"]
    firsts = [c for c in firsts if c in existing.columns]
    was = existing.select("migration_id", *[F.col(c).alias(f"_{c}") for c in firsts])
    ended = F.col("status").isin("complete", "failed")
    kept = new.join(was, "migration_id", "left").select(
        *[F.coalesce(f"_{c}", c).alias(c) if c in firsts else (F.when(ended, F.col(c)).alias(c) if c == "completed_at" else F.col(c)) for c in new.columns]
    )
    return upsert(existing, kept, ["migration_id"])


def first_and_last(rows: DataFrame) -> DataFrame:
    """A stream of migration writes reduced at once: first start and profile, last status, end of the last if it ended."""
    last = F.struct("started_at", "event_id")
    reduced = rows.groupBy("migration_id").agg(
        F.min("started_at").alias("started_at"), F.min_by("profile_key", last).alias("profile_key"), F.max_by("status", last).alias("status"), F.max("started_at").alias("_last"), F.count("*").alias("writes")
    )
    return reduced.withColumn("completed_at", F.when(F.col("status").isin("complete", "failed"), F.col("_last"))).drop("_last")


class Store:
    """Tables of a root folder that Spark can read and write (any Hadoop file system).

    Names that begin with ``_`` are the store's own and are not read as data.  One writer a table: a second one is
    refused while a put is under way."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self._wanted = spark, root.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    @property
    def buckets(self) -> int:
        """How many buckets every table has, from the store's first put on."""
        return next((int(n.removeprefix(SIZE)) for n in self._listed(self.root) if n.startswith(SIZE)), self._wanted)

    def held(self, name: str) -> list[int]:
        """The buckets of a table that hold rows."""
        return sorted(int(n.removeprefix("bucket=")) for n in self._listed(f"{self.root}/{name}") if n.startswith("bucket="))

    def bucket(self, name: str) -> Column:
        """The bucket of a row: tables whose first key is the same place it in the same one."""
        return F.pmod(F.xxhash64(KEYS[name][0]), F.lit(self.buckets)).cast("int")

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets; an empty table before the first put."""
        schema = TABLES[name]
        if not self.held(name):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.root}/{name}")
        return (rows if buckets is None else rows.where(F.col("bucket").isin(*buckets))).drop("bucket")

    @contextmanager
    def _writing(self, name: str) -> Iterator[None]:
        lock = f"{self.root}/{name}/_WRITER"
        if not self._take(lock, "put"):
            raise EngineError(f"{name}: another put is under way", 503)
        try:
            yield
        finally:
            self._delete(lock)

    @contextmanager
    def staged(self, rows: DataFrame) -> Iterator[DataFrame]:
        """``rows`` evaluated once into a table of their own, which is gone afterwards."""
        path = f"{self.root}/_staged/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        try:
            yield self.spark.read.schema(rows.schema).parquet(path)
        finally:
            self._delete(path)

    def put(self, name: str, rows: DataFrame) -> None:
        """Replace rows by key, one row a key; keys that are not given stay."""
        schema, keys = TABLES[name], KEYS[name]
        rows = rows.select(*schema.fieldNames()).withColumn("bucket", self.bucket(name))
        with self.staged(rows.dropDuplicates(keys)) as new, self._writing(name):
            self._finish(name)
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most the table's buckets
            if not touched:
                return
            mark = self._path(f"{self.root}/{SIZE}{self.buckets}")
            if not self._fs.exists(mark):
                self._fs.create(mark, False).close()
            old = self.read(name, touched).withColumn("bucket", self.bucket(name))
            upsert(old, new, keys).write.parquet(f"{self.root}/{name}/{PENDING}/{uuid.uuid4().hex}")
            self._finish(name)

    def _finish(self, name: str) -> None:
        """Move what is complete beside the table into it, and drop what is not; a large bucket is written by several tasks."""
        for one in self._listed(f"{self.root}/{name}/{PENDING}"):
            path = f"{self.root}/{name}/{PENDING}/{one}"
            if self._fs.exists(self._path(f"{path}/_SUCCESS")):
                whole = self.spark.read.parquet(path)
                whole.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.root}/{name}")
            self._delete(path)

    def recover(self, name: str) -> None:
        """Finish the puts of a writer that died."""
        with self._writing(name):
            self._finish(name)

    def add(self, name: str, rows: DataFrame) -> None:
        """Plain insert; a key that exists is an error."""
        if not self.read(name).join(rows.select(*KEYS[name]), KEYS[name], "left_semi").isEmpty():
            raise EngineError(f"{name}: key exists", 409)
        self.put(name, rows)

    def put_vectors(self, rows: DataFrame, dimension: int) -> None:
        """Validated vector upsert: every vector has the dimension; rewritten rows move to the end.

        The rows, and so their embeddings, are evaluated once; what was written is validated and put.
        Only the order of ``seq`` counts, so a sort over ranges numbers the rows, not one task."""
        start = self.read("vectors").agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
        with self.staged(rows) as written:
            if not written.where((F.size("embedding") != dimension) | F.col("embedding").isNull()).isEmpty():
                raise EngineError(f"vectors must have dimension {dimension}", 409)
            ordered = written.orderBy("seq" if "seq" in rows.columns else "chunk_id")
            self.put("vectors", ordered.withColumn("seq", F.monotonically_increasing_id() + F.lit(start + 1)))

    def _take(self, lock: str, owner: str) -> bool:
        """Create a lock file; False if another holds it.  A dead process of this host holds nothing."""
        path = self._path(lock)
        if self._fs.exists(path) and self._holder_is_dead(path):
            self._delete(lock)
        try:
            out = self._fs.create(path, False)
        except Exception:
            return False
        out.write(bytearray(f"{socket.gethostname()} {os.getpid()} {owner}\n".encode()))
        out.close()
        return True

    def lock(self, owner: str) -> bool:
        """Take the migration's lock; False if another holds it."""
        return self._take(f"{self.root}/LOCK", owner)

    def _holder_is_dead(self, path) -> bool:
        stream = self._fs.open(path)
        try:
            host, pid, *_ = (stream.readLine() or "").split(" ") + ["", ""]
        finally:
            stream.close()
        if host != socket.gethostname() or not pid.isdigit():
            return False
        try:
            os.kill(int(pid), 0)
        except ProcessLookupError:
            return True
        except PermissionError:
            return False
        return False

    def locked(self) -> bool:
        return self._fs.exists(self._path(f"{self.root}/LOCK"))

    def unlock(self) -> None:
        self._fs.delete(self._path(f"{self.root}/LOCK"), False)
