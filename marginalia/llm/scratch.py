"""Written intermediate tables: they cut lineage and survive lost executors.

Tables go to the shared folder named by ``spark.checkpoint.dir``.  Where that is unset, a
session of one machine (local master) gets a temporary folder; a cluster is refused."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"
_fallback: list[str] = []


def root(spark: SparkSession) -> str:
    """The shared folder; a local one only where the session names none."""
    named = spark.conf.get(CONF, None) or spark.sparkContext.getConf().get(CONF)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError(f"{CONF} must name a folder that all executors share")
    if not _fallback:
        _fallback.append(tempfile.mkdtemp(prefix="marginalia-"))
    return f"file://{_fallback[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/marginalia/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once and return a reader of what was written; see ``drop``."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def kept(df: DataFrame) -> DataFrame:
    """``df`` in Spark's own cache, for small tables that are read a few times: no files, and a lost executor's
    part is computed again from written tables; see ``drop``."""
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    out._scratch_kept = True
    return out


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows that go to a Python worker at once, for tables of whole texts: Spark's own number, 10,000, takes tens of MB on
    either side for each task.  A number that the session has set itself stands."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(rows))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    mark = "_"
    while any(c.startswith(mark) for c in taken):
        mark += "_"
    return [mark + n for n in names]


def drop(*tables: DataFrame) -> None:
    """Delete written and kept tables that nothing reads any more."""
    for df in tables:
        if getattr(df, "_scratch_kept", False):
            df.unpersist()
        path = getattr(df, "_scratch_path", None)
        if path:
            spark = df.sparkSession
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
