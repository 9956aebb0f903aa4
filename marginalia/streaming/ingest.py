"""Incremental ingest: new rows of a stream are upserted by key, a batch at a time.

Nothing here has watermarks or state: the table's keys make replays harmless."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from marginalia.functions import text as X
from marginalia.operators.store import Store, latest_per_key
from marginalia.schema import KEYS


def upserting(stream: DataFrame, store: Store, name: str, order: str) -> DataStreamWriter:
    """A writer that keeps the last row of each key by ``order``; a replayed batch changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        store.put(name, latest_per_key(batch, KEYS[name], F.col(order)))

    return stream.writeStream.foreachBatch(write)


def chunked(stream: DataFrame) -> DataFrame:
    """Chunk rows of a stream of (doc_id, text): stateless, so append mode."""
    cut = stream.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(X.pieces(F.col("text"))).alias("pos", "text"))
    page = (F.col("pos") + 1).cast("int")
    return cut.select(F.concat_ws("-", "doc_id", page.cast("string")).alias("chunk_id"), "doc_id", page.alias("page"), "text")
