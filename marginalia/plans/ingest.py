"""Uploads as one call: pages, chunks, vectors, guards, store and index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.errors import EngineError
from marginalia.operators import index
from marginalia.operators.store import Store
from marginalia.plans.providers import Embedding
from marginalia.sources import documents


def ingest(store: Store, files: DataFrame, provider: Embedding, configured: Embedding | None = None, pages_of: Callable[[bytes], list[str]] = documents.text_page) -> DataFrame:
    """Store and index ``files`` (doc_id, title, content); doc_id, title and chunk_count of each.

    Refused before anything is written: files without name or content (400), fallback vectors and a
    migration under way (503), a provider whose profile is not the configured one (409), a doc_id that is stored (409)."""
    if not files.where("coalesce(title, '') = '' or coalesce(length(content), 0) = 0").isEmpty():
        raise EngineError("a file has no name or no content")
    if provider.is_fallback:
        raise EngineError("Fallback vectors are never indexed.", 503)
    if configured and configured.key != provider.key:
        raise EngineError(f"The index holds {configured.key}, the vectors are {provider.key}.", 409)
    if store.locked():
        raise EngineError("A migration is under way.", 503)
    named = files.select("doc_id", "title", F.current_timestamp().alias("created_at"), F.lit(False).alias("is_favorite"), F.array().cast("array<string>").alias("tags"))
    store.add("papers", named)
    store.put("chunks", documents.chunk_rows(files, documents.pages(files, pages_of)))
    stored = store.read("chunks").join(files.select("doc_id"), "doc_id", "left_semi")  # parsed once
    index.index_chunks(store, stored, provider)
    return files.select("doc_id", "title").join(stored.groupBy("doc_id").agg(F.count("*").alias("chunk_count")), "doc_id")
