"""Uploaded files as pages and chunk rows.

Files are read as bytes; text is decoded as UTF-8 with bad bytes dropped.  A PDF library
is not part of this engine: ``pages_of`` takes any function from bytes to page texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.errors import EngineError
from marginalia.functions import text as X


def text_page(content: bytes) -> list[str]:
    """The whole file as one page; none if it is blank."""
    page = content.decode("utf-8", errors="ignore")
    return [page] if page.strip() else []


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("title"), "content")


def pages(files: DataFrame, pages_of: Callable[[bytes], list[str]] = text_page) -> DataFrame:
    """doc_id, title, page, text: pages numbered from 1 after blank ones are dropped; a file without pages has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r.doc_id, r.title, n, t) for r in batch.itertuples() for n, t in enumerate((p for p in pages_of(bytes(r.content)) if p.strip()), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "title", "page", "text"])

    return files.select("doc_id", "title", "content").mapInPandas(run, "doc_id string, title string, page int, text string")


def chunk_rows(files: DataFrame, page_rows: DataFrame, size: int = X.CHUNK_CHARS) -> DataFrame:
    """Chunks of every page, numbered over the document; a file without text has one placeholder row."""
    cut = page_rows.select("doc_id", "page", F.posexplode(X.pieces(F.col("text"), size)).alias("pos", "text"))
    empty = files.select("doc_id", "title").join(cut.select("doc_id").distinct(), "doc_id", "left_anti")
    placeholder = empty.select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("pos"), F.concat(F.lit("Uploaded paper "), "title").alias("text"))
    rows = cut.unionByName(placeholder)
    return rows.select(F.concat_ws("-", "doc_id", F.col("page").cast("string"), F.col("pos").cast("string")).alias("chunk_id"), "doc_id", "page", "text")


def check_upload(name: str | None, content: bytes | None) -> None:
    if not name:
        raise EngineError("a file name is required")
    if not content:
        raise EngineError("the file is empty")
