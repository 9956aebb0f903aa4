"""Small display and transport projections."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def node_radius(importance: Column) -> Column:
    return 7 + 9 * importance


def short_id(identifier: Column) -> Column:
    return F.left(identifier, F.lit(8))


def fixed_score(score: Column) -> Column:
    """Two decimals as text, by the double's exact value with ties to even; as it stands where that is 4 or more."""
    whole = (F.abs(score) * F.lit(float(1 << 60))).cast("long").cast("decimal(38,0)") * F.lit(100).cast("decimal(3,0)")  # exact below 4
    unit, half = (F.lit(Decimal(1 << n)).cast("decimal(20,0)") for n in (60, 59))
    cents = F.floor(whole / unit).cast("decimal(20,0)")
    left = (whole - cents * unit).cast("decimal(38,0)")
    up = (left > half) | ((left == half) & (cents % 2 == 1))
    n = (cents + F.when(up, 1).otherwise(0)).cast("long")
    text = F.concat(F.when(score < 0, "-").otherwise(""), F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))
    return F.when(F.abs(score) < 4, text).otherwise(F.format_string("%.2f", score))


def key_nodes(nodes: DataFrame, most: int = 5) -> DataFrame:
    return nodes.where("is_key").orderBy("rank").limit(most)


def report_json(report: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return report.select(F.to_json(F.struct("*")).alias("report"))


def write_texts(rows: DataFrame, column: str, path: str) -> None:
    """One text column as text files (Markdown answers, JSON reports)."""
    rows.select(column).write.mode("errorifexists").text(path)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def decoded_vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Little-endian float32 bytes (already out of base64) as a vector; null stays null."""
    for raw in batches:
        yield raw.map(lambda b: None if b is None else np.frombuffer(b, "<f4").astype(float).tolist())


def vector_from_base64(text: Column) -> Column:
    return decoded_vector(F.unbase64(text))
