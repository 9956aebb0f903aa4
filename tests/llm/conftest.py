import zlib

import numpy as np
import pytest

WORD = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "lorem Ipsum dolor " * 40_000


@pytest.fixture(scope="session")
def texts():
    """Awkward texts: null, empty, blank, unicode, ties, repeats and a very long one."""
    base = [None, "", " \n\t ", "one", "A b c d", "a B c d e", "Straße  naïve 日本語 テスト 😀 x", "tab\tand\nline\nline\n\nline", "▁▁a ▁ b　c d", "<s> hi </s> <|endoftext|> x", "x" * 3000, "it's 12,345.67 we'll", "\x00 odd \x01"]
    return [*base, *base[5:8], LONG]


def frame(spark, rows, schema="doc_id long, text string"):
    """Rows with extra columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    out = spark.createDataFrame(rows, schema)
    for name in ("value", "id", "n", "start", "score", "kept", "good", "component", "lang_pred", "row", "hash"):
        if name not in out.columns:
            out = out.withColumn(name, F.lit("clash"))
    return out


@pytest.fixture
def documents(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id here"), (3, "one")]
    return frame(spark, rows)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
