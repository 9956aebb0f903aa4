"""Text expressions against small Python models, on literals and generated strings."""

import re
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.functions import text as X


def column(spark, expression, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", expression(F.col("t")).alias("x"))
    return [r["x"] for r in sorted(rows.collect(), key=lambda r: r["i"])]


def chunked(text):
    whole = " ".join((text or "").split())
    return [whole[i : i + 900] for i in range(0, len(whole), 900)]


def tokenised(text):
    folded = text.casefold()
    cjk = "".join(c for c in folded if "㐀" <= c <= "鿿")
    return set(re.findall("[a-z0-9_]{2,}", folded)) | {cjk[i : i + 2] for i in range(len(cjk) - 1)}


def test_chunks_cut_at_900(spark):
    texts = ["a" * 901, "a" * 900, "", "  \n ", None, "x  y\n\nz", "é" * 1801]
    got = column(spark, X.pieces, texts)
    assert [[len(c) for c in g] for g in got][:2] == [[900, 1], [900]]
    assert got == [chunked(t) for t in texts]


def test_tokens_of_literals(spark):
    got = column(spark, X.tokens, ["检索 RAG", "Straße", "a ab a_b", "检索增强", "", None])
    assert [set(g) for g in got] == [{"rag", "检索"}, {"strasse"}, {"ab", "a_b"}, {"检索", "索增", "增强"}, set(), set()]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="abZ_9 ßé\n检索增", max_size=40), min_size=1, max_size=20))
def test_tokens_and_chunks_of_any_text(spark, texts):
    assert [set(t) for t in column(spark, X.tokens, texts)] == [tokenised(t) for t in texts]
    assert column(spark, X.pieces, texts) == [chunked(t) for t in texts]


@pytest.mark.parametrize("query", ["a", "%", "_b", "É", "a\\", "A%c", "x"])
def test_like_follows_sqlite(spark, query):
    values = ["abc", "ABC", "é", "É", "a\\b", "a%b", "", "xbz", None]
    db = sqlite3.connect(":memory:")
    want = [db.execute("select ? like ?", (v, f"%{query}%")).fetchone()[0] for v in values]
    got = column(spark, lambda c: X.like_ascii(c, query), values)
    assert got == [None if w is None else bool(w) for w in want]


def test_labels_first_that_matches(spark):
    got = column(spark, lambda c: X.after_labels(c, ["Dataset", "Data"]), ["data: A, B and C; rest", "Datasets : X.\n", "nothing", "Dataset: ,. data: Z"])
    assert got == [["A", "B", "C"], ["X"], ["unknown"], []]


def test_sentences(spark):
    got = column(spark, lambda c: X.sentences_with(c, ["loss"]), ["A. The Loss is! Fine. loss? x", "none here", ""])
    assert got == [["The Loss is!", "loss?"], ["unknown"], ["unknown"]]


def test_citation_numbers(spark):
    got = column(spark, lambda c: X.citation_numbers(c, F.lit(3)), ["[1] [4] [0] [3][3] [x]", ""])
    assert got == [[1, 3, 3], []]


def test_folding_of_every_character_that_tables_fold(spark):
    texts = ["".join(X.FOLDED), "aﬁb", "ﬁﬀ", "ẞßſΣς", "Straﬄe ꭰᏸ ŉx", "plain", ""] + [f"x{c}Y" for c in X.FOLDED]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.fold(F.col("t")).alias("f")).collect()
    assert {r["t"]: r["f"] for r in rows} == {t: "".join(X.FOLDED.get(c, c) for c in t).lower() for t in texts}


def test_cleanup_of_one_row_group_is_dealt_over_tasks(spark, tmp_path):
    from marginalia.plans import registry

    spark.range(2000).selectExpr("id as p_partkey", "concat('name ', id) as p_name").coalesce(1).write.parquet(f"file://{tmp_path}/part.parquet")
    found = registry.queries()["text_cleanup"](spark, f"file://{tmp_path}")
    assert found.count() == 2000 and found.select(F.spark_partition_id().alias("p")).distinct().count() > 1
