"""The inverted index against the scan: ties, zero scores, empty and null texts, blocks skipped."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.errors import EngineError
from marginalia.operators import postings, retrieval
from marginalia.sources import views

CHUNK = "chunk_id string, doc_id string, page int, text string"


def listed(rows):
    return [(r["item_id"], r["rank"], r["chunk_id"], r["score"]) for r in rows.orderBy("item_id", "rank").collect()]


@pytest.fixture
def corpus(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["the"] * 20
    rows = [(f"c{i}", "d", i % 7, " ".join(rng.choices(words, k=rng.choice([3, 8, 20])))) for i in range(400)]
    rows += [("e", "d", 0, ""), ("n", "d", 1, None), ("x1", "d", 3, "same words here"), ("x2", "d", 3, "same words here"), ("x3", "d", 2, "here same words"), ("cjk", "d", 1, "机器学习方法")]
    asked = [(1, "the w1 w2 w3"), (2, "same words here"), (3, "nothing known"), (4, ""), (5, None), (6, "w5"), (7, "学习方法"), (8, "unseen w59 the the")]
    return spark.createDataFrame(rows, CHUNK), spark.createDataFrame(asked, "item_id int, question string")


@pytest.mark.parametrize("k, ahead, block", [(5, 8, 256), (3, 1, 4), (12, 2, 16)])
def test_same_as_the_scan(spark, corpus, tmp_path, monkeypatch, k, ahead, block):
    chunks, asked = corpus
    monkeypatch.setattr(postings, "AHEAD", ahead)
    monkeypatch.setattr(postings, "BLOCK_ROWS", block)
    index = postings.PostingIndex.build(chunks, f"file://{tmp_path}/p")
    found = index.search(asked, k)
    got, want = listed(found.rows), listed(retrieval.lexical_topk_many(chunks, asked, k))
    assert [x[:3] for x in got] == [x[:3] for x in want] and [x[3] for x in got] == pytest.approx([x[3] for x in want])
    work = {r["item_id"]: (r["touched"], r["read"]) for r in found.work.collect()}
    assert set(work) == {1, 2, 6, 7, 8} and all(read <= touched for touched, read in work.values())
    if block == 4:
        assert work[1][1] < work[1][0]


def test_empty_sides_and_bounds(spark, corpus, tmp_path):
    chunks, asked = corpus
    none = postings.PostingIndex.build(chunks.limit(0), f"file://{tmp_path}/a")
    assert none.search(asked).rows.count() == 0
    index = postings.PostingIndex.build(chunks.where("chunk_id in ('e', 'n', 'x1')"), f"file://{tmp_path}/b")
    assert index.search(asked.limit(0)).rows.count() == 0
    assert [r[2] for r in listed(index.search(asked.where("item_id = 2"), 5).rows)] == ["x1", "e", "n"]
    index.clear()
    with pytest.raises(EngineError):
        index.search(asked, 501)


def test_one_question_as_lexical_topk(spark, tmp_path):
    chunks = views.chunks(spark, "/root/testdata/sf0.001")
    index = postings.PostingIndex.build(chunks, f"file://{tmp_path}/p")
    question = "The reading of thtion and the erin, in thand house"
    found = index.search(spark.createDataFrame([(1, question)], "item_id int, question string"), 10)
    want = retrieval.lexical_topk(chunks, question, 10).orderBy("rank").collect()
    assert [x[2] for x in listed(found.rows)] == [r["chunk_id"] for r in want]
    work = found.work.first()
    assert work["read"] < work["touched"]
