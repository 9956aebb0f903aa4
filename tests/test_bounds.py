"""Work and memory of single steps that must not follow the size of a table."""

import tracemalloc
from types import SimpleNamespace

import pyarrow as pa
import pytest

from marginalia.operators import retrieval


def test_scoring_does_not_list_every_pair_that_shares_a_token(spark):
    """A thousand chunks of tokens that two thousand questions all ask for: forty million pairs."""
    tokens = [f"t{i}" for i in range(20)]
    asked = pa.table({"_group": ["a"] * 2000, "asked": [tokens] * 2000})
    chunks = pa.record_batch({"chunk_id": [f"c{i:04}" for i in range(1000)], "page": pa.array(range(1000), pa.int32()), "_group": ["a"] * 1000, "own": [tokens + [f"u{i}"] for i in range(1000)]})
    run = retrieval._scored(SimpleNamespace(value=asked), 3)
    tracemalloc.start()
    found = pa.Table.from_batches(list(run(iter([chunks]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    assert found.num_rows == 6000 and set(found.column("chunk_id").to_pylist()) == {"c0000", "c0001", "c0002"}
    assert found.column("score").to_pylist() == pytest.approx([20 / 420**0.5] * 6000)


def shuffled(spark):
    """Bytes that the session's shuffles have written."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()


def test_a_posting_index_and_a_search_write_less_than_the_text(spark, tmp_path):
    import random

    from marginalia.operators import postings

    rng = random.Random(5)
    words = [f"word{i}" for i in range(3000)] + [f"the{i}" for i in range(40)] * 40
    texts = [" ".join(rng.choices(words, k=120)) for _ in range(3000)]
    chunks = spark.createDataFrame([(f"c{i}", "d", i % 5, t) for i, t in enumerate(texts)], "chunk_id string, doc_id string, page int, text string")
    asked = spark.createDataFrame([(i, texts[i][:300]) for i in range(20)], "item_id int, question string")
    before = shuffled(spark)
    found = postings.PostingIndex.build(chunks.coalesce(2), f"file://{tmp_path}/p").search(asked, 3)
    assert {(r["item_id"], r["chunk_id"]) for r in found.rows.where("rank = 1").collect()} == {(i, f"c{i}") for i in range(20)}
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) + shuffled(spark) - before < sum(map(len, texts))


def test_plan_runs_do_not_send_a_text_for_each_request(spark):
    import hashlib

    from pyspark.sql import functions as F

    from marginalia.plans import agents

    text = lambda i: "".join(hashlib.sha256(f"{i}-{j}".encode()).hexdigest() for j in range(14))
    chunks = spark.createDataFrame([(str(d), p, f"{d}-{p}", text(f"{d} {p}")) for d in range(4) for p in range(8)], "doc_id string, page int, chunk_id string, text string")
    ids = F.array((F.col("id") % 2).cast("string"), (F.col("id") % 2 + 2).cast("string"))
    asked = spark.range(2000).select(F.col("id").alias("request_id"), F.lit("ab cd").alias("direction"), ids.alias("paper_ids"), F.lit(None).cast("string").alias("experiment_result"))
    before = shuffled(spark)
    told = agents.plan_runs(asked, chunks).warnings
    assert told.count() == 2000 and shuffled(spark) - before < 2_000_000
    steps = agents.plan_runs(asked.limit(1), chunks).trace.where("tool_name = 'knowledge_search_tool'").first()
    assert steps["observation"] == "8 passages found in 2 papers."


def test_a_substring_index_shuffles_lists_and_not_pieces(spark, tmp_path):
    import random

    from pyspark.sql import functions as F

    from marginalia.operators import substrings

    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(200)]
    texts = [" ".join(rng.choices(words, k=100)) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    before = shuffled(spark)
    index = substrings.SubstringIndex.build(rows, F.array("text"), f"file://{tmp_path}/s")
    assert shuffled(spark) - before < sum(map(len, texts)) * 3 // 2  # places as integers; pieces alone would be more than twice the text
    needle = texts[7][:20]
    assert sorted(r["id"] for r in index.candidates(substrings.pieces_of(needle)).where(F.contains("text", F.lit(needle))).collect()) == [i for i, t in enumerate(texts) if needle in t]
