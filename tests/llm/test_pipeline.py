"""The pipeline on a small corpus with planted cases, stage by stage."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import frame


def corpus(spark, path):
    rng = random.Random(12)
    stems = {"en": ["the", "and", "thing", "over", "with", "stone"], "de": ["der", "und", "schön", "über", "nicht", "stein"]}
    prose = lambda lang, n: " ".join("".join(rng.choices(stems[lang], k=rng.choice([1, 2]))) for _ in range(n))
    rows = [(i, prose(lang, 60), lang) for i in range(120) for lang in [rng.choice(["en", "de"])]]
    items = [(k, prose("en", 30)) for k in range(3)]
    rows += [(200, rows[3][1], "en"), (201, rows[4][1] + " added", "en"), (202, f"{prose('en', 300)} {items[1][1]} {prose('en', 80)}", "en"), (203, "1234 -- 77", "en"), (204, None, None), (205, f"{prose('de', 40)} mail me@host.example {prose('de', 20)}", "de")]
    docs = frame(spark, rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs


def test_stages(spark, tmp_path):
    path = f"file://{tmp_path}"
    docs = corpus(spark, path)
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], path))
        if name != "pack":
            assert kept[-1].columns == docs.columns
    ids = [{r[0] for r in k.select("doc_id").collect()} for k in kept]
    everything = set(range(120)) | set(range(200, 206))
    assert ids[0] == everything and ids[1] == everything - {203, 204}
    assert ids[2] == ids[1] - {200, 201} and ids[3] == ids[2] - {202} and ids[4] == ids[3] == ids[5]
    assert "[EMAIL]" in kept[4].where("doc_id = 205").first()["text"]


def test_run(spark, tmp_path):
    path = f"file://{tmp_path}"
    corpus(spark, path)
    rows = corpus_pipeline.run(spark, path)
    assert {r[0] for r in rows.select("doc_id").distinct().collect()} >= {0, 5, 205}
    assert rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_awkward_tables(spark, tmp_path):
    """Empty, and with repeated, null and clashing columns and a very long text."""
    path = f"file://{tmp_path}"
    docs = corpus(spark, path)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0
    long = spark.createDataFrame([(900, "the and over thing with stone " * 30_000, "en"), (0, "the stone and thing over with them " * 9, "en"), (None, "stone the with over and thing here " * 9, "en")], "doc_id long, text string, lang string")
    first = docs.where("doc_id = 0")
    more = docs.unionByName(first).unionByName(long, allowMissingColumns=True).withColumns({c: F.lit("clash") for c in ("component", "_id", "_key", "shingles", "entity", "tier")})
    kept = [more]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], path))
        assert kept[-1].columns == more.columns
    rows = kept[-1].select("doc_id", "text").collect()
    assert sum(r["doc_id"] == 0 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 1  # equal rows once, another text under the same id
    assert sum(r["doc_id"] == 900 and len(r["text"]) > 800_000 for r in rows) == 1
    packed = corpus_pipeline.STAGES[-1][1](spark, kept[-1], path)
    assert packed.where("doc_id = 900").agg(F.sum("length") == F.max("doc_tokens")).first()[0]
