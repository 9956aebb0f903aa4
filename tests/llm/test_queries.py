"""The registered queries: against SQL where there is some, and the URL filter's cases."""

import pytest
from pyspark.sql import functions as F

from marginalia.llm import host_reputation, queries
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    assert_same(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name])


@pytest.mark.parametrize("name", ["op1_token_files", "op4_disclosure", "op5_tier_packing", "op7_hidden_markov", "op8_token_counts"])
def test_registered_query_covers_all_documents(spark, name):
    found = queries.queries()[name](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found.select("doc_id").distinct().count() == docs.count()
    if name == "op1_token_files":
        row = found.agg(F.max(F.col("start") + F.col("n_tokens")).alias("end"), F.sum("n_tokens").alias("n")).first()
        assert row["end"] == row["n"]
    if name == "op5_tier_packing":
        assert found.groupBy("doc_id").agg((F.sum("length") == F.max("doc_tokens")).alias("whole")).where("not whole").count() == 0


def test_language_query_on_held_out_documents(spark):
    found = queries.op9_language(spark, "/root/testdata/sf0.01").where("held_out")
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    assert found.join(lang, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.99


def test_quality_query_on_labels(spark):
    found = queries.op6_quality(spark, "/root/testdata/sf0.01").where("not base_failed")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rates = {r["quality"]: r["k"] for r in found.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert rates[1] >= 0.98 and rates[0] <= 0.1


def test_rules_and_hosts(spark):
    urls = [(1, "http://A.Example.ORG/es/x?q"), (2, "https://example.org/en/12"), (3, "https://org/y"), (4, "http://shop.com/fr/1"), (5, "http://shop.com/de/1#f"), (6, "http://shop.com"), (7, None), (8, "nothing"), (9, "http://notexample.org/es/"), (10, "http://x.com:80/FR/"), (None, "ftp://com/de/")]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("alpha", F.lit(1))
    none = spark.createDataFrame([], "page_id long, bad boolean")
    got = {r["page_id"]: r for r in host_reputation.judged(pages, none).collect()}
    want = {1: ("a.example.org", "/es/x", "example.org/es/", "block"), 2: ("example.org", "/en/12", "example.org/en/1", "block"), 3: ("org", "/y", "org/", "allow"), 4: ("shop.com", "/fr/1", "com/fr/", "allow"), 5: ("shop.com", "/de/1", "com/de/", "block"), 6: ("shop.com", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("notexample.org", "/es/", "org/", "allow"), 10: ("x.com:80", "/FR/", None, "allow"), None: ("com", "/de/", "com/de/", "block")}
    assert {k: (r["host"], r["path"], r["rule"], r["verdict"]) for k, r in got.items()} == want


def test_reputation_shrinks(spark):
    hosts = [(i, f"http://bad.net/{i}") for i in range(60)] + [(100 + i, f"http://h{i % 20}.good.net/{i}") for i in range(60)] + [(200, "http://new.bad.net/"), (201, "http://once.good.net/"), (202, "http://else.info/")]
    pages = spark.createDataFrame(hosts, "page_id long, url string")
    outcomes = spark.createDataFrame([(i, i % 10 != 0) for i in range(60)] + [(100 + i, False) for i in range(60)] + [(201, True), (1, None), (None, True)], "page_id long, bad boolean")
    got = {r["page_id"]: r for r in host_reputation.judged(pages, outcomes).collect()}
    assert got[0]["verdict"] == got[200]["verdict"] == "block" and got[100]["verdict"] == got[201]["verdict"] == got[202]["verdict"] == "allow"
    assert got[201]["bad_mean"] > got[100]["bad_mean"] and len(got) == len(hosts)
    assert host_reputation.judged(pages.limit(0), outcomes).count() == 0
    twice = host_reputation.judged(pages.unionByName(pages), outcomes).collect()
    assert len(twice) == 2 * len(hosts) and {r["verdict"] for r in twice if r["page_id"] == 0} == {"block"}
