"""Uploads in one call, verification, the works source and the graph's ladder."""

import json

import pytest
from pyspark.sql import functions as F

from marginalia.errors import EngineError
from marginalia.operators import graph, index
from marginalia.operators.store import Store
from marginalia.plans import ingest, providers
from marginalia.sources import literature

FILES = "doc_id string, title string, content binary"


def test_ingest(spark, tmp_path):
    store, mock = Store(spark, f"file://{tmp_path}"), providers.embedding("mock")
    files = spark.createDataFrame([("a", "a.txt", b"x" * 2000), ("b", "b.txt", b" \n")], FILES)
    assert {r["doc_id"]: r["chunk_count"] for r in ingest.ingest(store, files, mock, mock).collect()} == {"a": 3, "b": 1}
    assert store.read("papers").count() == 2 and store.read("vectors").count() == 4
    seen = index.verified(store, mock.key).first()
    assert seen["mode"] == "verify-only" and seen["state"] == "ready" and seen["indexed_count"] == 4
    assert index.entry(store.read("vectors"), "b-1-0").first()["text"] == "Uploaded paper b.txt"
    assert index.dimension(store.read("vectors")).first()[0] == 16 and index.dimension(store.read("vectors").limit(0)).first()[0] is None
    other = providers.Embedding("other", "m", 8, transport=lambda texts: [[0.0] * 8] * len(texts))
    more = spark.createDataFrame([("c", "c.txt", b"y")], FILES)
    for rows, provider, code in ((more, other, 409), (more, providers.embedding("openai"), 503), (files, mock, 409), (more.withColumn("title", F.lit("")), mock, 400)):
        with pytest.raises(EngineError) as error:
            ingest.ingest(store, rows, provider, mock)
        assert error.value.code == code
    store.lock("me")
    with pytest.raises(EngineError):
        ingest.ingest(store, more, mock)
    assert store.read("papers").count() == 2 and index.verified(store, mock.key).first()["state"] == "migrating"


def fetched(asked):
    if asked.get("filter") == "cites:W2" or asked.get("search") == "down":
        raise OSError("away")
    return json.dumps({"results": [{"id": "https://x/W9", "display_name": "n", "publication_year": 2020, "cited_by_count": 3, "referenced_works": ["x/W1"]}]})


def test_works_source(spark):
    from marginalia.sources.remote import WorksSource

    spark.dataSource.register(WorksSource)
    load = lambda **o: spark.read.format("openalex").options(fetch="tests.test_ingest:fetched", **o).load()
    assert literature.openalex_works(load(query="q", key="k")).first()["refs"] == ["W1"]
    citing = literature.openalex_works(load(cites="W1,W2", key="k"), keep=("cites",)).collect()
    assert [(r["cites"], r["paper_id"]) for r in citing] == [("W1", "W9")]
    assert all(r["body"] is None and r["warning"] for o in ({"query": " ", "key": "k"}, {"query": "q"}, {"query": "down", "key": "k"}) for r in load(**o).collect())


def paged(query, rows, start):
    if start == 4:
        raise OSError("away")
    return [(f"p{n}", f"{query} {n}", "a", 2020) for n in range(start, min(start + rows, 9))]


def paged_works(asked):
    number = int(asked.get("page", 1))
    if number == 2:
        raise OSError("away")
    return json.dumps({"results": [{"id": f"https://x/W{number}", "display_name": "n", "publication_year": 2020, "cited_by_count": 3, "referenced_works": []}]})


def test_pages_of_sources(spark):
    from marginalia.sources.remote import LiteratureSource, WorksSource

    spark.dataSource.register(LiteratureSource)
    spark.dataSource.register(WorksSource)
    load = lambda **o: spark.read.format("literature").options(query="q", fetch="tests.test_ingest:paged", limit=11, page=2, **o).load()
    for concurrency in (1, 3, 50):
        rows = load(concurrency=concurrency)
        assert rows.rdd.getNumPartitions() == min(concurrency, 6)
        found = {r["paper_id"]: r["warning"] for r in rows.collect()}
        assert set(found) == {"p0", "p1", "p2", "p3", "arxiv-5", "arxiv-6", "p6", "p7", "p8"}
        assert [k for k, told in found.items() if told] == ["arxiv-5", "arxiv-6"] and "row 5 on (away)" in found["arxiv-5"]
    works = spark.read.format("openalex").options(query="q", key="k", fetch="tests.test_ingest:paged_works", pages=3).load()
    assert [r["warning"] for r in works.where("warning is not null").collect()] == ["The works service failed on page 2 (away)."]
    assert sorted(r["paper_id"] for r in literature.openalex_works(works.where("body is not null")).collect()) == ["W1", "W3"]


def test_graph_from_source(spark):
    works = spark.createDataFrame([("1", "a", 2020, 5, 0, 0), ("2", "b", 2021, 1, 0, 1)], "paper_id string, title string, year int, citation_count long, influential long, first_seen long")
    edges = spark.createDataFrame([("1", "2")], "source string, target string")
    kept, links, told = graph.from_source(spark, "k", works, edges)
    assert graph.counts(kept, links).first()[:] == (2, 2, 1) and told == []
    for given in ((None, None), (works.limit(0), edges)):
        kept, links, told = graph.from_source(spark, "k", *given)
        assert kept.count() == 5 and links.count() == 4 and len(told) == 1
