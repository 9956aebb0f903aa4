"""Pinned cases of retrieval, knowledge search, graphs, JSON repair, the store and the agents."""

import pytest
from pyspark.sql import functions as F

from marginalia.errors import EngineError
from marginalia.functions import model_json as M
from marginalia.functions import vectors as V
from marginalia.operators import extract, graph, index, knowledge, retrieval
from marginalia.operators.store import Store, upsert_migrations
from marginalia.plans import agents, chains, providers
from marginalia.sources import documents, literature


@pytest.fixture
def chunks(spark):
    return spark.createDataFrame([("a", "doc-a", 1, "alpha beta"), ("b", "doc-b", 1, "alpha beta"), ("c", "doc-b", 2, "gamma"), ("d", "gone", 1, "alpha")], "chunk_id string, doc_id string, page int, text string")


@pytest.fixture
def papers(spark):
    rows = [("doc-a", "Alpha", True, ["rag", "x"]), ("doc-b", "Beta", False, ["vision"])]
    return spark.createDataFrame(rows, "doc_id string, title string, is_favorite boolean, tags array<string>")


@pytest.fixture
def vectors(spark):
    rows = [("a", "doc-a", ["rag"], "upload", [1.0, 0.0], 0), ("b", "doc-b", ["vision"], "upload", [0.0, 1.0], 1), ("z", "doc-b", [], "upload", [0.0, 0.0], 2), ("l", "doc-a", ["rag"], "upload", [1.0], 3)]
    schema = "chunk_id string, doc_id string, tags array<string>, module_source string, embedding array<double>, seq long"
    return spark.createDataFrame(rows, schema).withColumns({"page": F.lit(1), "text": F.col("chunk_id")})


def ids(frame, column="chunk_id", order="rank"):
    return [r[column] for r in frame.orderBy(order).collect()]


def test_vector_filters(vectors):
    assert ids(retrieval.cosine_topk(vectors, [1.0, 0.0], 5, doc_ids=["doc-a"], tags=["rag"], module_source="upload")) == ["a"]
    assert ids(retrieval.cosine_topk(vectors, [1.0, 0.0], 5, doc_ids=[])) == ["a", "b", "z"]


def test_zero_vector_scores_zero(vectors):
    rows = {r["chunk_id"]: r["score"] for r in retrieval.cosine_topk(vectors, [1.0, 0.0], 5).collect()}
    assert rows["z"] == 0.0 and rows["a"] == 1.0


def test_distance_rejects_other_lengths(vectors):
    with pytest.raises(Exception, match="differ in length"):
        retrieval.distance_topk(vectors, [1.0, 0.0], 5).collect()
    same = vectors.where("chunk_id <> 'l'")
    assert ids(retrieval.distance_topk(same, [1.0, 0.0], 1, candidate_factor=1, tags=["vision"])) == []


def test_lexical_ties(chunks):
    assert ids(retrieval.lexical_topk(chunks, "alpha beta", 4)) == ["b", "a", "d", "c"]
    asked = chunks.sparkSession.createDataFrame([(1, "alpha beta"), (2, "nothing"), (3, "gamma")], "item_id int, question string")
    many = retrieval.lexical_topk_many(chunks, asked, 2)
    assert [(r["item_id"], r["chunk_id"]) for r in many.orderBy("item_id", "rank").collect()] == [(1, "b"), (1, "a"), (2, "d"), (2, "b"), (3, "c"), (3, "d")]


def test_a_task_sends_its_best_rows_once():
    import random

    import pyarrow as pa

    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    asked = pa.table({"item_id": [1, 2, 3, 4], "_group": ["a", "a", "b", None], "asked": [["w1", "w2"], ["w3"], ["w1", "w4", "w5"], ["w1"]]})
    rows = [(f"c{i}", i % 3, "a" if i % 2 else "b", rng.sample(words, 6)) for i in range(400)]
    kinds = pa.schema([("chunk_id", pa.string()), ("page", pa.int32()), ("_group", pa.string()), ("own", pa.list_(pa.string()))])
    batches = [pa.RecordBatch.from_pylist([dict(zip(kinds.names, r)) for r in rows[lo : lo + 20]], schema=kinds) for lo in range(0, 400, 20)]
    shared = type("Shared", (), {"value": asked})
    sent = [r for b in retrieval._scored(shared, 3)(iter(batches)) for r in b.to_pylist()]
    want = []
    for place, (group, tokens) in enumerate(zip(asked["_group"].to_pylist(), asked["asked"].to_pylist())):
        scored = [(len({*tokens} & {*own}) / (len(tokens) * 6) ** 0.5, page, c) for c, page, g, own in rows if g == group]
        best = sorted(sorted((x for x in scored if x[0]), key=lambda x: x[2], reverse=True), key=lambda x: (-x[0], x[1]))[:3]
        want += [(place, c) for _, _, c in best]
    assert [(r["place"], r["chunk_id"]) for r in sent] == want and len(sent) <= 3 * 4
    few = retrieval._Best(2, 1)
    few.most = 3
    for i in range(10):
        few.add(pa.array([0, 1]).to_numpy(), pa.array([f"x{i}", f"y{i}"]), pa.array([0, i], pa.int32()), pa.array([i / 10, 0.5]).to_numpy())
        assert few.rows <= 4
    assert few.cut()["chunk_id"].to_pylist() == ["x9", "y0"]


def test_topk_bounds():
    with pytest.raises(EngineError):
        retrieval.check_k(0)


def test_ladder(chunks, vectors):
    found, warnings = retrieval.ladder(chunks, vectors, "alpha", [1.0, 0.0], 2, ["nowhere"])
    assert found.isEmpty() and not warnings
    found, warnings = retrieval.ladder(chunks, vectors, "alpha", [1.0, 0.0], 2, ["gone"])
    assert ids(found) == ["d"] and "no matching chunks" in warnings[0]
    _, warnings = retrieval.ladder(chunks, vectors, "alpha", [1.0, 0.0], 2, ["doc-a"], is_fallback=True, mock=False)
    assert "lexical fallback" in warnings[0]


def test_knowledge(papers, chunks):
    assert ids(knowledge.paper_search(papers, "RAG"), "doc_id", "doc_id") == ["doc-a"]
    assert ids(knowledge.paper_search(papers, "zzz", tag="vision"), "doc_id", "doc_id") == ["doc-b"]
    assert ids(knowledge.paper_search(papers, "", favorites_only=True), "doc_id", "doc_id") == ["doc-a"]
    assert sorted(ids(knowledge.chunk_search(chunks, papers, "ALPHA"), order="chunk_id")) == ["a", "b"]
    assert sorted(ids(knowledge.chunk_search(chunks, papers, "zzz"), order="chunk_id")) == ["a", "b", "c"]
    with pytest.raises(EngineError) as missing:
        knowledge.require_papers(papers, ["doc-a", "q", "r"])
    assert missing.value.code == 404 and "q" in str(missing.value)


def test_graph(spark):
    stub = "struct<paper_id: string, title: string, year: int, citation_count: long, influential: long>"
    rows = [("W1", "one", 2024, 90, 2, 0, [("W2", "Referenced work", None, 0, 0)], [("W3", "three", 2020, 5, 0)]), ("W2", "two", 2022, 40, 0, 1, [], []), ("W4", "four", None, 0, 0, 2, [], [("W5", "five", 2001, 0, 0)])]
    works = spark.createDataFrame(rows, f"paper_id string, title string, year int, citation_count long, influential long, first_seen int, references array<{stub}>, citations array<{stub}>")
    candidates, edges = graph.expanded(works)
    kept = graph.nodes(candidates, 3)
    top = kept.orderBy("rank").collect()
    assert [r["id"] for r in top] == ["openalex-W1", "openalex-W2", "openalex-W3"]
    assert top[0]["importance_score"] == 1.0 and top[0]["is_key"] and top[1]["title"] == "two"
    assert {(r["source"], r["target"]) for r in graph.links(edges, kept).collect()} == {("openalex-W1", "openalex-W2"), ("openalex-W3", "openalex-W1")}
    assert graph.links(edges.limit(0), kept).count() == 2
    nodes, links = graph.default_graph(spark, " ", 3)
    assert nodes.count() == 3 and links.count() == 2 and "unknown topic" in nodes.first()["title"]


def test_json_repair(spark):
    raw = ['{"gaps": [{"title": "t", "value_level": "HIGH", "description": "d"}]}', 'x\n```json\n{"gaps": [7, {"title": "t", "description": "d", "evidence_papers": [" a "]}]}\n```', "plain", "[1]", '{"other": 1}', 'say {"gaps": [{"title": " "}]} end', '{"gaps": 3}', None, ""]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "k int, raw string")
    rows = {(r["k"], r["pos"]): r for r in M.gap_items(texts, "raw", "k").collect()}
    assert set(rows) == {(0, 0), (1, 1)}
    assert rows[0, 0]["value_level"] == "high" and rows[0, 0]["evidence_papers"] == [M.LOCAL_EVIDENCE]
    assert rows[1, 1]["value_level"] == "mid" and rows[1, 1]["evidence_papers"] == ["a"] and len(rows[1, 1]["warnings"]) == 1
    sizes = [r[0] for r in spark.createDataFrame([([],), (["a"],), (list("abcdefg"),)], "p array<string>").select(M.padded_support(F.col("p"))).collect()]
    assert sizes == [["fallback-support-paper-1", "fallback-support-paper-2", "fallback-support-paper-3"], ["a", "fallback-support-paper-2", "fallback-support-paper-3"], list("abcde")]


def test_atom(spark):
    feed = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2501.1v1</id><title> a\n b </title><published>2025-01-02</published></entry><entry><id></id><title>x</title></entry></feed>'
    rows = literature.atom_papers(spark.createDataFrame([(feed,)], "feed string")).collect()
    assert [tuple(r) for r in rows] == [("arxiv-2501.1", "a b", literature.NO_ABSTRACT, 2025)]


def test_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"hello \xff world " + b"y" * 900)
    (tmp_path / "b.txt").write_bytes(b"   ")
    files = documents.binary_files(spark, str(tmp_path))
    rows = documents.chunk_rows(files, documents.pages(files)).orderBy("doc_id", "chunk_id").collect()
    assert [len(r["text"]) for r in rows[:2]] == [900, 12] and rows[2]["text"] == "Uploaded paper b.txt"


def stored(spark, root):
    store = Store(spark, f"file://{root}")
    store.put("chunks", spark.createDataFrame([("a", "d", 1, "text")], "chunk_id string, doc_id string, page int, text string"))
    return store


CHUNK = "chunk_id string, doc_id string, page int, text string"


def test_store_upsert_and_lock(spark, tmp_path):
    store = stored(spark, tmp_path)
    store.put("chunks", spark.createDataFrame([("a", "d", 2, "new"), ("b", "d", 1, "more")], CHUNK))
    assert [(r["chunk_id"], r["page"]) for r in store.read("chunks").orderBy("chunk_id").collect()] == [("a", 2), ("b", 1)]
    assert store.lock("me") and not store.lock("you")
    with pytest.raises(EngineError):
        index.index_chunks(store, store.read("chunks"), providers.embedding("mock"))
    store.unlock()
    with pytest.raises(EngineError):
        store.add("chunks", store.read("chunks"))
    store.put("chunks", store.read("chunks").limit(0))
    assert store.read("chunks").count() == 2


def files_of(folder):
    return {p.relative_to(folder): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_a_put_leaves_other_buckets_alone(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", buckets=8)
    rows = spark.createDataFrame([(f"c{i}", "d", i, "text") for i in range(200)], CHUNK)
    store.put("chunks", rows)
    before = files_of(tmp_path / "chunks")
    assert len({p.parts[0] for p in before}) == 8 == store.buckets
    changed = spark.createDataFrame([("c7", "d", 7, "changed"), ("c7", "d", 7, "changed")], CHUNK)
    touched = f"bucket={changed.select(store.bucket('chunks')).first()[0]}"
    Store(spark, f"file://{tmp_path}", buckets=3).put("chunks", changed)  # the number of the first put stands
    after = files_of(tmp_path / "chunks")
    assert {p: t for p, t in before.items() if p.parts[0] != touched} == {p: t for p, t in after.items() if p.parts[0] != touched}
    assert all(p not in after for p in before if p.parts[0] == touched)
    assert {r["chunk_id"]: r["text"] for r in store.read("chunks").collect()} == {f"c{i}": "changed" if i == 7 else "text" for i in range(200)}


def test_a_put_that_stops_half_way_is_finished(spark, tmp_path, monkeypatch):
    store, rows = stored(spark, tmp_path), spark.createDataFrame([("b", "d", 1, "x"), ("b", "d", 1, "x")], CHUNK)
    finish, calls = Store._finish, []
    monkeypatch.setattr(Store, "_finish", lambda self, name: calls.append(name) or (finish(self, name) if len(calls) == 1 else 1 / 0))
    with pytest.raises(ZeroDivisionError):
        store.put("chunks", rows)
    monkeypatch.undo()
    assert store.read("chunks").count() == 1
    rows.write.parquet(f"file://{tmp_path}/chunks/_pending/unfinished")
    (tmp_path / "chunks" / "_pending" / "unfinished" / "_SUCCESS").unlink()
    store.recover("chunks")
    assert sorted(r["chunk_id"] for r in store.read("chunks").collect()) == ["a", "b"]
    assert not list((tmp_path / "chunks" / "_pending").iterdir())
    (tmp_path / "chunks" / "_WRITER").write_text(f"{__import__('socket').gethostname()} 1 put\n")  # a living process
    with pytest.raises(EngineError) as error:
        store.put("chunks", rows)
    assert error.value.code == 503


def test_gaps_and_experiments_are_upserted(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", buckets=2)
    for level in ("mid", "high"):
        store.put("gaps", spark.createDataFrame([("g", "t", level, "d", ["p"], None)], "gap_id string, title string, value_level string, description string, evidence_papers array<string>, created_at timestamp"))
        lists = [["d"], ["m"], ["b"], ["s"], [level], ["p"]]
        store.put("experiments", spark.createDataFrame([("e", "g", level, *lists)], "experiment_id string, gap_id string, objective string, datasets array<string>, metrics array<string>, baselines array<string>, steps array<string>, risks array<string>, support_papers array<string>"))
    assert [r["value_level"] for r in store.read("gaps").collect()] == ["high"]
    assert [(r["objective"], r["risks"]) for r in store.read("experiments").collect()] == [("high", ["high"])]


def test_migration_upsert_keeps_the_first_start(spark):
    kinds = "migration_id string, profile_key string, status string, started_at timestamp, completed_at timestamp"
    at = lambda day: __import__("datetime").datetime(2024, 1, day)
    old = spark.createDataFrame([("m", "p", "running", at(1), None), ("n", "p", "complete", at(1), at(2))], kinds)
    new = spark.createDataFrame([("m", "q", "complete", at(3), at(4)), ("n", "p", "running", at(5), at(5)), ("o", "p", "failed", at(6), at(7))], kinds)
    rows = {r["migration_id"]: (r["profile_key"], r["status"], r["started_at"].day, r["completed_at"] and r["completed_at"].day) for r in upsert_migrations(old, new).collect()}
    assert rows == {"m": ("p", "complete", 1, 4), "n": ("p", "running", 1, None), "o": ("p", "failed", 6, 7)}


def counting(folder, fails=(), dimension=4):
    """A transport that leaves a file a call, and fails for texts of the given words."""

    def call(texts):
        import uuid
        from pathlib import Path

        (Path(folder) / uuid.uuid4().hex).write_text(str(len(texts)))
        if any(f in t for t in texts for f in fails):
            raise OSError("no answer")
        return [[float(len(t)), 1.0, 2.0, 3.0][:dimension] for t in texts]

    return call


def asked(folder):
    return sum(int(p.read_text()) for p in folder.iterdir())


def test_every_chunk_is_embedded_once(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    store = Store(spark, f"file://{tmp_path}/s", buckets=4)
    store.put("chunks", spark.createDataFrame([(f"c{i}", "d", i, f"text {i}") for i in range(100)], CHUNK))
    provider = providers.Embedding("local", "m", 4, transport=counting(tmp_path / "calls"), batch=10)
    assert index.index_chunks(store, store.read("chunks"), provider) == {"indexed": 100, "failed": 0}
    assert asked(tmp_path / "calls") == 100
    assert store.read("vectors").count() == 100 and store.read("index_state").first()["state"] == "ready"


def test_a_failing_batch_is_flagged_and_refused(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    store = Store(spark, f"file://{tmp_path}/s", buckets=2)
    store.put("chunks", spark.createDataFrame([(f"c{i}", "d", i, "bad" if i == 3 else f"text {i}") for i in range(12)], CHUNK))
    provider = providers.Embedding("local", "m", 4, transport=counting(tmp_path / "calls", ["bad"]), batch=1, retries=2)
    rows = {r["chunk_id"]: r for r in provider.embedded(store.read("chunks")).collect()}
    assert asked(tmp_path / "calls") == 11 + 3
    assert [k for k, r in rows.items() if r["is_fallback"]] == ["c3"] and "no answer" in rows["c3"]["embedding_error"]
    own = spark.createDataFrame([("bad",)], "t string").select(V.hash_vector(F.col("t"), 4).alias("v")).first()["v"]
    assert rows["c3"]["embedding"] == own and rows["c4"]["embedding"] == [6.0, 1.0, 2.0, 3.0]
    assert index.index_chunks(store, store.read("chunks"), provider) == {"indexed": 11, "failed": 1}
    assert {r["status"]: r["n"] for r in index.entry_counts(store.read("entries"), provider.key).collect()} == {"ready": 11, "failed": 1}
    assert "c3" not in {r["chunk_id"] for r in store.read("vectors").collect()} and store.read("index_state").first()["state"] == "degraded"


def test_wrong_shapes_and_null_texts_fall_back(spark):
    rows = spark.createDataFrame([("x",), (None,), ("",)], "text string").coalesce(1)
    short = providers.Embedding("local", "m", 4, transport=lambda texts: [[1.0] * 3] * len(texts))
    few = providers.Embedding("local", "m", 4, transport=lambda texts: [[1.0] * 4])
    none = providers.Embedding("local", "m", 4)
    for provider in (short, few, none):
        found = provider.embedded(rows).collect()
        assert len(found) == 3 and all(len(r["embedding"]) == 4 and r["embedding_error"] for r in found) and all(r["is_fallback"] for r in found)
    assert not any(r["is_fallback"] for r in providers.embedding("mock").embedded(rows).collect())
    assert none.embedded(rows.limit(0)).count() == 0 and providers.Embedding("Local BGE", "m--3", 4).collection == "paper_chunks_v2_local_bge_m_3_4"


def test_migration_is_resumable(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", buckets=2)
    store.put("chunks", spark.createDataFrame([("a", "d", 1, "text")], CHUNK))
    legacy = spark.createDataFrame([("a", "text", [0.5] * 16)], "chunk_id string, text string, embedding array<double>")
    mock = providers.embedding("mock")
    plan = index.migrate(store, mock, legacy, apply=False)
    assert plan["pending_count"] == 1 and plan["legacy_vector_count"] == 1 and store.read("migrations").count() == 0
    first = index.migrate(store, mock, legacy)
    assert first["processed_count"] == 1 and first["activated"]
    again = index.migrate(store, mock, legacy)
    assert again["processed_count"] == 0 and again["skipped_count"] == 1


def test_migration_stops_and_resumes(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    store = Store(spark, f"file://{tmp_path}/s", buckets=3)
    store.put("chunks", spark.createDataFrame([(f"c{i}", "d", i, "bad" if i == 5 else f"text {i}") for i in range(30)], CHUNK))
    legacy = spark.createDataFrame([(f"c{i}", f"text {i}", [0.5] * 4) for i in range(0, 30, 3)], "chunk_id string, text string, embedding array<double>")
    provider = providers.Embedding("local", "m", 4, transport=counting(tmp_path / "calls", ["bad"]), batch=1, retries=0)

    def stop(batch):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        index.migrate(store, provider, legacy, after_batch=stop)
    row = store.read("migrations").first()
    assert row["status"] == "running" and row["completed_at"] is None and not store.locked()
    assert store.read("index_state").first()["state"] == "migrating" and store.read("batches").count() == 1
    once = asked(tmp_path / "calls")
    done = index.migrate(store, provider, legacy)
    assert (done["processed_count"], done["failed_count"], done["missing_count"], done["activated"]) == (29, 1, 1, False)
    assert asked(tmp_path / "calls") == 20 > once > 0  # ten of thirty are reused, none embedded twice
    end = store.read("migrations").first()
    assert (end["status"], end["started_at"], end["processed_count"], end["failed_count"]) == ("failed", row["started_at"], 29, 1) and end["completed_at"] >= row["started_at"]
    entries = {r["chunk_id"]: (r["status"], r["error"]) for r in store.read("entries").collect()}
    assert len(entries) == 30 and entries["c5"][0] == "failed" and "no answer" in entries["c5"][1] and entries["c0"] == ("ready", None)
    assert store.read("vectors").where("chunk_id = 'c3'").first()["embedding"] == [0.5] * 4
    cured = providers.Embedding("local", "m", 4, transport=counting(tmp_path / "calls"), batch=1)
    last = index.migrate(store, cured, legacy)
    assert (last["processed_count"], last["skipped_count"], last["failed_count"], last["activated"]) == (1, 29, 0, True)
    assert store.read("migrations").first()["status"] == "complete" and store.read("index_state").first()["active_collection"] == cured.collection


def test_failed_write_is_marked(spark, tmp_path, monkeypatch):
    store, mock = stored(spark, tmp_path), providers.embedding("mock")
    monkeypatch.setattr(Store, "put_vectors", lambda *a: 1 / 0)
    with pytest.raises(EngineError):
        index.index_chunks(store, store.read("chunks"), mock)
    monkeypatch.undo()
    assert {r["status"]: r["n"] for r in index.entry_counts(store.read("entries"), mock.key).collect()} == {"failed": 1}
    assert store.read("index_state").first()["state"] == "degraded" and store.read("chunks").count() == 1
    with pytest.raises(EngineError):
        index.index_chunks(store, store.read("chunks"), providers.embedding("openai"))
    with pytest.raises(EngineError):
        store.put_vectors(store.read("chunks").withColumns({"embedding": F.array(F.lit(1.0)), "tags": F.array().cast("array<string>"), "module_source": F.lit(""), "content_hash": F.lit(""), "profile_key": F.lit("p")}), 16)


def test_only_ranges_that_differ_are_joined(spark, monkeypatch):
    ids = lambda values: spark.createDataFrame([(str(v),) for v in values], "chunk_id string")
    found = index.differences(ids(range(3000)), ids([*range(5, 3000), "x", "y"]))
    assert {r["chunk_id"] for r in found.missing.collect()} == {"0", "1", "2", "3", "4"} and {r["chunk_id"] for r in found.orphans.collect()} == {"x", "y"}
    assert 1 <= found.ranges.count() <= 7
    same = index.differences(ids(range(100)), ids(range(100)))
    assert same.ranges.count() == same.missing.count() == same.orphans.count() == 0
    assert index.differences(ids([]), ids([1])).orphans.count() == 1 and index.differences(ids([1]), ids([])).missing.count() == 1


def test_command_reports_and_exits(spark, tmp_path):
    import json

    store = Store(spark, f"file://{tmp_path}", buckets=2)
    store.put("chunks", spark.createDataFrame([("a", "d", 1, "text"), ("b", "d", 2, "bad")], CHUNK))
    legacy = spark.createDataFrame([], "chunk_id string, text string, embedding array<double>")
    (tmp_path / "calls").mkdir()
    failing = providers.Embedding("local", "m", 4, transport=counting(tmp_path / "calls", ["bad"]), batch=1, retries=0)
    told, code = index.command(store, failing, legacy)
    assert json.loads(told)["pending_count"] == 2 and code == 0
    told, code = index.command(store, failing, legacy, "apply")
    assert json.loads(told)["failed_count"] == 1 and code == 1
    told, code = index.command(store, failing, legacy, "verify")
    assert json.loads(told)["state"] == "degraded" and code == 1
    with pytest.raises(EngineError):
        index.command(store, failing, legacy, "other")


def test_status_precedence(spark):
    counts = spark.createDataFrame([(2, 1, 1, 0)], "source_count long, indexed_count long, missing_count long, orphan_count long")
    state = lambda **k: index.status(counts, F.lit(k.pop("failed", 0)), **k).first()["state"]
    assert state(locked=True, failed=1) == "migrating"
    assert state(failed=1, collection=index.LEGACY_COLLECTION) == "degraded"
    assert state(collection=index.LEGACY_COLLECTION) == "legacy" and state() == "migration_required"


def test_plan_runs(spark, chunks):
    kinds = "request_id int, direction string, paper_ids array<string>, experiment_result string"
    asked = spark.createDataFrame([(1, " alpha  methods ", ["doc-a", "doc-b"], "0.7"), (2, "gamma", ["none"], None)], kinds)
    levels = ["low", "high", "mid", "high"]
    gaps = ", ".join(f'{{"title": "t{i}", "value_level": "{v}", "description": "d{i}", "evidence_papers": ["e{i}"]}}' for i, v in enumerate(levels))
    plan = '{"experiments": [{"objective": "o", "datasets": ["d"], "metrics": ["m"], "baselines": ["b"], "steps": ["first"], "risks": ["r"]}]}'
    chat = lambda p: F.when(F.contains(p, F.lit("GAP_JSON")), '{"gaps": [' + gaps + "]}").when(F.contains(p, F.lit("Measured so far: 0.7")) & F.contains(p, F.lit("t1. d1")), plan).otherwise("none")
    runs = agents.plan_runs(asked, chunks, chat)
    cards = runs.cards.orderBy("card").collect()
    assert [c["title"] for c in cards] == ["alpha  methods：t1", "alpha  methods：t3", "alpha  methods：t0"]
    assert [c["next_action"] for c in cards][:2] == ["first", "准备评估划分"] and all(c["recommended_papers"][0].startswith("arxiv-1: ") for c in cards)
    assert "t1 t3 t0" in cards[0]["recommended_papers"][0]
    steps = runs.trace.orderBy("request_id", "step_index").collect()
    assert [r["tool_name"] for r in steps if r["request_id"] == 1] == list(agents.PLAN_TOOLS) and len(steps) == len(agents.PLAN_TOOLS) + agents.PLAN_STEPS
    assert steps[2]["observation"] == "3 passages found in 2 papers." and all(r["thought"] and r["observation"] for r in steps) and steps[-1]["next_decision"] == "complete"
    told = {r["request_id"]: r["warnings"] for r in runs.warnings.collect()}
    assert told[2] == [agents.NO_CARDS] and len(told[1]) == 3  # an unknown level, and two plans that fell back
    silent = agents.plan_runs(asked, chunks, chat, lambda rows: literature.stand_ins(rows.withColumn("most", F.lit(0))))
    assert silent.cards.where("card = 0").first()["recommended_papers"][:3] == ["e1", "e3", "e0"]
    assert agents.NO_NEW_PAPERS in silent.warnings.where("request_id = 1").first()["warnings"]
    for bad in (asked.withColumn("direction", F.lit(" \t")), asked.withColumn("paper_ids", F.array().cast("array<string>"))):
        with pytest.raises(EngineError):
            agents.plan_runs(bad, chunks)
    assert agents.plan_runs(asked.limit(0), chunks).trace.count() == 0


def test_reproduction(spark, papers):
    chunks = spark.createDataFrame([("a", "doc-a", 1, "The method is new. Dataset: CIFAR. Metric: accuracy. Baseline: X.")], "chunk_id string, doc_id string, page int, text string")
    rows = {r["doc_id"]: r for r in agents.reproduction_reports(papers, chunks, "template").collect()}
    assert rows["doc-a"]["datasets"] == ["CIFAR"] and rows["doc-b"]["datasets"] == ["unknown"]
    assert rows["doc-a"]["code_template"] and rows["doc-a"]["simulation_template"] and not rows["doc-b"]["code_template"] and len(rows["doc-b"]["non_claims"]) == 4
    steps = agents.reproduction_trace(papers, chunks, "focused", " now ").orderBy("step_index").collect()
    of_a, of_b = ([r for r in steps if r["doc_id"] == doc] for doc in ("doc-a", "doc-b"))
    assert [r["tool_name"] for r in of_a] == ["retrieve_paper_context", *agents.REPRODUCTION_ORDER["focused"]] and of_a[1]["input_summary"] == "mode=focused; chunks=1; requirement=now"
    assert [r["next_decision"] for r in of_b] == ["generate_report", "complete"] and all(r["thought"] and r["observation"] for r in steps)


def test_chains(spark):
    asked = spark.createDataFrame([(1, "what?"), (2, None)], "k int, question string")
    found = spark.createDataFrame([(1, 2, 3, "b", "y"), (1, 1, 3, "a", "x")], "k int, rank bigint, page int, chunk_id string, text string")
    one, two = chains.answers(asked, found, "k").orderBy("k").collect()
    assert one["citations"] == [1] and [s["chunk_id"] for s in one["sources"]] == ["a", "b"]
    assert two["answer"] == chains.INSUFFICIENT and two["sources"] == [] and two["citations"] == []
    assert chains.answers(asked, found, "k", chat=lambda p: p).where("k = 1").first()["answer"].endswith("what?\n\n[1] page 3, chunk a: x\n\n[2] page 3, chunk b: y")
    raw = ["", None, "[1]", '{"experiments": 3}', '{"experiments": [7, {"objective": "o"}]}', '{"experiments": []}']
    rows = spark.createDataFrame([(i, "q", None, r) for i, r in enumerate(raw)], "i int, query string, support_papers array<string>, raw string")
    plans = chains.experiment_plans(rows).orderBy("i").collect()
    told = chains.WARNINGS["experiments"]
    assert [p["warnings"] for p in plans] == [[told[0]], [told[0]], [told[0]], [told[1]], [told[2], told[3], told[4]], [told[4]]]
    assert all(len(p["experiments"]) == 1 and len(p["support_papers"]) == 3 for p in plans)
    empty = rows.limit(0)
    assert chains.experiment_plans(empty).count() == 0 and chains.gap_analyses(empty.withColumnRenamed("support_papers", "evidence")).count() == 0


def test_providers(spark):
    options = providers.model_options(spark, {"OPENAI_API_KEY": "k"})
    assert options.where("available").count() == 5
    assert providers.embedding("nobody").name == "mock" and providers.embedding("openai").is_fallback
    assert len(spark.range(1).select(V.hash_vector(F.lit("x"), 40).alias("v")).first()["v"]) == 40
    call = providers.Embedding("local", "m", 2, transport=lambda texts: [[1.0, 2.0]] * len(texts))
    assert spark.createDataFrame([("x",)], "t string").select(call.embed(F.col("t"))[0].alias("v")).first()["v"] == [1.0, 2.0]


def test_display(spark):
    rows = spark.createDataFrame([(["Xfyun Spark embedding failed", "mock chat", "DEEPSEEK_API_KEY missing", "z"],)], "w array<string>")
    assert len(rows.select(extract.unique_warnings(F.col("w")).alias("x")).first()["x"]) == 2


def test_streaming_upsert(spark, tmp_path):
    from marginalia.streaming import ingest

    store, folder = Store(spark, f"file://{tmp_path}/s"), f"{tmp_path}/in"
    rows = [("a", "p", None, None, "pending", None, 1), ("a", "p", None, None, "ready", None, 2), ("b", "p", None, None, "ready", None, 1)]
    schema = "chunk_id string, profile_key string, collection_name string, content_hash string, status string, error string, at int"
    spark.createDataFrame(rows, schema).withColumn("updated_at", F.timestamp_seconds("at")).drop("at").write.parquet(folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    ingest.upserting(stream, store, "entries", "updated_at").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(60)
    assert {r["chunk_id"]: r["status"] for r in store.read("entries").collect()} == {"a": "ready", "b": "ready"}


def fetched(query, limit):
    return [("p1", query, "a", 2020)] if query == "one" else []


def test_literature_source(spark):
    from marginalia.sources.remote import LiteratureSource

    spark.dataSource.register(LiteratureSource)
    load = lambda **o: spark.read.format("literature").options(**o).load().collect()
    assert len(load(query="q", limit=3)) == 3 and load(query=" ") == []
    assert [r["paper_id"] for r in load(query="one", fetch="tests.test_operators:fetched")] == ["p1"]
    assert "found nothing" in load(query="two", fetch="tests.test_operators:fetched")[0]["warning"]
    assert "failed" in load(query="two", fetch="tests.nowhere:f")[0]["warning"]


def test_small_projections(spark, tmp_path):
    import base64
    import struct

    from marginalia.functions import display

    raw = base64.b64encode(struct.pack("<3f", 1.0, -2.5, 0.5)).decode()
    rows = spark.createDataFrame([(raw, 0.5, "abcdefghij"), (None, None, None)], "t string, s double, i string")
    got = rows.select(display.vector_from_base64(F.col("t")).alias("v"), display.node_radius(F.col("s")).alias("r"), display.fixed_score(F.col("s")).alias("f"), display.short_id(F.col("i")).alias("i")).collect()
    assert got[0]["v"] == [1.0, -2.5, 0.5] and got[0]["r"] == 11.5 and got[0]["f"] == "0.50" and got[0]["i"] == "abcdefgh" and got[1]["v"] is None
    answers = spark.createDataFrame([("q", "a [1]", [(2, "c", "text")]), ("q", "a", [])], "question string, answer string, sources array<struct<page: int, chunk_id: string, text: string>>")
    shown = extract.answer_markdown(answers)
    texts = [r["markdown"] for r in shown.collect()]
    assert "1. 第 2 页，c" in texts[0] and "无来源片段" in texts[1]
    display.write_texts(display.report_json(answers), "report", f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out").count() == 2


def test_scores_round_by_their_exact_value(spark):
    from marginalia.functions import display

    values = [i / 1000 for i in range(0, 1001)] + [0.125, 0.375, 0.625, 0.875, 1.005, 2.675, 3.995, -0.125, -0.985, 1e-9, 17.256, 0.0]
    rows = spark.createDataFrame([(v,) for v in values], "s double").select("s", display.fixed_score(F.col("s")).alias("t")).collect()
    assert [(r["s"], r["t"]) for r in rows if r["t"] != f"{r['s']:.2f}"] == []


def test_lock_of_a_dead_process(spark, tmp_path):
    import socket

    store = Store(spark, f"file://{tmp_path}")
    (tmp_path / "LOCK").write_text(f"{socket.gethostname()} 99999999 gone\n")
    assert store.lock("me") and not store.lock("you")
