"""Operators 2 and 3 against brute force on shingle sets."""

import random
import re

import pytest
from pyspark.sql import functions as F

from marginalia.llm import bottomk_dedup, containment
from marginalia.llm.components import components
from tests.llm.conftest import LOWER, WORD, frame


def shingle_set(text):
    w = re.findall(WORD, (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(rows):
    sets = {d: shingle_set(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in ids}, sets


def corpus(seed, n=160, passage=60):
    """Near copies with changed words, chains, and one passage in most texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6)))
    shared = [word() for _ in range(passage)]
    bases = [[word() for _ in range(rng.choice([6, 20, 60, 150, 400]))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.6 else [word() for _ in range(rng.randint(1, 120))]
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.6:
            w += shared[: rng.choice([30, 60])]
        rows.append((i * 3, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_like_brute_force(spark, monkeypatch, seed):
    if seed == 2:
        monkeypatch.setattr(bottomk_dedup, "LONG_LIST", 4)
        monkeypatch.setattr(bottomk_dedup, "BLOCK", 150)  # hubs in several copies, gatherings in several blocks
    rows = corpus(seed)
    want, sets = groups(rows)
    got = {r["doc_id"]: r for r in bottomk_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[d]) and r["kept"] == (want[d] == d) for d, r in got.items())
    kept = bottomk_dedup.one_of_each(frame(spark, rows)).select("doc_id").collect()
    assert sorted(r[0] for r in kept) == sorted(d for d in want if want[d] == d)


def test_rows_that_repeat_a_doc_id(spark):
    rng = random.Random(3)
    a, b, c = (" ".join(f"w{rng.randrange(9999)}" for _ in range(30)) for _ in range(3))
    rows = [(5, a), (5, b), (3, b), (9, a), (9, a), (4, c), (4, c), (None, c), (None, c), (7, ""), (7, ""), (8, None), (2, "few words"), (2, "few words")]
    docs = frame(spark, rows).withColumns({c: F.lit("clash") for c in ("_id", "_key", "_found", "_dropped_id")})
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in bottomk_dedup.near_duplicates(docs).collect()}
    assert got == {(5, 3, False), (3, 3, True), (9, 3, False), (4, 4, True), (None, None, True), (7, 7, True), (8, 8, True), (2, 2, True)}
    kept = bottomk_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(map(str, docs.where("text is null or text = '' or doc_id is null").select("doc_id", "text").collect() + [type(kept.first())(doc_id=i, text=t) for i, t in ((5, a), (3, b), (4, c), (2, "few words"))]))
    assert bottomk_dedup.one_of_each(docs.limit(0)).count() == 0


def test_awkward_documents(documents):
    rows = bottomk_dedup.near_duplicates(documents).collect()
    assert len(rows) == documents.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["n_shingles"] == by[2]["n_shingles"] == 0 and by[0]["component_id"] == 0
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert by[13]["component_id"] == 5 and not by[13]["kept"]
    assert bottomk_dedup.near_duplicates(documents.limit(0)).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    found = {r["id"]: r["component"] for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, 101: 100}


def leaks(documents, items):
    return {(d, i, len(shingle_set(t)), len(shingle_set(t) & shingle_set(x))) for i, t in items for d, x in documents if shingle_set(t) and 100 * len(shingle_set(t) & shingle_set(x)) >= 75 * len(shingle_set(t))}


@pytest.mark.parametrize("bound", [containment.BROADCAST_SHINGLES, 0])
def test_containment_like_brute_force(spark, bound):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    items = [(i, " ".join(words(rng.choice([1, 4, 5, 12, 30, 60, 200])))) for i in range(30)] + [(40, ""), (41, None)]
    docs = []
    for d in range(60):
        w = words(rng.choice([0, 3, 40, 3000]))
        if d % 2:
            part = items[d % 30][1].split()
            for _ in range(rng.choice([0, 1, 3])):
                part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = part
        docs.append((d, " ".join(w).upper()))
    table = spark.createDataFrame(items, "item_id long, text string")
    found = containment.contained(frame(spark, docs), table, broadcast_shingles=bound).collect()
    want = leaks(docs, items)
    assert {tuple(r) for r in found} == want and len(found) == len(want) > 10
    clean = containment.clean(frame(spark, docs), table, broadcast_shingles=bound)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, *_ in want}


def test_containment_of_awkward_documents(spark, documents):
    items = spark.createDataFrame([(1, "A B c d E"), (2, None), (1, "a b c d e")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in containment.contained(documents, items).collect()) == [(5, 1), (13, 1)]
    assert containment.clean(documents, items).count() == documents.count() - 2
    assert containment.contained(documents, items.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [containment.BROADCAST_SHINGLES, 0])
def test_every_item_under_a_repeated_or_null_id_is_searched(spark, bound):
    rng = random.Random(15)
    prose = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(40))
    texts = [prose() for _ in range(4)]
    items = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (1, texts[1]), (1, texts[1].upper()), (None, texts[2]), (None, texts[3])], "item_id long, text string")
    docs = frame(spark, [(i, f"{prose()} {t} {prose()}") for i, t in enumerate(texts)] + [(7, prose())])
    found = containment.contained(docs, items, broadcast_shingles=bound)
    assert found.columns == ["doc_id", "item_id", "n_item", "n_shared"]
    assert sorted(tuple(r) for r in found.select("doc_id", F.coalesce("item_id", F.lit(-1)), "n_shared").collect()) == [(0, 1, 36), (1, 1, 36), (2, -1, 36), (3, -1, 36)]
    assert [r["doc_id"] for r in containment.clean(docs, items, broadcast_shingles=bound).collect()] == [7]


@pytest.mark.parametrize("bound", [containment.BROADCAST_SHINGLES, 0])
def test_clean_drops_only_leaking_rows_of_null_and_repeated_ids(spark, bound):
    item = "one two three four five six seven"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, f"so {item} it is"), (None, "clean without an id"), (None, None), (3, item), (3, "clean beside a leak"), (3, None), (4, item), (4, item)]
    clean = containment.clean(frame(spark, rows), items, broadcast_shingles=bound)
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in clean.collect()))) == sorted(map(str, [rows[1], rows[2], rows[4], rows[5]]))
