"""Filter audit, nearest neighbours and Merkle manifest against brute force and SQL, with awkward rows."""

import hashlib
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import filter_audit, merkle_manifest, queries, vantage_search
from tests.llm.conftest import LONG, LOWER, WORD, frame
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_neighbours", "op13_manifest"])
def test_same_as_sql_on_more_rows(spark, name):
    assert_same(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name])


# filter audit


def audited(rows, labels):
    """Every order played through, document by document."""

    def fails(i):
        doc_id, text, _ = rows[i]
        text = text or ""
        words = re.findall(WORD, text)
        earlier = doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in rows)
        tests = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": earlier}
        return {f for f, hit in tests.items() if hit}

    failed = [fails(i) for i in range(len(rows))]
    said = lambda d, at: d is not None and any(x[0] == d and x[at] == 1 for x in labels)
    out = {}
    for part in {lang or "" for _, _, lang in rows}:
        own = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [i for i in left if f in failed[i]]
                left = [i for i in left if f not in failed[i]]
                shapley[f] += len(gone)
                redundant = sum(f in failed[i] for i in own) - len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(failed[i] == {f} for i in own), sum(said(rows[i][0], 1) for i in gone), sum(said(rows[i][0], 2) for i in gone)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(shapley[order[step - 1]])
    return out


def test_audit_against_playing_every_order(spark, texts):
    many = " ".join(f"w{i}" for i in range(120))
    rows = [(i, t, [None, "", "en", "de"][i % 4]) for i, t in enumerate([*texts, many, many + " #", "UP " * 150, many.upper(), "same", "same", None, ""])]
    rows += [(None, "same", "en"), (None, "same", "en"), (5, "same", "de"), (7, many, "en"), (7, many, "en"), (7, "SHOUT", "en"), (-3, many, None)]
    labels = [(0, 1, 0), (7, 0, 1), (7, 1, None), (13, 1, 1), (None, 1, 1), (21, None, None), (99, 1, 1), (-3, 1, 0)]
    docs = frame(spark, rows, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("part", "mask", "same", "first")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("clash"))
    got = {(r[0], r[1], r[2]): list(r)[3:] for r in filter_audit.audit(docs, marks).collect()}
    assert got == audited(rows, labels)
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    assert {r["good_lost"] for r in filter_audit.audit(docs, marks.limit(0)).select("good_lost").distinct().collect()} == {0}


def test_swaps_reach_every_order_and_keep_the_counts():
    rng = np.random.default_rng(3)
    counts = {m: rng.integers(0, 3, 3) for m in range(32)}
    counts = {m: c for m, c in counts.items() if c.any()}
    paths = filter_audit.orders_of(counts)
    assert len(paths) == 120 == len({tuple(w for w, _, _ in p) for p in paths})
    for path in paths:
        before = 0
        for which, kept, gone in path:
            assert list(kept) == list(sum((c for m, c in counts.items() if not m & (before | 1 << which)), np.zeros(3, int)))
            assert list(gone) == list(sum((c for m, c in counts.items() if not m & before and m & 1 << which), np.zeros(3, int)))
            before |= 1 << which


def test_equal_subdiagrams_are_shared():
    diagram = filter_audit.Diagram({m: np.array([1]) for m in range(32)}, 5, 1)
    assert [len(level) for level in diagram.children] == [2] * 5


# nearest neighbours


def nearest(rows, k, every):
    best = {}
    for i, v in rows:
        if i is not None and v is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            best[i] = min(best.get(i, v), v)
    out = {}
    for q in (i for i in best if i % every == 0):
        scored = sorted((-float(np.cumsum(np.array(best[q]) * np.array(v))[-1]), i) for i, v in best.items() if i != q)[:k]
        out[q] = [(i, -s) for s, i in scored]
    return out


def listed(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_factor_one_is_exact_on_awkward_vectors(spark, monkeypatch):
    monkeypatch.setattr(vantage_search, "SHARD_BYTES", 1)  # shards of 256 vectors: several cells, and the hot vector over several shards
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.2, 1.0, 9.0])).tolist()) for i in range(1200)]
    rows += [(2000 + i, [1.0, 2.0, 3.0, 0.0, 0.0, 1.0]) for i in range(700)]
    rows += [(3000, None), (3020, [0.0] * 6), (3040, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (3060, [float("nan")] * 6), (3080, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0]), (3100, []), (None, [1.0] * 6), (40, [-5.0] * 6), (40, [-5.0] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("v", "cell", "norm", "score", "salt")})
    index = vantage_search.build(table)
    assert index.shards.count() > 5 and max(index.salts.values()) > 1
    got = listed(vantage_search.neighbours(table, k=20, factor=1.0))
    assert got == nearest(rows, 20, 20)
    loose = listed(vantage_search.neighbours(table, k=20))
    assert loose.keys() == got.keys() and sum(len(set(loose[q]) & set(got[q])) for q in got) >= 0.9 * sum(map(len, got.values()))


def test_few_or_no_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0]), (3, [-1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert listed(vantage_search.neighbours(table, factor=1.0)) == {0: [(1, 0.5), (2, 0.5), (3, -1.0)]}
    assert vantage_search.neighbours(table.where("vec_id = 0")).count() == 0
    assert vantage_search.neighbours(table.limit(0)).columns == ["query_id", "rank", "vec_id", "score"]
    with pytest.raises(ValueError, match="factor"):
        vantage_search.neighbours(table, factor=0.5)


def test_trees_prune_what_is_far(spark):
    rng = np.random.default_rng(9)
    points = np.repeat(rng.normal(size=(40, 8)) * 10, 50, axis=0) + rng.normal(size=(2000, 8)) * 0.01
    most = np.sqrt((points**2).sum(1)).max()
    tree = vantage_search.Tree.build(vantage_search.unit(points, most), 64)
    own = points[tree.order]
    scanned = {}
    for factor in (1.0, 4.0):
        ids = np.arange(2000)
        search = vantage_search.Search(tree, ids, own, ids[:200] + 10_000, own[:200], vantage_search.asked(own[:200]), most * np.sqrt((own[:200] ** 2).sum(1)), np.full(200, -np.inf), 5, factor)
        search.run(True)
        scanned[factor] = search.scanned
        if factor == 1.0:
            assert np.allclose(search.score, np.sort(own[:200] @ own.T, axis=1)[:, ::-1][:, :5])
    assert scanned[4.0] < scanned[1.0] <= 200 * 2000


def test_recall_of_the_query(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = listed(queries.op12_neighbours(spark, "/root/testdata/sf0.1"))
    want = nearest([(r["vec_id"], r["embedding"]) for r in table.collect()], 20, 20)
    assert got.keys() == want.keys()
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.95 * sum(map(len, want.values()))


# Merkle manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def proofs(rows):
    langs = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))):
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree_of([leaf_of(r) for r in langs[x]]) for x in order}
    top = tree_of([trees[x][-1][0] for x in order])
    out = []
    for k, lang in enumerate(order):
        for i, row in enumerate(langs[lang]):
            seen = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                seen = (*row[:4], row[4].translate(LOWER))
            at, beside = leaf_of(seen), []
            for levels, place in ((trees[lang], i), (top, k)):
                for level in levels[:-1]:
                    run, own = level[place // 8 * 8 : place // 8 * 8 + 8], place % 8
                    beside += run[:own] + run[own + 1 :]
                    at, place = digest(*run[:own], at, *run[own + 1 :]), place // 8
            root = top[-1][0]
            out.append((row[0], leaf_of(row), trees[lang][-1][0], root, digest(*beside), at, at == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("n, langs", [(1, ["en"]), (9, [None, "", "en"]), (1300, ["en", "en", "en", None]), (600, [f"l{i:02d}" for i in range(70)] + ["é", None])])
def test_manifest_against_brute_force(spark, n, langs):
    rows = [(i * 3 if i % 50 else None, f"s{i % 5}" if i % 7 else None, langs[i % len(langs)], i if i % 3 else None, [f"Text {i} Ä", "", None, "lower", "SAME"][i % 5]) for i in range(n)]
    rows += [rows[-1], rows[0], (6, None, langs[0], 1, LONG), (6, "again", langs[0], None, "A")] if n > 1 else []
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit("clash") for c in ("tree", "digest", "place", "size", "number", "members")})
    assert sorted(map(tuple, merkle_manifest.manifest(docs).collect()), key=str) == proofs(rows)


def test_manifest_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert merkle_manifest.manifest(docs).count() == 0


def test_manifest_of_several_rounds(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(merkle_manifest, "LEVELS", 1)
    monkeypatch.setattr(merkle_manifest, "BLOCK", 8)
    got = sorted(map(tuple, merkle_manifest.manifest(docs).collect()), key=str)
    assert got == proofs([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in docs.collect()])
