"""The index of pieces against scans: folding, wildcards, short needles, nulls; how much it leaves to verify."""

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import knowledge, substrings

TEXTS = ["Alpha beta", "ALPHABET soup", "gamma alp hab", "", None, "Größe ΣΟΦΟΣ", "größe", "K elvin Kelvin", "İstanbul", "100% of_it", "a\nlpha", "  ", "日本語テスト", "alpha alpha alpha"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = spark.createDataFrame([(i, t, [t, "tag"] if i % 2 else None) for i, t in enumerate(TEXTS)], "id int, text string, tags array<string>")
    texts = F.concat(F.array("text"), F.coalesce("tags", F.array().cast("array<string>")))
    return substrings.SubstringIndex.build(rows, texts, f"file://{tmp_path_factory.mktemp('s')}/i")


@pytest.mark.parametrize("needle", ["alpha", "ALPHA", "größe", "GRÖSSE", "σοφος", "kelvin", "i̇stanbul", "本語テ", "lph", "a\nl", "zzz", "al", "", "alphabet s"])
def test_contains(index, needle):
    hit = X.contains_folded(F.col("text"), needle)
    want = sorted(r["id"] for r in index.rows().where(hit).collect())
    assert sorted(r["id"] for r in index.candidates(substrings.pieces_of(needle)).where(hit).collect()) == want


@pytest.mark.parametrize("pattern", ["alpha%SOUP", "a_pha", "%", "0%_f", "größe", "GRÖ", "ALP_A%BETA", "K elvin"])
def test_like(index, pattern):
    hit = X.like_ascii(F.col("text"), pattern)
    want = sorted(r["id"] for r in index.rows().where(hit).collect())
    assert sorted(r["id"] for r in index.candidates(substrings.pattern_pieces(pattern)).where(hit).collect()) == want


def test_few_rows_are_left_to_verify(spark, tmp_path, monkeypatch):
    from marginalia.sources import views

    monkeypatch.setattr(substrings, "BLOCK_ROWS", 64)
    chunks = views.chunks(spark, "/root/testdata/sf0.001")
    built = substrings.SubstringIndex.build(chunks, F.array("text"), f"file://{tmp_path}/i")
    found, total = built.candidates(substrings.pieces_of("ThTion")), chunks.count()
    papers = views.papers(spark, "/root/testdata/sf0.001")
    want = knowledge.chunk_search(chunks, papers, "ThTion").count()
    assert want <= found.count() < total / 2
    assert knowledge.chunk_search(chunks, papers, "ThTion", found).count() == want
    assert knowledge.chunk_search(chunks, papers, "no such text", built.candidates(substrings.pieces_of("no such text"))).count() == 5


def test_nothing(spark, tmp_path):
    built = substrings.SubstringIndex.build(spark.createDataFrame([], "id int, text string"), F.array("text"), f"file://{tmp_path}/i")
    assert built.candidates(["abc"]).count() == 0 and built.candidates([]).count() == 0
