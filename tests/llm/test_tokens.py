"""Operators 1, 5 and 8 against the tokenizer libraries."""

import numpy as np
import public_tokenizers
import pytest

from marginalia.llm import encoding, huffman_files, merge_counts, tier_packing
from marginalia.llm import textkernel as tk
from tests.llm.conftest import crc


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {name: Tokenizer.from_file(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def encode(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("limit", [6, 9, 18])
def test_code_lengths_are_complete_and_limited(limit):
    rng = np.random.default_rng(1)
    counts = (rng.pareto(0.6, 60) * 5 + 1).astype(int)
    lengths = huffman_files.code_lengths(counts, limit)
    assert lengths.max() <= limit and (2.0**-lengths).sum() == 1
    code = huffman_files.Code(lengths, 18)
    tokens = rng.integers(0, 60, 5000)
    assert (code.decode(*code.encode(tokens), 5000) == tokens).all()


def test_one_symbol_code():
    lengths = huffman_files.code_lengths(np.array([0, 7, 0]))
    code = huffman_files.Code(lengths)
    assert (code.decode(*code.encode(np.ones(300, int)), 300) == 1).all()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_encode_like_whole_texts(library, texts, name):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    alphabet = list("ab  ́\n Theé日😀'sl\u0085 3.,!")
    more = ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(500)]
    encoder, found = encoding.ChunkEncoder(public_tokenizers.path(name)), []
    for part in tk.slices(pa.array([*texts, *more]), limit=5000):
        ids, lengths = encoder.encode(part)
        found += [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]
    assert found == [encode(library[name], t) for t in [*texts, *more]]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_are_sent_together_and_encode_like_whole_texts(library, name):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    pieces = ["the", "The", "TH", "é", "É", "Ünd", "ß", "ÿ", "×", "÷", "H\u0331", "J\u030c", "e\u0301", "İ", "Σ", "ª", "K\u212a", "\u00ad", "日本", "'S", "'ll", "7", "__", "#", "$$", "%", "&&&", "*", "<|", "|>", "<|ENDOFTEXT|>", "<|endoftext|>", "</w>", "Ġ", *"  \n\n.,!", "\u00a0", "\x1c", "\x7f"]
    texts = ["".join(rng.choice(pieces, rng.integers(0, 30))) for _ in range(2000)] + ["x" * n for n in (1023, 1024, 1025)] + [" " + "X" * 1024, "É" * 2000]
    texts += [" ".join("".join(rng.choice(["an", "Ér", "th", "óu", "STE"], 6)) for _ in range(400)) for _ in range(5)]
    encoder, sent, found = encoding.ChunkEncoder(public_tokenizers.path(name)), [], []

    class Library:
        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return library[name].encode_batch_fast(texts, **options)

    encoder.tokenizer = Library()
    for part in tk.slices(pa.array(texts), limit=20_000):
        if part.lo >= len(texts) - 5:
            sent.clear()
        ids, lengths = encoder.encode(part)
        found += [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]
    assert found == [encode(library[name], t) for t in texts]
    assert len(sent) <= 5  # some 2,000 distinct words were new; at most the first of a text goes alone


def test_files_round_trip(spark, documents, library):
    path = public_tokenizers.path("byte_bpe_50k.json")
    blocks, lengths = huffman_files.encode_corpus(documents, path, end_id=0, block_tokens=64)
    rows = huffman_files.read_blocks(blocks, lengths).collect()
    want = sorted((d if d is not None else -1, crc(encode(library["byte_bpe_50k.json"], t) + [0])) for d, t in documents.select("doc_id", "text").collect())
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["ids_crc32"]) for r in rows) == want
    ordered = sorted(rows, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.concatenate(([0], np.cumsum([r["n_tokens"] for r in ordered])[:-1])).tolist()
    assert [r["doc_id"] or -1 for r in ordered][1:] == sorted(r["doc_id"] or -1 for r in ordered)[1:]


def test_other_pre_tokenizers_encode_whole_texts(tmp_path):
    import pyarrow as pa
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    tokenizer.save(str(tmp_path / "t.json"))
    texts = ["one two, three", None, "", "it is one two"]
    encoder = encoding.ChunkEncoder(str(tmp_path / "t.json"))
    (part,) = tk.slices(pa.array(texts))
    ids, lengths = encoder.encode(part)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [encode(tokenizer, t) for t in texts]


def test_ids_that_do_not_fit_are_refused(documents):
    with pytest.raises(ValueError, match="do not fit"):
        huffman_files.tokenised(documents, public_tokenizers.path("byte_bpe_50k.json"), end_id=1 << 16)


def test_files_of_nothing(spark, documents):
    blocks, lengths = huffman_files.encode_corpus(documents.limit(0), public_tokenizers.path("byte_bpe_50k.json"))
    assert huffman_files.read_blocks(blocks, lengths).count() == 0


def test_packing(documents, library):
    docs = documents.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = tier_packing.packed(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    ids = {d: encode(library["word_bpe_49k.json"], t) + [2] for d, t in docs.select("doc_id", "text").collect()}
    windows, pieces = {}, {}
    for r in rows:
        whole = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(whole) and crc(whole[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"]
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for spans, total in [(w, None) for w in windows.values()] + [(p, len(ids[d])) for d, p in pieces.items()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == total if total else at <= 4096 and at & (at - 1) == 0
    assert set(pieces) == set(ids)


def test_pool_prefers_the_longest_that_fits():
    pool = tier_packing.Pool()
    for n in (3000, 900, 200, 100):
        pool.add((n, 0, np.zeros(n, np.int32), n))
    windows, left = tier_packing.pack(pool)
    assert [(t, [p[0] for p in w]) for t, w in windows] == [(4096, [3000, 900, 100, 200])]
    assert sum(len(p[2]) for p in left) == 104


def test_step_groups_are_filled_over_slices():
    groups, window = tier_packing.StepGroups(), lambda n, tier=4096: (tier, [(0, 0, np.zeros(n), n)])
    per, many = tier_packing.GROUP_TOKENS // 4096, tier_packing.GROUPS
    out = [x for part in range(3) for x in groups.add([window(n) for n in range(1, 1 + many * per // 2)] + [window(9)])]
    assert len(out) == many * per and sorted([g for _, g in out].count(g) for g in range(many)) == [per] * many
    work = [sum(w[1][0][3] ** 2 for w, own in out if own == g) for g in range(many)]
    assert max(work) < 1.2 * min(work)
    rest = list(groups.rest([window(3, 4), window(1, 1)]))
    assert [g for _, g in rest[-2:]] == [max(g for _, g in rest)] * 2 and len(rest) == 3 * (many * per // 2 + 1) - many * per + 2


def test_step_groups_of_a_corpus(spark):
    rows = [(i, "some words that are packed " * (1 + i * 7 % 400)) for i in range(1200)] + [(None, None), (3, "twice"), (3, "twice")]
    found = tier_packing.packed(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), public_tokenizers.path("word_bpe_49k.json")).collect()
    held, tiers = {}, {}
    for r in found:
        held[r["step_group"]] = held.get(r["step_group"], 0) + r["length"]
        tiers.setdefault(r["tier"] if r["tier"] in tier_packing.TIERS else 0, set()).add(r["step_group"])
    for tier, own in tiers.items():
        short = [g for g in own if held[g] != tier_packing.GROUP_TOKENS]
        assert len(short) <= (tier_packing.GROUPS if tier else 1)
    assert sum(held.values()) == sum({(r["doc_id"], r["doc_tokens"], r["start"]): r["length"] for r in found if r["doc_id"] != 3}.values()) + sum(r["length"] for r in found if r["doc_id"] == 3)
    assert tier_packing.packed(spark.createDataFrame([], "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json")).count() == 0



def test_counts_like_the_library(documents, texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = merge_counts.token_counts(documents, path, max_tokens=100).collect()
    want = sorted((d if d is not None else -1, len((t or "").encode()), len(model.encode(t or ""))) for d, t in documents.select("doc_id", "text").collect())
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_tokens"]) for r in rows) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in rows)


def test_counts_of_random_texts():
    import pyarrow as pa
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, merger = sentencepiece.SentencePieceProcessor(model_file=path), merge_counts.PieceMerger(path)
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab ▁\n theé日😀  "), rng.integers(0, 60))) for _ in range(800)] + [" " * n for n in range(40)] + ["a" * 500]
    got = np.concatenate([merge_counts.count_slice(p, merger, {}) for p in tk.slices(pa.array(texts), limit=2000)])
    assert got.tolist() == [len(model.encode(t)) for t in texts]
