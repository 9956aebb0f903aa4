"""Operators 4, 6, 7 and 9 against brute force and held-out rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import disclosure, hidden_markov, language_filters, quality_model
from tests.llm.conftest import LOWER, WORD, frame

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def digits(text):
    return [int(c) for c in text if c in "0123456789"]


def passes(kind, text):
    d = digits(text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        back = d[::-1]
        return 12 <= len(d) <= 19 and (sum(back[::2]) + sum(sum(divmod(2 * x, 10)) for x in back[1::2])) % 10 == 0
    return 9 <= len(d) <= 15 if kind == "phone" else True


def spans(text):
    found = [(m.start(), k, m.end()) for k, p in enumerate(PATTERNS.items()) for m in re.finditer(p[1], text) if passes(p[0], m.group())]
    return ",".join(f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in sorted(found))


def private_texts(n=400):
    rng = random.Random(4)
    parts = ["a.b@c.de", "x@y", "@", "a@b.c.d@e.fg", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111", "+49 (30) 123-4567", "+1", "+123456789012345678", "é", "日本", " ", "\n", ".", "word", "12", "+", "%@q.r-s.t", "-"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(n)]


def test_base_spans_like_the_patterns(spark):
    texts = private_texts()
    rows = disclosure.digests(frame(spark, list(enumerate(texts)))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [want.count(f"{k}:") for k in PATTERNS]


@pytest.mark.parametrize("most", [disclosure.BROADCAST_TERMS, 0])
def test_terms_that_name_an_entity(spark, most):
    rng = random.Random(6)
    filler = lambda n: " ".join(rng.choice(["some", "plain", "words", "here", "more", "text"]) for _ in range(n))
    rows = [(i, f"{filler(8)} contact Zorblatt at z@corp.example now {filler(3)}") for i in range(6)]
    rows += [(10 + i, f"{filler(9)} {i}@other.example {filler(4)}") for i in range(6)]
    rows += [(20 + i, f"only Zorblatt {filler(5)}" if i == 0 else filler(12)) for i in range(60)]
    rows += [(100 + i, "copied unique context of q@copy.example once") for i in range(9)] + [(200, None), (201, "")]
    got = {r["doc_id"]: r for r in disclosure.digests(frame(spark, rows), most).collect()}
    assert "term:" in got[0]["spans"] and got[20]["spans"] == "term:5:13" and got[20]["n_term"] == 1
    assert all(got[i]["n_term"] == 0 for i in range(100, 109)) and got[200]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in disclosure.sanitised(frame(spark, rows), most).collect()}
    assert "z@corp" not in clean[0] and "Zorblatt" not in clean[0] + clean[20] and "[EMAIL]" in clean[0]
    assert clean[200] is None and clean[201] == "" and clean[25] == dict(rows)[25]


@pytest.mark.parametrize("most", [disclosure.BROADCAST_TERMS, 0])
def test_terms_of_entities_in_one_or_two_documents(spark, most):
    rng = random.Random(16)
    filler = lambda n: " ".join(rng.choice(["some", "plain", "words", "here", "more", "text"]) for _ in range(n))
    rows = [(0, f"{filler(8)} Quixby writes from one@rare.example {filler(8)}")]
    rows += [(1 + i, f"{filler(7)} call Brandle on +49 30 1234567 {filler(7)}") for i in range(2)]
    rows += [(5, f"{filler(9)} Mumford 10.1.2.3 {filler(20)} 10.1.2.3 Mumford {filler(9)}"), (6, f"Mumford and Quixby {filler(3)}")]
    rows += [(10 + i, filler(20)) for i in range(300)]
    clean = {r["doc_id"]: r["text"] for r in disclosure.sanitised(frame(spark, rows), most).collect()}
    assert "Brandle" not in clean[1] + clean[2] and "writes" in clean[0] and "Mumford" not in clean[5] + clean[6]
    assert "Quixby" in clean[0] + clean[6]  # one context is no evidence
    assert all(clean[i] == t for i, t in rows if i >= 10)


def test_all_contexts_of_a_document_count_and_copies_do_not(spark):
    beside = [(0, "Tarn a@b.cc one two three four five six seven eight nine ten a@b.cc Tarn"), (1, "copy of c@d.ee"), (2, "copy of c@d.ee")]
    rows = disclosure.cooccurrences(frame(spark, beside)).groupBy("entity", "term").agg(F.sum("first").alias("n"), F.countDistinct("context").alias("contexts")).where("term != 0")
    assert {(r["n"], r["contexts"]) for r in rows.collect()} == {(1, 2), (1, 1), (2, 1)}


def planted(names=40):
    """Names beside their addresses in three passages each, every passage with rare words of its own, and one rare word in an address."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choices("bcdfghklmnprstvz", k=3)) + "".join(rng.choices("aeiou", k=2)) + "".join(rng.choices("bcdfghklmnprstvz", k=3))
    held, rows = [word().capitalize() for _ in range(names)], []
    for i, name in enumerate(held):
        for _ in range(3):
            beside = [word() for _ in range(4)]
            rows.append(f"{word()} the {beside[0]} of {name} {beside[1]} p{i}@host.example {beside[2]} and {beside[3]}")
    rows.append("write to Lonely at lonely.7@host.example for more")
    return {n.lower() for n in held} | {"lonely"}, rows


def brute_terms(texts):
    """Every term's highest disclosure, document by document."""
    term = re.compile(r"[A-Za-z\u0080-\U0010ffff]+")
    for_it, present, docs_near, holds = collections.defaultdict(set), collections.defaultdict(set), collections.defaultdict(set), collections.defaultdict(set)
    for d, text in enumerate(texts):
        spans = disclosure.base_spans(text)
        found = [m for m in term.finditer(text) if len(m.group().encode()) >= 3]
        for m in found:
            holds[m.group().lower()].add(d)
        outside = [m for m in found if all(m.end() <= a or m.start() >= b for a, _, b in spans)]
        for span in spans:
            e = disclosure.entity(text, span)
            present[e].add(d)
            at = sum(m.start() < span[0] for m in outside)
            near = tuple(m.group().lower() for m in outside[max(0, at - disclosure.CONTEXT) : at + disclosure.CONTEXT])
            for t in near:
                for_it[e, t].add(near)
                docs_near[e, t].add(d)
                if span[1] == 0 and t in {m.group().lower() for m in term.finditer(text[span[0] : span[2]].rpartition("@")[0])}:
                    for_it[e, t].add("own")
    out = {}
    for (e, t), contexts in for_it.items():
        a, b = len(contexts) + 0.5, len(holds[t]) - len(docs_near[e, t]) + 0.5
        mean = a / (a + b)
        low = mean - (mean * (1 - mean) / (a + b + 1)) ** 0.5
        if len(contexts) >= 2 and low >= disclosure.GENERALISE and low > len(present[e]) / len(texts):
            out[t] = max(out.get(t, 0), low)
    return out


def code_of(word):
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(disclosure.tk.span_hashes(raw, np.array([0]), np.array([len(raw)]), lower=True).view(np.int64)[0])


def test_disclosing_terms_against_brute_force_at_two_sizes(spark):
    names, rows = planted()
    rng = random.Random(5)
    rows += [f"{rng.choice(rows).split()[0]} seen once more" for _ in range(30)] + ["q@copy.example is copied here"] * 5 + [f"all of us {i} at everyone@host.example" for i in range(200)]
    filler = ["some plain words and more of the text here"] * 3000
    for texts in (rows, rows + filler):
        want = brute_terms(texts)
        got = {r["term"]: r["disclosure"] for r in disclosure.disclosing_terms(frame(spark, list(enumerate(texts)))).collect()}
        assert got == pytest.approx({code_of(t): x for t, x in want.items()})
        told = {t for t in want if t in names}
        assert told == names and len(want) <= 1.1 * len(names)  # precision among rare words
    assert brute_terms(rows).keys() >= names


def test_strong_terms_are_removed_and_ties_hold(spark):
    rng = random.Random(7)
    plain = ["some", "plain", "words", "here", "more", "text", "other", "such", "many", "few"]
    rows = [(i, f"{' '.join(rng.sample(plain, 5))} Grimbold a@strong.example {' '.join(rng.sample(plain, 5))}") for i in range(14)]
    rows += [(50 + i, f"{' '.join(rng.sample(plain, 5))} Fernando b@weak.example {' '.join(rng.sample(plain, 5))}") for i in range(3)] + [(99, "Grimbold and Fernando met")]
    rows += [(200 + i, " ".join(rng.sample(plain, 6))) for i in range(200)]
    rows[14 + 3] = (99, "Fernando met")
    clean = {r["doc_id"]: r["text"] for r in disclosure.sanitised(frame(spark, rows)).collect()}
    assert all("Grimbold" not in clean[i] and "[TERM]" not in clean[i] for i in range(14)) and "[EMAIL]" in clean[0]
    assert all("[TERM]" in clean[50 + i] and "Fernando" not in clean[50 + i] for i in range(3)) and clean[99] == "[TERM] met"


def test_private_data_in_awkward_documents(documents):
    assert disclosure.digests(documents).count() == documents.count()
    assert disclosure.sanitised(documents.limit(0)).count() == 0


def counted(text):
    w = re.findall(WORD, text or "")
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = collections.Counter(windows)
    inside = {i + j for i, x in enumerate(windows) if often[x] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)]


def test_base_counts(spark, texts):
    rng = random.Random(7)
    more = ["".join(rng.choice(["a ", "b ", "c# ", "é\n", "\n", "a b c d e f g h ", "|"]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    rows = list(enumerate([*texts, *more]))
    got = {r["doc_id"]: r for r in quality_model.judged(frame(spark, rows), None).collect()}
    for d, text in rows:
        want = counted(text)
        assert [got[d][c] for c in quality_model.COUNTS] == want
        assert got[d]["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and got[d]["kept"] != got[d]["base_failed"]


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(8)
    prose = lambda: " ".join(rng.choice(["river", "stone", "light", "walks", "under", "quiet", "trees"]) for _ in range(40))
    rows = [(i, prose().upper() + "!!" if i % 4 == 0 else prose()) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(300)] + [(1, None), (None, 1)], "doc_id long, quality int")
    model = quality_model.fit(frame(spark, rows), labels, rows=200)
    got = {r["doc_id"]: r for r in quality_model.judged(frame(spark, rows), model).collect()}
    assert all(got[i]["kept"] == (i % 4 != 0) for i in range(300, 400))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert quality_model.fit(frame(spark, rows), labels.limit(0)) is None


def test_forward_is_the_sum_over_all_paths():
    rng = np.random.default_rng(9)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = hidden_markov.Hmm(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((5, 3)), 0))
    texts = [rng.integers(0, 5, n) for n in (1, 4, 2, 6)]
    want = [sum(model.start[p[0]] * math.prod(model.move[a, b] for a, b in zip(p, p[1:], strict=False)) * math.prod(model.emit[s, q] for s, q in zip(t, p, strict=True)) for p in itertools.product(range(3), repeat=len(t))) for t in texts]
    group = hidden_markov.Group(texts)
    assert np.allclose(np.exp(group.forward(model)[0]), want)
    counts = group.expected(model)
    assert np.isclose(counts[0].sum(), 4) and np.isclose(counts[1:4].sum(), sum(len(t) - 1 for t in texts)) and np.isclose(counts[4:].sum(), sum(map(len, texts)))
    before = group.forward(model)[0].sum()
    after = group.forward(hidden_markov.Hmm(norm(counts[0], 0), norm(counts[1:4], 1), norm(counts[4:], 0)))[0].sum()
    assert after > before


def test_recursions_are_scaled_now_and_then(monkeypatch):
    """Against forward and backward scaled at every step; emissions so small that unscaled products would vanish."""
    monkeypatch.setattr(hidden_markov, "RUN_ROWS", 24)
    rng = np.random.default_rng(11)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    emit = norm(rng.random((6, 3)), 0) * np.array([1, 1e-60, 1e-9, 1, 1e-200, 1])[:, None]
    model = hidden_markov.Hmm(norm(rng.random(3), 0), norm(rng.random((3, 3)) ** 9, 1), emit)
    texts = [rng.integers(0, 6, n) for n in (5, 37, 1, 20, 37, 8)]
    want, logs = np.zeros((10, 3)), []
    for text in texts:
        alphas, scales = [], []
        for x in text:
            alpha = emit[x] * (model.start if not alphas else alphas[-1] @ model.move)
            scales.append(alpha.sum())
            alphas.append(alpha / scales[-1])
        logs.append(np.log(scales).sum())
        beta = np.ones(3)
        for t in range(len(text) - 1, -1, -1):
            want[4 + text[t]] += alphas[t] * beta
            if t == 0:
                want[0] += alphas[0] * beta
                break
            ahead = emit[text[t]] * beta / scales[t]
            want[1:4] += np.outer(alphas[t - 1], ahead) * model.move
            beta = model.move @ ahead
    group = hidden_markov.Group(texts)
    found, _, scales = group.forward(model)
    assert np.allclose(found, logs, rtol=1e-12) and np.allclose(group.expected(model), want)
    assert (scales == 1).sum() > len(scales) / 2  # most steps are left unscaled


def test_language_model(spark, texts):
    rng = random.Random(10)
    follow = {"a": "aaab", "b": "bbbc", "c": "cccd", "d": "ddda"}
    rows = list(enumerate(texts[:-1])) + [(1000 + i, " ".join(itertools.islice(walk(rng, follow), 60))) for i in range(300)] + [(None, "A b unseen")]
    got = hidden_markov.scored(frame(spark, rows), states=4, rounds=12, own=6).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    tokens = {d: [*re.findall(WORD, (t or "").translate(LOWER)), None] for d, t in rows}
    counts = collections.Counter(w for d, x in tokens.items() if not held(d) for w in x)
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for r in got:
        x = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(x), sum(counts[w] > 0 for w in x), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x), abs_tol=1e-6) and math.isfinite(r["score"])
    late = [r for r in got if r["held_out"] and r["doc_id"] >= 1000]
    assert sum(r["score"] for r in late) > sum(r["base_score"] for r in late)


def test_rare_words_have_emissions_of_their_own(spark, monkeypatch):
    """Words of one class (same ending) that live in different contexts are told apart, over several blocks."""
    rng = random.Random(13)
    monkeypatch.setattr(hidden_markov, "BLOCK_BYTES", 4000)
    side = lambda tag: " ".join(f"{tag} {tag}{rng.randrange(40)}xy" for _ in range(30))
    rows = [(i, side("ab" if i % 2 else "cd")) for i in range(200)]
    rows += [(1000, "ab ab7xy ab ab9xy"), (1001, "ab cd7xy ab cd9xy"), (1002, "ab newxy ab newerxy")]
    got = {r["doc_id"]: r["score"] for r in hidden_markov.scored(frame(spark, rows), states=2, rounds=8, own=2).collect()}
    assert got[1000] > got[1001] + 1 and got[1000] > got[1002] and len(got) == len(rows)


def test_share_of_a_class_sums_to_one(spark):
    rows = [(i, f"a{i % 7}zz b{i % 3}zz") for i in range(60)]
    docs = frame(spark, rows)
    words = hidden_markov.vocabulary(hidden_markov.word_counts(docs), 60, 1)
    model, classes, table = hidden_markov.train(hidden_markov.blocks(docs, words), words, 2, 2)
    found = table.toPandas()
    counts = found["n"].to_numpy()[:, None] * hidden_markov.unpacked_shares(found["shares"].to_numpy(), 2)
    assert len(found) == 9 and np.allclose(counts.sum(axis=0), classes.sum(axis=0)) and np.isclose(counts.sum(), found["n"].sum(), atol=0.5)


def walk(rng, follow):
    state = "a"
    while True:
        yield state
        state = rng.choice(follow[state])


def test_language_model_of_nothing(documents):
    assert hidden_markov.scored(documents.limit(0), rounds=1).count() == 0


def test_languages_on_held_out_rows(spark):
    rng = random.Random(11)
    stems = {"xx": ["bor", "lun", "ska", "fjor", "den"], "yy": ["qua", "zio", "mela", "ricco", "nulla"], "zz": ["дом", "река", "небо", "лес"]}
    rows = [(i, " ".join("".join(rng.choices(stems[lang], k=2)) for _ in range(rng.randint(3, 40))), lang) for i in range(300) for lang in [rng.choice(list(stems))]]
    rows += [(400, None, "xx"), (401, "12 -- !", "xx"), (402, "", None), (403, "BORSKA LUNDEN", None)]
    docs = frame(spark, rows, "doc_id long, text string, lang string")
    held = language_filters.held_out(F.col("doc_id"))
    filters = language_filters.learn(docs.where(~held))
    got = {r["doc_id"]: r for r in language_filters.predict(docs, filters).collect()}
    assert filters.languages == ["xx", "yy", "zz"]
    tested = [(d, lang) for d, _, lang in rows[:300] if zlib.crc32(str(d).encode()) % 3 == 1]
    assert sum(got[d]["lang_pred"] == lang for d, lang in tested) >= 0.98 * len(tested)
    assert [got[d]["lang_pred"] for d in (400, 401, 402, 403)] == ["und", "und", "und", "xx"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_filters.recognised(docs, filters, 0.3).where("doc_id >= 400").count() == 1
    none = language_filters.learn(docs.limit(0))
    assert {r["lang_pred"] for r in language_filters.predict(docs, none).collect()} == {"und"}


def test_languages_of_awkward_documents(documents):
    docs = documents.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"))
    assert language_filters.predict(docs, language_filters.learn(docs)).count() == documents.count()


def test_filters_against_exact_sets(spark):
    """Every n-gram of a language's exact set is in its filter; the share of others that are, too, is the rate that counts are corrected by."""
    rng = random.Random(40)
    stems = {"aa": "bcdfg", "bb": "hjklm", "cc": "bcdhj"}
    rows = [(i, "".join(rng.choice("aeiou" + stems[lang] + " ") for _ in range(3000)), lang) for i in range(60) for lang in [["aa", "bb", "cc"][i % 3]]]
    counts = {lang: collections.Counter() for lang in stems}
    for _, text, lang in rows:
        part = next(disclosure.tk.slices(__import__("pyarrow").array([text])))
        counts[lang].update(language_filters.grams(part)[1].tolist())
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    top = {g: max(s.get(g, 0) for s in share.values()) for s in share.values() for g in s}
    exact = {lang: {g for g, x in s.items() if x >= language_filters.MIN_SHARE and x >= language_filters.RELATIVE * top[g]} for lang, s in share.items()}
    filters = language_filters.learn(frame(spark, rows, "doc_id long, text string, lang string"))
    assert filters.languages == sorted(stems)

    def held(hashes):
        out = None
        for at in language_filters.probes(np.array(sorted(hashes), np.uint64)):
            found = filters.rows[0][at]
            out = found if out is None else out & found
        return out

    unknown = set(rng.getrandbits(64) for _ in range(200_000))
    for number, lang in enumerate(filters.languages):
        assert ((held(exact[lang]) >> number) & 1).all()
        false = ((held(unknown) >> number) & 1).mean()
        assert false == pytest.approx(filters.rates[number], abs=4 * (filters.rates[number] / 200_000) ** 0.5 + 1e-5)
    # with filters so full that most n-grams are false hits, the corrected counts still tell the languages apart
    full = language_filters.Filters(filters.languages, filters.rows | (np.random.default_rng(1).random(filters.rows.shape) < 0.8).astype(np.uint8) * np.uint8(2), filters.rates.copy(), 0)
    full.rates[1] = float(((full.rows[0] >> 1) & 1).mean() ** language_filters.HASHES)
    for text, want in (("bacadafaga badaf", "aa"), ("hajakalama hajam", "bb")):
        part = next(disclosure.tk.slices(__import__("pyarrow").array([text * 20])))
        assert full.decide(part)[0] == [want]


def test_empty_tables_give_no_rows(spark):
    none = frame(spark, [(1, "x")]).limit(0)
    assert quality_model.judged(none, None).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_model.fit(none, labels) is None
