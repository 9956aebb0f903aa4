"""Retrieval: filtered vector top-k, lexical top-k, and the ladder between them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.errors import EngineError
from marginalia.functions import text as X
from marginalia.functions import vectors as V
from marginalia.operators.fallback import when_empty


def filtered(rows: DataFrame, doc_ids: list[str] | None = None, tags: list[str] | None = None, module_source: str | None = None) -> DataFrame:
    """Rows of the given documents that hold all tags and come from the module; empty filters filter nothing."""
    if doc_ids:
        rows = rows.where(F.col("doc_id").isin(*doc_ids))
    if tags:
        rows = rows.where(F.size(F.array_except(F.lit(tags), F.col("tags"))) == 0)
    if module_source:
        rows = rows.where(F.col("module_source") == module_source)
    return rows


def check_k(k: int) -> int:
    if not 1 <= k <= 10:
        raise EngineError("top_k must lie between 1 and 10")
    return k


def ranked(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows with their rank; the window runs over k rows only."""
    return rows.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def cosine_topk(rows: DataFrame, query: list[float], k: int = 5, **filters) -> DataFrame:
    """Exact cosine top-k; vectors of another length are skipped, ties go by insertion."""
    found = filtered(rows, **filters).where(F.size("embedding") == len(query)).withColumn("score", V.cosine(F.col("embedding"), V.literal(query)))
    return ranked(found, [F.desc("score"), F.col("seq")], k)


def distance_topk(rows: DataFrame, query: list[float], k: int = 5, candidate_factor: int | None = None, tags: list[str] | None = None, **filters) -> DataFrame:
    """Top-k by squared distance, scored 1/(1+d); vectors of another length raise.

    With ``candidate_factor`` the nearest factor*k are cut before the tag filter, which
    may return fewer than k; without it tags filter first."""
    same = F.assert_true(F.size("embedding") == len(query), F.lit("query and stored vectors differ in length"))
    found = filtered(rows, tags=None if candidate_factor else tags, **filters)
    found = found.withColumn("distance", F.coalesce(same.cast("double"), V.squared_distance(F.col("embedding"), V.literal(query))))
    if candidate_factor:
        found = filtered(found.orderBy("distance", "seq").limit(candidate_factor * k), tags=tags)
    return ranked(found, [F.col("distance"), F.col("seq")], k).withColumn("score", V.similarity(F.col("distance")))


def _lexical_order() -> list[Column]:
    return [F.desc("score"), F.asc("page"), F.desc("chunk_id")]


def shared_tokens(text: Column, asked: Column) -> Column:
    """n and shared: how many tokens a text has, and how many of them are asked for; the text is cut once."""
    return V.bound(X.tokens(text), lambda own: F.struct(F.size(own).alias("n"), F.size(F.array_intersect(asked, own)).alias("shared")))


def lexical_scores(chunks: DataFrame, question: str | Column) -> DataFrame:
    asked = X.tokens(F.lit(question) if isinstance(question, str) else question)
    score = V.bound(shared_tokens(F.col("text"), asked), lambda x: X.token_cosine(x["shared"], F.size(asked), x["n"]))
    return chunks.withColumn("score", score)


def lexical_topk(chunks: DataFrame, question: str, k: int = 5) -> DataFrame:
    """Top-k by token cosine, then page, then chunk_id descending; rows without a shared token stay at 0."""
    return ranked(lexical_scores(chunks, question), _lexical_order(), k)


#: Tokens of questions that one pass over the chunks takes to every task, cells of a task's score table, and rows and tokens of a slice.
PASS_TOKENS, CELLS, SLICE_ROWS, SLICE_TOKENS = 2_000_000, 2_000_000, 256, 65_536


def lexical_topk_many(chunks: DataFrame, questions: DataFrame, k: int = 5, key: str = "item_id", group: str | None = None) -> DataFrame:
    """lexical_topk of every question of a table: key, chunk_id, page, score and rank; join the chunks for their texts.

    One pass over the chunks scores them against up to PASS_TOKENS question tokens, counted first and sent to every
    task; more questions are dealt to more passes.  A task keeps a running best k of each question and sends only these
    at its end, and only chunks that share a token; questions with fewer go on with the first chunks of the zero order,
    which is found once.  With ``group``, a column of both tables, a question meets its own group's chunks alone.  Rows
    that repeat a key are one question each where their tokens differ; null groups meet nothing."""
    of = F.col(group).cast("string") if group else F.lit("")
    asked = questions.select(key, of.alias("_group"), X.tokens(F.col("question")).alias("asked")).distinct()
    own = chunks.select("chunk_id", F.col("page").cast("int").alias("page"), of.alias("_group"), F.array_join(X.tokens(F.col("text")), " ").alias("own"))
    first = F.row_number().over(Window.partitionBy("_group").orderBy("page", F.desc("chunk_id")))
    zeros = chunks.select(of.alias("_group"), "chunk_id", F.col("page").cast("int").alias("page")).withColumn("first", first).where(F.col("first") <= 2 * k)
    total = asked.agg(F.sum(F.size("asked"))).first()[0] or 0
    passes = total // PASS_TOKENS + 1
    kind = asked.schema[key].dataType.simpleString()
    found = None
    for number in range(passes):
        part = asked if passes == 1 else asked.where(F.pmod(F.xxhash64(key, "asked"), F.lit(passes)) == number)
        rows = part.toArrow()  # at most about PASS_TOKENS tokens
        spark = chunks.sparkSession
        best = own.mapInArrow(_cut(_scored(spark.sparkContext.broadcast(rows), k)), "place int, chunk_id string, page int, score double")
        by_place = Window.partitionBy("place")
        best = best.withColumn("rank", F.row_number().over(by_place.orderBy(*_lexical_order())).cast("long")).where(F.col("rank") <= k)
        keys = spark.createDataFrame([(i, v, g) for i, (v, g) in enumerate(zip(rows.column(key).to_pylist(), rows.column("_group").to_pylist(), strict=True))], f"place int, {key} {kind}, _group string")
        have = best.groupBy(F.col("place").alias("_place")).agg(F.count("*").alias("have"), F.collect_set("chunk_id").alias("taken"))  # k at most
        short = keys.join(have, F.col("place") == F.col("_place"), "left").where(F.coalesce("have", F.lit(0)) < k)
        fill = short.join(zeros, "_group").where(~F.coalesce(F.array_contains("taken", F.col("chunk_id")), F.lit(False)))
        after = F.row_number().over(by_place.orderBy("first")) + F.coalesce("have", F.lit(0))
        fill = fill.withColumn("rank", after.cast("long")).where(F.col("rank") <= k).select(key, "chunk_id", "page", F.lit(0.0).alias("score"), "rank")
        best = best.join(keys, "place").select(key, "chunk_id", "page", "score", "rank").unionByName(fill)
        found = best if found is None else found.unionByName(best)
    return found


class _Best:
    """The best k rows of each question so far: score, then page, then chunk_id descending."""

    def __init__(self, questions: int, k: int):
        self.k, self.rows, self.parts = k, 0, []
        self.bar = np.zeros(questions)
        self.most = 4 * k * questions + 100_000

    def add(self, question: np.ndarray, chunk_id: pa.Array, page: pa.Array, score: np.ndarray) -> None:
        self.parts.append(pa.table([pa.array(question.astype(np.int32)), chunk_id, page, pa.array(score)], names=["place", "chunk_id", "page", "score"]))
        self.rows += len(question)
        if self.rows > self.most:
            self.cut()

    def cut(self) -> pa.Table | None:
        if not self.parts:
            return None
        rows = pa.concat_tables(self.parts).sort_by([("place", "ascending"), ("score", "descending"), ("page", "ascending"), ("chunk_id", "descending")])
        place = np.asarray(rows.column("place"))
        begins = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        nth = np.arange(len(place)) - np.repeat(begins, np.diff(np.append(begins, len(place))))
        full = nth == self.k - 1
        self.bar[place[full]] = np.asarray(rows.column("score"))[full]
        rows = rows.filter(pa.array(nth < self.k)).combine_chunks()
        self.parts, self.rows = [rows], rows.num_rows
        return rows


class Asked:
    """The questions of a pass in a task: how many tokens each has, their vocabulary, and who asks for each token."""

    def __init__(self, asked: pa.ListArray):
        self.n = np.asarray(asked.value_lengths()).astype(np.int64)
        self.vocabulary = asked.flatten().unique()
        token = self.places(asked.flatten())[1]
        by = np.argsort(token, kind="stable")
        self.questions = np.repeat(np.arange(len(self.n)), self.n)[by]
        self.begin = np.searchsorted(token[by], np.arange(len(self.vocabulary) + 1))

    def places(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens are asked for by anyone, and the places of these in the vocabulary."""
        at = pc.index_in(tokens, self.vocabulary)
        return np.asarray(at.is_valid()), np.asarray(at.drop_null()).astype(np.int64)

    def asking(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (which of ``tokens``, question), by question."""
        width = self.begin[tokens + 1] - self.begin[tokens]
        first = np.repeat(self.begin[tokens] - (np.cumsum(width) - width), width)
        question = self.questions[np.arange(int(width.sum())) + first]
        by = np.argsort(question, kind="stable")
        return np.repeat(np.arange(len(tokens)), width)[by], question[by]

    def shared(self, row: np.ndarray, at: np.ndarray, rows: int, chosen: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Some questions, and how many tokens each row shares with each of them; rows hold a token once.

        A product of 0/1 matrices of CELLS cells at most (or of one row or question): what is in memory does not follow
        how many pairs of a row and a question share a frequent token."""
        tokens, column = np.unique(at, return_inverse=True)
        which, question = self.asking(tokens)
        some = np.unique(question) if chosen is None else np.intersect1d(question, chosen)
        held = np.zeros((rows, len(tokens)), np.float32)
        held[row, column] = 1
        step = max(1, CELLS // max(1, rows, len(tokens)))
        for lo in range(0, len(some), step):
            part = some[lo : lo + step]
            a, b = np.searchsorted(question, part[0]), np.searchsorted(question, part[-1], "right")
            place = np.searchsorted(part, question[a:b])
            mine = part[place] == question[a:b]
            wanted = np.zeros((len(tokens), len(part)), np.float32)
            wanted[which[a:b][mine], place[mine]] = 1
            yield part, held @ wanted


def slices(n: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with SLICE_TOKENS tokens (or one row) and ``most`` rows at most."""
    ends, lo = np.cumsum(n), 0
    while lo < len(n):
        before = ends[lo - 1] if lo else 0
        hi = min(max(lo + 1, int(np.searchsorted(ends, before + SLICE_TOKENS, "right"))), lo + most, len(n))
        yield lo, hi
        lo = hi


def _cut(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` of batches whose last column lists tokens, sent as one string a row (no token holds a space); rows without any share none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.not_equal(batch.column(batch.num_columns - 1), ""))
            lists = pc.split_pattern(batch.column(batch.num_columns - 1), " ")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=batch.schema.names)

    return lambda batches: run(cut(batches))


def _scored(shared, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's best k chunks of every question, of those that share a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Asked(shared.value.column("asked").combine_chunks())
        groups = shared.value.column("_group").combine_chunks()
        names = groups.drop_null().unique()
        group = np.asarray(pc.index_in(groups, names).fill_null(-1)).astype(np.int64)
        best = _Best(len(asked.n), k)
        for whole in batches:
            for lo, hi in slices(np.asarray(whole.column(3).value_lengths().fill_null(0)), SLICE_ROWS) if len(asked.n) else ():
                batch = whole.slice(lo, hi - lo)
                own = batch.column(3)
                n_own = np.asarray(own.value_lengths()).astype(np.int64)
                of = np.asarray(pc.index_in(batch.column(2), names).fill_null(-2)).astype(np.int64)
                known, at = asked.places(own.flatten())
                for questions, counts in asked.shared(np.repeat(np.arange(len(n_own)), n_own)[known], at, len(n_own)):
                    score = counts / np.sqrt(np.maximum(1, n_own[:, None] * asked.n[questions][None, :]).astype(np.float64))
                    row, place = np.nonzero((counts > 0) & (score >= best.bar[questions][None, :]) & (of[:, None] == group[questions][None, :]))
                    best.add(questions[place], batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), score[row, place])
        found = best.cut()
        if found is not None:
            yield from found.to_batches()

    return run


def direction_topk(chunks: DataFrame, direction: str, k: int = 8) -> DataFrame:
    """Chunks by how many of the direction's words they contain, then in document order."""
    matched = X.matched_terms(F.col("text"), X.direction_terms(direction))
    return ranked(chunks.withColumn("matched", matched), [F.desc("matched"), F.col("doc_id"), F.col("page"), F.col("chunk_id")], k)


def sources(found: DataFrame) -> DataFrame:
    """Source paragraphs: a missing score reads 0."""
    return found.select("doc_id", "chunk_id", "page", "text", F.coalesce("score", F.lit(0.0)).alias("score"), "rank")


def context_block(found: DataFrame) -> DataFrame:
    """One row: numbered sources joined by blank lines."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] page "), F.col("page").cast("string"), F.lit(", chunk "), "chunk_id", F.lit(": "), "text")
    return found.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("context"))


def ladder(chunks: DataFrame, vectors: DataFrame | None, question: str, query: list[float] | None, k: int, doc_ids: list[str], is_fallback: bool = False, mock: bool = True) -> tuple[DataFrame, list[str]]:
    """Vector search, or lexical search where embeddings are a fallback, no index is there, or it has no match."""
    stored = filtered(chunks, doc_ids=doc_ids)
    lexical = sources(lexical_topk(stored, question, k))
    if is_fallback and not mock:
        return lexical, ["No vector of the question could be made; lexical fallback."]
    if vectors is None or query is None:
        return lexical, ["No vector index is open; lexical fallback."]
    found = sources(cosine_topk(vectors, query, k, doc_ids=doc_ids))
    if found.isEmpty() and not stored.isEmpty():
        return lexical, ["The vector index had no matching chunks; lexical fallback."]
    return found, []


def known_chunks(chunks: DataFrame, papers: DataFrame) -> DataFrame:
    return chunks.join(papers.select("doc_id"), "doc_id", "left_semi")


def or_first_chunks(matched: DataFrame, known: DataFrame, most: int = 5) -> DataFrame:
    """The matched chunks, or the first known ones in document order."""
    return matched.unionByName(when_empty(matched, known).orderBy("doc_id", "page", "chunk_id").limit(most))
