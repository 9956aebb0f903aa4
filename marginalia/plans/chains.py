"""Whole calls for many requests in one job: cited answers, research gaps and experiment plans.

``chat`` takes a prompt column and gives the answer column; the offline mock is the default.
Each request is one row, and its result is one row: nothing is gathered but a request's own
few sources and what its model text lists.

A null or blank question is asked like any other.  A request without sources is answered
without asking the model.  A null model text counts as no JSON.  An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import model_json as M
from marginalia.functions import text as X
from marginalia.functions import vectors as V
from marginalia.operators import retrieval
from marginalia.operators.cells import CellIndex, search
from marginalia.operators.fallback import or_else_per_key
from marginalia.plans import providers
from marginalia.plans.providers import Embedding
from marginalia.sources import workspace

Chat = Callable[[Column], Column]

# The answer without evidence, and the experiment where no model text can be used.
INSUFFICIENT = "证据不足：未在已上传论文中检索到可用于回答该问题的片段。"
DEFAULT_EXPERIMENT = {
    "datasets": ("公开基准数据集", "arXiv 文献派生子集"),
    "metrics": ("Accuracy", "F1", "NDCG"),
    "baselines": ("BM25", "标准 RAG", "不使用 reranking 的 RAG"),
    "steps": ("准备评估划分", "运行基线系统", "比较核心指标", "分析失败案例"),
    "risks": ("外部证据可能不完整", "数据集标签可能存在噪声"),
}
DEFAULT_OBJECTIVE = ("评估 ", " 的实验证据充分性。")
DEFAULT_GAP = (" 的证据覆盖仍不完整", "mid", "现有本地论文和外部文献显示，该方向仍存在评估、鲁棒性或可复现性方面的未解决问题。")

#: Warnings of the repair: no object, no array, an item that is no object, an item with missing fields, no item left.
WARNINGS = {
    "gaps": ("The model gave no JSON of gaps; the default gap stands.", "The model's JSON has no list of gaps; the default gap stands.", "An item that is no gap was left out.", "A gap without title or description was left out.", "No gap was left; the default gap stands."),
    "experiments": ("The model gave no JSON of experiments; the default plan stands.", "The model's JSON has no list of experiments; the default plan stands.", "An item that is no experiment was left out.", "An experiment with empty fields was left out.", "No experiment was left; the default plan stands."),
}


def answers(asked: DataFrame, found: DataFrame, key: str, chat: Chat = providers.mock_answer) -> DataFrame:
    """key, question, answer, citations and sources of every question.

    ``asked``: key, question.  ``found``: key, rank, page, chunk_id, text of its few best chunks."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] page "), F.col("page").cast("string"), F.lit(", chunk "), "chunk_id", F.lit(": "), "text")
    listed = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "page", "chunk_id", "text", line.alias("line")))).alias("sources"))
    joined = asked.select(key, "question").join(listed, key, "left")
    context = F.array_join(F.transform("sources", lambda s: s["line"]), "\n\n")
    prompt = F.concat(F.lit("READING_QA\nAnswer in Chinese from these passages alone; cite them by number; say so where they do not suffice.\n\n"), F.coalesce("question", F.lit("")), F.lit("\n\n"), context)
    told = joined.withColumn("answer", F.when(F.col("sources").isNull(), INSUFFICIENT).otherwise(chat(prompt)))
    n = F.greatest(F.size("sources"), F.lit(0))
    shown = F.coalesce(F.transform("sources", lambda s: s.dropFields("line")), F.array().cast("array<struct<rank: bigint, page: int, chunk_id: string, text: string>>"))
    return told.select(key, "question", "answer", X.citation_numbers(F.col("answer"), n).alias("citations"), shown.alias("sources"))


#: What a question is told of the rung that answered it.
NO_MEANING = "No vector of the question could be made; its words were searched instead."
NO_INDEX = "No vector index is open; words were searched instead."
NO_MATCH = "The vector index held no chunk of these papers; words were searched instead."


@dataclass
class Retrieved:
    """``found``: key, rank, doc_id, page, chunk_id, text, score of each question's sources.  ``outcome``: one row a
    question with its ``rung`` (vector, lexical or none) and ``warnings``."""

    found: DataFrame
    outcome: DataFrame


def retrieved(asked: DataFrame, chunks: DataFrame, index: CellIndex | None, provider: Embedding, k: int = 5, key: str = "item_id") -> Retrieved:
    """The sources of many questions, each by its own rung of the ladder.

    ``asked``: key, question, doc_ids (null or empty: all papers); keys are unique.  Every question is embedded once.  A
    question whose vector is a fallback is searched by words; others in ``index``, within their papers; those that find
    nothing there, though chunks of their papers are stored, by words.  Without stored chunks nothing is found.
    Questions that name papers meet only the chunks and vectors of these papers, by joins on doc_id."""
    spark = asked.sparkSession
    retrieval.check_k(k)
    none = F.array().cast("array<string>")
    named = asked.select(key, "question", F.array_distinct(F.coalesce("doc_ids", none)).alias("doc_ids"))
    path = workspace.folder(spark, "asked")
    provider.embedded(named, "question").write.parquet(path)
    asked = spark.read.parquet(path)  # embedded once
    blind = F.col("is_fallback") & F.lit(provider.name != "mock")
    seeing, every = asked.where(~blind), F.size("doc_ids") == 0
    pairs = lambda rows: rows.where(~every).select(key, "question", "embedding", F.explode("doc_ids").alias("_doc"))
    columns = [key, "doc_id", "page", "chunk_id", "text", "score"]
    by_vector = None
    if index is not None:
        stored = index.vectors().select("doc_id", "page", "chunk_id", "text", "seq", F.col("embedding").alias("_own"))
        near = pairs(seeing).join(stored, F.col("_doc") == F.col("doc_id")).withColumn("distance", V.squared_distance(F.col("embedding"), F.col("_own")))
        first = F.row_number().over(Window.partitionBy(key).orderBy("distance", "seq"))
        near = near.withColumn("rank", first.cast("long")).where(F.col("rank") <= k).withColumn("score", V.similarity(F.col("distance"))).select(*columns, "rank")
        whole = search(index, seeing.where(every).select(key, F.col("embedding").alias("query")), k, key=key).select(*columns, "rank")
        by_vector = near.unionByName(whole)
        path = workspace.folder(spark, "by-vector")
        by_vector.write.parquet(path)
        by_vector = spark.read.parquet(path)
    left = asked if by_vector is None else asked.join(by_vector.select(key).distinct(), key, "left_anti")

    mine = chunks.select("doc_id", "page", "chunk_id", "text").join(pairs(left).select(F.col("_doc").alias("doc_id")).distinct(), "doc_id", "left_semi")
    scored = retrieval.lexical_scores(pairs(left).join(mine, F.col("_doc") == F.col("doc_id")), F.col("question"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "page", F.desc("chunk_id")))
    by_words = scored.withColumn("rank", place.cast("long")).where(F.col("rank") <= k).select(*columns, "rank")
    best = retrieval.lexical_topk_many(chunks, left.where(every).select(key, "question"), k, key).select(key, F.col("chunk_id").alias("_c"), "score", "rank")
    by_words = by_words.unionByName(best.join(chunks.select("doc_id", "page", "chunk_id", "text"), F.col("_c") == F.col("chunk_id")).select(*columns, "rank"))
    found = by_words if by_vector is None else or_else_per_key(by_vector, by_words, key)
    path = workspace.folder(spark, "sources")
    found.write.parquet(path)
    found = spark.read.parquet(path)

    rungs = found.select(key).distinct().withColumn("_has", F.lit(True))
    seen = asked.select(key).limit(0).withColumn("_seen", F.lit(True)) if by_vector is None else by_vector.select(key).distinct().withColumn("_seen", F.lit(True))
    told = asked.join(rungs, key, "left").join(seen, key, "left")
    rung = F.when(F.col("_seen"), "vector").when(F.col("_has"), "lexical").otherwise("none")
    why = F.when(blind, NO_MEANING).when(F.lit(index is None), NO_INDEX).when(F.col("_has") & F.col("_seen").isNull(), NO_MATCH)
    return Retrieved(found, told.select(key, "question", rung.alias("rung"), F.array_compact(F.array("embedding_error", why)).alias("warnings")))


def ask(asked: DataFrame, chunks: DataFrame, index: CellIndex | None, provider: Embedding, chat: Chat = providers.mock_answer, k: int = 5, key: str = "item_id") -> DataFrame:
    """From questions to cited answers in one call: key, question, answer, citations, sources, rung and warnings."""
    got = retrieved(asked, chunks, index, provider, k, key)
    return answers(got.outcome, got.found, key, chat).join(got.outcome.select(key, "rung", "warnings"), key)


def evidence_lines(papers: DataFrame) -> Column:
    """``id: title. abstract`` of a paper, as prompts list the outside literature."""
    return F.concat("paper_id", F.lit(": "), "title", F.lit(". "), "abstract")


def _with_literature(requests: DataFrame, literature: DataFrame, key: str) -> DataFrame:
    """The requests with ``listed``: line, title line and paper_id of each one's few papers, in order."""
    one = F.struct("n", evidence_lines(literature).alias("line"), F.concat("paper_id", F.lit(": "), "title").alias("short"), "paper_id")
    held = literature.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("listed"))
    return requests.join(held, key, "left").withColumn("listed", F.coalesce("listed", F.array().cast(held.schema["listed"].dataType)))


def _prompt(marker: str, wish: str) -> Column:
    lines = F.array_join(F.transform("listed", lambda x: x["line"]), "\n")
    return F.concat(F.lit(f"{marker}\n{wish}\n\n"), F.coalesce("query", F.lit("")), F.lit("\n\n"), lines)


def analyse(requests: DataFrame, literature: DataFrame, chat: Chat = providers.mock_answer, key: str = "request_id") -> DataFrame:
    """From topics to research gaps: ``requests`` (key, query), ``literature`` (key, n, paper_id, title, abstract: a few a request)."""
    asked = _with_literature(requests.select(key, "query"), literature, key)
    raw = chat(_prompt("GAP_JSON", "List the open research gaps of this topic as JSON, in Chinese, with the papers that show them."))
    return gap_analyses(asked.select(key, "query", F.transform("listed", lambda x: x["short"]).alias("evidence"), raw.alias("raw")))


def suggest(requests: DataFrame, literature: DataFrame, chat: Chat = providers.mock_answer, key: str = "request_id") -> DataFrame:
    """From topics to experiment plans; the literature's papers support them."""
    asked = _with_literature(requests.select(key, "query"), literature, key)
    raw = chat(_prompt("EXPERIMENT_JSON", "Plan experiments on this topic as JSON, in Chinese: objective, datasets, metrics, baselines, steps and risks."))
    return experiment_plans(asked.select(key, "query", F.transform("listed", lambda x: x["paper_id"]).alias("support_papers"), raw.alias("raw")))


def _text(v: Column, field: str) -> Column:
    return X.clean_text(F.try_variant_get(v, F.lit(f"$.{field}"), "string"))


def _list(v: Column, field: str) -> Column:
    return X.clean_list(F.try_variant_get(v, F.lit(f"$.{field}"), "array<string>"))


def _repaired(requests: DataFrame, raw: str, array: str, item: Callable[[Column], Column], whole: Callable[[Column], Column], notes: Callable[[Column], Column], default: Column) -> DataFrame:
    """The requests with ``array``, the whole items of the model text or the default, and ``warnings`` in order."""
    no_json, no_list, no_item, lacking, none_left = (F.lit(w) for w in WARNINGS[array])
    keep = [c for c in requests.columns]
    listed = M.json_objects(requests, raw, *keep).withColumn("listed", F.try_variant_get("found", F.lit(f"$.{array}"), "array<variant>"))
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    read = listed.withColumn("read", F.transform("listed", lambda v: F.struct(is_object(v).alias("ok"), item(v).alias("x"))))
    told = F.transform("read", lambda r: F.when(~r["ok"], F.array(no_item)).when(~whole(r["x"]), F.array(lacking)).otherwise(notes(r["x"])))
    valid = F.transform(F.filter("read", lambda r: r["ok"] & whole(r["x"])), lambda r: r["x"])
    out = read.withColumns({"valid": valid, "told": F.flatten(told)})
    empty = F.coalesce(F.size("valid"), F.lit(0)) <= 0
    warnings = F.when(F.col("found").isNull(), F.array(no_json)).when(F.col("listed").isNull(), F.array(no_list)).when(empty, F.concat("told", F.array(none_left))).otherwise(F.col("told"))
    return out.select(*[c for c in keep if c != raw], F.when(F.col("listed").isNull() | empty, F.array(default)).otherwise(F.col("valid")).alias(array), warnings.alias("warnings"))


def experiment_plans(requests: DataFrame, raw: str = "raw") -> DataFrame:
    """Each request's experiments and warnings.

    ``requests``: query, support_papers (ids) and the model text ``raw``; other columns pass through."""
    item = lambda v: F.struct(_text(v, "objective").alias("objective"), *[_list(v, c).alias(c) for c in M.EXPERIMENT_LISTS])

    def whole(x: Column) -> Column:
        out = x["objective"] != ""
        for c in M.EXPERIMENT_LISTS:
            out = out & (F.size(x[c]) > 0)
        return out

    default = F.struct(F.concat(F.lit(DEFAULT_OBJECTIVE[0]), "query", F.lit(DEFAULT_OBJECTIVE[1])).alias("objective"), *[F.array(*map(F.lit, DEFAULT_EXPERIMENT[c])).alias(c) for c in M.EXPERIMENT_LISTS])
    none = F.array().cast("array<string>")
    out = _repaired(requests, raw, "experiments", item, whole, lambda x: none, default)
    return out.withColumn("support_papers", M.padded_support(F.coalesce("support_papers", none)))


def gap_analyses(requests: DataFrame, raw: str = "raw") -> DataFrame:
    """Each request's gaps and warnings.

    ``requests``: query, evidence (``id: title`` lines) and the model text ``raw``; other columns pass through."""
    none = F.array().cast("array<string>")
    pool = F.when(F.size("evidence") > 0, F.col("evidence")).otherwise(F.array(F.lit(M.LOCAL_EVIDENCE)))
    requests = requests.withColumn("evidence", pool)

    def item(v: Column) -> Column:
        return F.struct(_text(v, "title").alias("title"), F.lower(_text(v, "value_level")).alias("value_level"), _text(v, "description").alias("description"), _list(v, "evidence_papers").alias("evidence_papers"))

    def notes(x: Column) -> Column:
        level = F.when(~x["value_level"].isin(*M.GAP_LEVELS), F.concat(F.lit("Level of gap '"), x["title"], F.lit("' read as mid.")))
        filled = F.when(F.size(x["evidence_papers"]) == 0, F.concat(F.lit("Evidence of gap '"), x["title"], F.lit("' filled in.")))
        return F.filter(F.array(level, filled), lambda w: w.isNotNull())

    title, level, description = DEFAULT_GAP
    default = F.struct(F.concat("query", F.lit(title)).alias("title"), F.lit(level).alias("value_level"), F.lit(description).alias("description"), none.alias("evidence_papers"))
    out = _repaired(requests, raw, "gaps", item, lambda x: (x["title"] != "") & (x["description"] != ""), notes, default)

    def settled(x: Column) -> Column:
        known = F.when(x["value_level"].isin(*M.GAP_LEVELS), x["value_level"]).otherwise(F.lit("mid"))
        given = F.when(F.size(x["evidence_papers"]) > 0, x["evidence_papers"]).otherwise(F.col("evidence"))
        return F.struct(x["title"].alias("title"), known.alias("value_level"), x["description"].alias("description"), given.alias("evidence_papers"))

    return out.withColumn("gaps", F.transform("gaps", settled)).drop("evidence")
