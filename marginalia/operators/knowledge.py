"""Knowledge search over papers, notes, chunks, gaps and experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.errors import EngineError
from marginalia.functions import text as X
from marginalia.operators.fallback import or_else
from marginalia.operators.retrieval import known_chunks, or_first_chunks


def listed_papers(papers: DataFrame, tag: str | None = None, favorites_only: bool = False) -> DataFrame:
    if tag:
        papers = papers.where(F.array_contains("tags", tag))
    return papers.where("is_favorite") if favorites_only else papers


def paper_texts() -> Column:
    return F.concat(F.array("title", "doc_id"), F.coalesce("tags", F.array().cast("array<string>")))


def paper_search(papers: DataFrame, query: str = "", tag: str | None = None, favorites_only: bool = False, narrowed: DataFrame | None = None) -> DataFrame:
    """Papers whose title, id or a tag holds the query, or all papers if none does; then the filters.

    ``narrowed``: the papers that can match, from an index (see substrings), where there is one."""
    hit = X.contains_folded(F.col("title"), query) | X.contains_folded(F.col("doc_id"), query) | X.any_contains(F.col("tags"), query)
    return listed_papers(or_else((papers if narrowed is None else narrowed).where(hit), papers), tag, favorites_only)


def chunk_search(chunks: DataFrame, papers: DataFrame, query: str = "", narrowed: DataFrame | None = None) -> DataFrame:
    """Chunks of known papers that hold the query, or the first ones if none does; ``narrowed`` as in paper_search."""
    found = known_chunks(chunks if narrowed is None else narrowed, papers).where(X.contains_folded(F.col("text"), query))
    return or_first_chunks(found, known_chunks(chunks, papers))


def note_search(notes: DataFrame, query: str | None = None) -> DataFrame:
    """LIKE over title and content; without a query, every note."""
    return notes.where(X.like_ascii(F.col("title"), query) | X.like_ascii(F.col("content"), query)) if query else notes


def newest_notes(notes: DataFrame, query: str | None = None, order: str = "created_at") -> DataFrame:
    """The notes found, the newest first; of equally old ones the greater note_id."""
    return note_search(notes, query).orderBy(F.desc(order), F.desc("note_id"))


def gap_texts() -> Column:
    return F.concat(F.array("gap_id", "title", "value_level", "description"), "evidence_papers")


def gap_search(gaps: DataFrame, query: str = "") -> DataFrame:
    return gaps.where(X.any_contains(gap_texts(), query))


def experiment_texts(experiments: DataFrame) -> Column:
    lists = [c for c in ("datasets", "metrics", "baselines", "steps", "risks", "support_papers") if c in experiments.columns]
    return F.concat(F.array("experiment_id", "gap_id", "objective"), *lists)


def experiment_search(experiments: DataFrame, query: str = "") -> DataFrame:
    return experiments.where(X.any_contains(experiment_texts(experiments), query))


def sections(papers: DataFrame, notes: DataFrame, chunks: DataFrame, gaps: DataFrame, experiments: DataFrame, query: str = "", tag: str | None = None, favorites_only: bool = False) -> DataFrame:
    """All five result sets as (section, id, title, body)."""
    found = {
        "papers": paper_search(papers, query, tag, favorites_only).select(F.col("doc_id").alias("id"), "title", F.array_join("tags", ", ").alias("body")),
        "notes": note_search(notes, query).select(F.col("note_id").alias("id"), "title", F.col("content").alias("body")),
        "chunks": chunk_search(chunks, papers, query).select(F.col("chunk_id").alias("id"), F.concat(F.lit("page "), F.col("page").cast("string")).alias("title"), F.col("text").alias("body")),
        "gaps": gap_search(gaps, query).select(F.col("gap_id").alias("id"), "title", F.col("description").alias("body")),
        "experiments": experiment_search(experiments, query).select(F.col("experiment_id").alias("id"), F.col("gap_id").alias("title"), F.col("objective").alias("body")),
    }
    out = None
    for name, rows in found.items():
        rows = rows.select(F.lit(name).alias("section"), "id", "title", "body")
        out = rows if out is None else out.unionByName(rows)
    return out


def group_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("section").agg(F.count("*").alias("n"))


def first_per_group(found: DataFrame, most: int = 3) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("section").orderBy("id"))
    return found.withColumn("place", place.cast("long")).where(F.col("place") <= most)


def tag_vocabulary(papers: DataFrame) -> DataFrame:
    return papers.select(F.explode("tags").alias("tag")).distinct()


def merged_papers(current: DataFrame, new: DataFrame) -> DataFrame:
    """Papers of both lists by doc_id; fields of the current list win."""
    mine, other = current.alias("c"), new.alias("n")
    columns = [F.coalesce(F.col(f"c.{c}"), F.col(f"n.{c}")).alias(c) for c in current.columns]
    return mine.join(other, F.col("c.doc_id") == F.col("n.doc_id"), "full").select(*columns)


def require_papers(papers: DataFrame, ids: list[str]) -> None:
    """Raise for the first given id that is no paper."""
    if not ids:
        raise EngineError("at least one paper must be selected")
    known = {r["doc_id"] for r in papers.where(F.col("doc_id").isin(*ids)).select("doc_id").collect()}  # at most the given ids
    for one in ids:
        if one not in known:
            raise EngineError(f"Paper {one} does not exist.", 404)


def updated_paper(papers: DataFrame, doc_id: str, tags: list[str] | None = None, is_favorite: bool | None = None) -> DataFrame:
    """All papers with one's tags and favourite flag replaced; raises where it is missing."""
    require_papers(papers, [doc_id])
    own = F.col("doc_id") == doc_id
    changes = {}
    if tags is not None:
        changes["tags"] = F.when(own, F.lit(tags).cast("array<string>")).otherwise(F.col("tags"))
    if is_favorite is not None:
        changes["is_favorite"] = F.when(own, is_favorite).otherwise(F.col("is_favorite"))
    return papers.withColumns(changes) if changes else papers


def experiment_topic(requests: DataFrame, gaps: DataFrame) -> DataFrame:
    """A request's topic, or ``title. description`` of its stored gap where it has none."""
    stored = gaps.select("gap_id", F.concat("title", F.lit(". "), "description").alias("stored"))
    return requests.join(stored, "gap_id", "left").withColumn("topic", F.coalesce(F.when(F.col("topic") != "", F.col("topic")), "stored")).drop("stored")
