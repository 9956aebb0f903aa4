"""Literature records: Atom feeds, OpenAlex works, and the offline stand-in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import text as X

STAND_IN = "A stand-in: no literature service was asked."
ATOM = "entry array<struct<id: string, title: string, summary: string, published: string>>"
NO_ABSTRACT = "No abstract available."
WORKS = "results array<struct<id: string, display_name: string, publication_year: string, cited_by_count: string, referenced_works: string>>"


def atom_papers(feeds: DataFrame, feed: str = "feed") -> DataFrame:
    """paper_id, title, abstract, year of every entry that has an id and a title."""
    entries = feeds.select(F.explode(F.from_xml(F.col(feed), ATOM, {"rowTag": "feed"})["entry"]).alias("e"))
    raw, title = X.clean_text(F.col("e.id")), X.clean_text(F.col("e.title"))
    paper = F.concat(F.lit("arxiv-"), F.substring_index(F.element_at(F.split(raw, "/"), -1), "v", 1))
    summary = X.clean_text(F.col("e.summary"))
    rows = entries.where((raw != "") & (title != ""))
    return rows.select(paper.alias("paper_id"), X.normalised(title).alias("title"), X.normalised(F.when(summary == "", NO_ABSTRACT).otherwise(summary)).alias("abstract"), X.leading_year(X.clean_text(F.col("e.published"))).alias("year"))


def stand_ins(requests: DataFrame) -> DataFrame:
    """Numbered stand-ins where no literature service can be reached: request_id, n, paper_id, title, abstract and year.

    ``requests``: request_id, query, most.  None for a blank query."""
    asked = requests.where(F.coalesce(X.stripped(F.col("query")), F.lit("")) != "").where("most > 0")
    rows = asked.select("request_id", "query", F.explode(F.sequence(F.lit(1), "most")).alias("n"))
    text = F.col("n").cast("string")
    return rows.select("request_id", "n", F.concat(F.lit("arxiv-"), text).alias("paper_id"), F.concat(F.lit("arXiv study on "), "query", F.lit(" #"), text).alias("title"), F.lit(STAND_IN).alias("abstract"), F.lit(2025).alias("year"))


def openalex_works(answers: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``keep``, and paper_id, title, year, citation_count, refs of every work with an id and a name.

    A year that is no integer is null, a count that is none is 0; references count only
    where they are a list of strings."""
    work = answers.select(*keep, F.explode(F.from_json(F.col(body), WORKS)["results"]).alias("w"))
    whole = lambda c: F.when(F.col(c).rlike(r"^-?\d{1,18}$"), F.col(c).cast("long"))
    refs = F.coalesce(F.from_json("w.referenced_works", "array<string>"), F.array().cast("array<string>"))
    rows = work.where("w.id <> '' and w.display_name <> ''")
    return rows.select(*keep, X.last_segment(F.col("w.id")).alias("paper_id"), F.trim("w.display_name").alias("title"), whole("w.publication_year").cast("int").alias("year"), F.coalesce(whole("w.cited_by_count"), F.lit(0)).alias("citation_count"), F.transform(refs, X.last_segment).alias("refs"))


HISTORY = "array<struct<id: string, title: string, created_at: string>>"


def history_items(stored: DataFrame, raw: str = "raw", most: int = 8, key: str | None = None) -> DataFrame:
    """Stored JSON histories, one a row, read item by item: malformed ones dropped, the first ``most`` of each kept.

    ``key`` tells the histories apart; without it the table is one history."""
    keep = [key] if key else []
    items = stored.select(*keep, F.posexplode(F.try_variant_get(F.try_parse_json(raw), "$", "array<variant>")).alias("pos", "v"))
    field = lambda f: F.try_variant_get("v", f"$.{f}", "string")
    rows = items.where(F.schema_of_variant("v").startswith("OBJECT")).select(*keep, "pos", field("id").alias("id"), field("title").alias("title"), field("created_at").alias("created_at"))
    rows = rows.where("id is not null and title is not null and created_at is not null")
    if not key:
        return rows.orderBy("pos").limit(most)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("place") <= most).drop("place")
