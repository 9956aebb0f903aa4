"""Citation graphs: expansion, ranking, capped subgraphs and their fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.fallback import or_else

LEAST_NODES, MOST_NODES, KEY_NODES = 3, 50, 3


def capped(max_nodes: int) -> int:
    return max(LEAST_NODES, min(max_nodes, MOST_NODES))


def work_rank(citations: Column, influential: Column, year: Column) -> Column:
    """Citations, influential ones eightfold, and half a point a year after 2000; 1 at least."""
    recency = F.coalesce(F.nullif(year, F.lit(0)), F.lit(2000)) - 2000
    return F.greatest(F.lit(1.0), citations + influential * 8 + recency * 0.5)


def expanded(works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates and edges of works with nested ``references`` and ``citations`` (paper_id, title, year, citation_count, influential).

    A primary work wins over a stub of the same id wherever it stands; a candidate keeps
    the place where its id is first seen.  Edges keep repeats."""
    fields = ["paper_id", "title", "year", "citation_count", "influential"]
    own = works.select(F.lit(0).alias("kind"), "first_seen", F.lit(0).alias("inner"), *fields)
    stub = lambda c, kind: works.select(F.lit(kind).alias("kind"), "first_seen", F.posexplode(c).alias("inner", "x")).select("kind", "first_seen", (F.col("inner") + kind * 1_000_000).alias("inner"), *[f"x.{f}" for f in fields])
    seen = own.unionByName(stub("references", 1)).unionByName(stub("citations", 2))
    record = F.struct(*fields)
    primary = F.max_by(F.when(F.col("kind") == 0, record), F.when(F.col("kind") == 0, F.col("first_seen")))
    first = F.min_by(record, F.struct("first_seen", "inner"))
    grouped = seen.groupBy("paper_id").agg(F.coalesce(primary, first).alias("x"), F.min(F.struct("first_seen", "inner")).alias("first_seen"))
    out = works.select("paper_id", F.explode("references").alias("x")).select(F.col("paper_id").alias("source"), F.col("x.paper_id").alias("target"))
    back = works.select("paper_id", F.explode("citations").alias("x")).select(F.col("x.paper_id").alias("source"), F.col("paper_id").alias("target"))
    return grouped.select("x.*", "first_seen"), out.unionByName(back)


def nodes(works: DataFrame, max_nodes: int = 25) -> DataFrame:
    """The top works: id, title, year, importance_score (share of the top rank), is_key, rank."""
    score = work_rank(F.col("citation_count"), F.col("influential"), F.col("year"))
    top = works.withColumn("score", score).orderBy(F.desc("score"), "first_seen").limit(capped(max_nodes))
    order = Window.orderBy(F.desc("score"), F.col("first_seen"))  # over the capped nodes
    placed = top.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("best", F.max("score").over(Window.partitionBy(F.lit(0))))
    return placed.select(F.concat(F.lit("openalex-"), "paper_id").alias("id"), "title", "year", F.round(F.col("score") / F.col("best"), 3).alias("importance_score"), (F.col("rank") <= KEY_NODES).alias("is_key"), "rank")


def fixed(kept: DataFrame) -> DataFrame:
    """The capped nodes (at most MOST_NODES rows) computed once, as a local relation."""
    return kept.sparkSession.createDataFrame(kept.limit(MOST_NODES).collect(), kept.schema)


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends kept, repeats kept; the few ids are literals, so the scan filters on them."""
    ids = [r["id"].removeprefix("openalex-") for r in kept.select("id").limit(MOST_NODES).collect()]
    name = lambda c: F.concat(F.lit("openalex-"), c)
    links = edges.where(F.col("source").isin(*ids) & F.col("target").isin(*ids))
    return links.select(name("source").alias("source"), name("target").alias("target"), F.lit("cites").alias("relation"))


def star(kept: DataFrame) -> DataFrame:
    """Edges from the top node to all others."""
    top = kept.where("rank = 1").select(F.col("id").alias("source"))
    return kept.where("rank > 1").join(F.broadcast(top)).select("source", F.col("id").alias("target"), F.lit("cites").alias("relation"))


def links(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """The induced edges, or a star where none is left."""
    kept = fixed(kept)
    return or_else(induced(edges, kept), star(kept))


def enriched(works: DataFrame, citing: DataFrame, most: int = 2) -> DataFrame:
    """Per work, its first ``most`` references that are in the set and its ``most`` most cited citing works.

    ``works``: paper_id, refs (ids).  ``citing``: paper_id, citing_id, citation_count."""
    first = works.select("paper_id", F.posexplode(F.slice("refs", 1, most)).alias("pos", "ref"))
    inside = first.join(works.select(F.col("paper_id").alias("ref")), "ref", "left_semi").groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ref"))).alias("r"))
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("citation_count"), "citing_id"))
    top = citing.withColumn("place", place).where(F.col("place") <= most).groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("place", "citing_id"))).alias("c"))
    none = F.array().cast("array<string>")
    return works.select("paper_id").join(inside, "paper_id", "left").join(top, "paper_id", "left").select("paper_id", F.coalesce(F.transform("r", lambda x: x["ref"]), none).alias("references"), F.coalesce(F.transform("c", lambda x: x["citing_id"]), none).alias("citations"))


#: The default graph (id, title, year, importance, key) and its links.
DEFAULT_NODES = (("paper-root", "Survey of {}", 2025, 1.0, True), ("paper-method", "Core method for {}", 2024, 0.82, True), ("paper-eval", "Evaluation benchmark for {}", 2023, 0.66, False), ("paper-origin", "Early work on {}", 2021, 0.52, False), ("paper-application", "Applied system for {}", 2022, 0.46, False))
DEFAULT_LINKS = (("paper-root", "paper-method"), ("paper-root", "paper-eval"), ("paper-method", "paper-origin"), ("paper-eval", "paper-application"))


def default_graph(spark, keyword: str, max_nodes: int = 25) -> tuple[DataFrame, DataFrame]:
    """The graph without a source: up to five fixed nodes and the links between them."""
    name = keyword.strip() or "unknown topic"
    rows = [(i, t.format(name), y, s, k, p + 1) for p, (i, t, y, s, k) in enumerate(DEFAULT_NODES[: capped(max_nodes)])]
    ids = {r[0] for r in rows}
    kept = spark.createDataFrame(rows, "id string, title string, year int, importance_score double, is_key boolean, rank long")
    return kept, spark.createDataFrame([(a, b, "cites") for a, b in DEFAULT_LINKS if a in ids and b in ids], "source string, target string, relation string")


def counts(kept: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: how many nodes, key nodes and links a graph has."""
    held = kept.agg(F.count("*").alias("n_nodes"), F.count_if("is_key").alias("n_key"))
    return held.join(F.broadcast(edges.agg(F.count("*").alias("n_links"))))  # one row each


def from_source(spark, keyword: str, works: DataFrame | None = None, edges: DataFrame | None = None, max_nodes: int = 25, warnings: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, list[str]]:
    """Nodes, links and warnings: of the given works, else, where there are none, of the default graph."""
    if works is None or edges is None:
        return *default_graph(spark, keyword, max_nodes), [*warnings, "No citation source is in use; the graph is a fixed example."]
    if works.isEmpty():
        return *default_graph(spark, keyword, max_nodes), list(warnings or ("The citation source knows no works; the graph is a fixed example.",))
    kept = nodes(works, max_nodes)
    return kept, links(edges, kept), list(warnings)
