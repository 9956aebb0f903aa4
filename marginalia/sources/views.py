"""The engine's entities as views over star-schema tables (``{dir}/{name}.parquet``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.functions import vectors as V


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """The rows of a small file dealt over all cores, for work that is long a row: a row group is read by one task."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def documents(spark: SparkSession, d: str, ids: list[int] | None = None) -> DataFrame:
    """The documents, or the given ones: the filter is on the stored column, so the scan skips row groups."""
    rows = table(spark, d, "documents")
    return rows.where(F.col("doc_id").isin(*ids)) if ids else rows


def papers(spark: SparkSession, d: str, ids: list[int] | None = None) -> DataFrame:
    docs, labels = documents(spark, d, ids).select("doc_id", "lang", "source"), table(spark, d, "labels").select("doc_id", "quality")
    joined = docs.join(labels, "doc_id", "left")
    return joined.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("title"),
        F.timestamp_add("MINUTE", F.col("doc_id").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("created_at"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("is_favorite"),
        F.array("lang", "source").alias("tags"),
    )


def chunks(spark: SparkSession, d: str, ids: list[int] | None = None) -> DataFrame:
    cut = documents(spark, d, ids).select("doc_id", F.posexplode(X.pieces(F.col("text"))).alias("pos", "text"))
    page, doc_id = (F.col("pos") + 1).cast("int"), F.col("doc_id").cast("string")
    return cut.select(F.concat_ws("-", doc_id, page.cast("string")).alias("chunk_id"), doc_id.alias("doc_id"), page.alias("page"), "text")


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", X.normalised(F.col("text")).alias("question"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    odd = F.col("vec_id") % 2 == 1
    return table(spark, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("chunk_id"),
        (F.col("vec_id") % 50).cast("string").alias("doc_id"),
        F.array(F.concat(F.lit("t"), F.col("label").cast("string")), F.when(odd, "odd").otherwise("even")).alias("tags"),
        F.when(odd, "import").otherwise("upload").alias("module_source"),
        V.as_doubles(F.col("embedding")).alias("embedding"),
        F.col("vec_id").alias("seq"),
    )


def notes(spark: SparkSession, d: str) -> DataFrame:
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    return table(spark, d, "conversations").where("role = 'user'").select(
        F.concat_ws("-", conv, turn).alias("note_id"), F.concat_ws(" ", "role", conv).alias("title"), F.col("text").alias("content"), (F.col("conv_id") * 1000 + F.col("turn")).alias("created_seq")
    )


def gaps(spark: SparkSession, d: str) -> DataFrame:
    level = F.lower(F.when(F.col("c_acctbal") >= 5000, "high").when(F.col("c_acctbal") >= 0, "mid").otherwise("LOW"))
    return table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("gap_id"),
        F.col("c_name").alias("title"),
        F.when(level.isin("high", "mid"), level).otherwise("mid").alias("value_level"),
        F.col("c_mktsegment").alias("description"),
        F.array("c_mktsegment", F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string"))).alias("evidence_papers"),
        F.col("c_custkey").alias("seq"),
    )


def experiments(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")  # the sets below drop repeats
    lists = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(
        *[F.array_sort(F.collect_set(c)).alias(name) for c, name in (("p_name", "datasets"), ("p_brand", "metrics"), ("p_type", "baselines"))],
        F.transform(F.array_sort(F.collect_set("p_partkey")), lambda x: x.cast("string")).alias("keys"),
    )
    none = F.array().cast("array<string>")
    return orders.join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").cast("string").alias("experiment_id"),
        F.col("o_custkey").cast("string").alias("gap_id"),
        F.concat_ws(" ", "o_orderpriority", F.format_string("%.2f", "o_totalprice")).alias("objective"),
        *[F.coalesce(c, none).alias(c) for c in ("datasets", "metrics", "baselines")],
        F.slice(F.coalesce("keys", none), 1, 5).alias("support_papers"),
        F.col("o_orderkey").alias("seq"),
    )


def entry_events(spark: SparkSession, d: str) -> DataFrame:
    status = F.element_at(F.array(F.lit("ready"), F.lit("pending"), F.lit("failed")), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("chunk_id"), F.concat(F.lit("v2:mock:"), "event_type", F.lit(":16")).alias("profile_key"), status.alias("status"), F.col("ts").alias("updated_at"), "event_id")


def migrations(spark: SparkSession, d: str) -> DataFrame:
    status = F.element_at(F.array(F.lit("complete"), F.lit("running"), F.lit("failed")), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, d, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("migration_id"), F.concat(F.lit("v2:mock:"), "event_type", F.lit(":16")).alias("profile_key"), status.alias("status"), F.col("ts").alias("started_at"), "event_id"
    )


def works(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.countDistinct("l_orderkey").alias("citation_count"), F.count_if(F.col("l_returnflag") == "R").alias("influential"))
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    zero = F.lit(0).cast("long")
    return parts.join(lines, "p_partkey", "left").select(
        F.col("p_partkey").cast("string").alias("paper_id"), F.col("p_name").alias("title"), (1990 + F.col("p_size") % 36).cast("int").alias("year"), F.coalesce("citation_count", zero).alias("citation_count"), F.coalesce("influential", zero).alias("influential"), F.col("p_partkey").alias("first_seen")
    )


def citations(spark: SparkSession, d: str) -> DataFrame:
    """Per order, its smallest part cites each other distinct part; repeats over orders stay."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    least = lines.groupBy("l_orderkey").agg(F.min("l_partkey").alias("source"))
    return lines.join(least, "l_orderkey").where("l_partkey <> source").select(F.col("source").cast("string").alias("source"), F.col("l_partkey").cast("string").alias("target"))


def labelled_texts(spark: SparkSession, d: str) -> DataFrame:
    """Prose with ``Label: values`` parts; some keys lack a label."""
    key = F.col("p_partkey")
    dataset = F.when(key % 5 != 0, F.concat(F.lit("Dataset: "), "p_name", F.lit(", "), "p_brand", F.lit(" and "), "p_type", F.lit(". "))).otherwise("")
    metric = F.when(key % 7 != 0, F.concat(F.lit("Metrics : size "), F.col("p_size").cast("string"), F.lit("; kept. "))).otherwise("")
    base = F.when(key % 3 != 0, F.concat(F.lit("baseline: "), "p_brand", F.lit("\n"))).otherwise("")
    return table(spark, d, "part").select(key.alias("part_id"), F.concat(F.lit("The method uses "), "p_name", F.lit(". "), dataset, metric, base, F.lit("Training loss is low! End.")).alias("text"))


def model_texts(spark: SparkSession, d: str) -> DataFrame:
    """Model answers of four shapes: strict, fenced, in prose, invalid."""
    key = F.col("p_partkey")
    level = F.when(key % 3 == 0, "HIGH").when(key % 3 == 1, "mid").otherwise("low")
    title = F.when(key % 10 == 9, "").otherwise(F.col("p_name"))
    evidence = F.when(key % 4 == 2, "[]").otherwise(F.concat(F.lit('["'), "p_brand", F.lit('", " ", "x"]')))
    gap = F.concat(F.lit('{"title": "'), title, F.lit('", "value_level": "'), level, F.lit('", "description": "'), "p_type", F.lit('", "evidence_papers": '), evidence, F.lit("}"))
    gaps = F.concat(F.lit('{"gaps": ['), gap, F.lit(', 7, {"title": "second", "value_level": "high", "description": "d '), "p_brand", F.lit('"}]}'))
    steps = F.when(key % 6 == 5, "[]").otherwise('["plan", "run"]')
    plans = F.concat(F.lit('{"experiments": [{"objective": "'), "p_name", F.lit('", "datasets": ["'), "p_brand", F.lit('"], "metrics": ["F1"], "baselines": ["'), "p_type", F.lit('"], "steps": '), steps, F.lit(', "risks": ["drift"]}]}'))

    def shaped(body):
        return F.when(key % 4 == 0, body).when(key % 4 == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone."))).when(key % 4 == 2, F.concat(F.lit("Answer "), body, F.lit(" end"))).otherwise("no json here")

    return table(spark, d, "part").select(key.alias("part_id"), shaped(gaps).alias("gap_text"), shaped(plans).alias("plan_text"))


def atom_feeds(spark: SparkSession, d: str) -> DataFrame:
    """One Atom feed a brand; some entries without a summary."""
    key = F.col("p_partkey")
    summary = F.when(key % 4 != 0, F.concat(F.lit("<summary> about\n  "), "p_type", F.lit(" </summary>"))).otherwise("")
    entry = F.concat(F.lit("<entry><id>http://arxiv.org/abs/"), key.cast("string"), F.lit("v2</id><title> "), "p_name", F.lit("\n paper </title>"), summary, F.lit("<published>"), (1990 + F.col("p_size")).cast("string"), F.lit("-01-02T00:00:00Z</published></entry>"))
    rows = table(spark, d, "part").select("p_brand", F.struct(key.alias("k"), entry.alias("e")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]), "")
    return rows.groupBy("p_brand").agg(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), body, F.lit("</feed>")).alias("feed"))
