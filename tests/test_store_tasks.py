"""A bucket of a store that is larger than a task's share."""

from pyspark.sql import functions as F

from marginalia.operators.store import Store


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    chunks = spark.range(20000).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.lit("d").alias("doc_id"), F.lit(1).alias("page"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    kept = Store(spark, f"file://{tmp_path}/s", buckets=1)
    spark.conf.set(size, "200k")
    try:
        kept.put("chunks", chunks)
    finally:
        spark.conf.unset(size)
    assert len(list((tmp_path / "s/chunks/bucket=0").glob("*.parquet"))) > 1
    kept.put("chunks", chunks.limit(1).withColumn("text", F.lit("new")))
    assert kept.read("chunks").count() == 20000 and kept.read("chunks").where("text = 'new'").count() == 1
