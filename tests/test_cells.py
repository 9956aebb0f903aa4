"""The inverted-file collection against brute force: exact, probing, filters, growth, hot and empty cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.errors import EngineError
from marginalia.operators import cells

KINDS = "seq long, chunk_id string, doc_id string, tags array<string>, module_source string, embedding array<double>"


def rows(points, lo=0):
    return [(lo + i, f"c{lo + i}", str(i % 5), ["odd" if i % 2 else "even"], "upload" if i % 3 else "import", p.tolist()) for i, p in enumerate(points)]


def nearest(data, questions, k, keep=lambda r: True):
    out = {}
    for key, q in questions:
        found = sorted((float(((np.array(r[5]) - q) ** 2).sum()), r[0]) for r in data if keep(r))[:k]
        out[key] = [s for _, s in found]
    return out


def listed(found):
    out = {}
    for r in found.orderBy("item_id", "rank").collect():
        out.setdefault(r["item_id"], []).append(r["seq"])
        assert r["rank"] == len(out[r["item_id"]]) and r["score"] == pytest.approx(1 / (1 + r["distance"]))
    return out


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    points = np.repeat(rng.normal(size=(12, 8)) * 5, 40, axis=0) + rng.normal(size=(480, 8)) * 0.3
    points = np.vstack([points, np.zeros((1, 8)), np.tile(points[7], (300, 1))])
    data = rows(points)
    index = cells.CellIndex.build(spark.createDataFrame(data, KINDS), f"file://{tmp_path_factory.mktemp('cells')}/a", 12)
    questions = [(i, points[i * 31] + 0.05) for i in range(12)] + [(99, points[7])]
    return index, data, questions, spark.createDataFrame([(k, q.tolist()) for k, q in questions], "item_id int, query array<double>")


def test_exact_and_probing(clustered, monkeypatch):
    index, data, questions, asked = clustered
    want = nearest(data, questions, 5)
    assert index.rows.sum() == len(data) and len(index.centroids) == 12
    assert listed(cells.search(index, asked, 5, probes=1)) == want
    near = listed(cells.search(index, asked, 5, probes=2, exact=False))
    assert sum(len(set(near[k]) & set(want[k])) for k in want) >= 0.9 * 5 * len(want)
    monkeypatch.setattr(cells, "SLICE_ROWS", 50)
    monkeypatch.setattr(cells, "BLOCK", 4)
    assert listed(cells.search(index, asked, 5, probes=2)) == want


def test_other_cells_are_not_read(clustered):
    index, _, _, _ = clustered
    one = index.vectors([3])
    assert {r[0] for r in one.select("cell").distinct().collect()} == {3}
    assert "(cell#" in (plan := one._jdf.queryExecution().executedPlan().toString()).split("PartitionFilters: ")[1].split("]")[0], plan


def test_filters_come_before_the_cut(clustered):
    index, data, questions, asked = clustered
    want = nearest(data, questions, 5, lambda r: r[2] in ("1", "2") and "odd" in r[3] and r[4] == "upload")
    assert listed(cells.search(index, asked, 5, probes=1, doc_ids=["1", "2"], tags=["odd"], module_source="upload")) == want
    few = listed(cells.search(index, asked, 600, probes=1, exact=False, tags=["odd"]))
    assert all(len(found) == sum("odd" in r[3] for r in data) for found in few.values())  # too few near by: all cells are read
    assert listed(cells.search(index, asked, 5, doc_ids=["none"])) == {}


def test_growth_and_reopening(spark, tmp_path):
    rng = np.random.default_rng(8)
    first, second = rows(rng.normal(size=(200, 4))), rows(rng.normal(size=(150, 4)) * 3, 200)
    index = cells.CellIndex.build(spark.createDataFrame(first, KINDS), f"file://{tmp_path}/a")
    index.add(spark.createDataFrame(second, KINDS))
    index = cells.CellIndex.open(spark, f"file://{tmp_path}/a")
    questions = [(i, rng.normal(size=4) * 2) for i in range(20)]
    asked = spark.createDataFrame([(k, q.tolist()) for k, q in questions], "item_id int, query array<double>")
    assert listed(cells.search(index, asked, 7, probes=2)) == nearest(first + second, questions, 7)
    index.clear()
    with pytest.raises(Exception, match="one length"):
        index.add(spark.createDataFrame(rows(np.ones((1, 3))), KINDS))
    with pytest.raises(EngineError):
        cells.search(index, asked.withColumn("query", F.array(F.lit(1.0))))


def test_nothing(spark, tmp_path):
    none = spark.createDataFrame([], KINDS)
    index = cells.CellIndex.build(none, f"file://{tmp_path}/a")
    asked = spark.createDataFrame([(1, [1.0])], "item_id int, query array<double>")
    assert cells.search(index, asked).count() == 0
    index = cells.CellIndex.build(spark.createDataFrame(rows(np.ones((3, 2))), KINDS), f"file://{tmp_path}/b")
    assert cells.search(index, asked.limit(0)).count() == 0


def test_recall_on_the_given_vectors(spark, tmp_path):
    from marginalia.sources import views

    vectors = views.vectors(spark, "/root/testdata/sf0.1")
    index = cells.CellIndex.build(vectors, f"file://{tmp_path}/a")
    data = [(r["seq"], None, None, None, None, r["embedding"]) for r in vectors.collect()]
    questions = [(r[0], np.array(r[5])) for r in data if r[0] % 50 == 0]
    want = nearest(data, questions, 5)
    asked = vectors.where("seq % 50 = 0").select(F.col("seq").alias("item_id"), F.col("embedding").alias("query"))
    near = listed(cells.search(index, asked, 5, probes=len(index.centroids) * 3 // 5, exact=False))
    assert sum(len(set(near[k]) & set(want[k])) for k in want) >= 0.9 * 5 * len(want)
    assert listed(cells.search(index, asked, 5)) == want


def test_a_build_evaluates_its_rows_once(spark, tmp_path):
    """Rows may be costly to make (texts cut and embedded): statistics, the sample and the fit read a copy."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    points = np.random.default_rng(8).normal(size=(300, 4))
    index = cells.CellIndex.build(spark.createDataFrame(rows(points), KINDS).mapInArrow(counted, KINDS), f"file://{tmp_path}/a")
    assert made.value == 300 == index.rows.sum() == index.vectors().count()
    assert not (tmp_path / "a" / "_given").exists() and not (tmp_path / "a" / "_sample").exists()
    assert index.vectors() is index.vectors()  # listed once
    near = ((points[:, None, :] - index.centroids[None]) ** 2).sum(2).argmin(1)
    assert {r["seq"]: r["cell"] for r in index.vectors().collect()} == dict(enumerate(near.tolist()))
