"""The clustered index finds what a scan of all vectors finds, and reads few of them."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.operators import dense, vector_index
from siftwell.operators.vector_index import VectorIndex

VECTORS = "chunk_id long, vector array<double>"


def rows(df):
    return sorted((r["qid"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())


def grouped(n, dim, groups, noise, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dim))
    return [(k, (middle[k % groups] + rng.normal(size=dim) * noise).tolist()) for k in range(n)]


@pytest.mark.parametrize(("n", "groups", "noise", "piece"), [(700, 9, 0.1, 4096), (200, 200, 0.0, 40), (400, 1, 0.0, 120), (5, 2, 0.5, 2)])
def test_search_is_exact(spark, tmp_path, monkeypatch, n, groups, noise, piece):
    monkeypatch.setattr(vector_index, "PIECE", piece)
    monkeypatch.setattr(vector_index, "ASKED", 15)
    data = grouped(n, 6, groups, noise)
    data += [(n + 1, [0.0] * 6), (n + 2, None), (n + 3, []), (n + 4, [1.0, None] * 3), (n + 5, [float("nan")] * 6), (n + 6, [1.0, 2.0]), (n + 7, [float("inf")] * 6)]
    items = spark.createDataFrame(data, VECTORS).repartition(3)
    asked = items.filter("chunk_id % 29 = 0 OR vector IS NULL OR size(vector) < 6 OR chunk_id > 699").withColumnRenamed("chunk_id", "qid")
    index = VectorIndex.build(items, f"file://{tmp_path}/index")
    fitting = asked.filter("size(vector) = 6")
    assert rows(index.search(asked, 4)) == rows(dense.search(fitting, items, 4))
    allowed = items.filter("chunk_id % 5 = 1")
    assert rows(index.search(asked, 4, allowed)) == rows(dense.search(fitting, allowed, 4))
    assert rows(index.search(asked, n + 50)) == rows(dense.search(fitting, items, n + 50))


def test_most_clusters_are_not_read(spark, tmp_path):
    data = grouped(3000, 8, 40, 0.05, seed=3)
    items = spark.createDataFrame(data, VECTORS)
    index = VectorIndex.build(items, f"file://{tmp_path}/index")
    asked = items.filter("chunk_id < 3").withColumnRenamed("chunk_id", "qid").withColumn("block", F.lit(0))
    known = spark.sparkContext.broadcast(index._bounds())
    first = vector_index._chosen(asked, known, 10)
    worst = dense.search(asked, items, 10).filter("rank = 10").selectExpr("qid", "score AS worst")
    rest = vector_index._chosen(asked.join(worst, "qid"), known, 10, again=True)
    read = first.unionByName(rest).join(index.rings, ["cluster", "ring"]).groupBy("qid").agg(F.sum("n").alias("n")).collect()
    assert len(read) == 3 and all(10 <= r["n"] < 300 for r in read)  # of 3000
    folders = {p.name for p in Path(tmp_path, "index", "vectors").glob("cluster=*")}
    wanted = [r[0] for r in first.select("cluster").distinct().collect()]
    files = index.vectors.filter(F.col("cluster").isin(wanted))
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert len(folders) > 20 and "PartitionFilters: [cluster" in plan and 0 < files.count() < 600


def test_an_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], VECTORS)
    index = VectorIndex.build(none, f"file://{tmp_path}/index")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, vector array<double>")
    assert index.search(asked, 3).count() == 0
    index = VectorIndex.build(spark.createDataFrame([(1, [0.0, 0.0])], VECTORS), f"file://{tmp_path}/zero")
    assert rows(index.search(asked, 3)) == [(1, 1, 1, 0.0)]
