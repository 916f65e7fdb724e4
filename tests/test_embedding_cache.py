"""The embedding cache: each text is embedded once, and the cache itself is never shuffled."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftwell.functions import vectors as vec
from siftwell.sources import embedding_cache
from siftwell.sources.embedding_cache import EmbeddingCache


@pytest.fixture
def sized():
    return lambda texts: np.array([[len(t), 1.0] for t in texts])


def test_texts_are_embedded_once(spark, tmp_path, sized):
    rows = spark.createDataFrame([(k, f"text {k % 40}" if k % 11 else None) for k in range(200)], "id long, text string").repartition(4)
    cache = EmbeddingCache(spark, f"file://{tmp_path}/cache", 5)
    wanted = {r["id"]: [float(len(r["text"] or "")), 1.0] for r in rows.collect()}
    calls = []
    for turn in range(3):
        found, fresh = cache.embed(rows.filter("id < 100") if turn == 0 else rows, "m", "id", "text", sized)
        got = {r["id"]: list(r["vector"]) for r in found.collect()}
        assert got == {k: v for k, v in wanted.items() if turn or k < 100}
        calls.append(fresh.count())
        cache.append(fresh)
    assert calls == [rows.filter("id < 100").select(F.coalesce("text", F.lit(""))).distinct().count(), 0, 0] and cache.rows.count() == calls[0]
    other, _ = EmbeddingCache(spark, f"file://{tmp_path}/cache", 5).embed(rows, "other model", "id", "text", lambda texts: sized(texts) + 1)
    assert {r["id"]: r["vector"][1] for r in other.collect()}[1] == 2.0


def test_a_null_text_is_embedded_and_a_session_finds_the_rows(spark, tmp_path, sized):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "a")], "id long, text string")
    _, fresh = EmbeddingCache(spark, f"file://{tmp_path}/cache", 3).embed(rows, "m", "id", "text", sized)
    assert fresh.count() == 2
    EmbeddingCache(spark, f"file://{tmp_path}/cache", 3).append(fresh)
    again = EmbeddingCache(spark.newSession(), f"file://{tmp_path}/cache", 3)
    keys = rows.select(vec.cache_key("m", F.coalesce("text", F.lit(""))).alias("k")).distinct()
    assert again.rows.count() == 2 and again.found(again.spark.createDataFrame(keys.toPandas())).count() == 2


def test_the_cache_is_not_shuffled_and_misses_do_not_reach_it(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(embedding_cache, "FILTERED", 50)
    cache = EmbeddingCache(spark, f"file://{tmp_path}/cache", 4)
    known = spark.range(600).select(F.sha1(F.col("id").cast("string")).alias("k"), F.array(F.lit(1.0)).alias("v"))
    cache.append(known)
    asked = spark.range(400, 3000).select(F.sha1(F.col("id").cast("string")).alias("k"))
    found = cache.found(asked)
    assert {r["k"] for r in found.collect()} == {r["k"] for r in known.join(asked, "k").collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = plan[: plan.rindex("FileScan parquet spark_catalog")].splitlines()
    assert "Bucketed: true" in plan and not any("Exchange" in line for line in scan[scan.index(next(x for x in scan if "SortMergeJoin" in x)) + 1 :][-3:])
    passed = cache.maybe(asked).count()
    assert 200 <= passed < 200 + 0.05 * 2400


def test_filters_keep_what_they_hold():
    keys = pd.Series([f"{k:040x}" for k in range(1000, 4000)])
    data = embedding_cache.filtered(keys)
    assert embedding_cache.passing(keys, [data]).all() and embedding_cache.passing(keys, [embedding_cache.filtered(keys[:10]), data]).all()
    import hashlib

    others = pd.Series([hashlib.sha1(str(k).encode()).hexdigest() for k in range(4000)])
    held = embedding_cache.filtered(others[:2000])
    assert embedding_cache.passing(others[2000:], [held]).mean() < 0.03


@pytest.mark.parametrize("n", [0, 1])
def test_small_appends(spark, tmp_path, n):
    cache = EmbeddingCache(spark, f"file://{tmp_path}/cache", 3)
    cache.append(spark.range(n).select(F.sha1(F.lit("a")).alias("k"), F.array(F.lit(1.0)).alias("v")))
    assert cache.found(spark.range(1).select(F.sha1(F.lit("a")).alias("k"))).count() == n
