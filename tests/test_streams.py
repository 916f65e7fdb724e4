"""The semantic cache on a stream: as in a batch, across restarts, and without leftovers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.operators import semcache
from siftwell.streaming import stateful


@pytest.fixture
def store(spark):
    for name, value in stateful.STORE.items():
        spark.conf.set(name, value)
    yield
    for name in stateful.STORE:
        spark.conf.unset(name)


def requests(spark, rows):
    return spark.createDataFrame(rows, "request_id long, key string, s double, vector array<double>").selectExpr("request_id", "key", "timestamp_seconds(s + 1000000000) AS ts", "vector")


def ran(spark, df, tmp_path, files=None):
    """Rows that the stream has given so far; each call goes on from the checkpoint of the one before."""
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stateful.replay_stream(stream, 0.9, 600, "1 minute").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
    q = out.outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))


def test_a_stream_equals_batch_and_goes_on_from_its_checkpoint(spark, store, tmp_path):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(4, 8))
    rows = [(k, f"r{k % 2}", float(k * 60), (base[k % 4] + rng.normal(size=8) * 0.01).tolist()) for k in range(60)]
    rows[20:23] = [(20, "r0", 1200.0, None), (21, "r1", 1260.0, [float("nan")] * 8), (22, "r0", 1320.0, [1.0, 2.0])]
    df = requests(spark, rows)
    want = sorted(map(tuple, semcache.replay(df, 0.9, 600).collect()))
    assert {r[2] for r in want} == {"hit", "miss"}
    got = None
    for parts in ((0, 1), (2,)):
        for part in parts:
            df.filter(f"request_id div 20 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = ran(spark, df, tmp_path)
    assert got == want


def test_entries_end_without_another_request_of_their_key(spark, store, tmp_path):
    early = requests(spark, [(1, "idle", 0.0, [1.0, 0.0]), (2, "idle", 5.0, [0.0, 1.0]), (3, "busy", 6.0, [1.0, 0.0])])
    later = [requests(spark, [(10 + k, "busy", 10_000.0 + k, [1.0, 0.0])]) for k in range(2)]
    early.coalesce(1).write.parquet(str(tmp_path / "in"))
    ran(spark, early, tmp_path)
    state = lambda: spark.read.format("statestore").option("stateVarName", "entries").load(str(tmp_path / "c"))
    keys = lambda: sorted(r[0] for r in state().select(F.col("key.key")).collect())
    assert keys() == ["busy", "idle", "idle"]
    for df in later:
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ran(spark, early, tmp_path)
    assert keys() == ["busy"]
