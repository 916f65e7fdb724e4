"""The semantic cache against plain loops: random and adversarial logs, one key that holds nearly all, bad vectors."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.operators import monitor, semcache

SCHEMA = "request_id long, key string, vector array<double>, s long"
NAN, INF = float("nan"), float("inf")


def table(spark, rows, parts=5):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("request_id", "key", "vector", "timestamp_seconds(s) AS ts").repartition(parts)


def sound(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def served(rows, threshold, ttl):
    """One request after the other, each against all entries of its key."""
    live, out = {}, {}
    for q, key, v, s in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[3] is None, r[3] or 0, r[0])):
        best, similarity = None, 0.0
        if s is not None and sound(v):
            for e, w, t in live.get((key, len(v)), []):
                length = np.linalg.norm(v) * np.linalg.norm(w)
                score = round(float(np.dot(v, w) / (length or 1.0)), 6)
                if s - t <= ttl and score > similarity:
                    best, similarity = e, score
        hit = best is not None and similarity >= threshold
        out[q] = (key, "hit" if hit else "miss", similarity, best if hit else None)
        if not hit and s is not None and sound(v):
            live.setdefault((key, len(v)), []).append((q, v, s))
    return out


def got(df):
    return {r["request_id"]: (r["key"], r["cache"], round(r["similarity"], 6), r["entry_id"]) for r in df.collect()}


def turned(angle):
    return [math.cos(angle), math.sin(angle)]


def logs():
    rng = np.random.default_rng(8)
    near = rng.normal(size=(6, 5)).round(1)
    yield "random", [(k, f"r{rng.integers(2)}", (near[rng.integers(6)] + rng.normal(size=5) * 0.25).tolist(), int(rng.integers(0, 200))) for k in range(160)], 0.9, 60
    # one key, each request similar to the one before it alone: every second one is an entry
    yield "chain", [(k, "hot", turned(0.3 * k), k) for k in range(90)], math.cos(0.31), 1000
    # the same against the order of ids, and with a lifetime that cuts the chain
    yield "cut chain", [(90 - k, "hot", turned(0.3 * k), 7 * k) for k in range(90)], math.cos(0.31), 20
    yield "copies", [(k, "hot" if k % 20 else "cold", turned(0.001 * (k % 3)), k // 4) for k in range(150)], 0.999, 9
    yield "equal times", [(k, "hot", turned(0.2 * (k % 17)), k // 60) for k in range(120)], 0.95, 0


@pytest.mark.parametrize(("log", "cell"), [(0, 4096), (0, 11), (1, 11), (2, 11), (3, 4096), (3, 11), (4, 11)])
def test_replay_is_the_serial_one(spark, monkeypatch, log, cell):
    monkeypatch.setattr(semcache, "CELL", cell)
    name, rows, threshold, ttl = list(logs())[log]
    want = served(rows, threshold, ttl)
    assert got(semcache.replay(table(spark, rows), threshold, ttl)) == want, name
    assert {c for _, c, _, _ in want.values()} == {"hit", "miss"}


BAD = [None, [], [1.0, None], [NAN, 1.0], [1.0, INF], [-INF, 0.0]]


def test_bad_vectors_neither_hit_nor_hide_others(spark):
    rows = [(1, "k", [1.0, 0.0], 1), *((10 + k, "k", v, 2) for k, v in enumerate(BAD)), (30, "k", [1.0, 0.0], 3), (31, "k", [1.0, 0.0, 0.0], 3), (32, "k", [2.0, 0.0, 0.0], 4), (33, "k", [0.0, 0.0], 4), (34, "k", [1.0, 0.0], None), (35, None, [1.0, 0.0], 5)]
    want = served(rows, 0.9, 60)
    assert [want[q][1] for q in (1, 30, 31, 32, 33)] == ["miss", "hit", "miss", "hit", "miss"]
    assert got(semcache.replay(table(spark, rows), 0.9, 60)) == want
    found = {r["request_id"]: r["entry_id"] for r in semcache.history(table(spark, rows), 0.9, 60).collect()}
    assert {q: e for q, e in found.items() if e is not None} == {30: 1, 32: 31} and len(found) == len(rows)
    assert semcache.replay(table(spark, []), 0.9, 60).count() == 0


def test_a_hot_key_is_spread(spark, monkeypatch):
    """Tasks hold no more than two blocks of a key that has all requests, and every comparison is of two blocks."""
    monkeypatch.setattr(semcache, "CELL", 16)
    rows = [(k, "hot", turned(0.01 * k), k) for k in range(300)]
    blocks, kept = semcache.entries(table(spark, rows), 0.999, 50)
    sizes = [r["count"] for r in blocks.groupBy("block").count().collect()]
    assert len(sizes) > 15 and max(sizes) <= 16
    met = semcache._cells(blocks, blocks, 50_000_000, lambda a, b: a[["request_id"]].assign(n=len(a), m=len(b)), "request_id long, n long, m long").agg(F.max("n"), F.max("m")).first()
    assert max(met) <= 16
    assert {r["request_id"] for r in kept.collect()} == {q for q, r in served(rows, 0.999, 50).items() if r[1] == "miss"}


@pytest.fixture
def shared_log(spark):
    """Requests that share some fifty vectors, of which some are alike, some of another length, and some bad."""
    rng = np.random.default_rng(4)
    near = rng.normal(size=(8, 6)).round(1)
    vectors = [*((k, (near[k % 8] + rng.normal(size=6) * 0.1 * (k % 3)).tolist()) for k in range(48)), (48, [1.0, 2.0]), (49, [2.0, 4.1]), (50, [0.0] * 6), *((60 + k, v) for k, v in enumerate(BAD))]
    byid = dict(vectors)
    rows = [(k, None if k % 41 == 40 else "hot" if k % 9 else "cold", int(rng.choice(list(byid))), None if k % 53 == 52 else int(rng.integers(0, 300))) for k in range(500)]
    requests = spark.createDataFrame([*rows, (500, "hot", 99, 5)], "request_id long, key string, vec_id long, s long").selectExpr("request_id", "key", "vec_id", "timestamp_seconds(s) AS ts").repartition(5)
    return [(q, key, byid[v], s) for q, key, v, s in rows], requests, spark.createDataFrame(vectors, "vec_id long, vector array<double>").repartition(3)


@pytest.mark.parametrize(("cell", "step", "kept", "turn"), [(16384, 1024, 1 << 17, 16), (40, 7, 5, 2)])
def test_requests_that_share_vectors(spark, shared_log, monkeypatch, cell, step, kept, turn):
    for name, value in (("CELL", cell), ("SCAN", step), ("STEP", step), ("KEPT", kept), ("TURN", turn)):
        monkeypatch.setattr(semcache, name, value)
    rows, requests, vectors = shared_log
    want = served(rows, 0.97, 80)
    assert got(semcache.replay(requests, 0.97, 80, vectors)) == want
    assert len({e for _, _, _, e in want.values()}) > 20
    everything = {q: (s, e) for q, (_, _, s, e) in served_by_all(rows, 0.97, 80).items()}
    assert {r["request_id"]: (round(r["similarity"], 6), r["entry_id"]) for r in semcache.history(requests, 0.97, 80, vectors).collect()} == everything


def served_by_all(rows, threshold, ttl):
    """The same, where every request is an entry."""
    out = {}
    for q, key, v, s in rows:
        best = (0.0, 0, None)
        if key is not None and s is not None and sound(v):
            for e, other, w, t in rows:
                if other == key and t is not None and sound(w) and len(w) == len(v) and (t, e) < (s, q) and s - t <= ttl:
                    length = np.linalg.norm(v) * np.linalg.norm(w)
                    score = round(float(np.dot(v, w) / (length or 1.0)), 6)
                    best = max(best, (score, -t, -e)) if best[2] is not None or score > 0 else best
        out[q] = (key, "", best[0], -best[2] if best[2] is not None and best[0] >= threshold else None)
    return out


def test_no_request_is_copied_to_meet_another(spark, monkeypatch):
    """All are live for each other in many blocks; nothing is shuffled after they are stored in order, with or without vectors of their own."""
    monkeypatch.setattr(semcache, "CELL", 16)
    rows = [(k, "hot", turned(0.01 * (k % 50)), k) for k in range(400)]
    own = semcache.history(table(spark, rows), 0.9, 1000)
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
    assert own.filter("hit").count() == 399
    replayed = semcache.replay(table(spark, rows), 0.9, 1000)
    assert "Exchange" not in replayed._jdf.queryExecution().executedPlan().toString()
    assert got(replayed) == served(rows, 0.9, 1000)


def test_a_cached_run_shuffles_for_its_own_join_alone(spark, monkeypatch):
    monkeypatch.setattr(semcache, "CELL", 16)
    rows = [(k, "hot", turned(0.01 * (k % 50)), k) for k in range(200)]
    runs = spark.createDataFrame([(k, f"a{k}", 10.0 * k, 1.0) for k in range(200)], "request_id long, answer string, t_total_ms double, cost_usd double")
    run = monitor.cached_run(semcache.replay(table(spark, rows), 0.9, 100), runs)
    assert run._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2
    want = {q: (c, f"a{e if c == 'hit' else q}", 10.0 * e if c == "hit" else 0.0) for q, (_, c, _, e) in served(rows, 0.9, 100).items()}
    assert {r["request_id"]: (r["cache"], r["answer"], r["saved_ms"]) for r in run.collect()} == want
