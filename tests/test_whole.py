"""Queries over whole tables against brute force: no id prefix, no sample."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from compare import rows

from siftwell.functions import vectors as vec
from siftwell.operators import chunking, dense, evaluate, monitor, semcache
from siftwell.plans import catalogue

N, DIM = 437, 6


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    return rng.normal(size=(N, DIM)).round(2).astype(np.float32), rng.integers(0, 5, N)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory, vectors):
    folder = tmp_path_factory.mktemp("whole")
    rows = [(k, v.tolist(), int(label)) for k, (v, label) in enumerate(zip(*vectors, strict=True))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def cosines(v):
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    return u @ u.T


def nearest(v, k, allowed=None):
    """(qid, chunk_id, rank): the best for each id divisible by 100."""
    scores, ids = cosines(v).round(6), np.arange(len(v)) if allowed is None else np.flatnonzero(allowed)
    return [(q, int(c), r) for q in range(0, len(v), 100) for r, c in enumerate(ids[np.lexsort((ids, -scores[q, ids]))][:k], 1)]


def test_dense_topk(spark, tables, vectors):
    v, label = vectors
    for name, allowed in (("dense_topk", None), ("dense_topk_filtered", np.isin(label, (1, 3)))):
        got = catalogue.QUERIES[name](spark, tables).collect()
        assert sorted((r["qid"], r["chunk_id"], r["rank"]) for r in got) == sorted(nearest(v, 10, allowed))


def test_average_precision(spark, tables, vectors):
    v, label = vectors
    want = {}
    for q in range(0, N, 100):
        rel = [label[c] == label[q] for p, c, _ in nearest(v, 10) if p == q]
        want[q] = round(sum(sum(rel[: k + 1]) / (k + 1) for k, r in enumerate(rel) if r) / max(sum(rel), 1), 6)
    assert dict(map(tuple, catalogue.QUERIES["average_precision"](spark, tables).collect())) == pytest.approx(want)


def test_maxsim(spark, tables, vectors):
    v, want = vectors[0].astype(float), {}
    for q in range(0, N, 100):
        found = [c for p, c, _ in nearest(vectors[0], 20) if p == q]
        sums = [(v[q : q + 100] @ v[c // 10 * 10 : c // 10 * 10 + 10].T).max(1).sum().round(6) for c in found]
        for k, at in enumerate(sorted(range(20), key=lambda i: (-sums[i], i))[:5], 1):
            want[q, k] = (found[at], at + 1, pytest.approx(sums[at], abs=2e-6))
    got = catalogue.QUERIES["maxsim"](spark, tables).collect()
    assert {(r["qid"], r["rank"]): (r["chunk_id"], r["pre_rank"], r["score"]) for r in got} == want


def test_answer_relevancy(spark, tables, vectors):
    s = cosines(vectors[0])
    want = {q: round(s[q, q + 1 : q + 4].mean(), 6) if q + 1 < N else 0.0 for q in range(N)}
    assert dict(map(tuple, catalogue.QUERIES["answer_relevancy"](spark, tables).collect())) == pytest.approx(want, abs=2e-6)


def test_answer_relevancy_of_refusals(spark):
    answers = spark.createDataFrame([(1, [1.0, 0.0], False), (2, [1.0, 0.0], True), (3, [1.0, 0.0], False)], "qid long, vector array<double>, refused boolean")
    regenerated = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "qid long, vector array<double>")
    assert dict(map(tuple, evaluate.answer_relevancy(answers, regenerated).collect())) == {1: 0.5, 2: 0.0, 3: 0.0}


@pytest.mark.parametrize("cell", [4096, 7])
def test_cache_history(spark, vectors, monkeypatch, cell):
    monkeypatch.setattr(semcache, "CELL", cell)
    v, rng = vectors[0][:150].copy(), np.random.default_rng(3)
    at, key = rng.integers(0, 300, 150), rng.integers(0, 2, 150)  # equal times occur
    v[100:120] = v[:20]  # equal similarities
    rows = [(k, f"r{key[k]}", v[k].tolist(), int(at[k])) for k in range(150)]
    requests = spark.createDataFrame(rows, "request_id long, key string, vector array<float>, s long").selectExpr("request_id", "key", "vector", "timestamp_seconds(s) AS ts")
    scores, want = cosines(v).round(6), {}
    for q in range(150):
        live = [e for e in range(150) if key[e] == key[q] and at[q] - 60 <= at[e] and (at[e], e) < (at[q], q) and scores[q, e] > 0]
        e = min(live, key=lambda e: (-scores[q, e], at[e], e), default=None)
        want[q] = (None, 0.0, False) if e is None else (e if scores[q, e] >= 0.8 else None, scores[q, e], scores[q, e] >= 0.8)
    got = {r["request_id"]: (r["entry_id"], r["similarity"], r["hit"]) for r in semcache.history(requests, threshold=0.8, ttl=60).collect()}
    assert got == want
    # every event is looked up
    assert any(hit for _, _, hit in got.values()) and len(got) == 150


def test_dense_search_beyond_one_scan(spark, tables, vectors, monkeypatch):
    monkeypatch.setattr(vec, "QUERIES", 100)
    v = spark.read.parquet(f"{tables}/embeddings.parquet").selectExpr("vec_id AS chunk_id", "embedding AS vector")
    got = dense.search(v.withColumnRenamed("chunk_id", "qid"), v, 5).collect()
    scores = cosines(vectors[0]).round(6)
    assert sorted((r["qid"], r["rank"], r["chunk_id"]) for r in got) == [(q, k, int(c)) for q in range(N) for k, c in enumerate(np.lexsort((np.arange(N), -scores[q]))[:5], 1)]


def test_cached_runs_against_a_plain_replay(spark, vectors):
    """In order of time a request takes the nearest live entry of its key, or becomes one itself."""
    v, rng = vectors[0][:200].copy(), np.random.default_rng(9)
    v[120:160] = v[:40]
    at, key = rng.integers(0, 400, 200), rng.integers(0, 3, 200)
    rows = [(k, f"r{key[k]}", v[k].tolist(), int(at[k])) for k in range(200)]
    requests = spark.createDataFrame(rows, "request_id long, key string, vector array<float>, s long").selectExpr("request_id", "key", "vector", "timestamp_seconds(s) AS ts").repartition(3)
    scores, live, want = cosines(v).round(6), {}, {}
    for q in sorted(range(200), key=lambda k: (at[k], k)):
        entries = [e for e in live.get(key[q], []) if at[q] - at[e] <= 90]
        best = max(entries, key=lambda e: (scores[q, e], -entries.index(e)), default=None)
        hit = best is not None and scores[q, best] >= 0.8
        want[q] = ("hit" if hit else "miss", int(best) if hit else None)
        live[key[q]] = entries if hit else [*entries, q]
    replayed = semcache.replay(requests, 0.8, 90)
    assert {r["request_id"]: (r["cache"], r["entry_id"]) for r in replayed.collect()} == want
    runs = requests.selectExpr("request_id", "concat('a', request_id) AS answer", "10.0D * request_id AS t_total_ms", "1.0D AS cost_usd")
    got = {r["request_id"]: (r["answer"], r["cost_usd"], r["saved_ms"]) for r in monitor.cached_run(replayed, runs).collect()}
    assert got == {q: (f"a{e}", 0.0, 10.0 * e) if c == "hit" else (f"a{q}", 1.0, 0.0) for q, (c, e) in want.items()}
    assert 10 < sum(c == "hit" for c, _ in want.values()) < 190


def test_chunks_cover_their_texts(spark):
    """Pieces of each splitter are stretches of the text, in order, bounded, and leave out nothing but blanks."""
    import random

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 9)))
    texts = ["".join(word() + rng.choice([" ", " ", " ", "\n", "\n\n"]) for _ in range(rng.randint(0, 900))) for _ in range(12)]
    docs = spark.createDataFrame([(k, f"T{k}", t) for k, t in enumerate(texts)], "doc_id long, title string, text string")
    children, parents = chunking.parent_child(docs, 700, 150, 20)
    for chunks, size, lead in ((chunking.fixed(docs, 300, 50), 300, False), (chunking.by_headings(docs, 700), 700, True), (children, 150, True)):
        found = {}
        for r in chunks.orderBy("doc_id", "chunk_index", *(["child_index"] if "child_index" in chunks.columns else [])).collect():
            body = r["text"].split("\n", 1)[1] if lead else r["text"]
            assert len(body) <= size and body.strip()
            found.setdefault(r["doc_id"], []).append(body)
        for k, text in enumerate(texts):
            squeezed, upto = "".join(text.split()), 0
            for body in found.get(k, []):
                piece = "".join(body.split())
                at = max(a for a in range(max(0, upto - 120), upto + 1) if squeezed.startswith(piece, a))
                upto = max(upto, at + len(piece))
            assert upto == len(squeezed)


GATE = ["ref_rate", "cand_rate", "n_regressed", "regressed", "n_missing", "passed"]


def test_regression_gate_names_each_lost_item(spark):
    """Lost items come back as rows, each with the gate's figures; an item that the candidate lacks or wins isn't lost."""
    runs = lambda hits: spark.createDataFrame(list(hits.items()), "id long, hit boolean")
    reference = runs({1: True, 2: True, 3: False, 4: True, 5: True, 6: True})
    got = evaluate.regression_gate(reference, runs({1: True, 2: False, 3: True, 4: False, 5: True}))
    assert got.columns == GATE
    assert sorted(map(tuple, got.collect())) == [(0.8, 0.6, 2, k, 1, False) for k in (2, 4)]
    assert list(map(tuple, evaluate.regression_gate(reference, reference).collect())) == [(0.833333, 0.833333, 0, None, 0, True)]
    many = {k: True for k in range(3000)}
    assert {r["regressed"] for r in evaluate.regression_gate(runs(many), runs(dict.fromkeys(many, False))).collect()} == set(many)


def test_regression_gate_query_names_lost_items(spark, tmp_path):
    """Sources of items 0 and 20 are the fifth by words and the last by vectors, that of item 10 is near by both; item 30 has none."""
    passages = {k: " ".join(f"{w}{'xyz'[k // 10]}" for w in ("amber", "birch", "cedar", "dune", "ember", "fjord", "grove")) for k in (0, 10, 20)}
    at, texts, vectors = np.eye(4), {}, {}
    for k in range(40):
        own, nth = k // 10, k % 10
        words = passages[k - nth].split() if own < 3 else ["nothing"]
        texts[k] = f"filler{k} other{k}"
        if 1 <= nth <= 4:
            texts[k] = " ".join(words[::-1] * 2)
        elif nth == 5 and own < 3:
            texts[k] = passages[k - nth] + "".join(f" more{k}n{i}" for i in range(60))
        vectors[k] = (-at[own] if nth == 5 and own != 1 else at[own] + (nth + 1) * 0.01 * at[(own + 1) % 4]).tolist()
    spark.createDataFrame([(k, t, "en", "web") for k, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, v, 0) for k, v in vectors.items()], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([*passages.items(), (30, "no document has these seven plain words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = catalogue.regression_gate(spark, str(tmp_path))
    assert sorted(map(tuple, got.select(GATE).collect())) == [(0.75, 0.25, 2, k, 0, False) for k in (0, 20)]
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.sql(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    assert rows(got.toPandas()) == rows(con.sql(catalogue.ORACLE_SQL["regression_gate"]).df())
