"""Rows that share a doc_id but not their text."""

from __future__ import annotations

import random

import brute
import corpus_pipeline


def test_texts_of_one_doc_id_stay(spark):
    rng = random.Random(4)
    a, b, c, d = (brute.prose(rng, 80) for _ in range(4))
    near = a.split()
    near[79] = "changed"
    rows = [(1, a), (2, " ".join(near)), (2, b), (2, b), (3, c), (3, d), (3, a), (4, None), (4, ""), (5, ""), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    got = sorted(((i, t or "") for i, t in got), key=str)
    assert got == sorted([(1, a), (2, b), (3, c), (3, d), (4, ""), (5, ""), (None, a)], key=str)
