"""Reranking: a scorer gives hits new scores; ties keep the earlier order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import rank_list, tokenize
from siftwell.functions.vectors import sound
from siftwell.operators.filters import top

Scorer = Callable[[list[str], list[str]], "np.ndarray"]
#: Fixed value: characters of a passage that a listwise model sees.
PASSAGE = 800


_makers: dict[str, Callable[[], Scorer]] = {}


def register(name: str, make: Callable[[], Scorer]) -> None:
    """Names a scorer of pairs; `make` runs when it is first asked for."""
    _makers[name] = make
    scorer.cache_clear()


@cache
def scorer(name: str) -> Scorer:
    if name not in _makers:
        raise ValueError(f"no scorer of that name: {name}; known: {', '.join(sorted(_makers)) or 'none'}")
    return _makers[name]()


def rescored(hits: DataFrame, top_k: int, name: str) -> DataFrame:
    """hits with new_score: the best top_k of each query, with pre_rank, pre_score and reranker."""
    rows = hits.withColumnsRenamed({"rank": "pre_rank", "score": "pre_score"})
    ranked = top(rows, top_k, "qid", F.desc("new_score"), "pre_rank")
    return ranked.select("qid", "chunk_id", F.col("new_score").alias("score"), "rank", F.lit("rerank").alias("source"), "pre_rank", "pre_score", F.lit(name).alias("reranker"))


def texts(hits: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    return hits.select("qid", "chunk_id", "score", "rank").join(queries.select("qid", "query"), "qid").join(chunks.select("chunk_id", "text"), "chunk_id")


def lexical(hits: DataFrame, queries: DataFrame, chunks: DataFrame, top_k: int = 5) -> DataFrame:
    """By the share of the query's distinct tokens that the chunk has."""
    q = F.array_distinct(tokenize(F.col("query")))
    share = F.size(F.array_intersect(q, tokenize(F.col("text")))) / F.greatest(F.size(q), F.lit(1))
    return rescored(texts(hits, queries, chunks).withColumn("new_score", F.round(share, 6)), top_k, "lexical")


def paired(hits: DataFrame, queries: DataFrame, chunks: DataFrame, scorer: Scorer, top_k: int = 5, name: str = "pairs") -> DataFrame:
    """By a model that scores (query, text) pairs, loaded once a worker."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in batches:
            yield pd.Series(np.asarray(scorer(q.tolist(), t.tolist()), float))

    return rescored(texts(hits, queries, chunks).withColumn("new_score", score("query", "text")), top_k, name)


def max_sim(hits: DataFrame, query_vectors: DataFrame, chunk_vectors: DataFrame, top_k: int = 5) -> DataFrame:
    """Late interaction: for each query token vector its best dot product with a chunk's token vectors, summed.

    query_vectors (qid, token, vector) and chunk_vectors (chunk_id, vector) have a row a token; chunks without score 0.
    Tokens whose vectors are null, empty, or hold null or non-finite components don't count; vectors of different lengths
    are not compared.  A query's and a chunk's tokens are gathered, so a hit is one row and one matrix product.
    """
    size = F.size("vector").alias("size")
    asked = query_vectors.filter(sound(F.col("vector"))).groupBy("qid", size).agg(F.collect_list("vector").alias("q"))
    own = chunk_vectors.filter(sound(F.col("vector"))).groupBy("chunk_id", size).agg(F.collect_list("vector").alias("c"))
    rows = hits.select("qid", "chunk_id").join(asked, "qid").join(own, ["chunk_id", "size"]).select("qid", "chunk_id", "q", "c")
    matrix = lambda vectors: vectors.values.flatten().to_numpy().reshape(len(vectors.values), -1).astype(float)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [(matrix(q) @ matrix(c).T).max(1).sum() for q, c in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sums, pa.float64())], ["qid", "chunk_id", "s"])

    kinds = dict(rows.dtypes)
    sums = rows.mapInArrow(products, f"qid {kinds['qid']}, chunk_id {kinds['chunk_id']}, s double")
    sums = sums.groupBy("qid", "chunk_id").agg(F.round(F.sum("s"), 6).alias("new_score"))
    return rescored(hits.join(sums, ["qid", "chunk_id"], "left").withColumn("new_score", F.coalesce("new_score", F.lit(0.0))), top_k, "maxsim")


def listwise(hits: DataFrame, replies: DataFrame, top_k: int = 5) -> DataFrame:
    """By a model's reply (qid, raw) that lists passage numbers, best first.

    The n-th named of all passages scores count - n; unnamed ones 0; without a list the order stays.
    """
    order = replies.select("qid", rank_list(F.col("raw")).alias("order"))
    count = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    named = F.array_position("order", F.col("rank").cast("int"))
    # of a passage named twice the last place counts
    last = F.size("order") + 1 - F.array_position(F.reverse("order"), F.col("rank").cast("int"))
    score = F.when(F.col("order").isNull(), F.col("n") + 1 - F.col("rank")).when(named > 0, F.col("n") + 1 - last).otherwise(0)
    return rescored(hits.join(count, "qid").join(order, "qid", "left").withColumn("new_score", score.cast("double")), top_k, "listwise")


def passages(hits: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, query, passages): the numbered passages that a listwise model is shown."""
    rows = texts(hits, queries, chunks).withColumn("p", F.concat(F.lit("["), "rank", F.lit("] "), F.substring("text", 1, PASSAGE)))
    return rows.groupBy("qid", "query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "p"))), lambda x: x["p"]), "\n\n").alias("passages"))
