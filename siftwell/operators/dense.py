"""Dense search by cosine, exact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.vectors import dense_scores
from siftwell.operators.filters import Filter, top


def search(queries: DataFrame, vectors: DataFrame, k: int, where: Filter | None = None) -> DataFrame:
    """hits: the k nearest of vectors (chunk_id, vector and, for a filter, metadata) to each query (qid, vector).

    The filter comes first.  Scores are rounded to six digits, ties go to the smaller chunk_id.
    """
    if where is not None:
        vectors = where(vectors)
    items = vectors.select(F.col("chunk_id").alias("item_id"), "vector")
    scored = dense_scores(queries, items, k).withColumnRenamed("item_id", "chunk_id")
    return top(scored, k, "qid", F.desc("score"), "chunk_id").select("qid", "chunk_id", "score", "rank", F.lit("dense").alias("source"))
