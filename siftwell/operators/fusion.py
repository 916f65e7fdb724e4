"""Rank fusion over unions of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.filters import top


def rrf(hits: DataFrame, top_k: int = 5, k: float = 60, base: int = 1, by: str = "source") -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank), ranks counted from `base`; ties go to the smaller chunk_id.

    hits holds the rankings to fuse, told apart by `by`; a chunk counts once in each.
    """
    sums = hits.groupBy("qid", "chunk_id").agg(F.round(F.sum(1 / (F.col("rank") - 1 + base + F.lit(float(k)))), 9).alias("score"))
    return top(sums, top_k, "qid", F.desc("score"), "chunk_id").select("qid", "chunk_id", "score", "rank", F.lit("hybrid").alias("source"))


def dbsf(hits: DataFrame, top_k: int = 5) -> DataFrame:
    """Distribution-based score fusion: scores of a ranking from mean - 3 to mean + 3 deviations go to [0, 1], then sum.

    A ranking of one hit, or of equal scores, gives 0.5.
    """
    w = Window.partitionBy("qid", "source")
    mean, sd = F.avg("score").over(w), F.stddev_samp("score").over(w)
    scaled = F.when(sd.isNull() | (sd == 0), 0.5).otherwise((F.col("score") - mean) / (6 * sd) + 0.5)
    scaled = F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))
    sums = hits.withColumn("scaled", scaled).groupBy("qid", "chunk_id").agg(F.round(F.sum("scaled"), 6).alias("score"))
    return top(sums, top_k, "qid", F.desc("score"), "chunk_id").select("qid", "chunk_id", "score", "rank", F.lit("hybrid").alias("source"))


def multi_query(hits: DataFrame, top_k: int) -> DataFrame:
    """Fuses the rankings of a query's variants (column variant); a query with one variant keeps its ranking and scores."""
    count = F.count_distinct("variant")
    several = hits.groupBy("qid").agg(count.alias("variants"))
    marked = hits.join(several, "qid")
    single = top(marked.filter("variants = 1").drop("rank"), top_k, "qid", F.desc("score"), "chunk_id")
    return single.select("qid", "chunk_id", "score", "rank", "source").unionByName(rrf(marked.filter("variants > 1"), top_k, by="variant"))


def attribution(fused: DataFrame, hits: DataFrame) -> DataFrame:
    """For each fused hit its rank in the dense and in the sparse ranking; null where it is in none."""
    own = hits.groupBy("qid", "chunk_id").agg(*(F.max(F.when(F.col("source") == s, F.col("rank"))).alias(f"{s}_rank") for s in ("dense", "sparse")))
    return fused.join(own, ["qid", "chunk_id"], "left").select("qid", "chunk_id", "score", "rank", "dense_rank", "sparse_rank")
