"""BM25 over tables: postings, corpus statistics, weights, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import tokenize
from siftwell.operators.filters import Filter, top
from siftwell.sources.scratch import stored

K1, B = 1.2, 0.75


def profile(chunks: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(chunk_id, dl, term, tf), stored: how often a chunk has each term; of `terms` only, if given.

    All that BM25 needs comes from this one pass over the texts.  Tokens that are no term, and one more a chunk, go
    under a null term, so each chunk has exactly one such row, which counts it.
    """
    found = chunks.select("chunk_id", tokenize(F.col("text")).alias("tokens"))
    one_more = F.concat("tokens", F.array(F.lit(None).cast("string")))
    # explode would have the planner add a filter that tokenises once more
    rows = found.select("chunk_id", F.size("tokens").alias("dl"), F.explode_outer(one_more).alias("term"))
    if terms is not None:
        known = terms.select("term", F.lit(True).alias("asked")).distinct()
        rows = rows.join(known, "term", "left").withColumn("term", F.when(F.col("asked"), F.col("term")))
    return stored(rows.groupBy("chunk_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")), "profile")


def corpus_stats(profiled: DataFrame) -> DataFrame:
    """One row: n chunks and avgdl (1.0 for an empty corpus)."""
    return profiled.filter("term is null").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"))


def postings(profiled: DataFrame) -> DataFrame:
    return profiled.filter("term is not null")


def weight(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def doc_weights(profiled: DataFrame) -> DataFrame:
    """(chunk_id, term, tf, w): sparse document vectors."""
    rows = postings(profiled).crossJoin(F.broadcast(corpus_stats(profiled)))  # one row
    return rows.select("chunk_id", "term", "tf", weight(F.col("tf"), F.col("dl"), F.col("avgdl")).alias("w"))


def explain(profiled: DataFrame) -> DataFrame:
    """doc_weights with three digits, numbered by falling weight within each chunk."""
    rows = doc_weights(profiled).select("chunk_id", "term", F.round("w", 3).alias("w"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("w"), "term")))


def term_stats(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term): the set of a query's tokens; how often it has one doesn't matter."""
    return queries.select("qid", F.explode(F.array_distinct(tokenize(F.col("query")))).alias("term"))


def scores(asked: DataFrame, posted: DataFrame, spread: DataFrame, stats: DataFrame) -> DataFrame:
    """(qid, chunk_id, score) from query terms, postings, document frequencies and the one row of statistics.

    Postings are dealt by chunk, so that sums and the first cut of a ranking need no shuffle where Spark finds the
    query terms small enough to send to all tasks.
    """
    known = stored(asked.join(spread, "term"), "asked")
    dealt = posted.repartition(int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk_id")
    rows = dealt.join(known, "term").crossJoin(F.broadcast(stats))  # one row
    s = weight(F.col("tf"), F.col("dl"), F.col("avgdl")) * idf(F.col("n"), F.col("df"))
    return rows.groupBy("qid", "chunk_id").agg(F.round(F.sum(s), 6).alias("score"))


def ranked(sums: DataFrame, k: int) -> DataFrame:
    return top(sums, k, "qid", F.desc("score"), "chunk_id").select("qid", "chunk_id", "score", "rank", F.lit("sparse").alias("source"))


def search(queries: DataFrame, chunks: DataFrame, k: int, where: Filter | None = None) -> DataFrame:
    """hits: the k best chunks of each query (qid, query) by BM25; chunks without a query term are no hits.

    Statistics are those of all chunks; the filter bears on candidates only, before the ranking.  Chunks are tokenised
    on the fly; for many batches of queries over one corpus, see block_index.
    """
    asked = query_terms(queries)
    profiled = profile(chunks, asked)
    posted = postings(profiled)
    allowed = posted if where is None else posted.join(where(chunks).select("chunk_id"), "chunk_id", "left_semi")
    return ranked(scores(asked, allowed, term_stats(posted), corpus_stats(profiled)), k)
