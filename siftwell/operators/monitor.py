"""Request logs: flattening, key figures, alerts, costs; runs behind a cache; comparing indexes."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators.evaluate import IN_MEMORY, quantiles

# USD a million tokens (input, output, embedding), tokens of an embedded query; alert limits.
PRICE_IN, PRICE_OUT, PRICE_EMBED, QUERY_TOKENS = 0.20, 1.20, 0.02, 20
NO_ANSWER_RATE, P95_MS, LOW_SHARE, RECENT = 0.20, 4000, 0.30, 20
KPIS = ("requests", "p50_total_ms", "p95_total_ms", "p95_retrieval_ms", "p95_generation_ms", "no_answer_rate", "avg_input_tokens", "cost_usd", "cost_per_request")
#: Requests without a filter must not share answers with those of public access, so their key is no role's.
UNFILTERED = "<unfiltered>"


def flattened(runs: DataFrame, *more: str) -> DataFrame:
    """The twelve columns of a request log, from runs with a trace struct; what a trace lacks is 0 or `-`.  Columns in `more` come first."""
    t = lambda name: F.coalesce(F.col(f"trace.{name}"), F.lit(0))
    ms = [F.bround(t(c).cast("double")).cast("int").alias(c) for c in ("t_retrieval_ms", "t_rerank_ms", "t_generation_ms", "t_total_ms")]
    return runs.select(*more, "query", "no_answer", "top_score", F.size(F.array_distinct("doc_ids")).alias("n_docs"), *ms, t("input_tokens").cast("int").alias("input_tokens"), t("output_tokens").cast("int").alias("output_tokens"), t("cost_usd").cast("double").alias("cost_usd"), F.coalesce("trace.cache", F.lit("-")).alias("cache"))


def kpis(log: DataFrame) -> DataFrame:
    """One row of key figures of a request log."""
    avg = lambda c: F.round(F.avg(c), 4)
    times = ((F.col("t_total_ms"), {"p50_total_ms": 0.5, "p95_total_ms": 0.95}), (F.col("t_retrieval_ms") + F.col("t_rerank_ms"), {"p95_retrieval_ms": 0.95}), (F.col("t_generation_ms"), {"p95_generation_ms": 0.95}))
    figures = [F.count(F.lit(1)).alias("requests"), avg(F.col("no_answer").cast("double")).alias("no_answer_rate"), avg("input_tokens").alias("avg_input_tokens"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"), F.round(F.avg("cost_usd"), 6).alias("cost_per_request")]
    if log.count() <= IN_MEMORY:  # all in one pass
        return log.agg(*figures, *(F.round(F.percentile(v.cast("double"), p), 4).alias(n) for v, shares in times for n, p in shares.items())).select(*KPIS)
    out = log.agg(*figures)
    for value, shares in times:
        out = out.crossJoin(quantiles(log, value, shares))  # one row each
    return out.select(*KPIS)


def alerts(log: DataFrame, order: list[str], baseline: DataFrame | None = None) -> DataFrame:
    """(alert, value): refusals in the last RECENT requests, p95 of all, recent top scores below the baseline's decile.

    One row `none` if nothing is amiss.  `order` puts the log in sequence.
    """
    recent = log.orderBy(*(F.desc(c) for c in order)).limit(RECENT)
    rate = recent.agg(F.avg(F.col("no_answer").cast("double")).alias("v"))
    p95 = quantiles(log, "t_total_ms", {"v": 0.95}, digits=9)
    low = recent.crossJoin(F.broadcast(quantiles(baseline or log, "top_score", {"base": 0.10}, digits=9)))  # one row
    share = low.agg(F.avg(F.coalesce(F.col("top_score") < F.col("base"), F.lit(False)).cast("double")).alias("v"))
    limits = (("no_answer_rate", rate, NO_ANSWER_RATE), ("p95_latency", p95, P95_MS), ("low_top_score", share, LOW_SHARE))
    found = None
    for name, df, limit in limits:
        row = df.filter(F.col("v") > limit).select(F.lit(name).alias("alert"), F.round("v", 6).alias("value"))
        found = row if found is None else found.union(row)
    none = found.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit("none").alias("alert"), F.lit(None).cast("double").alias("value"))
    return found.union(none)


def cost(input_tokens: Column, output_tokens: Column) -> Column:
    return F.round(input_tokens / 1e6 * PRICE_IN + output_tokens / 1e6 * PRICE_OUT, 6)


def daily_cost(avg_in: Column, avg_out: Column, requests: int = 10_000, cache_hit: float = 0.0) -> Column:
    return requests * (avg_in / 1e6 * PRICE_IN + avg_out / 1e6 * PRICE_OUT + QUERY_TOKENS / 1e6 * PRICE_EMBED) * (1 - cache_hit)


def reranker_capacity(log: DataFrame, requests: int = 10_000, hours: int = 8, peak: float = 3.0) -> DataFrame:
    """CPU seconds a day, and workers at the peak (a multiple of the mean rate over a day's hours), from rerank times."""
    busy = F.col("p95") / 1000 * (requests / (hours * 3600) * peak)
    mean = log.agg(F.round(F.avg("t_rerank_ms") / 1000 * requests, 4).alias("cpu_s_per_day"))
    rows = mean.crossJoin(quantiles(log, "t_rerank_ms", {"p95": 0.95}, digits=9))  # one row each
    return rows.select("cpu_s_per_day", F.greatest(F.lit(1), F.bround(busy)).cast("long").alias("workers"))


def histogram(log: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) over [low, high); 0 is below, bins + 1 above."""
    return log.filter(F.col(value).isNotNull()).groupBy(F.width_bucket(F.col(value).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def roles_key(roles: Column) -> Column:
    """Sorted roles; no roles mean public access, null means an unfiltered search."""
    return F.when(roles.isNull(), UNFILTERED).when(F.size(roles) == 0, "all").otherwise(F.array_join(F.array_sort(roles), ","))


def cached_run(replayed: DataFrame, runs: DataFrame) -> DataFrame:
    """(request_id, cache, cache_similarity, answer, cost_usd, saved_ms) of requests behind a semantic cache.

    replayed says which requests hit which entry (request_id, cache, similarity, entry_id), runs what a run gives
    (request_id, answer, t_total_ms, cost_usd).  A hit has its entry's answer, costs nothing, and saves that run's time.
    """
    own = F.coalesce("entry_id", "request_id")
    rows = replayed.select("request_id", "cache", F.round("similarity", 3).alias("cache_similarity"), own.alias("ran"))
    rows = rows.join(runs.select(F.col("request_id").alias("ran"), "answer", "t_total_ms", "cost_usd"), "ran", "left")
    hit = F.col("cache") == "hit"
    return rows.select("request_id", "cache", "cache_similarity", "answer", F.when(hit, 0.0).otherwise(F.col("cost_usd")).alias("cost_usd"), F.when(hit, F.col("t_total_ms")).otherwise(0.0).alias("saved_ms"))


def cache_stats(rows: DataFrame) -> DataFrame:
    """One row of cached_run's totals: hits, misses, saved_ms."""
    return rows.agg(F.count_if(F.col("cache") == "hit").alias("hits"), F.count_if(F.col("cache") == "miss").alias("misses"), F.round(F.coalesce(F.sum("saved_ms"), F.lit(0.0)), 4).alias("saved_ms"))


def compare_indexes(blue: DataFrame, green: DataFrame) -> DataFrame:
    """(qid, n_blue, n_green, n_common, same_top) of two indexes' hits for the same queries."""
    both = blue.select("qid", "chunk_id", F.col("rank").alias("b")).join(green.select("qid", "chunk_id", F.col("rank").alias("g")), ["qid", "chunk_id"], "full")
    return both.groupBy("qid").agg(F.count("b").alias("n_blue"), F.count("g").alias("n_green"), F.count_if(F.col("b").isNotNull() & F.col("g").isNotNull()).alias("n_common"), F.coalesce(F.bool_or((F.col("b") == 1) & (F.col("g") == 1)), F.lit(False)).alias("same_top"))


@contextmanager
def traced(spark: SparkSession, name: str, **attributes: object) -> Iterator[dict[str, object]]:
    """Tags all jobs of the block with `name`, for Spark's event log, and gives them `name.attribute` as properties.

    The dict it gives holds the attributes and, in the end, the time that the block took.
    """
    span: dict[str, object] = dict(attributes)
    spark.sparkContext.addJobTag(name)
    for key, value in attributes.items():
        spark.sparkContext.setLocalProperty(f"{name}.{key}", str(value))
    began = time.perf_counter()
    try:
        yield span
    finally:
        span["t_total_ms"] = (time.perf_counter() - began) * 1000
        spark.sparkContext.removeJobTag(name)
        for key in attributes:
            spark.sparkContext.setLocalProperty(f"{name}.{key}", None)
