"""Quantiles of any window of a log from stored sketches of its days, without reading the log again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of a sketch: exact up to so many values, some; beyond that, see `rank_error`.
K = 4096


def rank_error(k: int = K) -> float:
    """How far a quantile's true rank is from the one asked for, as a share of all values, in 99 of 100 cases.

    That of a KLL sketch of size k, by the public formula fitted to it; merging sketches keeps it.
    """
    return 2.296 / k**0.9021


def daily(log: DataFrame, value: str, by: str | None = None, ts: str = "ts", k: int = K) -> DataFrame:
    """(day, by, n, low, high, sketch) of the values of a log; nulls don't count, and NaN doesn't either.

    Sketches combine before the shuffle, so a day or group that has most of the rows costs no more than a small one.
    """
    v = F.col(value).cast("double")
    group = F.col(by).cast("string") if by else F.lit(None).cast("string")
    rows = log.select(F.to_date(ts).alias("day"), group.alias("by"), v.alias("v")).filter(v.isNotNull() & ~F.isnan(v))
    return rows.groupBy("day", "by").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.kll_sketch_agg_double("v", k).alias("sketch"))


def append(sketches: DataFrame, path: str) -> None:
    """Adds sketches of new rows; a day may be added to as often as it gets rows."""
    sketches.write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def quantiles(sketches: DataFrame, shares: dict[str, float], since: str | None = None, until: str | None = None, grouped: bool = True) -> DataFrame:
    """(by, n, a column each) over the days from `since` to `until`, both included; one row for all groups if not grouped.

    A quantile is a value of the log: the least one whose rank is not below its share.  Shares 0 and 1 are exact.
    """
    rows = sketches
    if since is not None:
        rows = rows.filter(F.col("day") >= F.lit(since).cast("date"))
    if until is not None:
        rows = rows.filter(F.col("day") <= F.lit(until).cast("date"))
    rows = rows.groupBy(*(["by"] if grouped else [])).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch").alias("s"))
    at = lambda p: F.col("low") if p <= 0 else F.col("high") if p >= 1 else F.kll_sketch_get_quantile_double("s", F.lit(float(p)))
    return rows.select(*(["by"] if grouped else []), "n", *(F.when(F.col("n") > 0, at(p)).alias(name) for name, p in shares.items()))
