"""Predicates over chunk metadata.  None means no filter; so does an empty list of doc_ids, while no roles leave public access."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import all_of


@dataclass(frozen=True)
class Filter:
    """roles: access has one of them or `all`; status and department: equal; doc_ids: among these."""

    roles: tuple[str, ...] | None = None
    status: str | None = "current"
    department: str | None = None
    doc_ids: tuple | None = None

    def column(self) -> Column:
        parts = []
        if self.roles is not None:
            parts.append(F.arrays_overlap("access", F.array(F.lit("all"), *map(F.lit, self.roles))))
        if self.status:
            parts.append(F.col("status") == self.status)
        if self.department:
            parts.append(F.col("department") == self.department)
        if self.doc_ids:
            parts.append(F.col("doc_id").isin(list(self.doc_ids)))
        return all_of(parts)

    def __call__(self, chunks: DataFrame) -> DataFrame:
        return chunks.filter(self.column())


def post_filter_loss(hits: DataFrame, chunks: DataFrame, roles: Iterable[str], least: int = 3) -> DataFrame:
    """What filtering after the ranking costs: per query the hits left, and whether they are fewer than `least`."""
    allowed = chunks.filter(Filter(roles=tuple(roles), status=None).column()).select("chunk_id", F.lit(1).alias("ok"))
    left = hits.join(allowed, "chunk_id", "left").groupBy("qid").agg(F.count("ok").alias("n_left"), F.count(F.lit(1)).alias("n_hits"))
    return left.select("qid", "n_hits", "n_left", (F.col("n_left") < least).alias("starved"))


def golden(items: DataFrame, types: Iterable[str] | None = None, answerable: bool | None = None, ids: Iterable | None = None) -> DataFrame:
    """Golden items by type, answerability (null: answerable) and id; None, or no type or id at all, means any."""
    rows = items.withColumn("answerable", F.coalesce("answerable", F.lit(True)))
    parts = []
    if types := list(types or ()):
        parts.append(F.col("type").isin(types))
    if answerable is not None:
        parts.append(F.col("answerable") == answerable)
    if ids := list(ids or ()):
        parts.append(F.col("id").isin(ids))
    return rows.filter(all_of(parts))


def top(rows: DataFrame, k: int, by: str, *order: Column | str) -> DataFrame:
    """The first k rows of each group with their rank; Spark drops the others before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)
