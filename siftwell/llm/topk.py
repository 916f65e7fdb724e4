"""Exact top-k search by inner product with vector-approximation files.

Components are turned into integers first.  The approximation is a table of its own, written once: blocks of vectors
with a byte a component, and the borders of its cells.  A scan of that table alone bounds every score from both sides;
what can't reach a query's k-th best lower bound, over all tasks, is done with.  Of the rest, exact vectors are read in
the order of their upper bounds: the first few of each query give a k-th score, and then only those whose bound is not
below it.  Queries go to all tasks in passes of a fixed number, one at a time, so what is sent has a bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import stored

SCALE = 1024
#: Vectors in a block; queries in a pass and those scanned at a time; blocks that a task has from Spark at a time.
BLOCK, PASS, SCAN, BLOCKS = 16_384, 32_768, 64, 8
#: Times k exact vectors are read for each query before its k-th score decides on the others.
FIRST = 4
#: 64-bit integers serve vectors whose integers are below LARGE and whose squares sum to less than NORM: all scores
#: among them fit.  Others have Python's integers; those of HUGE or more have no bounds either and are always read.
LARGE, NORM, HUGE = 1 << 31, 1 << 62, 1e150
MOST = (1 << 63) - 1


def scaled(x: float) -> int:
    """floor(SCALE * x), exactly, also where that is beyond a double."""
    y = x * SCALE
    return math.floor(y) if math.isfinite(y) else int(x) * SCALE


def integers(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, ids, rows of floor(SCALE * x)) of the valid vectors of a batch (vec_id, embedding), by dimension and by kind of integer."""
    ids, lists = batch.column(0), batch.column(1)
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    sizes = np.diff(ends, prepend=0)
    total = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[ends] - c[ends - sizes]
    finite = np.isfinite(flat)
    values = np.floor(np.where(finite, flat, 0) * SCALE)
    small = np.abs(values) < LARGE
    good = (total(~finite) == 0) & ~np.asarray(ids.is_null()) & ~np.asarray(lists.is_null())
    plain = (total(~small) == 0) & (total(np.where(small, values, 0) ** 2) < NORM)
    for size in np.unique(sizes[good]):
        for kind in (True, False):
            rows = np.flatnonzero(good & (sizes == size) & (plain == kind))
            if len(rows):
                at = (ends[rows] - size)[:, None] + np.arange(size)
                exact = values[at].astype(np.int64) if kind else np.array([[scaled(x) for x in row] for row in flat[at].tolist()], object)
                yield rows, ids.take(pa.array(rows)).to_numpy(), exact


@dataclass
class Cells:
    """The approximation of a block: a byte a component; cells of a dimension have one width.  Without borders nothing is known."""

    ids: np.ndarray
    low: np.ndarray | None
    width: np.ndarray | None
    codes: np.ndarray | None

    @classmethod
    def of(cls, ids: np.ndarray, exact: np.ndarray) -> Cells:
        if exact.dtype == object and (np.abs(exact) >= int(HUGE)).any():
            return cls(ids, None, None, None)
        low, width = exact.min(0).astype(float), (exact.max(0) - exact.min(0) + 1).astype(float) / 256
        return cls(ids, low, width, np.clip((exact.astype(float) - low) // width, 0, 255).astype(np.uint8))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score that each vector can have with each query."""
        if self.codes is None or queries.dtype == object and (np.abs(queries) >= int(HUGE)).any():
            none = np.full((len(self.ids), len(queries)), np.inf)
            return -none, none
        asked = queries.astype(float)
        wide = asked * self.width
        middle = self.codes.astype(float) @ wide.T + (asked @ (self.low + self.width / 2))
        # half a cell either way, and the rounding of values, cells and the sums above
        slack = np.abs(wide).sum(1) / 2 + 1e-9 * (np.abs(asked) @ (np.abs(self.low) + 256 * self.width)) + 1e-6
        return middle - slack, middle + slack


CELLS = "size int, ids binary, low binary, width binary, codes binary"


def _approximated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors (vec_id, embedding) to rows of CELLS, a block each."""
    held: dict[tuple[int, bool], list[tuple[np.ndarray, np.ndarray]]] = {}

    def block(key: tuple[int, bool]) -> pa.RecordBatch:
        cells = Cells.of(*(np.concatenate(x) for x in zip(*held.pop(key), strict=True)))
        parts = [None if x is None else x.tobytes() for x in (cells.ids.astype(np.int64), cells.low, cells.width, cells.codes)]
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), *(pa.array([x], pa.binary()) for x in parts)], ["size", "ids", "low", "width", "codes"])

    for batch in batches:
        for _, ids, exact in integers(batch):
            for a in range(0, len(ids), BLOCK):
                key = exact.shape[1], exact.dtype == object
                held.setdefault(key, []).append((ids[a : a + BLOCK], exact[a : a + BLOCK]))
                if sum(len(i) for i, _ in held[key]) >= BLOCK:
                    yield block(key)
    for key in list(held):
        yield block(key)


def beyond(score: int) -> str:
    """A text that puts scores which a long can't tell apart in order; empty for others."""
    if -MOST <= score < MOST:
        return ""
    digits = str(abs(score))
    text = f"{len(digits):04d}{digits}"
    return text if score > 0 else text.translate(str.maketrans("0123456789", "9876543210"))


def search(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """The k best of all other rows for each row of vectors (vec_id, embedding) that `is_query` names.

    query_id, rank (from 1), vec_id, score.  Scores are inner products of floor(1024 * x), x as double; ties go to
    the smaller vec_id; a query with fewer than k others gets all.  Null vectors, null ids, and vectors with a null
    or non-finite component take no part; vectors meet those of their dimension only.  A score beyond a long is given
    as the nearest long, and ranked by its true value.  Rows with the query's own vec_id are not its results; repeated
    rows otherwise count each.  Without queries, as in an empty table, there are no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = rows.filter(is_query)
    passes, found = max(1, -(-asked.count() // PASS)), None
    few = stored(_few_copies(rows, k), "vectors")
    cells = approximation(few)
    for turn in range(passes):
        part = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == turn).toArrow()  # some PASS rows
        queries: dict[tuple[int, bool], list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in part.combine_chunks().to_batches():
            for _, ids, exact in integers(batch):
                queries.setdefault((exact.shape[1], exact.dtype == object), []).append((ids, exact))
        sent = spark.sparkContext.broadcast([(d, np.concatenate([i for i, _ in q]), np.concatenate([x for _, x in q])) for (d, _), q in sorted(queries.items())])
        got = stored(_neighbours(few, candidates(cells, sent, k), sent, k).withColumn("turn", F.lit(turn)), "neighbours")
        sent.destroy()
        found = got if found is None else found.union(got)
    order = Window.partitionBy("turn", "query_no").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _few_copies(rows: DataFrame, k: int) -> DataFrame:
    """Of equal vectors those of the k + 1 smallest ids: ties go to smaller ids, so no other one is among any query's k best.

    Spark limits the ranks before the shuffle, so a vector that a third of all rows have costs a task k + 1 of them.
    """
    own = Window.partitionBy(F.xxhash64("embedding"), "embedding").orderBy("vec_id")
    return rows.filter("vec_id is not null and embedding is not null").withColumn("n", F.dense_rank().over(own)).filter(F.col("n") <= k + 1).drop("n")


def approximation(rows: DataFrame) -> DataFrame:
    """The stored table of CELLS of vectors (vec_id, embedding)."""
    return stored(rows.mapInArrow(_approximated, CELLS), "cells")


def candidates(cells: DataFrame, sent: Broadcast, k: int) -> DataFrame:
    """(query_no, query_id, vec_id, high, nth), stored: what may be among a query's k best, by the cells alone, the most promising first."""
    spark, name = cells.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BLOCKS))  # a row is a block
    try:
        near = stored(cells.mapInArrow(_bounded(sent, k), "query_no long, query_id long, vec_id long, low double, high double"), "bounds")
    finally:
        spark.conf.set(name, before)
    by = Window.partitionBy("query_no")
    floor = near.withColumn("n", F.row_number().over(by.orderBy(F.desc("low")))).filter(F.col("n") == k).select("query_no", F.col("low").alias("floor"))
    left = near.join(floor, "query_no", "left").filter(F.col("floor").isNull() | (F.col("high") >= F.col("floor")))
    return stored(left.groupBy("query_no", "query_id", "vec_id").agg(F.max("high").alias("high")).withColumn("nth", F.row_number().over(by.orderBy(F.desc("high"), "vec_id"))), "candidates")


def _neighbours(rows: DataFrame, near: DataFrame, sent: Broadcast, k: int) -> DataFrame:
    """Scores of the candidates that are read: the first of each query, then those that can still reach its k-th score."""
    first = stored(_scored(rows, near.filter(F.col("nth") <= FIRST * k), sent), "first")
    best = Window.partitionBy("query_no").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    worst = first.withColumn("n", F.row_number().over(best)).filter(F.col("n") == k).select("query_no", F.col("score").cast("double").alias("worst"))
    rest = near.filter(F.col("nth") > FIRST * k).join(worst, "query_no", "left")
    # a long may be rounded as a double
    rest = rest.filter(F.col("worst").isNull() | (F.col("high") >= F.col("worst") - F.abs("worst") * 1e-12 - 1))
    return first.union(_scored(rows, rest, sent))


def _scored(rows: DataFrame, near: DataFrame, sent: Broadcast) -> DataFrame:
    """(query_no, query_id, vec_id, score, beyond) of the exact vectors of candidates (query_no, query_id, vec_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = sent.value
        begin = np.cumsum([0, *(len(ids) for _, ids, _ in groups)])
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for places, ids, exact in integers(pa.RecordBatch.from_arrays([batch.column(2), batch.column(3)], ["vec_id", "embedding"])):
                for g, (d, _, queries) in enumerate(groups):
                    own = (numbers[places] >= begin[g]) & (numbers[places] < begin[g + 1])
                    if d != exact.shape[1] or not own.any():
                        continue
                    asked, x = queries[numbers[places[own]] - begin[g]], exact[own]
                    if x.dtype == object or asked.dtype == object:
                        asked, x = asked.astype(object), x.astype(object)
                    scores = [int(v) for v in (asked * x).sum(1)]
                    columns = [batch.column(c).take(pa.array(places[own])) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(ids[own]), pa.array([min(max(v, -MOST - 1), MOST) for v in scores], pa.int64()), pa.array(map(beyond, scores), pa.string())], ["query_no", "query_id", "vec_id", "score", "beyond"])

    pairs = near.select("query_no", "query_id", "vec_id").join(rows, "vec_id").select("query_no", "query_id", "vec_id", "embedding")
    return pairs.mapInArrow(run, "query_no long, query_id long, vec_id long, score long, beyond string")


def _bounded(sent: Broadcast, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = sent.value
        lows = [np.full((len(ids), k), -np.inf) for _, ids, _ in groups]  # the k best lower bounds of each query so far
        found: list[list[list[tuple[np.ndarray, ...]]]] = [[[] for _ in ids] for _, ids, _ in groups]

        def left(g: int, q: int) -> tuple[np.ndarray, ...]:
            """What the best lower bounds leave over of a query's vectors."""
            parts = tuple(np.concatenate(x) for x in zip(*found[g][q], strict=True))
            some = parts[2] >= lows[g][q].min()
            return tuple(x[some] for x in parts)

        for batch in batches:
            for size, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, low, width, codes = (None if x is None else np.frombuffer(x, kind) for x, kind in zip(parts, (np.int64, float, float, np.uint8), strict=True))
                cells = Cells(ids, low, width, None if codes is None else codes.reshape(-1, size))
                for g, (d, query_ids, queries) in enumerate(groups):
                    for b in range(0, len(queries) if d == size else 0, SCAN):
                        least, most = cells.bounds(queries[b : b + SCAN])
                        for q in range(b, min(b + SCAN, len(queries))):
                            other = ids != query_ids[q]
                            low, high = least[other, q - b], most[other, q - b]
                            top = np.concatenate([lows[g][q], low])
                            lows[g][q] = np.partition(top, len(top) - k)[len(top) - k :]
                            some = high >= lows[g][q].min()
                            found[g][q].append((ids[other][some], low[some], high[some]))
                            if len(found[g][q]) > 16:
                                found[g][q] = [left(g, q)]
        at = 0
        for g, (_, query_ids, _) in enumerate(groups):
            for q in range(len(query_ids)):
                if found[g][q]:
                    ids, low, high = left(g, q)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), at + q)), pa.array(np.full(len(ids), query_ids[q])), pa.array(ids), pa.array(low), pa.array(high)], ["query_no", "query_id", "vec_id", "low", "high"])
            at += len(query_ids)

    return run
