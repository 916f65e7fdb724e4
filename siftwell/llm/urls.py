"""URL filters: a sort-merge range join of canonical keys with rules.

A host's labels in reverse, each with a dot after it, make a key: all hosts of a domain share the domain's key as a
prefix, so a rule's host is an interval of keys and intervals nest.  Rows and rules are dealt into key ranges and
sorted; one sweep keeps a stack of the rules whose interval it is in, outermost first.  Ranges split within a host,
by path and row, so no host lands in one task; a rule goes to each range that its interval meets.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import spread

#: Rows that are looked at to place the borders, a range, on average.
LOOKED_AT = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?`, `#` or the end.

    Both are empty if url is null or has no `://`.
    """
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


class Sweep:
    """The rules whose interval holds the present key: a level a host, each with its paths."""

    def __init__(self):
        self.levels: list[tuple[str, str, dict[str, str], set[int]]] = []

    def at(self, key: str) -> None:
        while self.levels and not key.startswith(self.levels[-1][0]):
            self.levels.pop()

    def add(self, key: str, host: str, path: str, verdict: str) -> None:
        self.at(key)
        if not self.levels or self.levels[-1][0] != key:
            self.levels.append((key, host, {}, set()))
        _, _, paths, sizes = self.levels[-1]
        if paths.get(path) != "block":
            paths[path] = verdict
        sizes.add(len(path))

    def longest(self, key: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits, and its verdict."""
        self.at(key)
        best, found = (-1, -1), None
        for _, host, paths, sizes in self.levels:
            for n in sizes:
                if n <= len(path) and (verdict := paths.get(path[:n])) and (len(host) + n, len(host)) > best:
                    best, found = (len(host) + n, len(host)), (host + path[:n], verdict)
        return found


def rules_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def judged(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """One row per row of pages (page_id, url; other columns are ignored): page_id, host, path, rule, verdict.

    rules has host, path and verdict (allow or block).  A rule fits its host and all subdomains if the url's path
    starts with the rule's; the longest (host and path as one string) wins, of equally long ones that with the longer
    host; of one rule with both verdicts, block.  `rule` is that string, null if none fits; the verdict is then
    `otherwise`, as for null urls and urls without a host.  Urls may have any length.  Repeated rows are judged each; an
    empty table gives no rows.
    """
    spark, ranges = pages.sparkSession, spread(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    # a null id gets a number, so that equal rows without one can be parted
    number = F.coalesce(F.col("page_id").cast("long"), -1 - F.monotonically_increasing_id())
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), number.alias("id")).withColumn("key", key_of(F.col("host")))
    # about as many rows in all, however many tasks send some; they place borders and decide nothing else
    share = min(1.0, LOOKED_AT * ranges / max(pages.count(), 1))
    looked = sorted(map(tuple, rows.sample(share, 0).select("key", "path", "id").collect()))
    borders = sorted({looked[len(looked) * k // ranges] for k in range(1, ranges)}) if looked else []
    keys = [b[0] for b in borders]
    names = ["range", "key", "is_row", "path", "host", "verdict", "page_id"]
    schema = "range int, key string, is_row boolean, path string, host string, verdict string, page_id long"

    def deal_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            own = [bisect_right(borders, row) for row in zip(*(batch.column(c).to_pylist() for c in ("key", "path", "id")), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), batch.column("key"), pa.array([True] * n), batch.column("path"), batch.column("host"), pa.nulls(n, pa.string()), batch.column("page_id")], names)

    def deal_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, path, host, verdict in zip(*(batch.column(k).to_pylist() for k in ("key", "path", "host", "verdict")), strict=True):
                # keys that start with this one end before the same key with its last dot raised
                own = range(bisect_left(keys, key), bisect_left(keys, key[:-1] + "/") + 1)
                yield pa.RecordBatch.from_pydict({"range": pa.array(own, pa.int32()), "key": [key] * len(own), "is_row": [False] * len(own), "path": [path] * len(own), "host": [host] * len(own), "verdict": [verdict] * len(own), "page_id": pa.nulls(len(own), pa.int64())})

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now = Sweep(), None
        for batch in batches:
            kept, found = [], []
            for k, (range_, key, is_row, path, host, verdict) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:6]), strict=True)):
                if range_ != now:
                    state, now = Sweep(), range_
                if is_row:
                    kept.append(k)
                    found.append(state.longest(key, path) or (None, otherwise))
                else:
                    state.add(key, host, path, verdict)
            rows = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("host"), rows.column("path"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    events = rows.mapInArrow(deal_rows, schema).union(rules.withColumn("key", key_of(F.col("host"))).mapInArrow(deal_rules, schema))
    dealt = events.repartitionById(len(borders) + 1, F.col("range")).sortWithinPartitions("range", "key", "is_row")
    return dealt.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")
