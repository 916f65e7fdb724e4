"""What the operators of this subpackage share: scratch tables, word tables in numpy, ranks without a hot task."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.sources.scratch import passing, scratch, stored

__all__ = ["Words", "mixed", "passing", "powers", "ranked", "raw", "rolled", "scratch", "slices", "spread", "stored", "unused"]

#: A word is a run of anything but these bytes; in UTF-8 they never occur inside a character.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Text bytes that one numpy pass handles; intermediates take some 40 times as much.
CHUNK_BYTES = 1 << 20

_IS_WORD = np.ones(256, bool)
_IS_WORD[list(BLANKS)] = False
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = np.ones(1, np.uint64)


def _trimmer() -> Callable[[int], object]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not glibc
        return lambda _: None


_trim = _trimmer()


def slices(batch: pa.RecordBatch, column: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose texts have about `most` bytes; a longer single text is a part of its own.

    After them, memory that Arrow and malloc have kept from earlier batches goes back to the machine: workers live on
    between stages.
    """
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(size), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()
    _trim(0)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty), end to end, and the len(texts) + 1 borders between them."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, borders, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    borders = np.frombuffer(borders, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[borders[0] : borders[-1]], borders - borders[0]


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 64), _BASE, np.uint64)
        grown[0] = 1
        _POWERS = np.cumprod(grown)
    return _POWERS


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of some texts as arrays: where each starts and ends, which text holds it, and its 64-bit hash."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        data, borders = raw(texts)
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint8)
        self.data, self.borders = data, borders
        inside = _IS_WORD[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = borders[:-1][np.diff(borders) > 0]
        if len(full):
            first[full] = inside[full]
            last[full[1:] - 1] = inside[full[1:] - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(borders, self.start, "right") - 1
        #: The first word of each text, and after the last text the number of words.
        self.first = np.searchsorted(self.start, borders[:-1], "left")
        self.first = np.append(self.first, len(self.start))
        self.inside = inside

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        if not len(self):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        at = np.cumsum(size) - size
        bytes_ = self.data[self.inside].astype(np.uint64) + np.uint64(1)
        bytes_ *= powers(int(size.max()))[np.arange(len(bytes_)) - np.repeat(at, size)]
        return mixed(np.add.reduceat(bytes_, at) + size.astype(np.uint64))


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive values, in order; len(hashes) - n + 1 of them."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = mixed(out + hashes[k : k + len(out)] * np.uint64(2 * k + 0x632BE59BD9B4E019))
    return out


#: Groups that a key's rows are dealt to, at most; they only keep tasks even, and totals few.
MOST_GROUPS = 20_000


def ranked(df: DataFrame, key: str, order: list[str | Column], per_group: int = 500, value: str | None = None, name: str = "rank") -> DataFrame:
    """Adds a running total within each key (of `value`, else of ones), not counting the row itself.

    A key may hold a third of all rows: rows of a key are dealt to hash groups of about `per_group` rows (or more, in
    MOST_GROUPS groups), totals are run within a group and added to the totals of the groups before it.  Only group
    totals meet by key.  The input must be a stored table, since it is read twice.  Keys must not be null.
    """
    groups = min(max(1, -(-df.count() // per_group)), MOST_GROUPS)
    one = F.col(value).cast("long") if value else F.lit(1).cast("long")
    df = df.withColumn("_group", F.pmod(F.xxhash64(*order), F.lit(groups)))
    sums = df.groupBy(key, "_group").agg(F.sum(one).alias("_sum"))
    before = Window.partitionBy(key).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "_group", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(key, "_group").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_run", F.coalesce(F.sum(one).over(within), F.lit(0)))
    return df.join(sums, [key, "_group"]).withColumn(name, (F.col("_run") + F.col("_base")).cast("long")).drop("_group", "_run", "_base")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, not even in other letters' case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def spread(spark: SparkSession) -> int:
    """The number of partitions for data that a step deals out itself."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
