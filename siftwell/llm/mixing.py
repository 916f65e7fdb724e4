"""Mixing sources to target weights, by blocks of fixed length.

The words of each source, document after document, form one stream that is cut into blocks.  The mix is a number of
shards with equally many slots; a shard draws how many of its slots each source gets, and the i-th slot of a source
takes the block to which a pseudorandom permutation of the source's block numbers maps i; each pass through a source
has a permutation of its own.  Slots and documents meet in a join by block number.

Counts are multinomial draws on condition of the totals that the targets fix: shards draw without replacement from
the slots of all sources.  So any shard is a fair sample of the mix, and the whole mix meets its targets to a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from siftwell.llm.common import Words, mixed, ranked, slices, spread, stored, unused

#: Weights of sources in code-point order, repeating, and how often a source may be taken whole.
WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
#: Words in a block, slots in a shard.
BLOCK, SHARD = 128, 1024


def targets(sizes: list[int], weights: list[int], most: int = MOST_PASSES) -> list[Fraction]:
    """Shares of sum(sizes) by weight; none above `most` times its size, the excess going to the others by weight."""
    left, total, out = set(range(len(sizes))), Fraction(sum(sizes)), [Fraction(0)] * len(sizes)
    while left:
        heavy = sum(weights[k] for k in left)
        full = {k for k in left if total * weights[k] / heavy > most * sizes[k]}
        if not full:
            for k in left:
                out[k] = total * weights[k] / heavy
            break
        for k in full:
            out[k] = Fraction(most * sizes[k])
        total -= sum(out[k] for k in full)
        left -= full
    return out


def permuted(at: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Maps each at < n by the permutation of range(n) that key names: a four-round Feistel network, walked until in range."""
    half = np.ones(len(n), np.uint64)
    while (small := (np.uint64(1) << (half + half)) < n.astype(np.uint64)).any():
        half += small
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, walk = at.astype(np.uint64), np.arange(len(at))
    while len(walk):
        left, right = out[walk] >> half[walk], out[walk] & mask[walk]
        for r in range(4):
            left, right = right, left ^ (mixed(right + key[walk] + np.uint64(r * 0x9E3779B97F4A7C15 % (1 << 64))) & mask[walk])
        out[walk] = (left << half[walk]) | right
        walk = walk[out[walk] >= n[walk]]
    return out.astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text) to (doc_id, source, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(Words(part.column(2)).counts.astype(np.int64))], ["doc_id", "source", "size"])

    return docs.mapInArrow(run, "doc_id long, source string, size long")


class Mix:
    """The mix of docs (doc_id, source, text; other columns are ignored).

    sources: one row a source (source_no, source, source_size, target, blocks, slots).  `placed`: one row per row of
    docs (doc_id, source_no, size, at), `at` counting the words of its source before it.  `slots`: one row per slot
    of the mix (shard, slot, source_no, block).  Null and empty texts have size 0 and are never taken; a null source
    is a source, after all others; rows with one doc_id, and repeated rows, are separate documents, in an order that a
    hash gives.  A text of any length is only counted, and lies in as many blocks as its words fill.  An empty table has
    no sources and no slots.  The table of sources comes to the driver, the rows don't.
    """

    def __init__(self, docs: DataFrame, seed: int = 0, block: int = BLOCK):
        spark = docs.sparkSession
        self.block, self.spark = block, spark
        rows = stored(word_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")), "sizes")
        named = [(r["source"], r["s"]) for r in rows.groupBy("source").agg(F.sum("size").alias("s")).collect()]
        named.sort(key=lambda x: (x[0] is None, x[0] or ""))
        sizes = [s for _, s in named]
        goals = targets(sizes, [WEIGHTS[k % len(WEIGHTS)] for k in range(len(named))])
        blocks = [-(-s // block) for s in sizes]
        # a stream's last block is short, so slots count by its mean block
        slots = [min(MOST_PASSES * b, round(g * b / s)) if s else 0 for g, b, s in zip(goals, blocks, sizes, strict=True)]
        schema = "source_no int, source string, source_size long, target double, blocks long, slots long"
        self.sources = spark.createDataFrame([(k, n, s, float(g), b, c) for k, ((n, s), g, b, c) in enumerate(zip(named, goals, blocks, slots, strict=True))], schema)
        numbered = rows.join(self.sources.select("source_no", F.col("source").alias("_source")), F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "source_no", "size")
        self.placed = stored(ranked(stored(numbered, "numbered"), "source_no", ["doc_id", "size"], value="size", name="at"), "placed")
        self.slots = self._slots(blocks, slots, seed)

    def _slots(self, blocks: list[int], slots: list[int], seed: int) -> DataFrame:
        shards = max(1, -(-sum(slots) // SHARD))
        left, sizes = np.array(slots, np.int64), np.array(blocks, np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(0).to_numpy()
                for shard, counts, begun in Mix._shards(int(own[0]), int(own[-1]) + 1, 0, shards, left, np.zeros_like(left), seed):
                    source = np.repeat(np.arange(len(counts)), counts)
                    at = np.arange(len(source)) - np.repeat(np.cumsum(counts) - counts, counts) + begun[source]
                    passes = at // sizes[source]
                    key = mixed(mixed(source.astype(np.uint64) + np.uint64(seed)) + passes.astype(np.uint64))
                    block = permuted(at % sizes[source], sizes[source], key)
                    order = np.random.Generator(np.random.PCG64([seed, 1, shard])).permutation(len(source))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(source), shard, np.int64)), pa.array(np.arange(len(source))), pa.array(source[order].astype(np.int32)), pa.array(block[order])], ["shard", "slot", "source_no", "block"])

        return self.spark.range(0, shards, 1, min(shards, spread(self.spark))).mapInArrow(run, "shard long, slot long, source_no int, block long")

    @staticmethod
    def _shards(first: int, last: int, low: int, high: int, left: np.ndarray, begun: np.ndarray, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, slots of each source in it, and before it) for shards from first up to last.

        `left` is what shards low up to high have in all; the lower half draws its part, with a generator of its own,
        and so on, so any task finds its shards alone, and the mix doesn't depend on how many tasks there are.
        """
        if high <= first or low >= last:
            return
        if high - low == 1:
            yield low, left, begun
            return
        middle = (low + high) // 2
        draw = np.random.Generator(np.random.PCG64([seed, 0, low, high]))
        part = Mix._draw(draw, left, min((middle - low) * SHARD, int(left.sum())))
        yield from Mix._shards(first, last, low, middle, part, begun, seed)
        yield from Mix._shards(first, last, middle, high, left - part, begun + part, seed)

    @staticmethod
    def _draw(draw: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
        """n slots without replacement, by source: one hypergeometric draw a source."""
        out, rest = np.zeros(len(left), np.int64), int(left.sum())
        for k, own in enumerate(left.tolist()):
            rest -= own
            out[k] = own if n >= own + rest else _hypergeometric(draw, own, rest, n)
            n -= int(out[k])
        return out

    def taken(self) -> DataFrame:
        """One row per row of docs: doc_id, source_no, size, at, taken, and `parts` (begin, end, times) of its words."""
        b = self.block
        times = self.slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"))
        some = self.placed.filter("size > 0")
        reach = some.select("source_no", "at", "size", F.explode(F.sequence(F.expr(f"at div {b}"), F.expr(f"(at + size - 1) div {b}"))).alias("block"))
        begin, end = F.greatest(F.col("block") * b - F.col("at"), F.lit(0)), F.least((F.col("block") + 1) * b - F.col("at"), F.col("size"))
        parts = reach.join(times.hint("merge"), ["source_no", "block"]).select("source_no", "at", F.struct(begin.alias("begin"), end.alias("end"), "times").alias("part"))
        # of the rows with words, source_no and at name one
        summed = parts.groupBy("source_no", "at").agg(F.sum(F.expr("(part.end - part.begin) * part.times")).alias("taken"), F.array_sort(F.collect_list("part")).alias("parts"))
        key = F.when(F.col("size") > 0, F.col("at"))
        rows = self.placed.withColumn("_at", key).join(summed.withColumnsRenamed({"at": "_at"}), ["source_no", "_at"], "left")
        return rows.select("doc_id", "source_no", "size", "at", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "parts")


def _hypergeometric(draw: np.random.Generator, own: int, rest: int, n: int) -> int:
    if n <= 0 or own == 0:
        return 0
    if own + rest < 10**9:
        return int(draw.hypergeometric(own, rest, n))
    # beyond the generator's range, the normal limit, kept within what is possible
    p, all_ = own / (own + rest), own + rest
    sd = (n * p * (1 - p) * (all_ - n) / (all_ - 1)) ** 0.5
    return int(min(max(round(draw.normal(n * p, sd)), n - rest, 0), own, n))


def report(docs: DataFrame, seed: int = 0) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target (of its source) and taken (words, repeats counted).

    What becomes of odd rows is said in Mix; an empty table gives no rows.
    """
    mix = Mix(docs, seed)
    sources = mix.sources.select("source_no", "source_size", "target")
    return mix.taken().join(sources, "source_no").select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix as rows of docs: a document's words of the k-th pass over its blocks make its k-th row, for k up to 3.

    All columns of docs are returned; text has the words taken, joined by one space if not the whole text is, and
    n_chars (if there) its length.  Null and empty texts are never taken; an empty table gives an empty mix.
    """
    mix = Mix(docs, seed)
    fate = mix.taken().filter("taken > 0").join(mix.sources.select("source_no", F.col("source").alias("_source")), "source_no")
    # rows with one (doc_id, source, size) are told apart by their order
    fate = fate.select("doc_id", "_source", "size", "parts", F.row_number().over(Window.partitionBy("doc_id", "_source", "size").orderBy("at")).alias("_turn"))
    column, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                rows, texts = [], []
                for k, (text, parts, size) in enumerate(zip(part.column(column).to_pylist(), part.column(len(names)).to_pylist(), part.column(len(names) + 1).to_pylist(), strict=True)):
                    words = None
                    for turn in range(1, MOST_PASSES + 1):
                        own = [(p["begin"], p["end"]) for p in parts if p["times"] >= turn]
                        got = sum(e - b for b, e in own)
                        if got == size:
                            rows.append(k), texts.append(text)
                        elif got:
                            words = words if words is not None else text.encode().split()
                            rows.append(k), texts.append(b" ".join(w for b, e in own for w in words[b:e]).decode())
                out = part.take(pa.array(rows, pa.int64()))
                columns = out.columns[: len(names)]
                columns[column] = pa.array(texts, pa.string())
                if "n_chars" in names:
                    columns[names.index("n_chars")] = pa.array([len(t) for t in texts]).cast(part.schema.field(names.index("n_chars")).type)
                yield pa.RecordBatch.from_arrays(columns, names)

    id_, source, size, turn, hash_ = unused(docs, "id", "from", "words", "turn", "hash")
    keys = docs.select("*", F.col("doc_id").cast("long").alias(id_), F.col("source").cast("string").alias(source), F.xxhash64("text").alias(hash_))
    sized = _with_size(keys, size)
    sized = sized.withColumn(turn, F.row_number().over(Window.partitionBy(id_, source, size).orderBy(hash_)))
    fate = fate.select(F.col("doc_id").alias("f_id"), F.col("_source").alias("f_source"), F.col("size").alias("f_words"), "parts", F.col("_turn").alias("f_turn"))
    left = sized.select(F.struct(*names).alias("f_row"), F.col(id_).alias("f_i"), F.col(source).alias("f_s"), F.col(size).alias("f_w"), F.col(turn).alias("f_t"))
    on = F.col("f_i").eqNullSafe(F.col("f_id")) & F.col("f_s").eqNullSafe(F.col("f_source")) & (F.col("f_w") == F.col("f_words")) & (F.col("f_t") == F.col("f_turn"))
    return left.join(fate, on).select(*(F.col("f_row").getField(c).alias(c) for c in names), F.col("parts").alias(unused(docs, "parts")[0]), F.col("f_w").alias(size)).mapInArrow(run, docs.schema)


def _with_size(docs: DataFrame, name: str) -> DataFrame:
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(Words(part.column(column)).counts.astype(np.int64))], [*part.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))
