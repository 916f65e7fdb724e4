"""Repeated passages across documents: exact windows of words, counted by super-k-mer partitioning.

Every window of WINDOW words has a minimiser, the smallest hash of the GRAM-word runs in it.  Consecutive windows
with one minimiser travel as one packed string (a super-k-mer) to that minimiser's bucket; equal windows have equal
minimisers, so each bucket finds its repeated windows alone, by sorting them.

A census of minimisers comes first, with a combine before its shuffle.  Windows repeat across documents only under
minimisers that several documents have; strings of others stay where they are.  Buckets with many strings are split
by document: each part reports what repeats within it and hands on, by a 128-bit sum, the windows that are first
in the part, so no bucket's size reaches one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import Words, mixed, rolled, slices, spread, stored, unused

WINDOW, GRAM = 50, 8
#: Windows that a packed string holds at most; longer runs go as several strings.
RUN = 256
#: Bits of the sieve of minimisers that several documents have.  It is a filter of fixed size: a minimiser that
#: shares a bit with another one is sent for nothing, never lost.
SIEVE_BITS = 26
#: Buckets are split so that a part has about this many documents.  How many parts is kept for 2 ** SLOT_BITS slots of
#: minimisers, as the largest bucket of a slot needs; another bucket of that slot is split for nothing, and no worse for it.
HOT, SLOT_BITS = 500, 20


class Runs:
    """Super-k-mers of some texts: minimiser, text, first window (its first word in the text), number of windows."""

    def __init__(self, texts: pa.Array, window: int = WINDOW, gram: int = GRAM):
        self.words, self.window = Words(texts), window
        w = self.words
        grams = rolled(w.hashes(), gram)
        n = len(w) - window + 1
        self.minimiser = self.doc = self.first = self.count = self.word = np.zeros(0, np.int64)
        if n <= 0:
            return
        reach, least, size = window - gram + 1, grams, 1
        while 2 * size <= reach:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[:n], least[reach - size : reach - size + n])
        at = np.flatnonzero(w.doc[:n] == w.doc[window - 1 :])
        if not len(at):
            return
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]])
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(at)))
        parts = -(-count // RUN)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        self.word = at[np.repeat(begin, parts)] + nth * RUN
        self.count = np.minimum(np.repeat(count, parts) - nth * RUN, RUN)
        self.minimiser = least[self.word].view(np.int64)
        self.doc = w.doc[self.word]
        self.first = self.word - w.first[self.doc]

    def packed(self, some: np.ndarray) -> list[bytes]:
        """The words of the super-k-mers named, joined by one space."""
        w = self.words
        size = w.end - w.start
        spaced = np.full(int(size.sum()) + len(size), 32, np.uint8)
        spaced[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = w.data[w.inside]
        begin = np.append(0, np.cumsum(size + 1))
        a, b = begin[self.word[some]], begin[self.word[some] + self.count[some] + self.window - 1] - 1
        whole = spaced.tobytes()
        return [whole[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]

    def text_keys(self) -> np.ndarray:
        """A hash of each text's words, which tells rows with one doc_id apart."""
        w = self.words
        h = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(w.hashes() + np.arange(len(w), dtype=np.uint64) - np.repeat(w.first[:-1], w.counts).astype(np.uint64)))])
        return mixed(h[w.first[1:]] - h[w.first[:-1]]).view(np.int64)


def census(docs: DataFrame) -> DataFrame:
    """(minimiser, n) of those that several doc_ids have; n counts documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                runs = Runs(part.column(1))
                order = np.lexsort((runs.minimiser, runs.doc))
                m, d = runs.minimiser[order], runs.doc[order]
                new = np.ones(len(m), bool)
                new[1:] = (m[1:] != m[:-1]) | (d[1:] != d[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(m[new]), part.column(0).take(pa.array(d[new]))], ["minimiser", "doc_id"])

    rows = docs.mapInArrow(run, "minimiser long, doc_id long")
    return rows.groupBy("minimiser").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("minimiser", "n")


def repeated(group: list[tuple[int, int, int, bytes]], window: int = WINDOW) -> tuple[list[tuple], list[tuple]]:
    """Of a bucket's (doc_id, text key, first, packed): windows that a smaller doc_id has, and the windows of the rest.

    Both as (doc_id, text key, first, number or bytes of the window).  Strings that several documents send whole are
    taken once, for the smallest; the windows of distinct strings are sorted, and of equal ones the first one stays.
    """
    owner: dict[bytes, int] = {}
    for doc_id, _, _, packed in group:
        if doc_id < owner.get(packed, doc_id + 1):
            owner[packed] = doc_id
    entries = []
    for number, (packed, doc_id) in enumerate(owner.items()):
        begin = [0, *(k + 1 for k, byte in enumerate(packed) if byte == 32), len(packed) + 1]
        entries += [(packed[begin[j] : begin[j + window] - 1], doc_id, number, j) for j in range(len(begin) - window)]
    late: dict[int, list[int]] = {}
    if len(owner) > 1:
        entries.sort()
        previous, least = None, 0
        for content, doc_id, number, j in entries:
            if content != previous:
                previous, least = content, doc_id
            elif doc_id > least:
                late.setdefault(number, []).append(j)
    sizes, contents = {}, {}
    for content, _, number, j in entries:
        sizes[number] = max(sizes.get(number, 0), j + 1)
        contents[number, j] = content
    numbers = {packed: number for number, packed in enumerate(owner)}
    flagged, rest = [], []
    for doc_id, key, first, packed in group:
        number = numbers[packed]
        if doc_id > owner[packed]:
            flagged.append((doc_id, key, first, sizes[number]))
            continue
        mine = sorted(late.get(number, ()))
        begin = 0
        while begin < len(mine):
            end = begin
            while end + 1 < len(mine) and mine[end + 1] == mine[end] + 1:
                end += 1
            flagged.append((doc_id, key, first + mine[begin], end - begin + 1))
            begin = end + 1
        out = set(mine)
        rest += [(doc_id, key, first + j, contents[number, j]) for j in range(sizes[number]) if j not in out]
    return flagged, rest


def _bucket_rows(docs: DataFrame, sieve, hot) -> DataFrame:
    """(doc_id, text) to (minimiser, part, doc_id, text_key, first, packed) for minimisers that the sieve lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, parts = sieve.value, hot.value
        for batch in batches:
            for part in slices(batch, 1):
                runs = Runs(part.column(1))
                place = runs.minimiser & ((1 << SIEVE_BITS) - 1)
                some = np.flatnonzero((bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1))
                if not len(some):
                    continue
                m = runs.minimiser[some]
                doc_id, text_key = part.column(0).to_numpy()[runs.doc[some]], runs.text_keys()[runs.doc[some]]
                own = parts[m & ((1 << SLOT_BITS) - 1)]
                split = np.where(own > 1, (mixed(doc_id.view(np.uint64)) % own).astype(np.int64), -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(split), pa.array(doc_id), pa.array(text_key), pa.array(runs.first[some]), pa.array(runs.packed(some), pa.binary())], ["minimiser", "part", "doc_id", "text_key", "first", "packed"])

    return docs.mapInArrow(run, "minimiser long, part int, doc_id long, text_key long, first long, packed binary")


def _settled(rows: DataFrame) -> DataFrame:
    """Flags (doc_id, text_key, first, n) of each bucket or part of one; of parts also first windows, by w1 and w2."""

    def settle(group: list[tuple[int, int, int, bytes]], split: bool) -> list[tuple]:
        if len(group) == 1 and not split or (len({g[0] for g in group}) == 1 and not split):
            return []
        flagged, rest = repeated(group)
        out = [(*f, None, None) for f in flagged]
        if split:
            for doc_id, key, first, content in rest:
                sums = np.frombuffer(hashlib.blake2b(content, digest_size=16).digest(), np.int64).tolist()
                out.append((doc_id, key, first, 1, *sums))
        return out

    names = ["doc_id", "text_key", "first", "n", "w1", "w2"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 6)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, out = [], None, []
        for batch in batches:
            m, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rest = [batch.column(k) for k in range(2, 6)]
            edge = np.flatnonzero((m[1:] != m[:-1]) | (part[1:] != part[:-1])) + 1
            borders = [0, *edge.tolist(), len(m)]
            for a, b in zip(borders, borders[1:], strict=False):
                if a == b:
                    continue
                now = (int(m[a]), int(part[a]))
                if now != key:
                    if held:
                        out += settle(held, key[1] >= 0)
                    held, key = [], now
                if b - a > 1 or held or now[1] >= 0 or b == len(m):  # a string alone in its bucket repeats nothing
                    held += zip(*(c.slice(a, b - a).to_pylist() for c in rest), strict=True)
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        if held:
            out += settle(held, key[1] >= 0)
        if out:
            yield batch_of(out)

    return rows.mapInArrow(run, "doc_id long, text_key long, first long, n long, w1 long, w2 long")


def flags(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, first, n): runs of windows of a document that also start in one with a smaller doc_id."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    several = stored(census(rows), "minimisers")
    word = F.col("minimiser").bitwiseAND((1 << SIEVE_BITS) - 1)
    bits = several.groupBy(F.shiftright(word, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(minimiser & 63 as int))")).alias("bits")).toArrow()  # at most 2 ** (SIEVE_BITS - 6) rows
    sieve = np.zeros(1 << (SIEVE_BITS - 6), np.uint64)
    sieve[bits.column("word").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    slot = F.col("minimiser").bitwiseAND((1 << SLOT_BITS) - 1)
    heavy = several.filter(F.col("n") > HOT).groupBy(slot.alias("slot")).agg(F.ceil(F.max("n") / HOT).alias("parts")).toArrow()  # at most 2 ** SLOT_BITS rows
    hot = np.ones(1 << SLOT_BITS, np.uint64)
    hot[heavy.column("slot").to_numpy()] = heavy.column("parts").to_numpy()
    context = spark.sparkContext
    packed = _bucket_rows(rows, context.broadcast(sieve), context.broadcast(hot))
    dealt = packed.repartition(spread(spark), "minimiser", "part").sortWithinPartitions("minimiser", "part")
    settled = stored(_settled(dealt), "windows")
    first = settled.filter("w1 is not null")
    least = first.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"))
    handed = first.join(least, ["w1", "w2"]).filter("doc_id > least")
    return settled.filter("w1 is null").select("doc_id", "text_key", "first", "n").union(handed.select("doc_id", "text_key", "first", "n"))


def _with_flags(docs: DataFrame) -> DataFrame:
    (name,) = unused(docs, "flags")
    gathered = flags(docs).groupBy("doc_id").agg(F.collect_list(F.struct("text_key", "first", "n")).alias("flags")).select(F.col("doc_id").alias("flagged"), "flags")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id")).join(gathered, F.col("id") == F.col("flagged"), "left")
    return rows.select("row.*", F.col("flags").alias(name))


def _kept_words(texts: pa.Array, flags: list) -> list[tuple[int, int, bytes]]:
    """(words, words removed, kept words joined by one space) of each text."""
    out, keys = [], None
    for k, (text, own) in enumerate(zip(texts.to_pylist(), flags, strict=True)):
        words = (text or "").encode().split()
        gone = 0
        if own:
            keys = Runs(texts).text_keys() if keys is None else keys
            edge = np.zeros(len(words) + 1, np.int64)
            for f in own:
                if f["text_key"] == keys[k]:
                    edge[f["first"]] += 1
                    edge[f["first"] + f["n"] + WINDOW - 1] -= 1
            stay = np.cumsum(edge[:-1]) == 0
            gone = len(words) - int(stay.sum())
            words = [w for w, s in zip(words, stay.tolist(), strict=True) if s] if gone else words
        out.append((len(words) + gone, gone, b" ".join(words)))
    return out


def report(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text; other columns are ignored): doc_id, n_words, n_removed, kept_sha256.

    Words covered by a window of WINDOW words that also starts in a document with a smaller doc_id are removed;
    kept_sha256 is of the others, joined by one space.  Null and empty texts have no words.  Rows with one doc_id are
    judged each by its own text, and none of them has the smaller id.  Rows with a null doc_id stay as they are and
    repeat nothing.  An empty table gives no rows.  A long text is held by one task as a whole; its windows are dealt
    out like all others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = _kept_words(part.column(1), part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([hashlib.sha256(f[2]).hexdigest() for f in found], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_flags(rows).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut(docs: DataFrame) -> DataFrame:
    """docs with the repeated words gone from `text`; texts that lose none stay as they are, n_chars follows if there.

    Rows, nulls, repeated ids and empty tables fare as in `report`: every row stays, a text may become empty.
    """
    names = docs.columns
    column = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                texts = part.column(column).to_pylist()
                for k, (_, gone, kept) in enumerate(_kept_words(part.column(column), part.column(len(names)).to_pylist())):
                    texts[k] = kept.decode() if gone else texts[k]
                columns = part.columns[: len(names)]
                columns[column] = pa.array(texts, pa.string())
                if "n_chars" in names:
                    columns[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in texts]).cast(part.schema.field(names.index("n_chars")).type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return _with_flags(docs).mapInArrow(run, docs.schema)
