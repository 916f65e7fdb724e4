"""Document fingerprints by order MinHash, sensitive to edit distance.

The k-mers of a text (of code points; its end is padded, so a text of n characters has n of them) are numbered by
occurrence.  Each of FUNCTIONS hash functions selects the ORDER numbered k-mers with the least values, puts them back
into text order, and hashes that tuple: the share of equal tuples between two texts falls with the edits between
them, moved passages included, as a plain MinHash of k-mers does not see.

A batch of texts is one set of numpy arrays.  An edited version shares the k-mers before its first change with its
original, numbers included, so these are hashed once for both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import mixed, slices, spread

#: Code points a k-mer; k-mers a tuple; tuples a fingerprint.
K, ORDER, FUNCTIONS = 6, 2, 64
#: Hexadecimal digits of a tuple's hash in a fingerprint: two tuples are taken for equal by chance once in 65,536.
DIGITS = 4
#: Pads the end of a text; it is no character.
PAD = "\U0010ffff"
#: K-mers that a function looks at in a text, some; a text where that finds too few is searched as a whole.
LOOKED_AT = 8
#: Text bytes that one numpy pass handles.
PASS_BYTES = 1 << 19
#: Neighbours are found in buckets of consecutive ids; so many buckets a partition, as they are dealt by hash.
BUCKETS = 8

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIERS = (mixed(np.arange(1, FUNCTIONS + 1, dtype=np.uint64) * _BASE) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_EIGHT = np.arange(8)
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _numbers(h: np.ndarray, owner: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The occurrence number of each k-mer in its text; those of an edited tail don't count those of the original tail.

    owner is the number of its text, ascending; kind is 0 before the first change, then 1 for the original tail, 2 for
    the edited one.
    """
    n, out = len(h), np.zeros(len(h), np.uint64)
    if n < 2:
        return out
    bits = np.uint64((n - 1).bit_length())
    high = np.uint64(64 - max(1, int(owner[-1]).bit_length()))
    key = owner.astype(np.uint64) << high  # by text, so that what follows reads near by
    key |= h >> (np.uint64(64) - high + bits) << bits
    key |= np.arange(n, dtype=np.uint64)
    key.sort()
    top = key >> bits
    near = top[1:] == top[:-1]
    several = np.flatnonzero(np.append(near, False) | np.append(False, near))  # the others occur once
    order = (key[several] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    own, text = h[order], owner[order]
    same = (own[1:] == own[:-1]) & (text[1:] == text[:-1])
    if (same != (top[several][1:] == top[several][:-1])).any():  # different k-mers fell together
        own, text = order[np.lexsort((order, own, text))], None
        order, own, text = own, h[own], owner[own]
        same = (own[1:] == own[:-1]) & (text[1:] == text[:-1])
    first = np.flatnonzero(np.append(True, ~same)) if len(order) else np.zeros(0, np.int64)
    run, at, kinds = np.repeat(first, np.diff(np.append(first, len(order)))), np.arange(len(order)), kind[order]
    tails = np.append(0, np.cumsum(kinds == 1))
    out[order] = at - run - np.where(kinds == 2, tails[at] - tails[run], 0)
    return out


def _least(packed: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """The ORDER smallest values of each owner; owners come in order, values don't repeat."""
    out = np.full((ORDER, owners), _MOST)
    if len(packed):
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        size = np.diff(np.append(first, len(owner)))
        for k in range(ORDER):
            out[k, owner[first]] = low = np.minimum.reduceat(packed, first)
            packed = np.where(packed == np.repeat(low, size), _MOST, packed)
    return out


def signatures(texts: list[str], edits: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (a row of FUNCTIONS tuple hashes a text) of texts, and of texts whose end from a place on is replaced.

    A text without a character has no k-mers, so all its tuples are the empty one.
    """
    docs = len(texts)
    n = np.array([len(t) for t in texts], np.int64)
    shared = np.array([max(0, cut - K + 1) for cut, _ in edits], np.int64)
    tails = [t[s:cut] + new for t, s, (cut, new) in zip(texts, shared.tolist(), edits, strict=True)]
    more = np.array([len(t) for t in tails], np.int64)
    end = PAD * (K - 1)
    chars = np.frombuffer("".join(x for t, e in zip(texts, tails, strict=True) for x in (t, end, e, end)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    windows = np.zeros(max(0, len(chars) - K + 1), np.uint64)
    for k in range(K):
        windows = windows * _BASE + chars[k : k + len(windows)]
    size = n + more
    total = int(size.sum())
    at = np.arange(total)
    at += np.repeat(np.arange(2 * docs) * (K - 1), np.stack([n, more], 1).ravel())
    h = mixed(windows[at] + np.uint64(1))
    owner = np.repeat(np.arange(docs, dtype=np.int32), size)
    kind = np.repeat(np.tile(np.array([0, 1, 2], np.uint8), docs), np.stack([np.minimum(shared, n), n - np.minimum(shared, n), more], 1).ravel())
    x = _numbers(h, owner, kind)
    x = (mixed(h + (x + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)).astype(np.uint32)

    limit = np.repeat(np.minimum(2.0**32 - 1, 2.0**32 * LOOKED_AT / np.maximum(n, 1)).astype(np.uint32), size)
    seen = []
    below, value = np.zeros(-(-total // 8) * 8, bool), np.empty_like(x)
    for a in _MULTIPLIERS:
        np.less_equal(np.multiply(x, a, out=value), limit, out=below[:total])
        eights = np.flatnonzero(below.view(np.uint64))  # few of them hold any
        some = (eights[:, None] * 8 + _EIGHT).ravel()
        some = some[below[some]]
        seen.append((some, value[some].astype(np.uint64) << np.uint64(32) | some.astype(np.uint64)))
    some = np.concatenate([s for s, _ in seen])
    packed = np.concatenate([p for _, p in seen])
    group = np.repeat(np.arange(FUNCTIONS) * docs, [len(s) for s, _ in seen]) + owner[some]
    begin = np.cumsum(size) - size

    def tuples(skip: int, count: np.ndarray) -> np.ndarray:
        use = kind[some] != skip
        low = _least(packed[use], group[use], FUNCTIONS * docs)
        short = (low != _MOST).sum(0) < np.tile(np.minimum(count, ORDER), FUNCTIONS)
        for g in np.flatnonzero(short).tolist():
            f, d = divmod(g, docs)
            own = np.arange(begin[d], begin[d] + size[d])
            own = own[kind[own] != skip]
            value = (x[own] * _MULTIPLIERS[f]).astype(np.uint64) << np.uint64(32) | own.astype(np.uint64)
            value = np.sort(np.partition(value, min(ORDER, len(value)) - 1)[:ORDER])
            low[: len(value), g] = value
        which = np.where(low == _MOST, np.uint64(1 << 32), low & np.uint64(0xFFFFFFFF))
        which.sort(axis=0)
        out = np.zeros(FUNCTIONS * docs, np.uint64)
        for row in which:
            there = row < np.uint64(1 << 32)
            out[there] = mixed(out[there] * np.uint64(3) + h[row[there].astype(np.int64)] + np.uint64(1))
        return (out >> np.uint64(64 - 4 * DIGITS)).astype(np.uint16).reshape(FUNCTIONS, docs).T

    return tuples(2, n), tuples(1, shared + more)


def shown(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: Column, b: Column) -> Column:
    """The share of equal tuples of two fingerprints, 0 to 1."""
    tuples = lambda x: F.transform(F.sequence(F.lit(0), F.lit(FUNCTIONS - 1)), lambda k: F.substring(x, k * DIGITS + 1, F.lit(DIGITS)))
    return F.size(F.filter(F.zip_with(tuples(a), tuples(b), lambda x, y: x == y), lambda same: same)) / F.lit(float(FUNCTIONS))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each row of docs (doc_id, text; other columns are ignored); rows stay where they are.

    Null text counts as empty; all empty texts have one fingerprint.  Repeated rows give a row each, an empty table
    none.  A long text is held by one task as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, PASS_BYTES):
                texts = [t or "" for t in part.column(1).to_pylist()]
                found, _ = signatures(texts, [(len(t), "") for t in texts])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shown(s) for s in found], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def _places(docs: DataFrame, buckets: int) -> Column:
    """The bucket of a doc_id, and, for the first id of a bucket, the bucket before it as -1 - bucket; as an array.

    Ids fall along the buckets, nulls are in the last one; after the last bucket comes the first.  Only ids are read,
    and only borders and first ids of buckets come to the driver.
    """
    shares = [(k + 1) / buckets for k in range(buckets - 1)]
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), F.array(*map(F.lit, shares)), 10 * buckets)).first()[0] if shares else []
    cuts = np.unique(np.array(cuts or [], np.int64))

    def bucket(ids: pa.Array) -> np.ndarray:
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        return np.where(known, len(cuts) - np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False), "right"), len(cuts) + 1)

    @F.arrow_udf("int")
    def alone(ids: pa.Array) -> pa.Array:
        return pa.array(bucket(ids), pa.int32())

    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    found = sorted(tuple(r) for r in ids.groupBy(alone("id").alias("b")).agg(F.max("id")).collect())  # a row a bucket
    first, before = np.zeros(len(cuts) + 2, np.int64), np.zeros(len(cuts) + 2, np.int32)
    for k, (b, head) in enumerate(found):
        first[b], before[b] = head or 0, found[k - 1][0]

    @F.arrow_udf("array<int>")
    def places(ids: pa.Array) -> pa.Array:
        own = bucket(ids)
        leads = (ids.fill_null(0).to_numpy(zero_copy_only=False) == first[own]).astype(np.int64)
        ends = np.cumsum(1 + leads)
        out = np.repeat(own, 1 + leads).astype(np.int32)
        out[ends[leads == 1] - 1] = -1 - before[own[leads == 1]]
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(out, pa.int32()))

    return places(F.col("doc_id").cast("long"))


FOUND = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (copied, doc_id, text) in order to FOUND; a copied row ends its bucket, so it is only looked at."""
    left: tuple[bool, int | None, str] | None = None
    row: list | None = None  # of the text before `left`, but for its likeness to that
    last: np.ndarray | None = None

    def batch(rows: list[list]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in FOUND.split(", ")])

    def step(rows: list[tuple[bool, int | None, str]], ahead: list[str]) -> Iterator[list]:
        nonlocal row, last
        texts = [t for _, _, t in rows]
        cuts = [len(t) - len(t) // 3 for t in texts]
        edits = [(cut, new[: len(t) - cut]) for t, cut, new in zip(texts, cuts, ahead, strict=True)]
        own, edited = signatures(texts, edits)
        for (copied, doc_id, text), (cut, new), a, b in zip(rows, edits, own, edited, strict=True):
            if row:
                yield [*row, float((last == a).mean())]
            row, last = None, a
            if not copied:
                sha = hashlib.sha256((text[:cut] + new).encode("utf-8", "surrogatepass")).hexdigest()
                row = [doc_id, len(text), sha, shown(a), shown(b), float((a == b).mean())]

    for arrived in batches:
        for part in slices(arrived, 2, PASS_BYTES):
            rows = list(zip(*(c.to_pylist() for c in part.columns), strict=True))
            rows = [left, *rows] if left else rows
            left = rows.pop()
            if rows:
                yield batch(list(step(rows, [*(t for _, _, t in rows[1:]), left[2]])))
    if left:
        yield batch(list(step([left], [""])))


def compared(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint, that of its edited text, and their likeness; and the likeness to the next text.

    docs (doc_id, text; other columns are ignored) in order of falling doc_id.  The edited text has the last third
    (floor) of the code points replaced by the first as many, or all, of the next document; after the last comes the
    first.  Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null text counts as empty, and an empty text has no third to replace; two empty texts are as like as can be.  Rows
    without a doc_id come last; rows of one doc_id follow each other by a hash of their texts, then by the texts, so
    repeated rows are each other's next.  A document alone is its own next one; an empty table gives no rows.

    Texts move once: to the bucket of their ids, where tasks read them in order and hold two of them and a pass.  The
    first of a bucket goes to the bucket before it too.  Rows that share one doc_id (or have none) go through one task.
    """
    n = spread(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select(F.explode(_places(docs, BUCKETS * n)).alias("place"), "doc_id", "text")
    copied = F.col("place") < 0
    rows = rows.withColumns({"copied": copied, "place": F.when(copied, -1 - F.col("place")).otherwise(F.col("place"))})
    rows = rows.repartition(n, "place").sortWithinPartitions("place", "copied", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text")
    return rows.select("copied", "doc_id", "text").mapInArrow(_compared, FOUND)
