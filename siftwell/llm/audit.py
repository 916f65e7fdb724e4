"""Audit of how filters interact, by a packed bitmap index.

One pass over the texts says which filters a document fails.  Tasks then pack their rows into bitsets: one a filter, a
label and a part of the corpus.  What survives a set of filters is the AND-NOT of its bitsets, and population counts
of it, for each of the 32 sets, are all that leaves a task; summed, they give every step of every order of filters,
since what a step removes depends only on the set of filters before it.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import slices, stored

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
#: Texts longer than this are not held as a list of words.
LONG = 1 << 20
#: Parts whose bitsets a task holds at a time, and parts that it sums up before it hands them on.
PARTS, HELD = 64, 4096

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_UPPER, _MARKS = bytes(range(65, 91)), b"#$%&*|"


def failed(text: str) -> int:
    """The filters among A to D that a text fails, as bits.

    A: under 200 words; B: fewer distinct words than half of the words; C: over 3 % of the characters are A-Z;
    D: holds one of ``#$%&*|``.
    """
    data = text.encode("utf-8", "surrogatepass")
    if len(data) > LONG:
        seen, words = set(), 0
        for m in _WORD.finditer(data):
            seen.add(m[0])
            words += 1
    else:
        seen = data.split()  # at the same bytes as _WORD
        words, seen = len(seen), set(seen)
    upper = len(data) - len(data.translate(None, _UPPER))
    marks = len(data) != len(data.translate(None, _MARKS))
    return (words < 200) | (100 * len(seen) < 50 * words) << 1 | (100 * upper > 3 * len(text)) << 2 | marks << 3


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic): a row a document; bits of the filters that it fails, E (an earlier document's copy) included.

    Texts are read once, for A to D and a SHA-256.  A text's smallest doc_id comes from one grouping by that, which
    combines before the shuffle; it is joined back on doc_id and SHA-256 together, so copies don't meet in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                texts = [t or "" for t in part.column(2).to_pylist()]
                sums = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(map(failed, texts), pa.int32()), pa.array(sums, pa.binary())], ["doc_id", "part", "fails", "sha"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    rows = stored(rows.mapInArrow(run, "doc_id long, part string, fails int, sha binary"), "flags")
    first = rows.groupBy("sha").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality"), one("toxic"))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    rows = rows.join(first, ["doc_id", "sha"], "left").select("doc_id", "part", F.col("fails").bitwiseOR(copy.cast("int") * 16).alias("fails"))
    no = F.lit(False)
    return rows.join(known, "doc_id", "left").select("part", "fails", F.coalesce("quality", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans to rows of 64-bit words."""
    data = np.packbits(np.ascontiguousarray(bits), axis=-1, bitorder="little")
    return np.pad(data, [(0, 0)] * (data.ndim - 1) + [(0, -data.shape[-1] % 8)]).view(np.uint64)


def counts(fails: np.ndarray, labels: np.ndarray, parts: np.ndarray, n: int) -> np.ndarray:
    """[part, set, what]: rows that survive a set of filters: all of them, and those with each label.

    fails are bits of filters, labels booleans (a row a label), parts numbers below n.
    """
    filters = packed((fails >> np.arange(len(FILTERS))[:, None] & 1).astype(bool))
    marks, of = packed(labels), packed(parts == np.arange(n)[:, None])
    alive = np.empty((SETS, filters.shape[1]), np.uint64)
    alive[0] = packed(np.ones((1, len(fails)), bool))[0]
    for s in range(1, SETS):
        low = (s & -s).bit_length() - 1
        alive[s] = alive[s & (s - 1)] & ~filters[low]
    whole = alive[None] & of[:, None]
    return np.stack([np.bitwise_count(w).sum(-1, dtype=np.int64) for w in (whole, *(whole & m for m in marks))], -1)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        names, found = list(sums), np.array(list(sums.values()), np.int64).reshape(-1, SETS, 3)
        columns = [pa.array(np.repeat(np.array(names, object), SETS), pa.string()), pa.array(np.tile(np.arange(SETS, dtype=np.int32), len(names)))]
        sums.clear()
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(found[:, :, k].ravel()) for k in range(3))], ["part", "filters", "n", "good", "toxic"])

    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        codes, fails = (c.to_numpy(zero_copy_only=False) for c in (coded.indices, batch.column(1)))
        labels = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3)])
        names = coded.dictionary.to_pylist()
        for first in range(0, len(names), PARTS):
            some = (codes >= first) & (codes < first + PARTS) if len(names) > PARTS else slice(None)
            found = counts(fails[some], labels[:, some], codes[some] - first, min(PARTS, len(names) - first))
            for name, own in zip(names[first:], found, strict=False):
                sums[name] = sums.get(name, 0) + own
        if len(sums) >= HELD:
            yield out()
    yield out()


ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
#: The set of filters before each step of each order.
BEFORE = [sum(1 << FILTERS.index(f) for f in order[:k]) for order in ORDERS for k in range(len(FILTERS))]


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes from each part of the corpus at each step of every order of the five filters.

    docs (doc_id, text, lang; other columns are ignored), labels (doc_id, quality, toxic).  Returns part (lang, null as
    an empty string), filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600
    rows for each part, zeros included; an empty table gives none.

    Null text counts as empty, and equal to other empty texts.  A row without a doc_id is no one's later copy and has
    no label; rows that share a doc_id are no earlier to each other, and count each.  A label counts if any row of the
    document in `labels` has it; null labels don't.  A long text is held by one task as a whole.
    """
    found = flagged(docs, labels).mapInArrow(_indexed, "part string, filters int, n long, good long, toxic long")
    found = found.groupBy("part", "filters").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    found = found.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("filters", "n", "good", "toxic"))).alias("s"))  # one of each set
    found = found.select("part", *(F.col(f"s.{c}").alias(c) for c in ("n", "good", "toxic")))

    at = lambda c, s: F.col(c)[s]
    sets = [[s for s in range(SETS) if not s >> f & 1] for f in range(len(FILTERS))]
    orders = lambda s: math.factorial(s.bit_count()) * math.factorial(len(FILTERS) - 1 - s.bit_count())
    total = [sum((orders(s) * (at("n", s) - at("n", s | 1 << f)) for s in sets[f]), F.lit(0)) for f in range(len(FILTERS))]
    found = found.withColumn("shapley", F.array(*total))

    rows = found.select("*", F.posexplode(F.lit(ORDERS)).alias("order", "filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    rows = rows.withColumn("before", F.lit(BEFORE)[F.col("order") * len(FILTERS) + F.col("step") - 1])
    rows = rows.withColumn("filter", F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1))) - 1)
    own = F.lit([1 << k for k in range(len(FILTERS))])[F.col("filter")]
    rows = rows.withColumns({"own": own, "after": F.col("before").bitwiseOR(own), "others": F.lit(SETS - 1) - own})
    lost = lambda c: at(c, F.col("before")) - at(c, F.col("after"))
    return rows.select(
        "part", "filter_order", "step", at("n", F.col("after")).alias("kept"), lost("n").alias("removed"), (at("n", 0) - at("n", F.col("own")) - lost("n")).alias("redundant"),
        (at("n", F.col("others")) - at("n", SETS - 1)).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.col("shapley")[F.col("filter")].alias("shapley"),
    )
