"""Packing documents into sequences: cutting-stock by column generation.

Documents longer than a sequence give whole sequences; what is left of each is a piece.  Pieces are counted by
length class (UNIT tokens wide).  A linear program over patterns (how many pieces of each class share a sequence)
is solved by column generation: the simplex method holds one pattern a class, and a knapsack by dynamic programming
prices the next pattern from the duals.  Rounded down, the patterns cover all but a few pieces of each class, which
first-fit decreasing places.  A piece's place then follows from its rank in its class alone.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import ranked, slices, stored
from siftwell.llm.tokens import ENCODED, Encoder

SEQUENCE = 2048
#: Width of a length class.  A sequence loses half of it a piece on average.
UNIT = 8
#: The linear program ends when its value is proven to be within this share of the optimum.
GAP = 5e-4


def priced(classes: np.ndarray, values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The best value of pieces that fit into `room`, and how many of each class: an unbounded knapsack."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    few = np.searchsorted(classes, np.arange(room + 1), "right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if n := few[c]:
            with_ = values[:n] + best[c - classes[:n]]
            if with_[k := int(with_.argmax())] > best[c] + 1e-12:
                best[c], last[c] = with_[k], k
    counts, c = np.zeros(len(classes)), room
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            counts[last[c]] += 1
            c -= classes[last[c]]
    return best[room], counts


def planned(demand: dict[int, int], room: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns (times used, pieces by class) that use up the demand exactly; classes are lengths in 1..room."""
    classes = np.array(sorted(c for c, n in demand.items() if n), int)
    if not len(classes):
        return []
    need, left = np.array([demand[c] for c in classes], float), Counter({c: n for c, n in demand.items() if n})
    columns = np.diag((room // classes).astype(float))
    inverse, x = np.diag(1 / np.diag(columns)), need / np.diag(columns)
    for _ in range(40 * len(classes) + 100):
        value, column = priced(classes, inverse.sum(0), room)
        if value <= 1 + GAP:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        x -= ratio[out] * step
        x[out] = ratio[out]
        inverse[out] /= step[out]
        others = np.arange(len(x)) != out
        inverse[others] -= np.outer(step[others], inverse[out])
        columns[:, out] = column
    used: Counter = Counter()
    for k in np.argsort(-columns.max(0), kind="stable"):
        pattern = {int(c): int(n) for c, n in zip(classes, columns[:, k], strict=True) if n}
        times = min([int(x[k] + 1e-6), *(left[c] // n for c, n in pattern.items())])
        if times > 0:
            used[tuple(pattern.items())] += times
            left.subtract({c: n * times for c, n in pattern.items()})
    while any(left.values()):
        space, pattern = room, {}
        for c in sorted((c for c, n in left.items() if n), reverse=True):
            if n := min(left[c], space // c):
                pattern[c], space = n, space - n * c
        used[tuple(sorted(pattern.items()))] += 1
        left.subtract(pattern)
    return [(n, dict(p)) for p, n in used.items()]


def pieces(docs: DataFrame, tokenizer: str, end: int = 1, sequence: int = SEQUENCE) -> DataFrame:
    """Tokenises each row of docs and cuts it: doc_id, start, length, ids_crc32, doc_tokens and `_class`."""
    width = UNIT * sequence // SEQUENCE or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.of(tokenizer, end)
        for batch in batches:
            for part in slices(batch, 1, ENCODED):
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1)), strict=True):
                    n, view = len(ids) // 4, memoryview(ids)
                    for a in range(0, n, sequence):
                        b = min(a + sequence, n)
                        rows.append((doc_id, a, b - a, zlib.crc32(view[4 * a : 4 * b]), n, -(-(b - a) // width)))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.int32()], strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_class"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, _class int")


def pack(docs: DataFrame, tokenizer: str, end: int = 1, sequence: int = SEQUENCE) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of docs (doc_id, text; other columns are ignored) is a document: its ids and the end id.  Null and
    empty texts give a piece of length 1; rows with one doc_id are separate documents; an empty table gives no rows.  A
    very long text is encoded by one task as a whole, and gives a piece for each sequence that it fills.
    Only counts by class come to the driver (at most sequence / UNIT), and the patterns go to all tasks: one a class
    from the program, and few from the rest.
    """
    table = stored(pieces(docs, tokenizer, end, sequence), "pieces")
    width = UNIT * sequence // SEQUENCE or 1
    room = sequence // width
    demand = {r["_class"]: r["count"] for r in table.groupBy("_class").count().collect()}
    uses: dict[int, list[tuple[int, int, int, int]]] = {}  # class: first rank, first sequence, pieces a sequence, first slot
    rank, sequences = Counter(), 0
    for times, pattern in planned(demand, room):
        slot = 0
        for c in sorted(pattern, reverse=True):
            uses.setdefault(c, []).append((rank[c], sequences, pattern[c], slot))
            rank[c] += times * pattern[c]
            slot += pattern[c]
        sequences += times
    uses_of = {c: np.array(u, np.int64).T for c, u in uses.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, ranks = (batch.column(k).to_numpy() for k in ("_class", "_rank"))
            sequence_id, slot = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
            for c in np.unique(kinds):
                rows = np.flatnonzero(kinds == c)
                first, base, each, lead = uses_of[int(c)]
                u = np.searchsorted(first, ranks[rows], "right") - 1
                past = ranks[rows] - first[u]
                sequence_id[rows], slot[rows] = base[u] + past // each[u], lead[u] + past % each[u]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence_id), pa.array(slot)], [*batch.schema.names[:5], "sequence_id", "_slot"])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ranks = ranked(table, "_class", names, name="_rank").select(*names, "_class", "_rank")
    placed = ranks.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, _slot long")
    before = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*names, "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
