"""Conversation repair by error-correcting Earley parsing.

A weighted grammar of roles derives ``(s?(ua)+)?`` and, by extra productions, what edits make of it: any row may be
deleted or given the role that is due, and a turn may be inserted.  The grammar is left-linear, so each chart item
begins at the first row and a column of the chart has an item a nonterminal; it retains the least (cost, audit), where
the audit is the initials of its edits.  The completed chart's best item yields the repair.

Rows are sorted by conversation and turn over all tasks.  A conversation that lies inside a task is parsed there.
One that is long, or crosses a border between tasks, is cut into chunks, each parsed from every nonterminal that it
may begin with; a stream over the chunks' costs picks their borders, and a last one joins audits and texts in order.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import spread, stored

# The cost of edits; what an undeleted truncated row adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows and bytes of text of a chunk, at most (but for a single longer row).
ROWS, BYTES = 512, 1 << 22
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Production:
    """left -> before, then a row of the role `row`; or of any role, by an edit; or nothing, which inserts one.

    `turn` is the initial of the role that the repaired conversation has for it, if any.
    """

    left: str
    before: str
    edit: str
    row: str | None
    turn: str | None
    cost: int


START, SYSTEM, USER, ASSISTANT = NONTERMINALS = ("start", "system", "user", "assistant")
#: A conversation may end after these.
FINAL = (START, ASSISTANT)
GRAMMAR = tuple(
    [Production(SYSTEM, START, "K", "s", "s", KEEP)]
    + [Production(x, x, "D", "any", None, DELETE) for x in NONTERMINALS]
    + [
        Production(left, before, edit, row, left[0], cost)
        for left, befores in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,)))
        for before in befores
        for edit, row, cost in (("K", left[0], KEEP), ("R", "any", REROLE), ("I", None, INSERT))
    ]
)
SCANS = tuple(p for p in GRAMMAR if p.row)
INSERTS = {x: tuple(p for p in GRAMMAR if p.before == x and not p.row) for x in NONTERMINALS}

Column = dict[str, tuple[int, str]]


def completed(column: Column) -> Column:
    """The column with the items that insertions add, each at its least (cost, audit)."""
    out: Column = {}
    queue = [(item, x) for x, item in column.items()]
    heapq.heapify(queue)
    while queue:
        (cost, audit), x = heapq.heappop(queue)
        if x not in out:  # else there is a lesser one
            out[x] = cost, audit
            for p in INSERTS[x]:
                heapq.heappush(queue, ((cost + p.cost, audit + p.edit), p.left))
    return out


@lru_cache(1 << 12)
def chart(rows: str, start: str = START) -> Column:
    """The last column, before insertions there, of parsing rows from `start` on.

    A row is its role's initial, in upper case if it is truncated; ``x`` if it must be deleted, ``o`` for other roles.
    """
    column: Column = {start: (0, "")}
    for row in rows:
        items, column = completed(column), {}
        for p in SCANS:
            if p.before in items and (p.edit == "D" or row != "x" and p.row in ("any", row.lower())):
                cost, audit = items[p.before]
                item = cost + p.cost + (TRUNCATED if row.isupper() and p.edit != "D" else 0), audit + p.edit
                column[p.left] = min(column.get(p.left, item), item)
    return column


def repaired(audit: str, rows: list[tuple[str, str]], start: str = START) -> Iterator[str]:
    """``role:text`` of the turns that the edits leave of rows (role, text)."""
    left, last = iter(rows), start
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(left)
        if edit == "D":
            continue
        if edit == "K" and role[:1] == "s":
            last = SYSTEM
        else:
            last = ASSISTANT if last == USER else USER
        yield f"{role if edit == 'K' else last}:{text}"


@dataclass
class Run:
    """Consecutive rows of a conversation, after damage: what is counted in them, and what they are repaired from."""

    rows: list[tuple[str, str]] = field(default_factory=list)
    marks: list[str] = field(default_factory=list)
    size: int = 0
    low: int | None = None
    high: int | None = None
    turns: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0

    def add(self, role: str, text: str, turn: int | None, fresh: bool, seen: bool) -> None:
        """fresh: no earlier row has this turn; seen: an earlier one has this role and text."""
        said = text.rstrip(BLANKS)
        mark = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if not said:
            self.blank, mark = self.blank + 1, "x"
        elif seen:
            self.duplicate, mark = self.duplicate + 1, "x"
        elif said[-1] not in ".!?":
            self.truncated, mark = self.truncated + 1, mark.upper()
        if self.rows:
            self.illegal += illegal(self.rows[-1][0], role)
        self.rows.append((role, text))
        self.marks.append(mark)
        self.size += len(text)
        if turn is not None:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.turns += fresh


def illegal(role: str, following: str) -> int:
    return role[:1] + following[:1] not in ("su", "ua", "au")


DONE = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
CHUNK = "task int, seq int, first string, last string, low long, high long, n_turns long, n_blank long, n_duplicate long, n_truncated long, n_illegal long, costs array<long>, places array<int>, audits array<string>, roles array<string>, texts array<string>"


def _schema(*of: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ", ".join(of).split(", "))])


def _batches(rows: Iterator[tuple | None], schema: pa.Schema, most: int = 1000) -> Iterator[pa.RecordBatch]:
    """Record batches of rows; None ends a batch."""
    held: list[tuple] = []
    for row in rows:
        held += [row] if row else []
        if held and (row is None or len(held) >= most):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield from _batches(iter([*held, None]), schema)


def ended(column: Column) -> tuple[int, str, str]:
    """(cost, audit, nonterminal before its last insertions) of the best way to end after a column."""
    found = []
    for x, item in column.items():
        items = completed({x: item})
        found += [(*items[y], x) for y in FINAL if y in items]
    return min(found)


def finished(conv_id: int | None, run: Run) -> tuple:
    """The row of DONE of a conversation that is one run."""
    _, audit, _ = best = ended(chart("".join(run.marks)))
    gaps = 0 if run.low is None else run.high - run.low + 1 - run.turns
    text = "\n".join(repaired(audit, run.rows))
    return conv_id, gaps, run.blank, run.duplicate, run.truncated, run.illegal, best[0], audit, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def chunk(task: int, seq: int, run: Run) -> tuple:
    """The row of CHUNK of a run: costs, audits and, among the audits from one nonterminal, their order; by start, then by end."""
    costs, places, audits = [], [], []
    for start in NONTERMINALS:
        column = chart("".join(run.marks), start)
        order = sorted(column, key=lambda x: column[x][1])
        for end in NONTERMINALS:
            cost, audit = column.get(end, (None, None))
            costs.append(cost)
            audits.append(audit)
            places.append(order.index(end) if end in column else None)
    first, last = (run.rows[0][0], run.rows[-1][0]) if run.rows else (None, None)
    counted = (run.low, run.high, run.turns, run.blank, run.duplicate, run.truncated, run.illegal)
    return task, seq, first, last, *counted, costs, places, audits, [r for r, _ in run.rows], [t for _, t in run.rows]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (task, conv_id, kind, turn, role, sha, text, copies) to whole conversations and chunks of others."""
    schema = _schema(DONE, CHUNK)
    nothing_done, nothing_cut = (None,) * (len(DONE.split(", ")) - 1), (None,) * len(CHUNK.split(", "))

    def rows() -> Iterator[tuple | None]:
        begun, first = False, True
        task = conv = turn = mark = row = None
        run, seq, earlier = Run(), 0, False

        def out(last: bool) -> Iterator[tuple | None]:
            if not (first or last or seq):
                yield (*finished(conv, run), *nothing_cut)
            elif run.rows or not seq:
                yield (conv, *nothing_done, *chunk(task, seq, run))
                yield None

        for batch in batches:
            for task, conv_id, kind, at, role, sha, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # noqa: B007
                if not begun or conv_id != conv:
                    if begun:
                        yield from out(False)
                        first = False
                    begun, conv, run, seq, turn, mark, row = True, conv_id, Run(), 0, None, None, None
                if kind == 0:  # the next rows of this key are the first of their role and text
                    mark = at, role, sha
                elif kind == 1:
                    for _ in range(copies):
                        if len(run.rows) >= ROWS or run.rows and run.size + len(text) > BYTES:
                            yield (conv, *nothing_done, *chunk(task, seq, run))
                            yield None
                            run, seq = Run(), seq + 1
                        earlier = (at, role, sha) == row or (at, role, sha) != mark
                        run.add(role, text, at, at != turn, earlier)
                        turn, row = at, (at, role, sha)
        if begun:
            yield from out(True)

    return _batches(rows(), schema)


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order: for each end of a chunk the best start; with the last chunk of a conversation, its best end.

    Of two ways to one end the cheaper is better, then the one whose audit so far is less: audits that end with the same
    row are never beginnings of each other, so how they go on doesn't matter, nor do the audits themselves, but for
    their order.
    """
    schema = _schema("conv_id long, task int, seq int, back array<int>, end int")

    def rows() -> Iterator[tuple]:
        held: tuple | None = None
        state: dict[int, tuple[int, tuple]] = {}

        def final() -> tuple:
            column = {NONTERMINALS[q]: (cost, chr(33 + place)) for q, (cost, place) in state.items()}  # a letter stands for an audit
            return (*held, NONTERMINALS.index(ended(column)[2]))

        for batch in batches:
            for conv_id, task, seq, costs, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or held[0] != conv_id:
                    if held:
                        yield final()
                    state = {0: (0, 0)}
                elif held:
                    yield (*held, None)
                best = {}
                for q in range(4):
                    ways = [(cost + costs[4 * p + q], place, places[4 * p + q], p) for p, (cost, place) in state.items() if costs[4 * p + q] is not None]
                    if ways:
                        best[q] = min(ways)
                order = sorted({(b[1], b[2]) for b in best.values()})
                state = {q: (b[0], order.index((b[1], b[2]))) for q, b in best.items()}
                held = conv_id, task, seq, [best[q][3] if q in best else None for q in range(4)]
        if held:
            yield final()

    return _batches(rows(), schema)


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What _forward gives, last chunks first, to the start and end of each chunk on the best way."""

    def rows() -> Iterator[tuple]:
        at = None
        for batch in batches:
            for conv_id, task, seq, back, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = at if end is None else end
                yield conv_id, task, seq, back[at], at
                at = back[at]

    return _batches(rows(), _schema("conv_id long, task int, seq int, start int, stop int"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order, with start and stop, to rows of DONE; texts stream through the hash."""

    def rows() -> Iterator[tuple]:
        conv, begun, total, audit, sha = None, False, {}, [], None

        def done() -> tuple:
            column = {NONTERMINALS[total["stop"]]: (0, "")}
            cost, more, _ = ended(column)
            feed(repaired(more, [], NONTERMINALS[total["stop"]]))
            gaps = 0 if total["low"] is None else total["high"] - total["low"] + 1 - total["turns"]
            return conv, gaps, *(total[k] for k in ("blank", "duplicate", "truncated", "illegal")), total["cost"] + cost, "".join([*audit, more]), sha.hexdigest()

        def feed(turns: Iterator[str]) -> None:
            for turn in turns:
                sha.update((("\n" if total["fed"] else "") + turn).encode("utf-8", "surrogatepass"))
                total["fed"] = True

        for batch in batches:
            for r in batch.to_pylist():
                if not begun or r["conv_id"] != conv:
                    if begun:
                        yield done()
                    begun, conv, audit, sha = True, r["conv_id"], [], hashlib.sha256()
                    total = dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal", "cost"), 0) | dict.fromkeys(("low", "high", "last")) | {"fed": False}
                for k in ("turns", "blank", "duplicate", "truncated", "illegal"):
                    total[k] += r[f"n_{k}"]
                if r["low"] is not None:
                    total["low"], total["high"] = r["low"] if total["low"] is None else total["low"], r["high"]
                if r["first"] is not None:
                    total["illegal"] += illegal(total["last"], r["first"]) if total["last"] is not None else 0
                    total["last"] = r["last"]
                which = 4 * r["start"] + r["stop"]
                total["cost"] += r["costs"][which]
                total["stop"] = r["stop"]
                audit.append(r["audits"][which])
                feed(repaired(r["audits"][which], list(zip(r["roles"], r["texts"], strict=True)), NONTERMINALS[r["start"]]))
        if begun:
            yield done()

    return _batches(rows(), _schema(DONE), 100)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of rows of those columns, by crc32(`conv_id:turn`) % 20; copies is 0 for a dropped row.

    0 drops a row, 1 empties its text, 2 takes its full stops and marks of exclamation and question, 3 repeats it, 4 makes
    it a user's.  Nulls become a space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def repairs(rows: DataFrame) -> DataFrame:
    """A row a conversation: what is wrong with its rows, the cheapest edits that make it legal, and a digest of the result.

    rows (conv_id, turn, role, text, copies): `copies` equal rows, 0 if only the conversation itself is to be known.
    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows go by turn, nulls first; rows of one turn by role, then by the SHA-256 of their texts, equal ones follow each
    other.  role and text must not be null; an empty text is blank, a role with another initial than s, u, a can only be
    given another or be deleted.  A null conv_id is a conversation too.  One without rows has zeros, an empty audit and
    the hash of the empty string.  An empty table gives no rows.  A text of more than BYTES is a chunk of its own.

    Texts move once, to their place in order; what an earlier row has said is found by a grouping of (conversation,
    role, SHA-256) that combines before the shuffle, and joins the sorted rows as rows of its own.  A conversation, however
    long, is spread over as many tasks as its turns fill, each of which holds a chunk; only its chunks' costs, a row
    for ROWS rows, and the streams that join its audit and hash its text, pass through one task.  Rows that share
    conversation and turn are in one task.
    """
    n = spread(rows.sparkSession)
    sha = F.unhex(F.sha2("text", 256))
    nothing = F.lit(None)
    own = rows.select("conv_id", "turn", F.when(F.col("copies") > 0, 1).otherwise(2).alias("kind"), "role", sha.alias("sha"), "text", "copies")
    first = own.filter("kind = 1").groupBy("conv_id", "role", "sha").agg(F.min(F.struct(F.col("turn").isNotNull().alias("k"), "turn")).alias("f"))
    first = first.select("conv_id", F.col("f.turn").alias("turn"), F.lit(0).alias("kind"), "role", "sha", nothing.cast("string").alias("text"), nothing.cast("int").alias("copies"))
    first = stored(first, "first")  # the ranges are sampled
    ordered = own.unionByName(first).repartitionByRange(n, F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"))
    ordered = ordered.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "sha", "kind")
    parsed = ordered.select(F.spark_partition_id().alias("task"), "conv_id", "kind", "turn", "role", "sha", "text", "copies").mapInArrow(_parsed, f"{DONE}, {CHUNK}")
    parsed = stored(parsed, "parsed")
    chunks = parsed.filter("task is not null")
    key = ["conv_id", "task", "seq"]
    asc, desc = ([f(c) for c in key] for f in (F.asc_nulls_first, F.desc_nulls_last))
    in_order: Callable[[DataFrame, list], DataFrame] = lambda df, order: df.repartition(n, "conv_id").sortWithinPartitions(*order)
    ways = in_order(chunks.select(*key, "costs", "places"), asc).mapInArrow(_forward, "conv_id long, task int, seq int, back array<int>, end int")
    ways = in_order(ways, desc).mapInArrow(_traced, "conv_id long, task int, seq int, start int, stop int")
    same = F.col("c.conv_id").eqNullSafe(F.col("w.conv_id")) & (F.col("c.task") == F.col("w.task")) & (F.col("c.seq") == F.col("w.seq"))
    chunks = chunks.alias("c").join(ways.alias("w"), same).select("c.conv_id", *(f"c.{x.split()[0]}" for x in CHUNK.split(", ")), "start", "stop")
    done = [x.split()[0] for x in DONE.split(", ")]
    return parsed.filter("task is null").select(done).union(in_order(chunks, asc).mapInArrow(_joined, DONE))


def report(rows: DataFrame) -> DataFrame:
    """Repairs of conversations (conv_id, turn, role, text; other columns are ignored), after damage."""
    return repairs(damaged(rows))
