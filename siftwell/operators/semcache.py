"""Semantic cache over a log of requests: the nearest earlier one, and which requests a running cache would have answered.

Requests are sorted by key and time over all tasks and stored without their vectors, which are stored once beside them.
A task takes consecutive requests of a key, and reads from these tables, piece by piece, the entries that can be live for
them: no row is copied to meet another, so disk grows with the log and not with its pairs.  A key that holds most of the
log is spread over as many tasks as it fills; nothing else is ever compared, and no list of similar pairs is made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import dataset, fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.vectors import sound
from siftwell.sources.scratch import passing, scratch, stored

KEY = ["key", "size"]
ROW = [*KEY, "request_id", "at", "vec", "block"]
#: Requests of a block, and entries of a piece, at most; requests compared, and requests served, at a time.
CELL, SCAN, STEP = 16384, 256, 1024
#: Vectors that a task keeps from one piece to the next, if it needs no more at once.
KEPT = 1 << 17
#: Full blocks that a replay takes up in its first turn, and in any.
TURN, TURNS = 16, 4096

Compare = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]


class Table:
    """Rows of stored tables that tasks read themselves."""

    def __init__(self, *tables: DataFrame) -> None:
        self.files, self.data, self.cell = sorted(f for table in tables for f in table.inputFiles()), None, CELL

    def read(self, columns: list[str], where: pc.Expression) -> Iterator[pa.Table]:
        """The rows that pass, CELL of them at a time at most, in the order of files."""
        if self.files and self.data is None:
            named = [fs.FileSystem.from_uri(f) for f in self.files]
            self.data = dataset.dataset([path for _, path in named], format="parquet", filesystem=named[0][0])
        held, n = [], 0
        for batch in self.data.to_batches(columns=columns, filter=where, batch_size=self.cell, use_threads=False) if self.files else ():
            held, n = [*held, batch], n + len(batch)
            while n >= self.cell:
                rows = pa.Table.from_batches(held)
                yield rows.slice(0, self.cell)
                held, n = rows.slice(self.cell).to_batches(), n - self.cell
        if n:
            yield pa.Table.from_batches(held)

    def live(self, asked: pd.DataFrame, micros: int, where: pc.Expression | None = None) -> Iterator[pd.DataFrame]:
        """Pieces of the entries that can be live for requests of one key, each in order of time."""
        f, first = pc.field, asked.iloc[0]
        near = (f("key") == first["key"]) & (f("size") == int(first["size"])) & (f("at") >= int(asked["at"].min()) - micros) & (f("at") <= int(asked["at"].max()))
        for piece in self.read(["request_id", "at", "vec"], near if where is None else near & where):
            yield piece.to_pandas().sort_values(["at", "request_id"])


class Vectors:
    """Vectors of a stored table (vec, vector) by number."""

    def __init__(self, table: Table) -> None:
        self.table, self.known, self.held, self.kept = table, np.zeros(0, np.int64), np.zeros((0, 0)), KEPT

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        """A row for each of numbers, which ascend and belong to vectors of one length."""
        new = np.setdiff1d(numbers, self.known, assume_unique=True)
        if len(new):
            f, vecs, rows = pc.field("vec"), [], []
            for part in self.table.read(["vec", "vector"], (f >= int(new[0])) & (f <= int(new[-1]))):
                own = np.flatnonzero(np.isin(part["vec"], new))
                if len(own):
                    vecs.append(part["vec"].to_numpy()[own])
                    rows.append(part["vector"].combine_chunks().take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1))
            if len(self.known) and len(self.known) + len(new) <= max(self.kept, len(numbers)) and self.held.shape[1] == rows[0].shape[1]:
                vecs, rows = [self.known, *vecs], [self.held, *rows]
            elif len(new) < len(numbers):  # start again with what is asked for
                self.known = np.zeros(0, np.int64)
                return self(numbers)
            vecs, rows = np.concatenate(vecs), np.concatenate(rows)
            order = np.argsort(vecs)
            self.known, self.held = vecs[order], rows[order]
        return self.held[np.searchsorted(self.known, numbers)]


def _tasks(df: DataFrame) -> int:
    """Partitions by number, not by their bytes: these are few for the work on them."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _log(requests: DataFrame, vectors: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """All requests, stored in order of key and time, as ROW; and the stored table of their vectors (vec, vector).

    KEY is their key and the length of their vectors, 0 if they can't be compared.  Blocks have at most CELL consecutive
    requests of a key; their numbers rise with time.
    """
    fine, size = F.col("ts").isNotNull() & F.col("key").isNotNull(), F.when(sound(F.col("vector")), F.size("vector")).otherwise(0)
    number = F.monotonically_increasing_id()
    if vectors is not None:
        known = stored(vectors.select("vec_id", size.alias("length"), "vector", number.alias("vec")), "vectors")
        requests, size, held = requests.join(known.select("vec_id", "vec", "length"), "vec_id"), F.col("length"), ["vec"]
    else:
        held = ["vector"]
    size = F.when(fine, size).otherwise(0)
    at = F.when(size > 0, F.unix_micros(F.col("ts").cast("timestamp"))).otherwise(0)
    rows = requests.select("request_id", "key", size.alias("size"), at.alias("at"), *held)
    ordered = rows.repartitionByRange(_tasks(requests), *KEY, "at", "request_id").sortWithinPartitions(*KEY, "at", "request_id").withColumn("block", F.expr(f"monotonically_increasing_id() div {CELL}"))
    log = stored(ordered if vectors is not None else ordered.withColumn("vec", number), "requests")
    return log.select(ROW), (known if vectors is not None else log).select("vec", "vector")


def _parts(batches: Iterable[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Consecutive requests of a key, so many of them at most."""
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + len(batch)
        if n >= most:
            rows = pd.concat(held, ignore_index=True)
            for a in range(0, n - n % most, most):
                yield from (part for _, part in rows.iloc[a : a + most].groupby(KEY, sort=False, dropna=False))
            held, n = [rows.iloc[n - n % most :]], n % most
    if n:
        yield from (part for _, part in pd.concat(held, ignore_index=True).groupby(KEY, sort=False, dropna=False))


def _cells(asked: DataFrame, entries: DataFrame | Table, micros: int, compare: Compare, schema: str, fold: Callable[[pd.DataFrame, Iterable[pd.DataFrame]], pd.DataFrame] | None = None, where: pc.Expression | None = None) -> DataFrame:
    """What `compare` gives for requests of a key, as they are stored, with each piece of the entries that may be live for them.

    `fold` makes one frame of the requests and what they got from all pieces.
    """
    table = entries if isinstance(entries, Table) else Table(entries)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _parts(batches, table.cell):
            found = (compare(part, piece) for piece in (table.live(part, micros, where) if part["size"].iloc[0] else ()))
            if fold:
                yield fold(part, found)
            else:
                yield from found

    return asked.mapInPandas(run, schema)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    return x / np.where((n := np.linalg.norm(x, axis=1)) == 0, 1, n)[:, None]


def _before(asked: pd.DataFrame, entries: pd.DataFrame) -> np.ndarray:
    """How many of the entries, which are in order, come before each request in order of (at, request_id)."""
    at, ids = (np.concatenate([asked[c], entries[c]]) for c in ("at", "request_id"))
    entry = np.arange(len(at)) >= len(asked)
    order = np.lexsort((entry, np.unique(ids, return_inverse=True)[1], at))
    out = np.zeros(len(at), int)
    out[order] = np.cumsum(entry[order])
    return out[: len(asked)]


class Nearest:
    """Nearest live entries of requests: scores in single precision leave the candidates, whose exact scores decide.

    A vector is compared once for all its requests and entries of a scan, as far as these are live for all of it; entries
    whose lifetime begins or ends within a scan are looked at one by one.
    """

    def __init__(self, vectors: DataFrame, micros: int) -> None:
        table = Table(vectors)
        self.asked, self.entries, self.micros, self.scan, self.step = Vectors(table), Vectors(table), micros, SCAN, STEP

    def __call__(self, asked: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        """(similarity, created, entry_id) for each of asked, 0 where none is above 0; the oldest of equals; both in order of time."""
        best, place = np.zeros(len(asked)), np.zeros(len(asked), int)
        at, ids = entries["at"].to_numpy(), entries["request_id"].to_numpy()
        low, high = np.searchsorted(at, asked["at"].to_numpy() - self.micros), _before(asked, entries)
        if len(asked) and len(entries) and (low < high).any():
            numbers, own = np.unique(asked["vec"], return_inverse=True)
            x = _unit(self.asked(numbers))
            numbers, code = np.unique(entries["vec"], return_inverse=True)
            y = _unit(self.entries(numbers))
            sides, x32, y32 = (x, y), x.astype(np.float32), y.astype(np.float32)
            margin = 2e-6 + 2.5e-7 * (x.shape[1] + 8)  # digits that are rounded away, and those that single precision lacks
            for a in range(0, len(asked), self.scan):
                some = slice(a, a + self.scan)
                begin, end, first, last = low[some].min(), high[some].max(), low[some].max(), high[some].min()
                if begin >= end:
                    continue
                if first < last:  # live for the whole scan
                    oldest = np.full(len(numbers), -1)
                    oldest[code[first:last][::-1]] = np.arange(first, last)[::-1]
                    there = np.flatnonzero(oldest >= 0)
                    rows, back = np.unique(own[some], return_inverse=True)
                    score, where = self._best(x32[rows] @ y32[there].T, margin, sides, rows, there, oldest[there])
                    best[some], place[some] = score[back], where[back]
                edge = np.concatenate([np.arange(begin, first), np.arange(last, end)]) if first < last else np.arange(begin, end)
                if len(edge):
                    live = (edge >= low[some, None]) & (edge < high[some, None])
                    scores = np.where(live, x32[own[some]] @ y32[code[edge]].T, -2)
                    score, where = self._best(scores, margin, sides, own[some], code[edge], edge)
                    closer = (score > best[some]) | (score == best[some]) & (where < place[some])
                    best[some], place[some] = np.where(closer, score, best[some]), np.where(closer, where, place[some])
        best[best <= 0] = 0
        return pd.DataFrame({"similarity": best, "created": at[place] if len(at) else 0, "entry_id": ids[place] if len(ids) else asked["request_id"].to_numpy()})

    @staticmethod
    def _best(scores: np.ndarray, margin: float, sides: tuple[np.ndarray, np.ndarray], left: np.ndarray, right: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best exact score of each row, and the least of the places that have it; -2 marks what doesn't count."""
        r, c = np.divmod(np.flatnonzero(scores >= np.maximum(scores.max(1) - margin, -1.5)[:, None]), scores.shape[1])
        pairs, back = np.unique(left[r] * len(sides[1]) + right[c], return_inverse=True)
        exact = np.concatenate([np.einsum("ij,ij->i", sides[0][p // len(sides[1])], sides[1][p % len(sides[1])]) for p in np.array_split(pairs, 1 + len(pairs) // 4096)]).round(6)[back]
        order = np.lexsort((places[c], -exact, r))
        rows, at = np.unique(r[order], return_index=True)
        score, where = np.zeros(len(scores)), np.zeros(len(scores), int)
        score[rows], where[rows] = exact[order][at], places[c][order][at]
        return score, where

    def pairs(self, rows: pd.DataFrame, threshold: float) -> np.ndarray:
        """Which of rows, in order of time, are live for which of them and similar."""
        numbers, own = np.unique(rows["vec"], return_inverse=True)
        x, at = _unit(self.asked(numbers)), rows["at"].to_numpy()
        scores = (x @ x.T).round(6)
        return np.tril(((scores >= threshold) & (scores > 0))[own[:, None], own] & (at[:, None] - at <= self.micros), -1)

    def of_all(self, asked: pd.DataFrame, found: Iterable[pd.DataFrame]) -> pd.DataFrame:
        """The nearest of what was found in several pieces."""
        best = pd.DataFrame({"similarity": 0.0, "created": 0, "entry_id": asked["request_id"].to_numpy()})
        for other in found:
            older = (other["created"] < best["created"]) | (other["created"] == best["created"]) & (other["entry_id"] < best["entry_id"])
            closer = (other["similarity"] > best["similarity"]) | (other["similarity"] == best["similarity"]) & older
            best = best.where(~closer, other)
        return best


def _nearest(asked: DataFrame, entries: DataFrame | Table, vectors: DataFrame, micros: int, where: pc.Expression | None = None) -> DataFrame:
    """(request_id, key, similarity, entry_id) of all requests: the nearest live entry above 0, the oldest of equals; 0 and null without one."""
    kinds, nearest = dict(asked.dtypes), Nearest(vectors, micros)

    def fold(part: pd.DataFrame, found: Iterable[pd.DataFrame]) -> pd.DataFrame:
        best = nearest.of_all(part, found)
        entry = best["entry_id"].astype("Int64" if best["entry_id"].dtype.kind in "iu" else object).mask(best["similarity"] == 0, None)
        return pd.DataFrame({"request_id": part["request_id"].to_numpy(), "key": part["key"].to_numpy(), "similarity": best["similarity"], "entry_id": entry})

    return _cells(asked, entries, micros, nearest, f"request_id {kinds['request_id']}, key {kinds['key']}, similarity double, entry_id {kinds['request_id']}", fold, where)


def history(requests: DataFrame, threshold: float = 0.92, ttl: float = 3600, vectors: DataFrame | None = None) -> DataFrame:
    """(request_id, entry_id, similarity, hit): each request's nearest live one among all requests before it.

    requests (request_id, key, vector, ts), of one key in order of (ts, request_id).  Ages up to ttl seconds live; ties
    go to the older entry; entry_id is null below the threshold.  A request without a key or time, or whose vector is null,
    empty, or holds null or non-finite components, has no nearest one and is none; nor are vectors of other lengths.

    Where requests share vectors, they come with `vec_id` instead and the vectors apart (vec_id, vector); requests whose
    vec_id is not among these are left out.
    """
    rows, known = _log(requests, vectors)
    hit = F.col("similarity") >= threshold
    return _nearest(rows, rows, known, int(ttl * 1_000_000)).select("request_id", F.when(hit, F.col("entry_id")).alias("entry_id"), "similarity", hit.alias("hit"))


def entries(requests: DataFrame, threshold: float, ttl: float, vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The requests that can be compared, in blocks; and those of them that become entries of a cache that runs over them."""
    rows, known = _log(requests, vectors)
    rows = rows.filter("size > 0")
    return rows, _entries(rows, known, threshold, int(ttl * 1_000_000))


def _entries(rows: DataFrame, vectors: DataFrame, threshold: float, micros: int) -> DataFrame:
    """Those of the stored rows that become entries of the cache.

    A request is served by an entry if an earlier live one is similar enough, else it becomes one.  So entries are the
    lexicographically first maximal independent set of the graph that joins similar requests.  Turns settle it, each of
    which takes up the next blocks in order of time, fewer where many requests were left undecided, and more where few:

    1. Requests of these blocks that are similar to an entry of earlier turns are served.
    2. A request waits if an earlier undecided one of another block is similar.
    3. Each block serves its undecided requests in order: one that is similar to a fresh entry is served, one that waits,
       or is similar to a waiting one, stays undecided, any other becomes an entry.
    4. Undecided requests similar to a fresh entry of an earlier block are served; the others are left to the next turn.

    The first block of each key that has undecided requests is always settled, so a turn settles CELL of a key's requests
    at the least, or all that are left of them in such a block.  The driver holds a time for each block.
    """
    spark, nearest, f = rows.sparkSession, Nearest(vectors, micros), pc.field
    kind = {c: dict(rows.dtypes)[c] for c in ROW}
    row = ", ".join(f"`{c}` {t}" for c, t in kind.items())
    similar = lambda best: ((best["similarity"] >= threshold) & (best["similarity"] > 0)).to_numpy()

    def unserved(asked: DataFrame, fresh: list[DataFrame]) -> DataFrame:
        fold = lambda part, found: part[~similar(nearest.of_all(part, found))]
        return _cells(asked, Table(*fresh), micros, nearest, row, fold, f("fresh"))

    def settled(undecided: Table) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(block: pd.DataFrame) -> pd.DataFrame:
            block = block.sort_values(["at", "request_id"]).reset_index(drop=True)
            others = undecided.live(block, micros, f("block") < int(block["block"].iloc[0]))
            waits = similar(nearest.of_all(block, (nearest(block, piece) for piece in others)))
            entry, open_ = np.zeros(len(block), bool), np.zeros(len(block), bool)
            for a in range(0, len(block), step := nearest.step):
                some, done = block.iloc[a : a + step], block.iloc[:a]
                left = ~similar(nearest(some, done[entry[:a]]))
                held = waits[a : a + step] | similar(nearest(some, done[open_[:a]]))
                near, fresh, kept = nearest.pairs(some, threshold), entry[a : a + step], open_[a : a + step]
                for k in np.flatnonzero(left):
                    if not (near[k] & fresh).any():
                        kept[k] = held[k] or (near[k] & kept).any()
                        fresh[k] = not kept[k]
            return block[ROW].assign(fresh=entry)[entry | open_]

        return run

    blocks = sorted((r["at"], r["n"]) for r in rows.groupBy(*KEY, "block").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n")).collect())  # a row a block
    begins, ends = [at for at, _ in blocks], np.cumsum([n for _, n in blocks])
    kept: list[tuple[int, DataFrame]] = []
    undecided, a, take = None, 0, TURN * CELL
    while a < len(begins) or undecided is not None:
        b, turn = max(min(a + 1, len(begins)), int(np.searchsorted(ends, take + (ends[a - 1] if a else 0), "right"))), len(kept)
        paths = [scratch(spark, f"{what}{turn}") for what in ("states", "undecided")]
        with passing(spark):
            tables = [undecided] if undecided is not None else []
            if a < b:
                new = rows.filter(F.col("at") >= begins[a]) if b == len(begins) else rows.filter((F.col("at") >= begins[a]) & (F.col("at") < begins[b]))
                recent = [table for last, table in kept if last >= begins[a] - micros]
                tables.append(stored(unserved(new, recent) if recent else new, "new"))
            asked = tables[0] if len(tables) == 1 else tables[0].union(tables[1])
            states = stored(asked.repartition(_tasks(rows), *KEY, "block").groupBy(*KEY, "block").applyInPandas(settled(Table(*tables)), f"{row}, fresh boolean"), "states", paths[0])
        n, n_open, last = states.agg(F.count(F.lit(1)), F.count_if(~F.col("fresh")), F.max("at")).first()
        kept.append((last if n > n_open else begins[0] - micros - 1, states))
        undecided = None
        if n_open:
            undecided = stored(unserved(states.filter("NOT fresh").select(ROW), [states] if n > n_open else []), "undecided", paths[1])
            undecided = None if undecided.isEmpty() else undecided
        took = (ends[b - 1] if b else 0) - (ends[a - 1] if a else 0)
        a, take = b, max(CELL, take // 2) if 4 * n_open > took else min(2 * take, TURNS * CELL)
    out = rows.filter("false")
    for _, states in kept:
        out = out.union(states.filter("fresh").select(ROW))
    return out


REPLAYED = "request_id long, key string, cache string, similarity double, entry_id long"


def replay(requests: DataFrame, threshold: float = 0.92, ttl: float = 3600, vectors: DataFrame | None = None) -> DataFrame:
    """What a semantic cache does with requests (request_id, key, ts, vector): request_id, key, cache, similarity, entry_id.

    Each key has its own cache and is served in order of (ts, request_id): a request takes the nearest live entry that is
    similar enough (`hit`), or else becomes an entry itself (`miss`).  similarity is that of the nearest live entry, 0 if
    none is above 0.  Requests without a key are left out; those without a time, or whose vector is null, empty, or holds
    null or non-finite components, are misses and no entries.  request_ids must differ.  vectors as in `history`.
    """
    rows, known = _log(requests, vectors)
    micros = int(ttl * 1_000_000)
    kept = stored(_entries(rows.filter("size > 0"), known, threshold, micros).repartitionByRange(*KEY, "at", "request_id").sortWithinPartitions(*KEY, "at", "request_id"), "entries")
    hit = F.col("similarity") >= threshold
    best = _nearest(rows.filter("key is not null"), kept, known, micros)
    return best.select("request_id", "key", F.when(hit, "hit").otherwise("miss").alias("cache"), "similarity", F.when(hit, F.col("entry_id")).alias("entry_id"))
