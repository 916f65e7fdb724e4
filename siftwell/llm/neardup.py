"""Near-duplicate documents by MinHash with tensored banding, links confirmed on whole shingle sets.

A document's signature is two small collections of sub-keys, each made of a few minhashes.  A table key is a pair of
one sub-key from either collection, so SIDE sub-keys a side give SIDE * SIDE tables, while minhashes grow with SIDE
only.  Documents with equal sets are one node.  Sub-keys that no other node has are dropped before pairs are formed.

Nodes that share a bucket are candidates.  A bucket of any size is settled without all its pairs.  In rounds, nodes
are compared with a few of their buckets' nodes, components are formed, and buckets that lie in one component are
done.  Then nodes go that share too few shingles with all other components together to be linked to any.  What is
left are groups of texts much alike, but not enough.  There each node is written as its differences from the group's
central node; two nodes that are linked, but not both with it, must agree on many differences, so on one of the
first few in a common order, rare ones first, and they meet by that.  So every candidate pair is confirmed, rejected,
ruled out by a bound, or connected already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import Words, mixed, rolled, slices, stored
from siftwell.llm.graph import components

#: Sub-keys in either collection, minhashes in a sub-key.  A pair at similarity 0.8 is missed with a chance of
#: 2 * (1 - 0.8 ** ROWS) ** SIDE = 0.0002, at 0.85 below 0.00001; at 0.2 it is a candidate with a chance of 1 %.
SIDE, ROWS = 13, 3
#: Rounds against a few nodes of other components, at most, and nodes that a node meets in a round; rounds end
#: early when less than this share of pairs is a link.
PIVOT_ROUNDS, PIVOTS, LEAST_GAIN = 4, 3, 0.05
#: Shingles of at least COMMON nodes, of which MOST_COMMON at most, are looked up in each task.
COMMON, MOST_COMMON = 256, 20_000


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; a text with fewer words has its whole sequence as one."""
    w = Words(texts, lower=True)
    h = w.hashes()
    runs = rolled(h, width)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        else:
            out.append(mixed(rolled(h[a:b], b - a)[:1] + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n] | np.uint64(1), seeds[n:]


def sub_keys(sets: list[np.ndarray]) -> np.ndarray:
    """2 * SIDE sub-keys of each (non-empty) set."""
    values = np.concatenate(sets)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    factor, plus = _factors(2 * SIDE * ROWS)
    keys = np.zeros((len(sets), 2 * SIDE), np.uint64)
    for k in range(2 * SIDE * ROWS):
        keys[:, k // ROWS] = mixed(keys[:, k // ROWS] + np.minimum.reduceat(mixed_low(values * factor[k] + plus[k]), at))
    return keys


def mixed_low(h: np.ndarray) -> np.ndarray:
    return h ^ (h >> np.uint64(32))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, h1 and h2 (of the set; null if empty), keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = shingle_sets(part.column(1), width)
                n = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(n)
                keys, sums = [None] * len(sets), np.zeros((len(sets), 2), np.int64)
                if len(some):
                    for k, row in zip(some.tolist(), sub_keys([sets[k] for k in some]).view(np.int64), strict=True):
                        keys[k] = row
                        sums[k] = np.frombuffer(hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest(), np.int64)
                none = n == 0
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(sums[:, 0], mask=none), pa.array(sums[:, 1], mask=none), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "h1", "h2", "keys"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text) to (node, hashes): the set as sorted 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1), width)], pa.binary())], ["node", "hashes"])

    return docs.mapInArrow(run, "node long, hashes binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * shared >= percent * all shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _buckets(nodes: DataFrame) -> DataFrame:
    """(node, n, keys) to (node, key, n, near): table keys that several nodes have.

    `near` counts the nodes met in all of a node's buckets: those at the centre of a group meet most.
    """
    subs = nodes.select("node", "n", F.posexplode("keys").alias("at", "value"))
    shared = subs.groupBy("at", "value").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    kept = subs.join(shared, ["at", "value"]).groupBy("node", "n").agg(F.collect_list(F.struct("at", "value")).alias("subs"))
    left, right = F.filter("subs", lambda s: s["at"] < SIDE), F.filter("subs", lambda s: s["at"] >= SIDE)
    pairs = F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: F.xxhash64(x["at"], x["value"], y["at"], y["value"]))))
    rows = stored(kept.select(F.explode(pairs).alias("key"), "node", "n"), "table_keys")
    several = rows.groupBy("key").agg(F.min("node").alias("_a"), F.max("node").alias("_b"), F.count(F.lit(1)).alias("size")).filter("_a < _b").select("key", "size")
    rows = stored(rows.join(several, "key"), "shared_keys")
    return rows.drop("size").join(rows.groupBy("node").agg(F.sum("size").alias("near")), "node")


def _merged(owner: DataFrame, links: DataFrame) -> DataFrame:
    """owner (node, component) after more links (a, b): components that a link joins get the smaller one's name."""
    a, b = (owner.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
    joined = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    return owner if links.isEmpty() else stored(_renamed(owner, components(joined)), "owners")


def _renamed(owner: DataFrame, found: DataFrame) -> DataFrame:
    new = found.select(F.col("node").alias("component"), F.col("component").alias("new"))
    inside = owner.join(new, "component", "left").select("node", F.coalesce("new", "component").alias("component"))
    # ids that are in links only
    return inside.unionByName(found.join(owner.select("node"), "node", "left_anti").select("node", "component"))


def _open(buckets: DataFrame, owner: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components, with the node's component c."""
    held = buckets.join(owner, "node").select("key", "node", "n", "near", F.col("component").alias("c"))
    mixed_ = held.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("key")
    return held.join(mixed_, "key")


def _named(rows: DataFrame, owner: DataFrame, node: str, component: str) -> DataFrame:
    return rows.join(owner.select(F.col("node").alias(node), F.col("component").alias(component)), node)


def _fits(n: str, m: str, percent: int) -> Column:
    return F.expr(f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})")


def _pivot_pairs(held: DataFrame, percent: int, turn: int) -> DataFrame:
    """Each node with at most PIVOTS nodes of other components: those that its buckets put first.

    On the first turn central nodes are first, later it is by a hash of the turn.
    """
    order = F.xxhash64("node", F.lit(turn)) if turn else -F.col("near")
    first = held.groupBy("key").agg(F.min(F.struct(order.alias("h"), "node", "n", "c")).alias("p"))
    met = held.join(first, "key").filter("c <> p.c").filter(_fits("n", "p.n", percent))
    chosen = met.groupBy("node").agg(F.slice(F.array_sort(F.collect_set(F.struct("p.h", "p.node"))), 1, PIVOTS).alias("ps"))
    return _pairs(chosen.select("node", F.explode("ps.node").alias("other")))


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _untested(pairs: DataFrame, tested: DataFrame | None) -> DataFrame:
    return stored(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")


def _reachable(held: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, own): the shingles h that a node shares with other components at all, rare ones first, if enough for a link.

    A link needs at least `percent` of a node's shingles in the other one; shingles that only the node's own
    component has are in none.  Shingles of very many nodes are few, go to all tasks, and meet nowhere.
    """
    nodes = held.select("node", "n", "c").distinct()

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3):
                size = pc.binary_length(part.column(3)).to_numpy(zero_copy_only=False) // 8
                at = pa.array(np.repeat(np.arange(len(part)), size))
                hashes = np.frombuffer(b"".join(part.column(3).to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(at) for k in range(3)), pa.array(hashes)], ["node", "n", "c", "h"])

    rows = nodes.join(sets, "node").select("node", "n", "c", "hashes").mapInArrow(spelled, "node long, n long, c long, h long")
    several = rows.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("f")).filter("low < high")
    abroad = stored(several.select("f", "h"), "shingles")
    common = abroad.filter(F.col("f") >= COMMON).orderBy(F.desc("f")).limit(MOST_COMMON).collect()
    common = F.broadcast(abroad.sparkSession.createDataFrame(common, abroad.schema))  # at most MOST_COMMON rows
    near = rows.join(common, "h").select("node", "n", "f", "h")
    far = rows.join(common, "h", "left_anti").join(abroad.hint("merge"), "h").select("node", "n", "f", "h")
    shared = near.union(far).groupBy("node", "n").agg(F.array_sort(F.collect_set(F.struct("f", "h"))).alias("own"))
    return shared.filter(F.expr(f"100 * size(own) >= {percent} * n")).select("node", "own")


def _stars(held: DataFrame) -> DataFrame:
    """(p, pn, node, n): the nodes of each bucket with its central node p."""
    first = held.groupBy("key").agg(F.min(F.struct((-F.col("near")).alias("h"), "node", "n")).alias("p"))
    met = held.join(first, "key").filter("node <> p.node")
    return met.select(F.col("p.node").alias("p"), F.col("p.n").alias("pn"), "node", "n").distinct()


def _differences(stars: DataFrame, sets: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """(p, e, node, n, c, d, m, at, index): shingles e by which a node differs from p, as far as links need them.

    d counts the shingles that only one of node and p has, m those of them that another component's node may differ
    by too.  Nodes x, y differ from each other by what only one of them differs from p by.  A link allows them
    (100 - percent) / (100 + percent) of their sizes' sum, so they must agree on the rest, which is never nothing:
    where it could be, both are linked with p.  So, if all differences stand in one order, rare ones first, the first
    one that they agree on is among the first few of either, and among fewer still (index) of the one with smaller d.
    """
    centres = sets.select(F.col("node").alias("p"), F.col("hashes").alias("x"))
    rows = stars.join(own, "node").join(sets.withColumnRenamed("hashes", "y"), "node").join(centres, "p")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch, 2)):
            ids, which = np.unique(part.column(0).to_numpy(), return_inverse=True)
            lost: list[list[np.ndarray]] = [[] for _ in ids]
            for k, x, y in zip(which.tolist(), part.column(1), part.column(2), strict=True):
                lost[k].append(np.setdiff1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True))
            e, f = zip(*(np.unique(np.concatenate(x), return_counts=True) for x in lost), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(ids, [len(x) for x in e]), np.concatenate(e).view(np.int64), np.concatenate(f))], ["p", "e", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch, 5)):
            out: list[tuple[np.ndarray, ...]] = []
            n = part.column(2).to_numpy()
            for k, (x, y, own, lost) in enumerate(zip(*(part.column(c) for c in range(4, 8)), strict=True)):
                centre, whole = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                e, f = (np.concatenate([own.values.field(c).to_numpy(), lost.values.field(c).to_numpy() if lost.is_valid else np.zeros(0, np.int64)]) for c in ("h", "f"))
                differ = np.isin(e, whole) ^ np.isin(e, centre)
                e, f = e[differ], f[differ]
                d, m = len(np.setxor1d(centre, whole, assume_unique=True)), len(e)
                some = min(m, m - d + int(n[k]) * (100 - percent) // percent + 1)
                few = m - d + int(n[k]) * (100 - percent) // (2 * percent) + 1
                if some > 0:
                    at = np.arange(some)
                    out.append((np.full(some, k), e[np.lexsort((e, f))[:some]], np.full(some, d), np.full(some, m), at, at < few))
            if out:
                k, *rest = map(np.concatenate, zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(k)) for c in range(4)), *map(pa.array, rest)], ["p", "node", "n", "c", "e", "d", "m", "at", "index"])

    # of p's own shingles, so no more than it has
    lost = rows.select("p", "x", "y").mapInArrow(counted, "p long, e long, f long").groupBy("p", "e").agg(F.sum("f").alias("f"))
    lost = lost.groupBy("p").agg(F.collect_list(F.struct("f", F.col("e").alias("h"))).alias("lost"))
    return rows.join(lost, "p", "left").select("p", "node", "n", "c", "x", "y", "own", "lost").mapInArrow(run, "p long, node long, n long, c long, e long, d long, m long, at long, index boolean")


def _agreeing(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components with a difference in common, the first of all by which they may be linked."""
    other = rows.filter("index").select("p", "e", *(F.col(k).alias(f"{k}2") for k in ("node", "n", "c", "d", "m", "at")))
    enough = F.expr(f"2 * {100 + percent} * least(m - at, m2 - at2) >= {100 + percent} * (d + d2) - {100 - percent} * (n + n2)")
    met = rows.join(other, ["p", "e"]).filter("c <> c2 and d >= d2").filter(_fits("n", "n2", percent)).filter(enough)
    return _pairs(met.select("node", F.col("node2").alias("other")))


def linked(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """One row per row of docs (doc_id, text; other columns are ignored): doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of distinct shingles of `width` words,
    A-Z lower-cased; component_id is the smallest doc_id reachable over links, itself included, and kept means that
    it is the document's own.  Texts without a word (null, empty) have an empty set and are linked with nothing.
    Rows with one doc_id are one vertex.  Rows with a null doc_id take no part: null component_id, kept true.  Repeated
    rows give a row each; equal texts share a node, so ties between them don't arise; an empty table gives no rows.  A
    very long text is held by one task as a whole, with the hashes of its shingles.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(signatures(rows, width), "signatures")
    live = signed.filter("h1 is not null and doc_id is not null")
    classes = live.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"))
    members = stored(live.join(classes, ["h1", "h2"]).select("doc_id", "node", F.col("n_shingles").alias("n"), F.when(F.col("doc_id") == F.col("node"), F.col("keys")).alias("keys")), "members")
    # a doc_id with several texts joins the nodes of all of them
    repeated = members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b").select("doc_id")
    links = members.join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    nodes = members.filter("keys is not null").select("node", "n", "keys").distinct()
    buckets = stored(_buckets(nodes), "buckets")
    wanted = buckets.select(F.col("node").alias("doc_id")).distinct()
    sets = stored(full_sets(rows.join(wanted, "doc_id", "left_semi"), width).distinct(), "sets")

    owner = stored(wanted.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("component")), "owners")
    owner = _merged(owner, links)
    tested = None

    def compared(pairs: DataFrame) -> tuple[int, int]:
        nonlocal owner, tested
        pairs = _untested(pairs, tested)
        tested = pairs if tested is None else tested.union(pairs)
        found = stored(confirmed(pairs, sets, percent), "links")
        owner = _merged(owner, found)
        return pairs.count(), found.count()

    for turn in range(PIVOT_ROUNDS):
        asked, found = compared(_pivot_pairs(_open(buckets, owner), percent, turn))
        if found < LEAST_GAIN * asked + 1:
            break
    # what is left meets by one collection's sub-keys: fewer and larger buckets that hold all pairs of the tables'
    held = stored(_open(buckets, owner).select("node", "n", "near", "c", "key"), "open")
    own = stored(_reachable(held, sets, percent), "reachable")
    left = held.select("node", "n", "near").distinct().join(own.select("node"), "node").join(nodes.select("node", "keys"), "node")
    held = left.select(F.posexplode(F.slice("keys", 1, SIDE)).alias("at", "value"), "node", "n", "near").withColumn("key", F.xxhash64("at", "value")).drop("at", "value")
    stars = stored(_stars(stored(_open(held, owner), "open")), "stars")
    met = _named(_named(stars, owner, "node", "c"), owner, "p", "pc").filter("c <> pc").filter(_fits("n", "pn", percent))
    compared(_pairs(met.select("node", F.col("p").alias("other"))))
    several = _named(stars, owner, "node", "c").groupBy("p").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("p")
    compared(_agreeing(stored(_differences(_named(stars.join(several, "p", "left_semi"), owner, "node", "c"), sets, own, percent), "differences"), percent))
    of = members.join(owner, "node", "left").select("doc_id", F.coalesce("component", "node").alias("c"))
    of = of.groupBy("doc_id").agg(F.min("c").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(of, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def representatives(docs: DataFrame, width: int = 5, percent: int = 80, texts: bool = False) -> DataFrame:
    """The rows of docs that stay if each component keeps its smallest doc_id; of rows with that doc_id, one each.

    With `texts`, each distinct (doc_id, set of shingles) is a vertex of its own, so that rows of one doc_id whose
    texts are not linked stay.
    """
    if texts and not _several_texts(docs).isEmpty():
        return _by_text(docs, width, percent)
    kept = linked(docs, width, percent).filter("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    # join and window need the same partitioning, so texts move once
    named = rows.filter("id is not null").join(kept, F.col("id") == F.col("kept_id"), "left_semi")
    copy = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("row")))
    named = named.withColumn("copy", copy).filter("copy = 1").select("row.*")
    return named.union(rows.filter("id is null").select("row.*"))


def _several_texts(docs: DataFrame) -> DataFrame:
    text = F.xxhash64("text")
    return docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(text).alias("low"), F.max(text).alias("high")).filter("low < high")


def _by_text(docs: DataFrame, width: int, percent: int) -> DataFrame:
    numbered = stored(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("vertex")), "vertices")
    rows = numbered.select("row", "vertex", F.col("row.doc_id").cast("long").alias("id"))
    named = rows.filter("id is not null")
    found = linked(named.select(F.col("vertex").alias("doc_id"), "row.text"), width, percent)
    found = found.select(F.col("doc_id").alias("vertex"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("group"))
    # texts without a word are linked with nothing, but equal within a doc_id
    keyed = named.select("vertex", "id", F.xxhash64("row").alias("h")).join(found, "vertex").withColumn("alone", F.when(F.col("group").isNull(), F.col("id")))
    kept = keyed.groupBy("group", "alone").agg(F.min(F.struct("id", "h", "vertex")).alias("first")).select(F.col("first.vertex").alias("vertex"))
    return named.join(kept, "vertex", "left_semi").select("row.*").union(rows.filter("id is null").select("row.*"))
