"""A stored index for exact dense search: clusters with centre and radii, most of which a search never reads.

Unit vectors lie on a sphere, where the cosine falls with the distance.  A vector at distance d of its cluster's centre is
at least |e - d| away from a query at distance e of it, so the distances of a ring of vectors bound their cosines, and what
cannot reach a query's k-th best is skipped: its files are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions.vectors import sound, units
from siftwell.operators.filters import top
from siftwell.sources.scratch import stored

#: Vectors that centres are fitted on, at most; rounds of that; clusters, at most.
SAMPLE, ROUNDS, CLUSTERS = 20_000, 12, 1024
#: Vectors that a task holds at a time; rings that a cluster is cut into, at most; queries that meet them at a time.
PIECE, RINGS, ASKED = 4096, 32, 4096
#: Cosines are rounded to six digits, so one within this of the k-th best may equal it.
MARGIN = 2e-6
#: The cluster of zero vectors, whose cosine with anything is 0.
ZEROS = -1


def centred(x: np.ndarray, clusters: int, seed: int = 0) -> np.ndarray:
    """Centres of unit vectors by k-means; the first ones are drawn apart from each other."""
    rng = np.random.default_rng(seed)
    centres, far = x[rng.integers(len(x), size=1)], np.full(len(x), np.inf)
    while len(centres) < min(clusters, len(x)):
        far = np.minimum(far, np.maximum(2 - 2 * x @ centres[-1], 0))
        if far.max() <= 1e-12:
            break
        centres = np.vstack([centres, x[rng.choice(len(x), p=far / far.sum())]])
    for _ in range(ROUNDS):
        nearest = (x @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        sums, n = np.zeros_like(centres), np.bincount(nearest, minlength=len(centres))
        np.add.at(sums, nearest, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1), 0))


@dataclass
class VectorIndex:
    """vectors (chunk_id, vector, ring, piece, cluster), a folder a cluster; rings (cluster, ring, n, low, high, pieces); centres."""

    vectors: DataFrame
    rings: DataFrame
    centres: DataFrame
    size: int

    @classmethod
    def build(cls, vectors: DataFrame, path: str, clusters: int | None = None) -> VectorIndex:
        """Writes an index of vectors (chunk_id, vector) below `path`.

        Null, empty and non-finite vectors are left out, and so are vectors of another length than the most frequent one
        (the shorter of equally frequent ones).  The number of clusters is the root of the number of vectors, CLUSTERS at
        most; they are fitted on SAMPLE vectors, drawn by a hash of their ids, and take in all.
        """
        spark, fine = vectors.sparkSession, vectors.filter(sound(F.col("vector"))).select("chunk_id", "vector")
        found = fine.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
        size, n = (found["size"], found["n"]) if found else (0, 0)
        fine = fine.filter(F.size("vector") == size)
        some = fine.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).toPandas()["vector"]
        x = np.vstack([x for _, x in units(some)]) if len(some) else np.zeros((0, size))
        x = x[(x != 0).any(1)]
        centres = centred(x, clusters or min(CLUSTERS, max(1, round(n**0.5)))) if len(x) else np.zeros((0, size))
        sent = spark.sparkContext.broadcast(centres)

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at, x in units(batch["vector"]):
                    own = np.full(len(x), ZEROS)
                    far = np.zeros(len(x))
                    some = (x != 0).any(1) if len(sent.value) else np.zeros(len(x), bool)
                    if some.any():
                        d = distances(x[some], sent.value)
                        own[some], far[some] = d.argmin(1), d.min(1)
                    yield batch.iloc[at].assign(cluster=own, far=far)

        kinds = dict(fine.dtypes)
        rows = stored(fine.mapInPandas(assign, f"chunk_id {kinds['chunk_id']}, vector {kinds['vector']}, cluster int, far double"), "assigned")
        spans = rows.groupBy("cluster").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.least(F.lit(RINGS), F.ceil(F.count(F.lit(1)) / PIECE)).alias("n"))
        ring = F.least(F.floor((F.col("far") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-9)) * F.col("n")), F.col("n") - 1).cast("int")
        rows = rows.join(spans, "cluster").select("chunk_id", "vector", "cluster", "far", ring.alias("ring"))
        rings = rows.groupBy("cluster", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("low"), F.max("far").alias("high"))
        rings.withColumn("pieces", F.ceil(F.col("n") / PIECE).cast("int")).write.mode("overwrite").parquet(f"{path}/rings")
        pieces = spark.read.parquet(f"{path}/rings").select("cluster", "ring", "pieces")
        rows = rows.join(pieces, ["cluster", "ring"]).withColumn("piece", F.pmod(F.xxhash64("chunk_id"), F.col("pieces")).cast("int"))
        rows = rows.select("chunk_id", "vector", "ring", "piece", "cluster").repartitionByRange("cluster", "ring", "piece", "chunk_id").sortWithinPartitions("cluster", "ring", "piece")
        rows.write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/vectors")
        table = [(k, c.tolist(), size) for k, c in enumerate(centres)] + [(ZEROS, [0.0] * size, size)]
        spark.createDataFrame(table, "cluster int, centre array<double>, size int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        rows.limit(0).drop("cluster").withColumn("cluster", F.lit(0)).write.mode("overwrite").parquet(f"{path}/schema")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        schema = spark.read.parquet(f"{path}/schema").schema  # an empty index has no files of vectors
        vectors = spark.read.schema(schema).parquet(f"{path}/vectors")
        centres = spark.read.parquet(f"{path}/centres")
        return cls(vectors, spark.read.parquet(f"{path}/rings"), centres, centres.first()["size"])

    def search(self, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
        """hits: the k nearest chunks of each query (qid, vector), exactly, of the chunks in `allowed` (chunk_id) if given.

        Queries that are null, empty, non-finite or of another length than the index have no hits.  Each query first
        reads the rings next to it that hold k vectors; their k-th best cosine then rules out all rings that can't reach
        it.  Scores are rounded to six digits, ties go to the smaller chunk_id.
        """
        return top(self.scores(queries, k, allowed), k, "qid", F.desc("score"), "chunk_id").select("qid", "chunk_id", "score", "rank", F.lit("dense").alias("source"))

    def scores(self, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
        """(qid, chunk_id, score): the k best of each piece that a query reads, and so its k best of all."""
        spark = queries.sparkSession
        fine = queries.filter(sound(F.col("vector")) & (F.size("vector") == self.size)).select("qid", F.col("vector").cast("array<double>").alias("vector"))
        blocks = max(1, -(-fine.count() // ASKED))
        asked = stored(fine.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")), "asked")
        known = spark.sparkContext.broadcast(self._bounds())
        first = self._read(stored(_chosen(asked, known, k), "first"), k, allowed)
        worst = first.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id"))).filter(F.col("nth") == k).select("qid", F.col("score").alias("worst"))
        rest = stored(_chosen(asked.join(worst, "qid", "left"), known, k, again=True), "rest")
        return first.unionByName(self._read(rest, k, allowed))

    def _bounds(self) -> tuple[np.ndarray, pd.DataFrame]:
        """Centres and rings; their number is bounded by CLUSTERS and RINGS."""
        centres = self.centres.filter(F.col("cluster") != ZEROS).orderBy("cluster").toPandas()["centre"]
        return np.array(list(centres), float).reshape(-1, max(self.size, 1)), self.rings.orderBy("cluster", "ring").toPandas()

    def _read(self, pairs: DataFrame, k: int, allowed: DataFrame | None) -> DataFrame:
        """The k best of each piece of the rings in pairs (qid, vector, block, cluster, ring), stored."""
        wanted = [r[0] for r in pairs.select("cluster").distinct().collect()]  # CLUSTERS at most
        ring = ["cluster", "ring"]
        cell = [*ring, "piece", "block"]
        pieces = self.rings.select(*ring, F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
        meets = pairs.select(*ring, "block").distinct().join(pieces, ring)
        items = self.vectors.filter(F.col("cluster").isin(wanted)) if wanted else self.vectors.limit(0)
        if allowed is not None:
            items = items.join(allowed.select("chunk_id"), "chunk_id", "left_semi")
        items = items.join(meets, [*ring, "piece"])
        items = items.toDF(*items.columns)
        kinds = dict(pairs.dtypes)["qid"], dict(items.dtypes)["chunk_id"]

        def best(asked: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
            out = pd.DataFrame({"qid": asked["qid"].iloc[:0], "chunk_id": items["chunk_id"].iloc[:0], "score": np.zeros(0)})
            if not len(asked) or not len(items):
                return out
            x, q = (_rows(f["vector"]) for f in (items, asked))
            scores, ids = (q @ x.T).round(6), items["chunk_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            scores, ids = scores[:, order], ids[order]  # a stable sort then leaves ties by id
            near = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            return pd.DataFrame({"qid": np.repeat(asked["qid"].to_numpy(), near.shape[1]), "chunk_id": ids[near].ravel(), "score": np.take_along_axis(scores, near, 1).ravel()})

        asked = pairs.join(pieces, ring)
        found = asked.groupBy(*cell).cogroup(items.groupBy(*cell)).applyInPandas(best, f"qid {kinds[0]}, chunk_id {kinds[1]}, score double")
        return stored(found, "scores")


def _rows(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_list()).astype(float)
    return x / np.where((n := np.linalg.norm(x, axis=1)) == 0, 1, n)[:, None]


def _reach(q: np.ndarray, centres: np.ndarray, rings: pd.DataFrame) -> np.ndarray:
    """The highest cosine that each query can have with a vector of each ring."""
    own, low, high = (rings[c].to_numpy() for c in ("cluster", "low", "high"))
    e = distances(q, centres)[:, np.maximum(own, 0)] if len(centres) else np.zeros((len(q), len(own)))
    near = np.maximum(np.maximum(e - high, low - e), 0)
    reach = 1 - near**2 / 2
    return np.where((own == ZEROS) | (q == 0).all(1)[:, None], 0.0, reach)


def _chosen(asked: DataFrame, known: Broadcast, k: int, again: bool = False) -> DataFrame:
    """(qid, vector, block, cluster, ring): the rings nearest to each query that hold k vectors; or, `again`, all others that may reach its k-th best."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, rings = known.value
        for batch in batches:
            for a in range(0, len(batch), 256):
                some = batch.iloc[a : a + 256]
                reach = _reach(_rows(some["vector"]), centres, rings)
                order = np.argsort(-reach, axis=1, kind="stable")
                full = np.cumsum(rings["n"].to_numpy()[order], axis=1)
                need = np.zeros(reach.shape, bool)
                np.put_along_axis(need, order, np.pad(full, ((0, 0), (1, 0)))[:, :-1] < k, 1)
                if again:
                    need = ~need & (reach >= some["worst"].fillna(-2.0).to_numpy()[:, None] - MARGIN)
                row, ring = np.nonzero(need)
                yield pd.DataFrame({"qid": some["qid"].to_numpy()[row], "vector": some["vector"].to_numpy()[row], "block": some["block"].to_numpy()[row], "cluster": rings["cluster"].to_numpy()[ring], "ring": rings["ring"].to_numpy()[ring]})

    return asked.mapInPandas(run, f"qid {dict(asked.dtypes)['qid']}, vector array<double>, block int, cluster int, ring int")
