"""An index that changes: segments, tombstones and corrected statistics, in versions that readers are pinned to.

An upsert writes one segment of its chunks and one table of tombstones for what it replaces, so it costs as much as its
chunks, not as the index.  Searches rank the live chunks of all segments under statistics that count each live chunk once,
as an index built afresh would.  Compaction writes live chunks into one segment.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.vectors import hash_embed
from siftwell.operators import dense, lexical
from siftwell.operators.block_index import BlockIndex, weighted
from siftwell.operators.filters import Filter
from siftwell.sources.scratch import stored
from siftwell.sources.versions import Versions

Embed = Callable[[DataFrame], DataFrame]


def embed(chunks: DataFrame) -> DataFrame:
    return hash_embed(chunks, "chunk_id", "text")


@dataclass
class Snapshot:
    """One version of an index: what it holds doesn't change, whatever is committed after it."""

    spark: SparkSession
    path: str
    version: int
    manifest: dict

    def _table(self, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{part}")

    def _dead(self, segment: str) -> DataFrame | None:
        """Chunks (chunk_id) of a segment that are deleted or replaced."""
        tombs = [t["id"] for t in self.manifest["tombs"] if segment in t["counts"]]
        parts = [self._table(f"tombs/{t}/ids").filter(F.col("segment") == segment).select("chunk_id") for t in tombs]
        return reduce(DataFrame.union, parts) if parts else None

    def _live(self, segment: str, table: DataFrame) -> DataFrame:
        dead = self._dead(segment)
        return table if dead is None else table.join(dead, "chunk_id", "left_anti")

    def _all(self, name: str) -> DataFrame | None:
        parts = [self._live(s["id"], self._table(f"segments/{s['id']}/{name}")) for s in self.manifest["segments"]]
        return reduce(DataFrame.unionByName, parts) if parts else None

    @property
    def chunks(self) -> DataFrame | None:
        """All live chunks; None in an index that never had any."""
        return self._all("chunks")

    def stats(self) -> tuple[int, int]:
        """The number of live chunks, and the sum of their lengths in tokens."""
        gone = [c for t in self.manifest["tombs"] for c in t["counts"].values()]
        return tuple(sum(s[k] for s in self.manifest["segments"]) - sum(c[i] for c in gone) for i, k in enumerate(("n", "total")))

    def terms(self) -> DataFrame:
        """(term, df) over live chunks."""
        parts = [self._table(f"segments/{s['id']}/lexical/terms").select("term", "df") for s in self.manifest["segments"]]
        parts += [self._table(f"tombs/{t['id']}/terms").select("term", (-F.col("df")).alias("df")) for t in self.manifest["tombs"]]
        return reduce(DataFrame.union, parts).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    def sparse(self, queries: DataFrame, k: int, where: Filter | None = None) -> DataFrame:
        """hits: the k best live chunks of each query (qid, query) by BM25."""
        n, total = self.stats()
        if not n:
            return lexical.ranked(queries.select("qid", F.lit(None).alias("chunk_id"), F.lit(0.0).alias("score")).limit(0), k)
        asked = stored(weighted(lexical.query_terms(queries), self.terms(), n), "asked")
        found = []
        for s in self.manifest["segments"]:
            index, chunks = BlockIndex.load(self.spark, f"{self.path}/segments/{s['id']}/lexical"), self._table(f"segments/{s['id']}/chunks")
            open_ = None
            if where is not None or self._dead(s["id"]) is not None:
                open_ = self._live(s["id"], where(chunks) if where else chunks).select("chunk_id")
            found.append(index.scores(asked, k, total / n if total else 1.0, open_))
        return lexical.ranked(reduce(DataFrame.unionByName, found), k)

    def dense(self, asked: DataFrame, k: int, where: Filter | None = None) -> DataFrame:
        """hits: the k nearest live chunks of each query (qid, vector)."""
        vectors = self._all("vectors")
        if where is not None:
            vectors = vectors.join(where(self.chunks).select("chunk_id"), "chunk_id", "left_semi")
        return dense.search(asked, vectors, k)


@dataclass
class IndexStore:
    """The versions of an index below `path`.  Writers that meet get versions.Conflict; the later one does its work again."""

    spark: SparkSession
    path: str
    embed: Embed = embed

    @property
    def versions(self) -> Versions:
        return Versions(self.spark, f"{self.path}/versions")

    def snapshot(self, version: int | None = None) -> Snapshot:
        """A version of the index, the present one if not said."""
        version = self.versions.latest() if version is None else version
        manifest = self.versions.read(version) if version else {"segments": [], "tombs": []}
        return Snapshot(self.spark, self.path, version, manifest)

    def upsert(self, chunks: DataFrame) -> int:
        """Adds chunks (chunk_id, text and metadata, of the same columns each time), in place of those with their ids; the new version.

        chunk_ids are distinct and not null.
        """
        now = self.snapshot()
        segment = self._segment(chunks)
        tombs = self._tombs(now, self.spark.read.parquet(f"{self.path}/segments/{segment['id']}/chunks").select("chunk_id"))
        return self.versions.commit({"segments": [*now.manifest["segments"], segment], "tombs": now.manifest["tombs"] + tombs}, now.version)

    def delete(self, ids: DataFrame) -> int:
        """Takes out the chunks of ids (chunk_id); unknown ones are passed over."""
        now = self.snapshot()
        tombs = self._tombs(now, stored(ids.select("chunk_id").distinct(), "ids"))
        return self.versions.commit(now.manifest | {"tombs": now.manifest["tombs"] + tombs}, now.version)

    def compact(self, most: int | None = None) -> int:
        """Writes the live chunks of segments of at most `most` chunks (all, if not said) into one segment."""
        now = self.snapshot()
        old = [s["id"] for s in now.manifest["segments"] if most is None or s["n"] <= most]
        if not old:
            return now.version
        part = Snapshot(self.spark, self.path, now.version, now.manifest | {"segments": [s for s in now.manifest["segments"] if s["id"] in old]})
        kept = [s for s in now.manifest["segments"] if s["id"] not in old]
        segment = self._segment(part.chunks)
        # tombstones of segments that stay are written anew, without the others
        dead = [now._dead(s["id"]) for s in kept]
        ids = [d for d in dead if d is not None]
        bare = Snapshot(self.spark, self.path, now.version, {"segments": kept, "tombs": []})
        tombs = self._tombs(bare, stored(reduce(DataFrame.union, ids).distinct(), "ids"), [s for s, d in zip(kept, dead, strict=True) if d is not None]) if ids else []
        return self.versions.commit({"segments": [*kept, segment], "tombs": tombs}, now.version)

    def restore(self, version: int) -> int:
        """Makes an earlier version the present one again, as a new version."""
        return self.versions.commit(self.versions.read(version), self.versions.latest())

    def _segment(self, chunks: DataFrame) -> dict:
        name = uuid.uuid4().hex
        folder = f"{self.path}/segments/{name}"
        chunks.write.parquet(f"{folder}/chunks")
        own = self.spark.read.parquet(f"{folder}/chunks")
        index = BlockIndex.build(own, f"{folder}/lexical")
        self.embed(own).write.parquet(f"{folder}/vectors")
        return {"id": name, "n": index.stats[0], "total": index.stats[1]}

    def _tombs(self, now: Snapshot, ids: DataFrame, segments: list[dict] | None = None) -> list[dict]:
        """Tombstones for the live chunks that have one of ids (chunk_id), and the statistics that go with them."""
        found = []
        for s in segments or now.manifest["segments"]:
            docs = now._live(s["id"], self.spark.read.parquet(f"{self.path}/segments/{s['id']}/lexical/docs"))
            found.append(docs.join(ids, "chunk_id", "left_semi").select(F.lit(s["id"]).alias("segment"), "chunk_id", "dl"))
        if not found:
            return []
        name = uuid.uuid4().hex
        folder = f"{self.path}/tombs/{name}"
        reduce(DataFrame.union, found).write.parquet(f"{folder}/ids")
        dead = self.spark.read.parquet(f"{folder}/ids")
        counts = {r["segment"]: [r["n"], r["total"]] for r in dead.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total")).collect()}  # a row a segment
        if not counts:
            return []
        words = [BlockIndex.load(self.spark, f"{self.path}/segments/{s}/lexical").frequencies(dead.filter(F.col("segment") == s)) for s in counts]
        reduce(DataFrame.union, words).groupBy("term").agg(F.sum("df").alias("df")).write.parquet(f"{folder}/terms")
        return [{"id": name, "counts": counts}]


@dataclass
class Alias:
    """A name that queries use, and the index behind it: a blue one, then a green one.

    A switch is one atomic commit; other sessions see it as they next ask, and readers that hold a snapshot keep it.
    """

    spark: SparkSession
    path: str

    def switch(self, index: str, version: int | None = None) -> int:
        """Points the alias at a version (the present one, if not said) of the index at the path `index`."""
        store = IndexStore(self.spark, index)
        known = Versions(self.spark, self.path)
        return known.commit({"index": index, "version": store.versions.latest() if version is None else version}, known.latest())

    def snapshot(self, switched: int | None = None) -> Snapshot:
        """What the alias points at, or pointed at after its `switched`-th switch."""
        known = Versions(self.spark, self.path)
        if not (number := known.latest() if switched is None else switched):
            raise LookupError(f"the alias {self.path} points at nothing yet")
        to = known.read(number)
        return IndexStore(self.spark, to["index"]).snapshot(to["version"])

    def both(self, search: Callable[[Snapshot], DataFrame]) -> tuple[DataFrame, DataFrame]:
        """A search of what the alias pointed at before the last switch, and of what it points at now."""
        number = Versions(self.spark, self.path).latest()
        return search(self.snapshot(max(1, number - 1))), search(self.snapshot(number))
