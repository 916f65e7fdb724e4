"""A cache of embeddings in buckets, with Bloom filters in front: lookups shuffle what they ask for, never the cache."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.vectors import cache_key, embed
from siftwell.sources.scratch import stored

#: Bits a key and hashes of a key: about one in a hundred absent keys passes.  Keys of one filter, some.
BITS, HASHES, FILTERED = 10, 7, 100_000


def places(keys: pd.Series, size: int) -> np.ndarray:
    """The bits of each key (40 hexadecimal digits), a row a key."""
    a, b = (np.array([int(k[i : i + 15], 16) for k in keys], np.uint64) for i in (0, 15))
    return ((a[:, None] + np.arange(HASHES, dtype=np.uint64) * (b[:, None] | np.uint64(1))) % np.uint64(size)).astype(np.int64)


def filtered(keys: pd.Series) -> bytes:
    size = max(64, -(-len(keys) * BITS // 8) * 8)
    bits = np.zeros(size, bool)
    bits[places(keys, size).ravel()] = True
    return np.packbits(bits).tobytes()


def passing(keys: pd.Series, filters: list[bytes]) -> np.ndarray:
    """Whether each key may be in one of the filters."""
    out = np.zeros(len(keys), bool)
    for data in filters:
        bits = np.unpackbits(np.frombuffer(data, np.uint8)).astype(bool)
        out |= bits[places(keys, len(bits))].all(1)
    return out


@dataclass
class EmbeddingCache:
    """Rows (k, v) below `path`, in `buckets` buckets by k, and filters (bucket, bits) of what each append has added.

    The number of buckets is fixed with the first append; keys come from vectors.cache_key.
    """

    spark: SparkSession
    path: str
    buckets: int = 64

    @property
    def rows(self) -> DataFrame:
        """The cache, as a table that Spark knows to be in buckets."""
        name = f"siftwell_cache_{hashlib.md5(self.path.encode()).hexdigest()}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (k STRING, v ARRAY<FLOAT>) USING parquet CLUSTERED BY (k) SORTED BY (k) INTO {self.buckets} BUCKETS LOCATION '{self.path}/rows'")
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name)

    def _bucket(self) -> Column:
        return F.pmod(F.hash("k"), F.lit(self.buckets)).alias("bucket")

    def append(self, fresh: DataFrame) -> None:
        """Adds rows (k, v) of keys that the cache lacks; filters come first, so that no row is ever behind none."""
        fresh = stored(fresh.select("k", F.col("v").cast("array<float>").alias("v")), "fresh")
        if not (n := fresh.count()):
            return
        pieces = -(-n // (self.buckets * FILTERED))
        keys = fresh.select("k", self._bucket(), F.pmod(F.xxhash64("k"), F.lit(pieces)).alias("piece"))
        made = keys.groupBy("bucket", "piece").applyInPandas(lambda own: pd.DataFrame({"bucket": [own["bucket"].iloc[0]], "bits": [filtered(own["k"])]}), "bucket int, bits binary")
        made.write.mode("append").parquet(f"{self.path}/filters")
        self.rows.limit(0)  # makes the table known
        fresh.repartition(self.buckets, "k").sortWithinPartitions("k").write.insertInto(f"siftwell_cache_{hashlib.md5(self.path.encode()).hexdigest()}")

    def maybe(self, keys: DataFrame) -> DataFrame:
        """Those of keys (k) that the filters let pass: all that the cache has, and one in a hundred of the others."""
        from pyspark.errors import AnalysisException

        try:
            filters = self.spark.read.schema("bucket int, bits binary").parquet(f"{self.path}/filters")
        except AnalysisException:  # nothing was ever added
            return keys.select("k").limit(0)

        def some(own: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            return own.loc[passing(own["k"], filters["bits"].tolist()) if len(own) else [], ["k"]]

        return keys.select("k", self._bucket()).groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(some, "k string")

    def found(self, keys: DataFrame) -> DataFrame:
        """(k, v) of keys (k), distinct ones, that the cache has: the cache is joined bucket by bucket, where it lies."""
        return self.maybe(keys).join(self.rows.hint("merge"), "k")

    def embed(self, rows: DataFrame, model: str, key: str, text: str, provider: Callable[[list[str]], np.ndarray]) -> tuple[DataFrame, DataFrame]:
        """(key, vector) for all rows, and the new cache rows (k, v): only texts that the cache lacks are embedded, once each.

        The new rows aren't added yet.  A null text is an empty one.
        """
        keyed = rows.select(key, F.coalesce(text, F.lit("")).alias("_text"))
        keyed = keyed.withColumn("k", cache_key(model, F.col("_text")))
        asked = stored(keyed.select("k", "_text").dropDuplicates(["k"]), "asked")
        had = stored(self.found(asked), "had")
        missing = asked.join(had.select("k"), "k", "left_anti")
        # stored, so that a text is embedded once however often the rows are read
        fresh = stored(embed(missing, "k", "_text", provider).select("k", F.col("vector").alias("v")), "embedded")
        return keyed.join(had.unionByName(fresh), "k").select(key, F.col("v").alias("vector")), fresh
