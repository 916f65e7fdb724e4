"""Column builders for vectors, and the hashing embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.sources.scratch import stored

#: Fixed value: dimension of the hashing embedder; the last byte of the MD5 gives the bucket, the lowest bit of its 11th the sign.
HASH_DIM = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a vector of zeros counts as one of length 1."""
    length = lambda x: F.coalesce(F.nullif(norm(x), F.lit(0.0)), F.lit(1.0))
    return dot(a, b) / (length(a) * length(b))


def sound(a: Column) -> Column:
    """Whether a vector can be compared: not null, not empty, and without null or non-finite components."""
    whole = F.forall(a, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))  # NaN is above infinity
    return F.coalesce(a.isNotNull() & (F.size(a) > 0) & whole, F.lit(False))


def units(vectors: Iterable[np.ndarray | list | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per length, places and rows of length 1 of the vectors that are sound; zeros stay as they are."""
    vectors = list(vectors)
    sizes = np.array([0 if v is None else len(v) for v in vectors])
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        x = np.array([vectors[k] for k in at], float)  # a null component becomes NaN
        fine = np.isfinite(x).all(1)
        at, x = at[fine], x[fine]
        x /= np.where((n := np.linalg.norm(x, axis=1)) == 0, 1, n)[:, None]
        if len(at):
            yield at, x


def hash_embed(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, vector): each word adds 1 or -1 to one of HASH_DIM buckets, by its MD5; vectors have length 1 (or are zero).

    Words are found by Spark; a batch's distinct words are hashed once each and summed in numpy, so rows stay where
    they are: by grouping words, it would take two shuffles of them.
    """

    @F.pandas_udf("array<double>")
    def summed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows, out = np.repeat(np.arange(len(batch)), batch.map(len)), np.zeros((len(batch), HASH_DIM))
            if len(rows):
                which, words = pd.factorize(np.concatenate(batch.to_numpy()))
                sums = np.frombuffer(b"".join(hashlib.md5(w.encode()).digest() for w in words), np.uint8).reshape(-1, 16)
                np.add.at(out, (rows, sums[which, 15]), np.where(sums[which, 10] & 1, 1.0, -1.0))
            length = np.linalg.norm(out, axis=1)[:, None]
            yield pd.Series(list(out / np.where(length == 0, 1, length)))

    words = F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0)), F.array().cast("array<string>"))
    return rows.select(key, summed(words).alias("vector"))


def embed(rows: DataFrame, key: str, text: str, provider: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """(key, vector) by a provider that maps texts to rows of floats; loaded once a worker, fed by Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(np.asarray(provider(texts.fillna("").tolist()), np.float32)))

    return rows.select(key, run(F.col(text)).alias("vector"))


def cache_key(model: str, text: Column) -> Column:
    return F.sha1(F.concat(F.lit(model + "\0"), text))


def dense_scores(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(qid, item_id, score): exact cosine, the k best of each task, for queries (qid, vector).

    The queries go to all tasks; items (item_id, vector) are scanned by matrix products.  Each task hands on at most k
    rows a query, so the ranking after it sees few rows.  More than QUERIES queries go in passes of some QUERIES, dealt
    by a hash; what a pass finds is stored, so only one pass's queries are held at a time.

    Vectors that are null, empty, or hold null or non-finite components take no part, on either side; vectors of
    different lengths are not compared.
    """
    asked, items = queries.select("qid", "vector"), items.select("item_id", "vector")
    first = asked.limit(QUERIES + 1).toPandas()
    if len(first) <= QUERIES:
        return _scanned(first, asked, items, k)[0]
    asked, items = stored(asked, "queries"), stored(items, "items")
    passes, found = -(-asked.count() // QUERIES), None
    for turn in range(passes):
        part = asked.filter(F.pmod(F.xxhash64("qid"), F.lit(passes)) == turn).toPandas()
        got, sent = _scanned(part, asked, items, k)
        got = stored(got, "scores")
        sent.destroy()
        found = got if found is None else found.union(got)
    return found


def _scanned(asked: pd.DataFrame, queries: DataFrame, items: DataFrame, k: int) -> tuple[DataFrame, Broadcast]:
    names = asked["qid"].to_numpy()
    sent = queries.sparkSession.sparkContext.broadcast({q.shape[1]: (names[at], q) for at, q in units(asked["vector"])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {size: [(np.zeros(0), np.zeros(0, object))] * len(names) for size, (names, _) in sent.value.items()}
        for batch in batches:
            for at, x in units(batch["vector"]):
                names, q = sent.value.get(x.shape[1], ((), ()))
                ids = batch["item_id"].to_numpy()[at]
                for a in range(0, len(names), STEP):
                    scores = (x @ q[a : a + STEP].T).round(6)
                    deep = np.partition(scores, len(ids) - k, axis=0)[len(ids) - k] if len(ids) > k else np.full(scores.shape[1], -np.inf)
                    for j, (best, own) in enumerate(held[x.shape[1]][a : a + STEP]):
                        some = scores[:, j] >= max(deep[j], best[-1] if len(best) == k else -np.inf)
                        best, own = np.concatenate([best, scores[some, j]]), np.concatenate([own, ids[some]])
                        order = np.lexsort((own.astype(ids.dtype), -best))[:k]
                        held[x.shape[1]][a + j] = best[order], own[order]
        for size, found in held.items():
            for name, (best, own) in zip(sent.value[size][0], found, strict=True):
                if len(best):
                    yield pd.DataFrame({"qid": name, "item_id": own, "score": best})

    kinds = dict(queries.dtypes), dict(items.dtypes)
    return items.mapInPandas(run, f"qid {kinds[0]['qid']}, item_id {kinds[1]['item_id']}, score double"), sent


#: Queries in one scan of dense_scores, some, which bounds the broadcast; those that meet a batch at a time.
QUERIES, STEP = 20_000, 1024
