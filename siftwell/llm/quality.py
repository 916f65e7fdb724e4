"""Quality classifier: histogram gradient-boosted trees over document statistics.

Features are cut into at most BINS bins at quantiles of the sample.  Trees grow level by level to a fixed depth: a
histogram of gradients by node, feature and bin gives each node's best split.  The model is three flat arrays
(feature, threshold, value) with a tree a row, so numpy walks all documents of a batch down a tree at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import mixed, slices
from siftwell.llm.rules import Lines

#: Labelled documents that the trees are fitted on, at most (the first by a hash of doc_id).
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST_WEIGHT, SHRINK = 80, 4, 64, 0.15, 5.0, 1.0
#: A document is predicted good from this score on.
GOOD = 0.7

_NAMES = (
    "words", "word_length", "word_spread", "longest", "short", "symbols", "upper", "digits", "exclaimed", "bars", "marks", "wide",
    "lines", "line_words", "stopped", "same_lines", "repeated", "distinct", "top_word", "echoed", "capital",
)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of features for each text; a text without words has zeros."""
    x = Lines(texts)
    w = x.words
    docs, n = len(w.borders) - 1, np.maximum(x.n_words, 1)
    lead = (w.data & 0xC0) != 0x80
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[w.borders])
    is_ = lambda chars: np.isin(w.data, np.frombuffer(chars, np.uint8))
    chars = np.maximum(x.word_chars, 1)
    size = np.diff(np.stack([np.concatenate([[0], np.cumsum(lead & w.inside)])[e] for e in (w.start, w.end)]), axis=0)[0] if len(w) else np.zeros(0, np.int64)
    by_doc = lambda v: np.bincount(w.doc, weights=v, minlength=docs)
    mean = x.word_chars / n
    longest = np.zeros(docs)
    np.maximum.at(longest, w.doc, size)
    h = mixed(w.hashes() ^ mixed(w.doc.astype(np.uint64)))
    key, where, count = np.unique(h, return_index=True, return_counts=True)
    owner = w.doc[where]
    top = np.zeros(docs)
    np.maximum.at(top, owner, count)
    echo = np.zeros(len(w), bool)
    echo[1:] = h[1:] == h[:-1]
    capital = (w.data[w.start] >= 65) & (w.data[w.start] <= 90) if len(w) else np.zeros(0, bool)
    lines = np.bincount(x.doc, minlength=docs)
    some = np.maximum(lines, 1)
    stopped = np.bincount(x.doc, weights=x.features[:, 8], minlength=docs) if len(x.doc) else np.zeros(docs)
    upper, digits = (w.data >= 65) & (w.data <= 90), (w.data >= 48) & (w.data <= 57)
    columns = [
        np.log1p(x.n_words), mean, np.sqrt(np.maximum(by_doc(size.astype(float) ** 2) / n - mean**2, 0)), np.log1p(longest), by_doc(size <= 3) / n, x.n_symbols / chars,
        total(upper) / chars, total(digits) / chars, total(is_(b"!")) / chars, total(is_(b"|")) / n, total(is_(b"?.,;:-_/()[]\"'=+")) / chars, total(w.data >= 0xC0) / chars,
        np.log1p(lines), np.log1p(x.n_words / some), stopped / some, x.n_dup_lines / some, x.n_repeat_words / n, np.bincount(owner, minlength=docs) / n, top / n, by_doc(echo) / n, by_doc(capital) / n,
    ]
    return np.where((x.n_words > 0)[:, None], np.stack(columns, axis=1), 0.0).astype(np.float32)


@dataclass(frozen=True)
class Trees:
    """base: log-odds before any tree; the others have a row a tree, nodes in level order, leaves in `value`."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, depth = np.arange(len(x)), (self.feature.shape[1] + 1).bit_length() - 1
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - len(feature)]
        return 1 / (1 + np.exp(-out))


def grown(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Fits x (documents by features) to labels y by the logistic loss; without both labels every score is the share of ones."""
    share = (y.sum() + 1) / (len(y) + 2)
    base, inner = float(np.log(share / (1 - share))), (1 << depth) - 1
    if len(set(y.tolist())) < 2:
        trees = 0
    features = x.shape[1] if x.ndim == 2 else 1
    model = Trees(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if trees else np.zeros(0) for f in range(features)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1) if trees else None
    raw = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node, rows = np.zeros(len(y), np.int64), np.arange(len(y))
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            place = (((node - first)[:, None] * features + np.arange(features)) * BINS + binned).ravel()
            hist = [np.bincount(place, weights=np.repeat(v, features), minlength=width * features * BINS).reshape(width, features, BINS).cumsum(2) for v in (g, h)]
            (gl, hl), (gs, hs) = hist, (v[:, :, -1:] for v in hist)
            gain = gl**2 / (hl + SHRINK) + (gs - gl) ** 2 / (hs - hl + SHRINK) - gs**2 / (hs + SHRINK)
            gain = np.where((hl >= LEAST_WEIGHT * 0.05) & (hs - hl >= LEAST_WEIGHT * 0.05), gain, -np.inf)
            for f, e in enumerate(edges):
                gain[:, f, len(e) :] = -np.inf
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-9:
                    model.feature[t, first + k], model.threshold[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[rows, model.feature[t, node]] > model.threshold[t, node])
        leaf = node - inner
        gsum, hsum = (np.bincount(leaf, weights=v, minlength=inner + 1) for v in (g, h))
        model.value[t] = RATE * gsum / (hsum + SHRINK)
        raw += model.value[t][leaf]
    return model


def _measured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows = [r.tobytes() for r in statistics(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], ["doc_id", "row"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, row binary")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Trees:
    """Trees for labels (doc_id, quality) of documents that are not held out; at most SAMPLE of them.

    A label that is null, not 0 or 1, or given both ways counts for nothing.  The sample, a row of features each,
    comes to the driver.
    """
    rest = labels.filter(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("r")).filter("q = r and q in (0, 1)")
    rest = rest.select(F.col("doc_id").cast("long").alias("doc_id"), "q").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).toArrow()
    known = dict(zip(rest.column("doc_id").to_pylist(), rest.column("q").to_pylist(), strict=True))
    ids = docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(list(known), pa.int64())}))
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id", "left_semi")  # at most SAMPLE ids
    rows = sorted(zip(*(c.to_pylist() for c in _measured(picked).toArrow().columns), strict=True))
    x = np.stack([np.frombuffer(r, np.float32) for _, r in rows]) if rows else np.zeros((0, len(_NAMES)), np.float32)
    return grown(x, np.array([known[i] for i, _ in rows], float))


def scored(docs: DataFrame, model: Trees) -> DataFrame:
    """One row per row of docs (doc_id, text; other columns are ignored): doc_id, held_out, score, predicted.

    Whole texts are scored, on their text alone; null and empty texts have the score of all-zero statistics.  A null
    doc_id is not held out.  Repeated rows are scored each; an empty table gives no rows.  A long text is held by one
    task as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(statistics(part.column(1))))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
