"""Quality rules: counts per document, and line labels by a linear-chain conditional random field.

Each line with a word gets a few statistics.  The field scores a line as content or boilerplate from these, and a
pair of neighbouring lines from their labels; Viterbi decoding finds the best labelling of a document's lines.  A
document stays if it passes the base rules and enough of its words lie in content lines.

Training has labels of documents only, so those of lines are hidden.  A good document's lines are content.  In a bad
one some are boilerplate, which ones is what the field itself says: it is fitted, the lines of bad documents are
decoded anew (the least content-like ones of a document are boilerplate in any case), and so on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import Words, mixed, powers, rolled, slices

#: The symbols that count, and the window whose repetition counts.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Documents of either label to fit the field on, and how many of the first lines of each.
FIT_DOCS, FIT_LINES = 600, 200
#: Times that lines of bad documents are decoded anew, and the share of words in content lines that they have at most.
TURNS, BAD_SHARE = 4, 0.7
FEATURES = ("bias", "symbols", "upper", "digits", "marks", "repeated", "short", "word_length", "stopped", "wide")

_SYMBOL, _UPPER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(SYMBOLS)] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_MARK[list(b"!?.,;:-_/\\()[]{}\"'=+~^`@")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


@dataclass(frozen=True)
class Field:
    """Scores of content against boilerplate: weights of a line's features, of each pair of neighbouring labels."""

    weights: tuple[float, ...] = (2.0, -1.5, -1.0, -0.8, -0.8, -3.0, -0.5, 0.0, 0.3, 0.0)
    #: [left][right], 0 boilerplate, 1 content
    pairs: tuple[tuple[float, float], ...] = field(default=((0.5, -0.5), (-0.5, 0.5)))
    #: For content, before the first line: it takes evidence to reject a document.
    start: float = 1.5
    #: A document stays if at least this share of its words lies in content lines.
    share: float = 0.5

    def decode(self, scores: list[float], ends: list[int]) -> np.ndarray:
        """Best labels of consecutive chains; `ends` says where each chain ends."""
        (bb, bc), (cb, cc) = self.pairs
        out, at = np.zeros(len(scores), bool), 0
        for end in ends:
            back, b, c = [], 0.0, self.start
            for k in range(at, end):
                if k > at:
                    from_b = bb + b >= cb + c, bc + b > cc + c
                    b, c = max(bb + b, cb + c), max(bc + b, cc + c)
                    back.append(from_b)
                c += scores[k]
            label = c >= b
            for k in range(end - 1, at - 1, -1):
                out[k] = label
                if k > at:
                    label = not back[k - at - 1][label]
            at = end
        return out


class Lines:
    """Counts of some texts, and features of their lines that hold a word."""

    def __init__(self, texts: pa.Array):
        self.words = w = Words(texts)
        data, docs = w.data, len(w.borders) - 1
        new = data == 10
        begins = np.zeros(len(data) + 1, bool)
        begins[1:] = np.append(new[:-1], False) if len(data) else begins[1:]
        begins[w.borders[:-1]] = True
        start = np.flatnonzero(begins[:-1])
        end = np.append(start[1:], len(data))
        trimmed = np.where((end > start) & new[np.maximum(end - 1, 0)], end - 1, end) if len(start) else end
        total = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        lead = (data & 0xC0) != 0x80
        per = {k: total(m) for k, m in (("chars", lead), ("word_chars", lead & w.inside), ("symbols", _SYMBOL[data]), ("upper", _UPPER[data]), ("digits", _DIGIT[data]), ("marks", _MARK[data]), ("wide", data >= 0x80))}
        within = lambda k, a, b: per[k][b] - per[k][a]
        by_doc = lambda k: within(k, w.borders[:-1], w.borders[1:])
        self.n_words, self.word_chars, self.n_symbols = w.counts, by_doc("word_chars"), by_doc("symbols")
        # lines with a word
        line_words = np.searchsorted(w.start, end, "left") - np.searchsorted(w.start, start, "left")
        some = line_words > 0
        start, end, trimmed, line_words = start[some], end[some], trimmed[some], line_words[some]
        self.doc = np.searchsorted(w.borders, start, "right") - 1
        self.line_words = line_words
        again = np.zeros(len(start), bool)
        if len(start):
            size = trimmed - start
            at = np.cumsum(size) - size
            place = np.arange(int(size.sum())) - np.repeat(at, size)
            terms = (data[np.repeat(start, size) + place].astype(np.uint64) + np.uint64(1)) * powers(int(size.max()))[place]
            key = mixed(mixed(np.add.reduceat(terms, at) + size.astype(np.uint64)) ^ mixed(self.doc.astype(np.uint64)))
            order = np.argsort(key, kind="stable")
            again[order[1:]] = key[order[1:]] == key[order[:-1]]
        self.n_dup_lines = np.bincount(self.doc[again], minlength=docs)
        # words in repeated windows
        windows = rolled(w.hashes(), WINDOW)
        inside = np.flatnonzero(w.doc[: len(windows)] == w.doc[WINDOW - 1 :])
        key = mixed(windows[inside] ^ mixed(w.doc[inside].astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(w) + 1, np.int64)
        edge[inside[twice]] += 1
        edge[inside[twice] + WINDOW] -= 1
        self.n_repeat_words = np.bincount(w.doc[np.cumsum(edge[:-1]) > 0], minlength=docs)
        # features
        chars = np.maximum(within("word_chars", start, end), 1)
        share = lambda k: within(k, start, end) / chars
        stop = np.zeros(len(data) + 1, bool)
        stop[1:] = _STOP[data]
        self.features = np.stack([
            np.ones(len(start)), np.minimum(20 * share("symbols"), 3), np.minimum(5 * share("upper"), 3), np.minimum(5 * share("digits"), 3), np.clip(20 * share("marks") - 1, 0, 3), again.astype(float),
            np.exp(-line_words / 4.0), np.clip(np.log(chars / line_words) - 1.6, -1.5, 3), stop[trimmed].astype(float), within("wide", start, end) / np.maximum(end - start, 1),
        ], axis=1).astype(np.float32) if len(start) else np.zeros((0, len(FEATURES)), np.float32)
        self.line_ends = np.cumsum(np.bincount(self.doc, minlength=docs))

    def content_words(self, model: Field) -> np.ndarray:
        """Words in content lines, per document."""
        labels = model.decode((self.features @ np.array(model.weights)).tolist(), self.line_ends.tolist())
        return np.bincount(self.doc[labels], weights=self.line_words[labels], minlength=len(self.n_words)).astype(np.int64)


def _learned(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, weight: np.ndarray, model: Field, rounds: int, rate: float = 0.2, decay: float = 1e-3) -> Field:
    """The field after some rounds of gradient ascent on the likelihood of line labels y, given features x.

    Both are by place in the chain, then by chain, padded; chains are in order of falling size, so those that reach a
    place come first.
    """
    most, n, _ = x.shape
    alive = (np.arange(most)[:, None] < sizes).sum(1)
    w, t = np.array(model.weights), np.array(model.pairs)
    state = [(p, np.zeros_like(p), np.zeros_like(p)) for p in (w, t)]
    there = (np.arange(most)[:, None] < sizes) * weight
    own = np.array([[(there[1:] * (y[:-1] == a) * (y[1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
    for r in range(1, rounds + 1):
        emit = np.stack([np.zeros((most, n)), x @ w], axis=2)
        a, b = emit.copy(), np.zeros((most, n, 2))
        last = emit[0].copy()
        for k in range(1, most):
            m = alive[k]
            last[:m] = a[k, :m] = np.logaddexp(a[k - 1, :m, :1] + t[0], a[k - 1, :m, 1:] + t[1]) + emit[k, :m]
        for k in range(most - 2, -1, -1):
            m = alive[k + 1]
            ahead = emit[k + 1, :m] + b[k + 1, :m]
            b[k, :m] = np.logaddexp(t[:, 0] + ahead[:, :1], t[:, 1] + ahead[:, 1:])
        z = np.logaddexp(last[:, 0], last[:, 1])
        content = np.exp(np.minimum(a[:, :, 1] + b[:, :, 1] - z, 0))
        gw = np.einsum("kn,knf->f", (y - content) * there, x) - decay * w
        both = np.exp(np.minimum(a[:-1, :, :, None] + t + (emit + b)[1:, :, None, :] - z[:, None, None], 0)) * there[1:, :, None, None]
        gt = own - both.sum((0, 1)) - decay * t
        for g, (p, m, v) in zip((gw, gt), state, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return Field(tuple(w.tolist()), tuple(map(tuple, t.tolist())), model.start, model.share)


def fitted(chains: list[tuple[np.ndarray, np.ndarray, int]]) -> Field:
    """A field for chains of (features of lines, their words, label of the document); without both labels, the default."""
    chains = sorted((c for c in chains if len(c[0])), key=lambda c: -len(c[0]))
    if len({label for *_, label in chains}) < 2:
        return Field()
    sizes, good = np.array([len(x) for x, *_ in chains]), np.array([label for *_, label in chains]) == 1
    x, words = np.zeros((sizes[0], len(chains), len(FEATURES))), np.zeros((sizes[0], len(chains)))
    for k, (rows, count, _) in enumerate(chains):
        x[: len(rows), k], words[: len(rows), k] = rows, count
    # documents of either label weigh the same in sum
    weight = np.where(good, 1 / sizes[good].sum(), 1 / sizes[~good].sum()) / 2
    start = Field((0.0,) * len(FEATURES), ((0.0, 0.0), (0.0, 0.0)))
    # at first each line has its document's label, and neighbours say nothing
    y = np.broadcast_to(good, words.shape)
    model = _learned(x, y, sizes, weight, start, 40)
    model = Field(model.weights, start.pairs, 0.0)
    for _ in range(TURNS):
        y = _line_labels(x, words, sizes, good, model)
        model = _learned(x, y, sizes, weight, Field(model.weights, model.pairs), 40)
    return Field(model.weights, model.pairs, model.start, _best_share(x, words, sizes, good, model))


def _decoded(x: np.ndarray, sizes: np.ndarray, model: Field) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    scores = x @ np.array(model.weights)
    for k, size in enumerate(sizes.tolist()):
        yield k, size, scores[:size, k], model.decode(scores[:size, k].tolist(), [size])


def _line_labels(x: np.ndarray, words: np.ndarray, sizes: np.ndarray, good: np.ndarray, model: Field) -> np.ndarray:
    y = np.zeros(words.shape, bool)
    for k, size, scores, labels in _decoded(x, sizes, model):
        if good[k]:
            y[:size, k] = True
            continue
        order = np.argsort(scores, kind="stable")
        # lines that have to go until no more than BAD_SHARE is left, the least content-like ones
        gone = np.cumsum(words[order, k]) - words[order, k] < (1 - BAD_SHARE) * words[:size, k].sum()
        labels[order[gone]] = False
        y[:size, k] = labels
    return y


def _best_share(x: np.ndarray, words: np.ndarray, sizes: np.ndarray, good: np.ndarray, model: Field) -> float:
    """The share of content that tells good from bad documents best; of equally good ones that nearest to a half."""
    shares = np.array([words[:size, k][labels].sum() / words[:size, k].sum() for k, size, _, labels in _decoded(x, sizes, model)])
    right = lambda s: (shares[good] >= s).mean() + (shares[~good] < s).mean()
    return max((s / 20 for s in range(1, 20)), key=lambda s: (round(right(s), 6), -abs(s - 0.5)))


def _drawn(rows: np.ndarray, doc_id: int) -> np.ndarray:
    """FIT_LINES consecutive rows, from a place that a hash of doc_id draws among all; all of fewer."""
    at = zlib.crc32(str(doc_id).encode()) % max(1, len(rows) - FIT_LINES + 1)
    return rows[at : at + FIT_LINES]


def fit(docs: DataFrame, labels: DataFrame) -> Field:
    """A field from labels of documents, `quality`.

    Uses at most FIT_DOCS documents of either label (the first by a hash of doc_id, out of those whose crc32(doc_id)
    mod 4 is not 2), and of a longer one a chain of FIT_LINES lines with words, from a place in the whole text that a
    hash of doc_id draws.  A label that is null or given both ways
    counts for nothing; so do texts without words.  Of rows with one doc_id each counts.  Without documents of both
    labels, as in empty tables, the field is the default one.
    """
    rest = labels.filter("crc32(cast(doc_id as string)) % 4 <> 2").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("r")).filter("q = r and q in (0, 1)")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [rest.filter(F.col("q") == q).orderBy(*order).limit(FIT_DOCS) for q in (0, 1)]
    picked = {r["doc_id"]: r["q"] for p in picked for r in p.select("doc_id", "q").collect()}
    if not picked:
        return Field()

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = Lines(part.column(1))
                rows = np.concatenate([found.features, found.line_words[:, None]], axis=1).astype(np.float32)
                rows = [_drawn(r, i).tobytes() for r, i in zip(np.split(rows, found.line_ends[:-1]), part.column(0).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], ["doc_id", "rows"])

    ids = docs.sparkSession.createDataFrame([(int(k),) for k in picked], "doc_id long")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id", "left_semi")  # at most 2 * FIT_DOCS ids
    got = sorted(map(tuple, texts.mapInArrow(lines, "doc_id long, rows binary").collect()))
    table = [(np.frombuffer(rows, np.float32).reshape(-1, len(FEATURES) + 1), picked[i]) for i, rows in got]
    return fitted([(rows[:, :-1], rows[:, -1], label) for rows, label in table])


def _judged(texts: pa.Array, model: Field) -> dict[str, np.ndarray]:
    x = Lines(texts)
    failed = (x.n_words < 20) | (100 * x.n_repeat_words > 30 * x.n_words)
    share = x.content_words(model) / np.maximum(x.n_words, 1)
    counts = {k: getattr(x, k).astype(np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    return counts | {"base_failed": failed, "kept": ~failed & (share >= model.share), "content_share": share}


def report(docs: DataFrame, model: Field) -> DataFrame:
    """One row per row of docs (doc_id, text; other columns are ignored), whole texts.

    doc_id, n_words, word_chars (code points in words), n_symbols, n_dup_lines, n_repeat_words (long), base_failed,
    kept, content_share (share of words in content lines).  Null and empty texts have no words: base_failed is true.
    Repeated rows are judged each, rows without a doc_id as well; an empty table gives none.  A long text is held by one
    task as a whole, at some 100 bytes a character.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = _judged(part.column(1), model)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, found.values())], ["doc_id", *found])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def kept(docs: DataFrame, model: Field) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; null and empty texts go, repeated rows stay or go alike."""
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                yield part.filter(pa.array(_judged(part.column(column), model)["kept"]))

    return docs.mapInArrow(run, docs.schema)
