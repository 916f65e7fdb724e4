"""Chunking: documents to chunks.  Splitters that fold over a text run in Arrow batches, a document at a time."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate, chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where the recursive splitter cuts, in order of preference; overlaps within blocks.
SEPARATORS = ("\n\n", "\n", " ", "")
BLOCK_OVERLAP = 80


def _cut(text: str, separator: str) -> list[str]:
    """Parts of text, each but the first beginning with the separator."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in [head, *(separator + r for r in rest)] if p]


def _merged(parts: list[str], size: int, overlap: int) -> Iterator[str]:
    """Runs of parts of at most `size` characters; a run begins with the end of the one before, up to `overlap`."""
    window: list[str] = []
    held = 0
    for part in parts:
        if window and held + len(part) > size:
            if piece := "".join(window).strip():
                yield piece
            while window and (held > overlap or held + len(part) > size):
                held -= len(window.pop(0))
        window.append(part)
        held += len(part)
    if piece := "".join(window).strip():
        yield piece


def recursive(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters, cut at the coarsest separator that the text has, then at finer ones."""
    at = next((k for k, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    finer, out, short = separators[at + 1 :], [], []
    for part in _cut(text, separators[at]):
        if len(part) < size or not finer:
            short.append(part)
            continue
        out += _merged(short, size, overlap)
        short = []
        out += recursive(part, size, overlap, finer)
    return out + list(_merged(short, size, overlap))


def sections(text: str) -> list[tuple[tuple[str | None, str | None, str | None], str]]:
    """(headings of three levels, body) of each stretch under the same headings; # in fenced code is no heading."""
    out: list[tuple[tuple, list[str]]] = []
    path: list[str | None] = [None, None, None]
    fence = ""
    for line in text.split("\n"):
        bare = line.strip()
        if bare[:3] in ("```", "~~~") and (not fence or bare[:3] == fence):
            fence = "" if fence else bare[:3]
        heading = None if fence else re.match(r"(#{1,3})\s+(.+)", bare)
        if heading:
            level = len(heading[1]) - 1
            path[level:] = [heading[2].strip(), *[None] * (2 - level)]
            continue
        if not out or out[-1][0] != tuple(path):
            out.append((tuple(path), []))
        out[-1][1].append(line)
    return [(p, body) for p, lines in out if (body := "\n".join(lines).strip())]


def filled(blocks: list[str], size: int) -> list[str]:
    """Neighbouring blocks joined by a blank line as long as they fit into `size`; a longer block stands alone."""
    lengths = [len(b) for b in blocks]
    places = accumulate(lengths[1:], lambda at, n: (at[0], at[1] + 2 + n) if at[1] + 2 + n <= size else (at[0] + 1, n), initial=(0, *lengths[:1]))
    runs = groupby(zip(places, blocks, strict=False), key=lambda x: x[0][0])
    return ["\n\n".join(block for _, block in run) for _, run in runs]


def keep_tables(text: str, size: int) -> list[str]:
    """Blocks (between blank lines) packed up to `size`; longer ones are split unless they are tables, which stay whole."""
    if len(text) <= size:
        return [text]
    blocks = [b for b in re.split(r"\n\s*\n", text) if b]
    packable = [len(b) <= size or b.lstrip()[:1] == "|" for b in blocks]
    out: list[str] = []
    for fits, run in groupby(zip(packable, blocks, strict=True), key=lambda x: x[0]):
        own = [block for _, block in run]
        out += filled(own, size) if fits else chain.from_iterable(recursive(block, size, BLOCK_OVERLAP) for block in own)
    return out


def _cut_up(rows: DataFrame, cut: Callable[[str, str], list[tuple[str, str]]], title: Column, text: Column, index: str) -> DataFrame:
    """rows without text, for each piece that cut(title, text) gives, with its number, section and text."""

    @F.arrow_udf("array<struct<section string, text string>>")
    def pieces(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for titles, texts in batches:
            found = [cut(*row) for row in zip(titles.to_pylist(), texts.to_pylist(), strict=True)]
            flat = [pa.array([x[k] for own in found for x in own], pa.string()) for k in (0, 1)]
            ends = list(accumulate(map(len, found), initial=0))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, ["section", "text"]))

    rest = [c for c in rows.columns if c not in ("text", "section")]
    found = rows.select(*rest, pieces(F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))).alias("_pieces"))
    return found.select(*rest, F.posexplode("_pieces").alias(index, "_piece")).select(*rest, index, "_piece.section", "_piece.text")


def _per_document(docs: DataFrame, cut: Callable[[str, str], list[tuple[str, str]]], strategy: str) -> DataFrame:
    """Chunks by cut(title, text) -> [(section, text)], with the documents' other columns, numbered through a document."""
    out = _cut_up(docs, cut, F.col("title") if "title" in docs.columns else F.lit(""), F.col("text"), "chunk_index")
    return out.withColumns({"strategy": F.lit(strategy), "chunk_id": F.format_string(f"%s::{strategy}::%03d", F.col("doc_id").cast("string"), F.col("chunk_index"))})


def fixed(docs: DataFrame, size: int = 800, overlap: int = 100) -> DataFrame:
    """Chunks of at most `size` characters by the recursive splitter."""
    return _per_document(docs, lambda _, text: [("", p) for p in recursive(text, size, overlap)], "fixed")


def stride(docs: DataFrame, size: int, step: int) -> DataFrame:
    """Chunks of `size` characters every `step`, in SQL functions only."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.length("text") - size) / step), F.lit(0)).cast("int"))
    rows = docs.select("doc_id", "text", F.explode(starts).alias("chunk_index"))
    return rows.select("doc_id", "chunk_index", F.expr(f"substring(text, chunk_index * {step} + 1, {size})").alias("text"))


def by_headings(docs: DataFrame, size: int = 1500, breadcrumb: bool = True) -> DataFrame:
    """Sections under Markdown headings, their path in front; long ones are split at blank lines, tables kept whole."""

    def cut(title: str, text: str) -> list[tuple[str, str]]:
        trails = ((filter(None, headings if headings[0] else (title, *headings)), body) for headings, body in sections(text))
        named = [(" > ".join(trail), keep_tables(body, size)) for trail, body in trails]
        return [(name, piece) for name, pieces in named for piece in pieces if not piece.isspace()]

    chunks = _per_document(docs, cut, "headings")
    return chunks.withColumn("text", _under(F.col("text"))) if breadcrumb else chunks


def _under(text: Column) -> Column:
    return F.concat(F.lit("["), "section", F.lit("]\n"), text)


def parent_child(docs: DataFrame, parent_size: int = 1500, child_size: int = 350, overlap: int = 40) -> tuple[DataFrame, DataFrame]:
    """(children, parents): small chunks to search, and the sections that they are from.

    Children are cut from what follows a parent's path, and have that path in front themselves.
    """
    parents = by_headings(docs, parent_size)
    named = parents.drop("strategy").withColumnsRenamed({"chunk_id": "parent_id"})
    body = F.regexp_replace("text", r"^\[[^\n]*\n", "")
    children = _cut_up(named, lambda section, text: [(section, piece) for piece in recursive(text, child_size, overlap)], F.col("section"), body, "child_index")
    children = children.withColumns({"text": _under(F.col("text")), "strategy": F.lit("child"), "chunk_id": F.format_string("%s::c%02d", "parent_id", "child_index")})
    return children, parents


def with_prefix(chunks: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Chunks with a sentence of context (chunk_id, prefix) before their text; chunks without one stay."""
    rows = chunks.join(prefixes, "chunk_id", "left")
    text = F.when(F.col("prefix").isNotNull(), F.concat("prefix", F.lit("\n\n"), "text")).otherwise(F.col("text"))
    return rows.withColumns({"text": text, "contextualized": F.col("prefix").isNotNull()}).withColumnRenamed("prefix", "context_prefix")


def document_fingerprints(chunks: DataFrame, order: str = "chunk_index") -> DataFrame:
    """(doc_id, fingerprint): 12 hex digits of the SHA-1 of a document's chunk ids and texts in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, "chunk_id", "text"))), lambda c: F.concat(c["chunk_id"], c["text"]))
    return chunks.groupBy("doc_id").agg(F.substring(F.sha1(F.array_join(parts, "")), 1, 12).alias("fingerprint"))


def fingerprint(chunks: DataFrame, order: str = "chunk_index") -> DataFrame:
    """One row: a fingerprint of all chunks that any change of id, text or order changes; sums of hashes, so no task holds the corpus."""
    own = F.sha1(F.concat_ws("\0", F.col("doc_id").cast("string"), F.col(order).cast("string"), "chunk_id", "text"))
    part = lambda k: F.sum(F.conv(F.substring(own, k, 12), 16, 10).cast("decimal(20,0)")).cast("string")
    return chunks.agg(F.substring(F.sha1(F.concat_ws(",", F.count(F.lit(1)).cast("string"), part(1), part(13), part(25))), 1, 12).alias("fingerprint"))


def ordinals(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_id")) - 1)
