"""Token ids of whole texts, and their files: independent zstandard frames with a trailing seek table.

A file holds one frame a document: its ids as little-endian unsigned 32-bit integers.  Two skippable frames follow,
the int64 doc_ids in order (the smallest int64 for null), and the seek table of the public zstandard seekable format:
compressed size, size and the low half of XXH64 for each frame.  Any zstandard reader can read the whole file; a
reader of some documents fetches the table and then only their frames.
"""

from __future__ import annotations

import io
import json
import os
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import scratch, slices, spread, stored

#: Words whose ids a Python worker remembers (some 200 bytes each), and the longest such word.
REMEMBERED, LONGEST = 250_000, 64
#: ASCII punctuation between an ASCII letter or digit and a blank is a piece of its own, unless an apostrophe is in it.
AFTER_WORD = r"([a-z0-9])([!-&(-/:-@\[-`{-~]+)([\x20\x09-\x0d]|\z)"
#: Text bytes that are encoded at a time: more of them repeat more words.
ENCODED = 2 << 20
#: New words that the tokenizer gets in one call.
FRESH = 10_000
TABLE_MAGIC, INDEX_MAGIC, FOOTER_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
NO_ID = -(1 << 63)

_encoders: dict[tuple[str, int], Encoder] = {}


#: The pieces that a tokenizer by words cuts; none of them spans a blank.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def by_words(made: dict) -> bool:
    """Whether a tokenizer, given as its JSON, composes, lower-cases, cuts as PIECES says, and marks the ends of words."""
    steps = lambda key, of: [(x["type"], x) for x in (made.get(key) or {}).get(of, [])]
    kinds = [k for k, _ in steps("normalizer", "normalizers")]
    cuts = steps("pre_tokenizer", "pretokenizers")
    model = made["model"]
    return (
        kinds in (["NFC", "Replace", "Lowercase"], ["NFC", "Lowercase"])
        and all(x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for k, x in steps("normalizer", "normalizers") if k == "Replace")
        and [k for k, _ in cuts] == ["Split", "ByteLevel"]
        and cuts[0][1]["pattern"] == {"Regex": PIECES} and cuts[0][1]["invert"] and cuts[0][1]["behavior"] == "Removed"
        and not cuts[1][1]["use_regex"] and not cuts[1][1]["add_prefix_space"]
        and model["type"] == "BPE" and bool(model["end_of_word_suffix"]) and not model["dropout"]
        and all(x["content"].startswith("<|") for x in made["added_tokens"])
    )


class Encoder:
    """Ids of a tokenizer whose pieces never reach across blanks; each word is encoded once and then remembered.

    The tokenizer lower-cases and normalises within words only, so the ids of a text are those of its words, in
    order.  A-Z may be lowered, and punctuation after a word set apart, unless the text could spell a special token.
    New words of letters alone, already lower and composed, go to a copy of the tokenizer that cuts at blanks only.
    All that holds for tokenizers that are made as `by_words` says; texts of others are encoded whole.
    """

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        plain = json.loads(self.tokenizer.to_str())
        self.end = struct.pack("<I", end)
        self.whole = not by_words(plain)
        if self.whole:
            return
        levels = [p for p in plain["pre_tokenizer"]["pretokenizers"] if p["type"] == "ByteLevel"]
        plain |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *levels]}}
        self.letters = Tokenizer.from_str(json.dumps(plain))
        suffix = plain["model"]["end_of_word_suffix"]
        self.ends = np.array([(self.tokenizer.id_to_token(k) or "").endswith(suffix) for k in range(self.tokenizer.get_vocab_size())])
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, end: int) -> Encoder:
        """One per worker."""
        if (path, end) not in _encoders:
            _encoders[path, end] = cls(path, end)
        return _encoders[path, end]

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text and the end id, as little-endian unsigned 32-bit integers; a null text is empty."""
        texts = pc.fill_null(texts, "")
        if self.whole:
            coded = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            return [struct.pack(f"<{len(e.ids)}I", *e.ids) + self.end for e in coded]
        parted = pc.replace_substring_regex(pc.ascii_lower(texts), pattern=AFTER_WORD, replacement=r"\1 \2\3")
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, parted))
        words = split.flatten().dictionary_encode()
        # ids of the distinct words, then those of all words by place; an empty word, before or after blanks, has none
        coded = self._remembered(words.dictionary.to_pylist())
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        at, place = np.cumsum(size) - size, words.indices.to_numpy()
        own = size[place]
        ends = np.cumsum(own)
        out = np.frombuffer(b"".join(coded), "<u4")[np.repeat(at[place] - ends + own, own) + np.arange(own.sum())]
        cuts = np.concatenate([[0], ends])[split.offsets.to_numpy()].tolist()
        return [out[a:b].tobytes() + self.end for a, b in zip(cuts, cuts[1:], strict=False)]

    def _remembered(self, words: list[str]) -> list[bytes]:
        ids = list(map(self.known.get, words))
        fresh = [k for k, i in enumerate(ids) if i is None]
        # some at a time: the tokenizer's own results are large
        for a in range(0, len(fresh), FRESH):
            some = fresh[a : a + FRESH]
            for k, i in zip(some, self._coded([words[k] for k in some]), strict=True):
                ids[k] = i
        if len(self.known) < REMEMBERED:
            self.known |= {words[k]: ids[k] for k in fresh if len(words[k]) <= LONGEST}
        return ids

    def _coded(self, fresh: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        plain = [w.isalpha() and w == w.lower() and (w.isascii() or unicodedata.is_normalized("NFC", w)) for w in fresh]
        letters, rest = list(compress(fresh, plain)), list(compress(fresh, map(not_, plain)))
        pieces: Iterator[bytes] = iter(())
        if letters:
            ids = np.array(self.letters.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])).tolist()
            ids = ids.tobytes()
            pieces = (ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
        others = (struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))
        return [next(pieces if p else others) for p in plain]


class Writer:
    """Writes one file; `add` compresses a document's ids into a frame of its own."""

    def __init__(self, out: io.IOBase):
        self.out, self.zstd = out, zstandard.ZstdCompressor(level=3)
        self.table, self.doc_ids = bytearray(), []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.zstd.compress(ids)
        self.out.write(frame)
        self.table += struct.pack("<III", len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF)
        self.doc_ids.append(NO_ID if doc_id is None else doc_id)

    def finish(self) -> None:
        index = np.array(self.doc_ids, "<i8").tobytes()
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(self.table) + 9) + self.table)
        self.out.write(struct.pack("<IBI", len(self.doc_ids), 0x80, FOOTER_MAGIC))


class Reader:
    """Documents of one file by their place in it; the sum of each frame read is checked."""

    def __init__(self, source: pa.NativeFile):
        self.source, size = source, source.size()
        self.frames, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != FOOTER_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with sums")
        start = size - 9 - 12 * self.frames
        table = np.frombuffer(source.read_at(12 * self.frames, start), "<u4").reshape(-1, 3)
        self.at = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
        self.sizes, self.sums = table[:, 1], table[:, 2]
        self.doc_ids = np.frombuffer(source.read_at(8 * self.frames, start - 8 - 8 * self.frames), "<i8")
        self.zstd = zstandard.ZstdDecompressor()

    def ids(self, k: int) -> bytes:
        data = self.zstd.decompress(self.source.read_at(int(self.at[k + 1] - self.at[k]), int(self.at[k])), max_output_size=int(self.sizes[k]))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} is damaged")
        return data


def write(docs: DataFrame, tokenizer: str, end: int = 1, folder: str | None = None) -> DataFrame:
    """Writes the ids of all documents in ascending doc_id order; one row a file: part, uri, docs, tokens.

    docs are dealt out by ranges of doc_id (nulls first; rows of one id by a hash of their text), a file a partition.
    Files have unique names and count only if the returned table, stored once all are written, lists them, so tasks
    may fail or run twice.  Null texts are empty; an empty document has the end id alone; repeated rows are documents
    each.  An empty table has no file.  A long text is one frame, made by one task.  `folder` is a path that Spark and
    pyarrow read alike: with a scheme, or below spark.checkpoint.dir.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out, docs, tokens = Encoder.of(tokenizer, end), None, 0, 0
        for batch in batches:
            for part in slices(batch, 1, ENCODED):
                if out is None:
                    files, path = fs.FileSystem.from_uri(folder)
                    files.create_dir(path, recursive=True)
                    name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zst"
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                    writer = Writer(out)
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1)), strict=True):
                    writer.add(doc_id, ids)
                    docs, tokens = docs + 1, tokens + len(ids) // 4
        if out is not None:
            writer.finish()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "uri": [f"{folder}/{name}"], "docs": [docs], "tokens": [tokens]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartitionByRange(spread(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return stored(dealt.mapInArrow(run, "part int, uri string, docs long, tokens long"), "token_files")


def read(files: DataFrame) -> DataFrame:
    """From the files that `write` listed, a task a file: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Every document written has a row, those with a null doc_id too; without files there are none.
    """
    spark = files.sparkSession
    listed = sorted(map(tuple, files.select("part", "uri", "tokens").collect()))  # one row a file
    starts = np.concatenate([[0], np.cumsum([n for *_, n in listed], dtype=np.int64)]).tolist()
    uris = [uri for _, uri, _ in listed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k in (k for batch in batches for k in batch.column(0).to_pylist()):
            store, path = fs.FileSystem.from_uri(uris[k])
            with store.open_input_file(path) as source:
                file = Reader(source)
                sizes = file.sizes.astype(np.int64) // 4
                start = np.cumsum(sizes) - sizes + starts[k]
                for a in range(0, file.frames, 4096):
                    b = min(a + 4096, file.frames)
                    ids = file.doc_ids[a:b]
                    sums = [zlib.crc32(file.ids(j)) for j in range(a, b)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NO_ID), pa.array(start[a:b]), pa.array(sizes[a:b]), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    numbers = spark.range(0, len(uris), 1, max(1, len(uris)))
    return numbers.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
