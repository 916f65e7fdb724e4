"""A document corpus as a data source, for batch and stream: ``spark.read.format("siftwell_corpus").load(folder)``.

Files are listed once and dealt into partitions by size; PDFs of many pages are cut into ranges of pages.  A file that
can't be read is a row with its error, so one broken file costs no job.  A stream takes each file once: its offset is the
place of the last file in order of time and name, kept by Spark's checkpoint.

Options: `path` (or load's argument; several, comma-separated), `suffixes` (".md,.pdf"), `originals` (a folder of Markdown
files that stand for PDFs of the same name), `partitionBytes`, `pages` (of a partition).  Paths are those of any file
system that Arrow knows.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Rows of the source; page and pages are null but for PDF files that are cut into ranges of pages.
RAW = "source_path string, modified timestamp, size long, parser string, yaml string, text string, page int, pages int, error string"
_FRONT = re.compile(r"\A---\n(.*?)\n---\n", re.DOTALL)


@dataclass(frozen=True)
class File:
    path: str
    size: int
    at: int  # microseconds


@dataclass
class Part(InputPartition):
    """Whole files, or a range of pages of one PDF file."""

    files: tuple[File, ...]
    first: int | None = None
    last: int | None = None
    pages: int | None = None


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _bytes(path: str) -> bytes:
    system, inner = _fs(path)
    with system.open_input_stream(inner) as f:
        return f.read()


def listed(folders: list[str], suffixes: tuple[str, ...]) -> list[File]:
    """The files of the folders themselves, by time and path."""
    from pyarrow import fs

    out = []
    for folder in folders:
        system, inner = _fs(folder)
        scheme = folder.split("://", 1)[0] + "://" if "://" in folder else ""
        for info in system.get_file_info(fs.FileSelector(inner)):
            if info.type == fs.FileType.File and info.path.lower().endswith(suffixes) and not info.base_name.startswith((".", "_")):
                out.append(File(f"{scheme}{info.path}", info.size, int(info.mtime_ns or 0) // 1000))
    return sorted(out, key=lambda f: (f.at, f.path))


def split(text: str) -> tuple[str | None, str]:
    """(YAML, body): YAML is None where the text has no front matter."""
    m = _FRONT.match(text)
    return (m[1], text[m.end() :]) if m else (None, text)


class _Reading:
    """What batch and stream have in common."""

    def __init__(self, options: dict[str, str]):
        self.folders = [p.strip() for p in options["path"].split(",")]
        self.suffixes = tuple(s.strip().lower() for s in options.get("suffixes", ".md,.pdf").split(","))
        self.originals, self.bytes, self.pages = options.get("originals"), int(options.get("partitionbytes", 32 << 20)), int(options.get("pages", 50))

    def list(self) -> list[File]:
        return listed(self.folders, self.suffixes)

    def parts(self, files: list[File]) -> list[Part]:
        out, held, size = [], [], 0
        for f in files:
            pages = self._pages(f) if f.path.lower().endswith(".pdf") and not self.originals and f.size > self.bytes // 32 else None
            if pages and pages > self.pages:
                out += [Part((f,), a, min(a + self.pages, pages), pages) for a in range(0, pages, self.pages)]
                continue
            if held and size + f.size > self.bytes:
                out.append(Part(tuple(held)))
                held, size = [], 0
            held.append(f)
            size += f.size
        return [*out, Part(tuple(held))] if held else out

    def _pages(self, f: File) -> int | None:
        try:
            return len(_reader(_bytes(f.path)).pages)
        except Exception:  # the row of the file will say why
            return None

    def read(self, partition: Part) -> Iterator[tuple]:
        for f in partition.files:
            at = datetime.datetime.fromtimestamp(f.at / 1e6, datetime.timezone.utc)
            pdf = f.path.lower().endswith(".pdf")
            parser = "markdown" if not pdf else "layout" if self.originals else "pypdf"
            try:
                rows = [(*self._pdf(f, partition),)] if pdf else [(*split(_bytes(f.path).decode()), None)]
                yield from ((f.path, at, f.size, parser, yaml, text, page, partition.pages, None) for yaml, text, page in rows)
            except Exception as e:  # any fault of a file or its parser is that row's error
                yield f.path, at, f.size, parser, None, None, partition.first, partition.pages, f"{type(e).__name__}: {e}"

    def _pdf(self, f: File, part: Part) -> tuple[str | None, str, int | None]:
        stem = f.path[: -len(".pdf")]
        try:
            yaml = _bytes(f"{stem}.meta.yaml").decode()
        except FileNotFoundError:
            yaml = None
        if self.originals:
            return yaml, split(_bytes(f"{self.originals.rstrip('/')}/{stem.rsplit('/', 1)[-1]}.md").decode())[1], None
        pages = _reader(_bytes(f.path)).pages
        return yaml, "\n\n".join(pages[k].extract_text() or "" for k in range(part.first or 0, len(pages) if part.last is None else part.last)), part.first


def _reader(data: bytes):
    import io

    from pypdf import PdfReader

    return PdfReader(io.BytesIO(data))


class BatchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.reading = _Reading(options)

    def partitions(self) -> list[Part]:
        return self.reading.parts(self.reading.list()) or [Part(())]

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.reading.read(partition)


class StreamReader(DataSourceStreamReader):
    """Offsets are (time, path) of the last file taken.  A file that comes later with an earlier time is not seen."""

    def __init__(self, options: dict[str, str]):
        self.reading = _Reading(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = self.reading.list()
        return {"at": files[-1].at, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Part]:
        low, high = ((o["at"], o["path"]) for o in (start, end))
        return self.reading.parts([f for f in self.reading.list() if low < (f.at, f.path) <= high]) or [Part(())]

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.reading.read(partition)


class CorpusSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "siftwell_corpus"

    def schema(self) -> str:
        return RAW

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader(dict(self.options))

    def streamReader(self, schema: StructType) -> StreamReader:  # noqa: N802
        return StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CorpusSource)
