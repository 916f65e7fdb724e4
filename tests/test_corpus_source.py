"""The corpus as a data source: as the plain readers give it, file by file once, and with errors as rows."""

from __future__ import annotations

import os
import shutil

import pytest
from pyspark.sql import functions as F

from siftwell.sources import corpus, corpus_source


@pytest.fixture(scope="module", autouse=True)
def source(spark):
    corpus_source.register(spark)


def files(folder, n=9):
    folder.mkdir()
    for k in range(n):
        head = f"---\ndoc_id: d{k}\ntitle: T{k}\naccess: [hr, all]\nowner: {k}\n---\n" if k % 3 else ""
        (folder / f"f{k}.md").write_text(f"{head}# H\nbody ä {k}\n" * (1 + 40 * (k == 4)))
        os.utime(folder / f"f{k}.md", ns=(10**18 + k * 10**9, 10**18 + k * 10**9))
    (folder / "x.txt").write_text("passed over")


def plain(df):
    """Rows, with paths as Spark writes them."""
    df = df.withColumn("source_path", F.regexp_replace("source_path", "^file:/+", "/"))
    return sorted((tuple(r[c] if c != "extra" else str(r[c]) for c in sorted(df.columns) if c not in ("page", "pages", "error")) for r in df.collect()), key=str)


def test_equal_to_the_plain_reader(spark, tmp_path):
    files(tmp_path / "in")
    read = spark.read.format("siftwell_corpus")
    for size in (10**6, 40):
        raw = read.option("partitionBytes", size).load(f"file://{tmp_path}/in")
        assert (raw.rdd.getNumPartitions() > 5) == (size == 40)
        docs = corpus.parsed(raw)
        assert plain(docs) == plain(corpus.read_corpus(spark, f"file://{tmp_path}/in"))
        assert docs.filter("error is not null").count() == 0
    both = corpus.parsed(read.load(f"file://{tmp_path}/in, {tmp_path}/in"))
    assert both.count() == 18


def test_broken_files_are_rows(spark, tmp_path):
    files(tmp_path / "in", 3)
    (tmp_path / "in" / "bad.md").write_bytes(b"\xff\xfe\x00")
    for name in ("m", "n"):
        (tmp_path / "in" / f"{name}.pdf").write_bytes(b"%PDF")
    (tmp_path / "in" / "m.meta.yaml").write_text("title: Manual\n")
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "m.md").write_text("---\ntitle: other\n---\nlayout text\n")
    docs = corpus.parsed(spark.read.format("siftwell_corpus").option("originals", f"{tmp_path}/md").load(f"file://{tmp_path}/in"))
    rows = {r["source_path"].rsplit("/", 1)[1]: r for r in docs.collect()}
    assert len(rows) == 6 and rows["m.pdf"]["text"] == "layout text" and rows["m.pdf"]["title"] == "Manual" and rows["m.pdf"]["parser"] == "layout"
    assert rows["bad.md"]["error"].startswith("UnicodeDecodeError") and rows["bad.md"]["text"] is None
    assert "FileNotFoundError" in rows["n.pdf"]["error"] and rows["n.pdf"]["doc_id"] == "n"
    want = plain(corpus.from_originals(spark, f"file://{tmp_path}/md", f"file://{tmp_path}/in"))
    assert plain(docs.filter(F.col("parser") == "layout").filter("error is null")) == want


def test_pages_of_a_large_pdf_are_partitions(tmp_path, monkeypatch):
    class Page:
        def __init__(self, k):
            self.k = k

        def extract_text(self):
            return f"page {self.k}"

    class Pdf:
        def __init__(self, data):
            self.pages = [Page(k) for k in range(int(data[4:7]))]

    monkeypatch.setattr(corpus_source, "_reader", Pdf)
    for name, n in (("long", 23), ("short", 2)):
        (tmp_path / f"{name}.pdf").write_bytes(f"%PDF{n:03d}".encode())
    reading = corpus_source._Reading({"path": str(tmp_path), "pages": "10", "partitionbytes": "32"})
    parts = reading.parts(reading.list())
    assert sorted((p.first, p.last) for p in parts if p.first is not None) == [(0, 10), (10, 20), (20, 23)] and len(parts) == 4
    rows = [r for p in parts for r in reading.read(p)]
    text = "\n\n".join(r[5] for r in sorted((r for r in rows if r[0].endswith("long.pdf")), key=lambda r: r[6]))
    assert text == "\n\n".join(f"page {k}" for k in range(23)) and all(r[8] is None for r in rows)


def test_a_stream_takes_each_file_once(spark, tmp_path):
    files(tmp_path / "all")
    (tmp_path / "in").mkdir()

    def run():
        stream = corpus.parsed(spark.readStream.format("siftwell_corpus").load(f"file://{tmp_path}/in"))
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted(r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    for upto in (4, 4, 9):
        for k in range(upto):
            if not (tmp_path / "in" / f"f{k}.md").exists():
                shutil.copy2(tmp_path / "all" / f"f{k}.md", tmp_path / "in")
        assert run() == sorted("f%d" % k if k % 3 == 0 else f"d{k}" for k in range(upto))
