"""Document sources and sinks: Markdown with front matter, PDF with sidecar metadata, golden sets, index tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.sources.scratch import stored

#: Metadata that every document has after normalising; other keys go to `extra`.
KEYS = ("doc_id", "title", "department", "access", "status", "version", "valid_from", "valid_until")
META = "doc_id string, title string, department string, access array<string>, status string, version string, valid_from string, valid_until string, extra map<string,string>"
_FRONT = r"(?s)\A---\n(.*?)\n---\n"


def split_front_matter(text: Column) -> tuple[Column, Column]:
    """(YAML, body): YAML is null where the text has no front matter."""
    yaml = F.regexp_extract(text, _FRONT, 1)
    has = text.rlike(_FRONT)
    return F.when(has, yaml), F.when(has, F.regexp_replace(text, _FRONT, "")).otherwise(text)


def _parsed(texts: pd.Series) -> pd.DataFrame:
    """Front matter to raw metadata, values as text, `access` as a list; what isn't a mapping counts as empty."""
    import yaml

    rows = []
    for text in texts:
        try:
            found = yaml.safe_load(text) if text else {}
        except yaml.YAMLError:
            found = {}
        found = found if isinstance(found, dict) else {}
        row = {k: None if found.get(k) is None else str(found[k]) for k in KEYS if k != "access"}
        access = found.get("access")
        row["access"] = None if access is None else [str(a) for a in (access if isinstance(access, list) else [access])]
        row["extra"] = {str(k): str(v) for k, v in found.items() if k not in KEYS and v is not None}
        rows.append(row)
    return pd.DataFrame(rows, columns=[*KEYS, "extra"])


def parse_yaml(yaml: Column) -> Column:
    return F.pandas_udf(_parsed, META)(yaml)


def normalised(meta: Callable[[str], Column], fallback: Column) -> dict[str, Column]:
    """Defaults of missing metadata: id and title from the file's stem, public access, current, unknown department."""
    access = meta("access")
    return {
        "doc_id": F.coalesce(meta("doc_id"), fallback), "title": F.coalesce(meta("title"), fallback),
        "department": F.coalesce(meta("department"), F.lit("unbekannt")), "access": F.coalesce(access, F.array(F.lit("all"))),
        "status": F.coalesce(meta("status"), F.lit("current")), "version": F.coalesce(meta("version"), F.lit("")),
        "valid_from": meta("valid_from"), "valid_until": meta("valid_until"),
    }


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.meta)?\.[^./]+$", 1)


def _documents(rows: DataFrame, *more: str) -> DataFrame:
    """(yaml, text, source_path, parser) to documents; columns in `more` stay."""
    parsed = rows.withColumn("m", parse_yaml(F.col("yaml")))
    columns = normalised(lambda k: F.col(f"m.{k}"), _stem(F.col("source_path")))
    return parsed.select(*(c.alias(k) for k, c in columns.items()), F.trim(F.col("text"), F.lit(" \n\t\r")).alias("text"), F.col("m.extra").alias("extra"), "source_path", "parser", *more)


def read_markdown(spark: SparkSession, *folders: str) -> DataFrame:
    files = spark.read.text(list(folders), wholetext=True, recursiveFileLookup=False, pathGlobFilter="*.md")
    yaml, body = split_front_matter(F.col("value"))
    return _documents(files.select(yaml.alias("yaml"), body.alias("text"), F.col("_metadata.file_path").alias("source_path"), F.lit("markdown").alias("parser")))


def pdf_text(data: bytes) -> str:
    """Pages joined by blank lines; needs pypdf."""
    import io

    from pypdf import PdfReader

    return "\n\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)


def read_pdf(spark: SparkSession, *folders: str, parser: Callable[[bytes], str] = pdf_text, name: str = "pypdf") -> DataFrame:
    """PDF files with the metadata of `<stem>.meta.yaml` beside them, if there."""

    @F.pandas_udf("string")
    def parse(files: pd.Series) -> pd.Series:
        return files.map(parser)

    stem = F.regexp_replace(F.col("source_path"), r"(\.meta\.yaml|\.pdf)$", "")
    pdf = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(list(folders))
    pdf = pdf.select(F.col("path").alias("source_path"), "content").withColumn("stem", stem)
    side = spark.read.text(list(folders), wholetext=True, pathGlobFilter="*.meta.yaml").select(F.col("value").alias("yaml"), F.col("_metadata.file_path").alias("source_path"))
    side = side.select("yaml", F.regexp_replace(stem, r"^file:/+", "/").alias("stem"))
    rows = pdf.withColumn("stem", F.regexp_replace("stem", r"^file:/+", "/")).join(side, "stem", "left")
    return _documents(rows.select("yaml", parse("content").alias("text"), "source_path", F.lit(name).alias("parser")))


def from_originals(spark: SparkSession, originals: str, *folders: str) -> DataFrame:
    """The PDF files of folders as documents with the text of `<stem>.md` in `originals`; files without one are left out."""
    pdf = read_pdf(spark, *folders, parser=lambda _: "", name="layout").drop("text")
    texts = spark.read.text(originals, wholetext=True, pathGlobFilter="*.md").select(F.col("value"), _stem(F.col("_metadata.file_path")).alias("_stem"))
    body = F.trim(split_front_matter(F.col("value"))[1], F.lit(" \n\t\r"))
    rows = pdf.withColumn("_stem", _stem(F.col("source_path"))).join(texts.select("_stem", body.alias("text")), "_stem")
    return rows.drop("_stem")


def checked_format(path: Column) -> Column:
    """The file's suffix; any but .md and .pdf raises an error."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(suffix.isin(".md", ".pdf"), suffix).otherwise(F.raise_error(F.concat(F.lit("unsupported format: "), path)).cast("string"))


def read_corpus(spark: SparkSession, *folders: str, include: Iterable[str] | None = None, with_pdf: bool = False, originals: str | None = None) -> DataFrame:
    """Documents of all folders; of `include` only, if given.  Files of other formats are passed over.

    With `originals`, a PDF's text is that of its Markdown original, of the same name, in that folder: a way to read
    layouts without a parser.
    """
    docs = read_markdown(spark, *folders)
    if with_pdf:
        docs = docs.unionByName(from_originals(spark, originals, *folders) if originals else read_pdf(spark, *folders))
    return docs if include is None else docs.filter(F.col("doc_id").isin(list(include)))


def parsed(raw: DataFrame) -> DataFrame:
    """Rows of the source `siftwell_corpus`, of a batch or a stream, to documents, with the columns page, pages and error.

    A file that can't be read has its error, and a null text.
    """
    return _documents(raw, "page", "pages", "error")


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """The document of one file, by its suffix; any but .md and .pdf is an error."""
    suffix = spark.range(1).select(checked_format(F.lit(path)).alias("s")).first()["s"]
    docs = (read_markdown if suffix == ".md" else read_pdf)(spark, path.rsplit("/", 1)[0])
    return docs.filter(F.element_at(F.split("source_path", "/"), -1) == path.rsplit("/", 1)[-1])


def overview(docs: DataFrame) -> DataFrame:
    """doc_id, department, access (joined), status, length in characters; and the suffix of the source if known."""
    columns = ["doc_id", "department", F.concat_ws(",", "access").alias("access"), "status", F.length("text").cast("long").alias("n_chars")]
    if "source_path" in docs.columns:
        columns.append(F.regexp_extract("source_path", r"(\.[^./]+)$", 1).alias("format"))
    return docs.select(*columns)


GOLDEN = "id string, type string, question string, ground_truth string, source_docs array<string>, answerable boolean, allowed_roles array<string>, reviewed boolean"


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLDEN).json(path).filter("id is not null")


def write_golden(items: DataFrame, path: str, append: bool = False) -> None:
    items.write.mode("append" if append else "overwrite").json(path)


def feedback_candidates(feedback: DataFrame, stamp: int) -> DataFrame:
    """Feedback (question, expected, source_docs) as golden items to review, with ids `c<stamp><n>`, n from 1 by question.

    Questions are numbered range by range, after the sizes of the ranges before.
    """
    ranged = stored(feedback.select("question", "expected", "source_docs").repartitionByRange("question").withColumn("_range", F.spark_partition_id()), "feedback")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))  # a row a range
    feedback = ranged.join(sizes, "_range")
    n = (F.col("_base") + F.row_number().over(Window.partitionBy("_range").orderBy("question"))).cast("long")
    return feedback.select(F.concat(F.lit(f"c{stamp}"), n).alias("id"), F.lit("feedback").alias("type"), "question", F.col("expected").alias("ground_truth"), "source_docs", F.lit(True).alias("answerable"), F.lit(False).alias("reviewed"))


def write_index(path: str, **tables: DataFrame) -> None:
    """The tables of an index (chunks, postings, vectors, ...), each replaced as a whole."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)
