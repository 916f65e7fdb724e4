"""From hits to a prompt's context, and back from answers to sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import citations, is_refusal
from siftwell.operators.filters import top
from siftwell.sources.scratch import stored

SEPARATOR = "\n\n---\n\n"
#: Fixed value: the answer where there is no context.
NO_ANSWER = "Dazu enthaelt die Wissensbasis keine Information."


def renumbered(rows: DataFrame, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))


def dedupe(hits: DataFrame) -> DataFrame:
    """The first hit of each parent (of each chunk where it has none), ranked anew."""
    key = F.coalesce("parent_id", F.col("chunk_id").cast("string")) if "parent_id" in hits.columns else F.col("chunk_id").cast("string")
    rows = hits.withColumn("_key", key)
    first = Window.partitionBy("qid", "_key").orderBy("rank")
    return renumbered(rows.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth", "_key"), "rank")


def lost_in_middle(hits: DataFrame) -> DataFrame:
    """Odd ranks first in order, then even ranks backwards: 1, 2, 3, 4, 5 becomes 1, 3, 5, 4, 2."""
    place = F.when(F.col("rank") % 2 == 1, F.col("rank")).otherwise(F.lit(1 << 30) - F.col("rank"))
    return renumbered(hits.withColumn("_place", place), "_place").drop("_place")


def expand_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Replaces children by their parents, each once (the first child stays as child_id); other hits pass through."""
    rows = hits.join(parents.select(F.col("chunk_id").alias("parent_id"), F.lit(True).alias("_known")), "parent_id", "left")
    known = F.col("_known").isNotNull()
    rows = rows.select("qid", F.when(known, F.col("parent_id")).otherwise(F.col("chunk_id")).alias("chunk_id"), "score", "rank", F.when(known, F.lit("parent")).otherwise(F.col("source")).alias("source"), F.when(known, F.col("chunk_id")).alias("child_id"))
    first = Window.partitionBy("qid", "chunk_id").orderBy("rank")
    return renumbered(rows.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth"), "rank")


def pack(hits: DataFrame, max_chars: int = 6000) -> DataFrame:
    """(qid, rank, chunk_id, doc_id, block): blocks in order up to the first that overflows; the first always stays.

    hits has rank, doc_id, title, version and text; a null text counts as empty.  The separator between blocks doesn't count.
    """
    block = _block()
    upto = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = hits.withColumn("block", block).withColumn("_sum", F.sum(F.length("block")).over(upto))
    return rows.filter((F.col("rank") == 1) | (F.col("_sum") <= max_chars)).select("qid", "rank", "chunk_id", "doc_id", "block")


def _block() -> Column:
    return F.concat(F.lit("["), F.col("rank"), F.lit("] Quelle: "), F.coalesce("title", F.col("doc_id").cast("string")), F.lit(" ("), F.col("doc_id"), F.lit(", Version "), F.coalesce("version", F.lit("")), F.lit(")\n"), F.coalesce("text", F.lit("")))


def whole_corpus(docs: DataFrame) -> DataFrame:
    """(rank, doc_id, block) of all documents (doc_id, title, version, text) in order of doc_id, for a model that takes them all.

    doc_ids are distinct.  Ranks are counted by range: ranges of ids are numbered apart, after the sizes of those before.
    """
    ids = stored(docs.select("doc_id").repartitionByRange("doc_id").withColumn("range", F.spark_partition_id()), "ids")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ids.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row a range
    placed = ids.withColumn("at", F.row_number().over(Window.partitionBy("range").orderBy("doc_id"))).join(sizes, "range")
    rows = docs.join(placed.select("doc_id", (F.col("base") + F.col("at")).cast("long").alias("rank")), "doc_id")
    return rows.select("rank", "doc_id", _block().alias("block"))


def joined(packed: DataFrame) -> DataFrame:
    """(qid, context, n_sources, context_chars)."""
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda b: b["block"])
    rows = packed.groupBy("qid").agg(F.array_join(blocks, SEPARATOR).alias("context"), F.count(F.lit(1)).alias("n_sources"))
    return rows.withColumn("context_chars", F.length("context").cast("long"))


def distinct_docs(hits: DataFrame, k: int | None = None) -> DataFrame:
    """(qid, doc_id, rank): each query's documents in order of their first hit."""
    first = hits.groupBy("qid", "doc_id").agg(F.min("rank").alias("first"))
    return top(first, k or 1 << 30, "qid", "first", "doc_id").select("qid", "doc_id", "rank")


def cited(answers: DataFrame, packed: DataFrame) -> DataFrame:
    """(qid, cited_doc_ids): documents of the sources that an answer cites by number; other numbers count for nothing."""
    numbers = answers.select("qid", F.explode(citations(F.col("text"))).alias("rank"))
    found = numbers.join(packed.select("qid", "rank", "doc_id"), ["qid", "rank"]).groupBy("qid").agg(F.array_sort(F.collect_set("doc_id")).alias("cited_doc_ids"))
    return answers.select("qid").join(found, "qid", "left").select("qid", F.coalesce("cited_doc_ids", F.array().cast(found.schema["cited_doc_ids"].dataType)).alias("cited_doc_ids"))


def refusals(answers: DataFrame) -> DataFrame:
    return answers.withColumn("is_no_answer", is_refusal(F.col("text")))


def context_lengths(hits: DataFrame) -> DataFrame:
    """Mean over queries of their hits' total length."""
    return hits.groupBy("qid").agg(F.sum(F.length("text")).alias("chars")).agg(F.round(F.avg("chars"), 6).alias("avg_chars"), F.count(F.lit(1)).alias("n"))
