"""From raw documents to packed training sequences; each stage takes what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm import mixing, neardup, packing, rules, secrets
from siftwell.llm.common import passing, scratch
from siftwell.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose lines are mostly content; the field is fitted on labels of the input's documents.

    Rows keep all their columns and repeat as often as before; null and empty texts go.
    """
    return rules.kept(docs, rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    Of equal rows one stays; texts without a word, and rows without a doc_id, are no one's duplicates.
    """
    return neardup.representatives(docs, width=5, percent=80, texts=True)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mark; null texts stay null.

    Repeated rows stay as often as they are; an empty table stays empty.
    """
    return secrets.redacted(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a document has a row for each pass that takes some of it."""
    return mixing.mixed_documents(docs)


def packing_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the rows, placed in sequences; a row with a null or empty text is a document of one token.

    Repeated rows are documents of their own; an empty table gives no pieces.
    """
    return packing.pack(docs, tokenizer())


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("secret scans", secret_scans),
    ("mixing", mixing_sources),
    ("packing", packing_sequences),
]
#: The stages train models, hash and tokenise, which SQL doesn't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a Parquet table in the shared folder that the next one reads.

    Documents with null or empty texts fail the base rules, so they go first; rows without a doc_id are told apart by
    their texts alone; an empty table gives an empty result.  Each stage says more in the function it calls.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name.replace(" ", "_"))
        with passing(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
