"""Answer metrics from model calls: what a text states, what a context bears out, which passages help, what a text answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import is_refusal, json_list, json_object
from siftwell.functions.vectors import hash_embed
from siftwell.operators import evaluate
from siftwell.operators.transform import CHUNK, Chat, chat, offline, prompt
from siftwell.sources.scratch import stored

METRICS = ("context_precision", "context_recall", "faithfulness", "answer_relevancy")
#: (rows, key, text) to (key, vector).
Embedder = Callable[[DataFrame, str, str], DataFrame]
#: Questions that a model is asked for, an answer.
QUESTIONS = 3


def with_contexts(rows: DataFrame, log: DataFrame) -> DataFrame:
    """rows (question) with `contexts` of the last run of that question in log (query, run_no, contexts); none if it never ran."""
    last = log.groupBy(F.col("query").alias("question")).agg(F.max_by("contexts", "run_no").alias("contexts"))
    return rows.join(last, "question", "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))


def statements(text: Column, provider: Chat = offline) -> Column:
    """The model's reply that lists a text's statements."""
    return chat(prompt("statements", t=text), provider)


def supported(listed: Column, context: Column, provider: Chat = offline) -> Column:
    """The model's reply that says which of the listed statements follow from a context; null, unasked, for no statements."""
    bullets = F.array_join(F.transform(listed, lambda s: F.concat(F.lit("- "), s)), "\n")
    return chat(F.when(F.size(listed) > 0, prompt("supported", c=context, s=bullets)), provider)


def flags(raw: Column) -> Column:
    """The list of true and false in a reply; empty if there is none."""
    return F.coalesce(F.from_json(F.regexp_extract(raw, r"(?s)\[.*\]", 0), "array<boolean>"), F.array().cast("array<boolean>"))


def relevant(rows: DataFrame, provider: Chat = offline) -> DataFrame:
    """(id, rank, relevant) of rows (id, question, ground_truth, contexts): a model's verdict on each passage; unreadable ones are false."""
    each = rows.select("id", "question", "ground_truth", F.posexplode("contexts").alias("at", "passage"))
    ask = prompt("relevant", q=F.col("question"), r=F.col("ground_truth"), c=F.substring("passage", 1, CHUNK))
    said = each.select("id", (F.col("at") + 1).alias("rank"), chat(ask, provider).alias("raw"))
    return said.select("id", "rank", F.coalesce(json_object(F.col("raw"), "relevant boolean")["relevant"], F.lit(False)).alias("relevant"))


def relevancy(rows: DataFrame, provider: Chat = offline, embedder: Embedder = hash_embed) -> DataFrame:
    """(id, answer_relevancy) of rows (id, question, answer): see evaluate.answer_relevancy; refusals are not asked about."""
    ask = F.when(~is_refusal(F.col("answer")), prompt("questions", n=F.lit(str(QUESTIONS)), a=F.col("answer")))
    said = stored(rows.select("id", F.posexplode(json_list(chat(ask, provider))).alias("at", "text")), "questions")
    named = said.select(F.concat_ws("#", F.col("id").cast("string"), "at").alias("part"), "id", "text")
    regenerated = embedder(named, "part", "text").join(named.select("part", "id"), "part").select(F.col("id").alias("qid"), "vector")
    answers = embedder(rows, "id", "question").join(rows.select("id", is_refusal(F.col("answer")).alias("refused")), "id").withColumnRenamed("id", "qid")
    return evaluate.answer_relevancy(answers, regenerated).withColumnsRenamed({"qid": "id", "relevancy": "answer_relevancy"})


def metric_table(rows: DataFrame, provider: Chat = offline, embedder: Embedder = hash_embed, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(id, the metrics named) of rows (id, question, ground_truth, answer, contexts), one row each; ids are distinct.

    context_recall and faithfulness are the shares of the reference's and of the answer's statements that follow from
    the contexts, context_precision is the average precision of their ranks, answer_relevancy the mean cosine of the
    question and those that a model would answer so.  Nothing to judge by gives 0.  Each prompt goes out once.
    """
    out, context = rows.select("id"), F.array_join("contexts", "\n\n")
    for name, text in (("context_recall", "ground_truth"), ("faithfulness", "answer")):
        if name in metrics:
            listed = stored(rows.select("id", context.alias("context"), json_list(statements(F.col(text), provider)).alias("listed")), "statements")
            judged = listed.select("id", "listed", supported(F.col("listed"), F.col("context"), provider).alias("raw"))
            out = out.join(judged.select("id", F.round(evaluate.support_ratio(flags(F.col("raw")), F.col("listed")), 6).alias(name)), "id", "left")
    if "context_precision" in metrics:
        found = evaluate.average_precision(relevant(rows, provider).withColumnRenamed("id", "qid"))
        out = out.join(found.withColumnsRenamed({"qid": "id", "ap": "context_precision"}), "id", "left").fillna(0.0, ["context_precision"])
    if "answer_relevancy" in metrics:
        out = out.join(relevancy(rows, provider, embedder), "id", "left")
    return out.select("id", *metrics)


def metrics_summary(table: DataFrame, by: str | None = None) -> DataFrame:
    """The mean of each metric, to three digits, in total or by a column."""
    means = [F.round(F.round(F.avg(c), 9), 3).alias(c) for c in METRICS if c in table.columns]
    return (table.groupBy(by) if by else table).agg(*means)
