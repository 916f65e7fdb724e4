"""Retrieval and answer metrics, failure classes, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import family
from siftwell.functions.vectors import cosine
from siftwell.operators.context import distinct_docs
from siftwell.sources.scratch import stored

# Labels of failures, in the order in which their rules apply.
OK, UNASKED, NEAR_MISS, MISSING = "ok", "halluzination_statt_absage", "retrieval:semantic_near_miss", "retrieval:missing_evidence"
PARTIAL, REFUSED, NOISE, WRONG = "retrieval:partial_evidence", "generation:over_refusal", "generation:context_noise", "generation:wrong_answer"


def retrieval_rows(golden: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """One row per golden item (id, source_docs): hit, recall (null without sources), first_rank (null if missed), rr.

    hits (qid = id, doc_id, rank); documents count once, in order of their first hit, up to k.
    """
    sources = golden.select(F.col("id").alias("qid"), F.explode(F.array_distinct("source_docs")).alias("doc_id"))
    found = distinct_docs(hits, k).join(sources, ["qid", "doc_id"]).groupBy("qid").agg(F.count(F.lit(1)).alias("found"), F.min("rank").alias("first_rank"))
    rows = golden.join(found, golden["id"] == found["qid"], "left").drop("qid")
    n = F.size(F.array_distinct("source_docs"))
    return rows.withColumns({
        "hit": F.col("found").isNotNull(),
        "recall": F.when(n > 0, F.coalesce("found", F.lit(0)) / n),
        "first_rank": F.col("first_rank").cast("int"),
        "rr": F.coalesce(1 / F.col("first_rank"), F.lit(0.0)),
    }).drop("found")


def summary(rows: DataFrame, by: str | None = None) -> DataFrame:
    """n, hit_rate, recall, mrr, p_at_1 (rounded to three digits), in total or by a column; avg_ms if rows have t_retrieval_ms."""
    first = F.coalesce(F.col("first_rank") == 1, F.lit(False))
    # first to nine digits, so that no sum's order decides a half
    share = lambda c: F.round(F.round(F.avg(c.cast("double")), 9), 3)
    columns = [F.count(F.lit(1)).alias("n"), share(F.col("hit")).alias("hit_rate"), share(F.col("recall")).alias("recall"), share(F.col("rr")).alias("mrr"), share(first).alias("p_at_1")]
    if "t_retrieval_ms" in rows.columns:
        columns.append(F.bround(F.avg("t_retrieval_ms"), 0).alias("avg_ms"))
    return rows.groupBy(by).agg(*columns) if by else rows.agg(*columns)


def hit_by_type(rows: DataFrame, configs: list[str], first: bool = False) -> DataFrame:
    """Hit rate by type, a column a configuration; with `first`, the share whose first hit is at rank 1."""
    good = F.coalesce(F.col("first_rank") == 1, F.lit(False)) if first else F.col("hit")
    return rows.groupBy("type").pivot("config", configs).agg(F.round(F.avg(good.cast("double")), 6))


def e2e_summary(rows: DataFrame) -> DataFrame:
    """Accuracy, hit rate of answerable items, refusal rate of the others, mean time, total cost; null where none apply."""
    share = lambda c, where=None: F.round(F.avg(c.cast("double") if where is None else F.when(where, c.cast("double"))), 6)
    answerable = F.col("answerable")
    return rows.agg(
        F.count(F.lit(1)).alias("n"), share(F.col("correct")).alias("accuracy"), share(F.col("hit"), answerable).alias("hit_rate"),
        share(F.col("is_no_answer"), ~answerable).alias("refusal_rate"), F.round(F.avg("t_total_ms"), 6).alias("avg_ms"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
    )


def failure_class() -> Column:
    """The label of an evaluated row; empty where it was not judged."""
    families = F.transform("retrieved_docs", family)
    near = F.exists("source_docs", lambda s: F.array_contains(families, family(s)))
    return (
        F.when(F.col("correct").isNull(), "").when(F.col("correct"), OK).when(~F.col("answerable"), UNASKED)
        .when(~F.col("hit") & near, NEAR_MISS).when(~F.col("hit"), MISSING)
        .when(F.col("recall") < 1.0, PARTIAL).when(F.col("is_no_answer"), REFUSED)
        .when(F.col("first_rank") > 2, NOISE).otherwise(WRONG)
    )


def failure_pivot(rows: DataFrame, types: list[str]) -> DataFrame:
    return rows.groupBy("failure").pivot("type", types).count().fillna(0)


def failure_cube(rows: DataFrame) -> DataFrame:
    """Counts by failure and type with margins, null standing for all."""
    return rows.cube("failure", "type").agg(F.count(F.lit(1)).alias("n"))


def prefix_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.split_part("failure", F.lit(":"), F.lit(1)).alias("stage")).agg(F.count(F.lit(1)).alias("n"))


def average_precision(judged: DataFrame) -> DataFrame:
    """(qid, ap) of rows (qid, rank, relevant): the mean over relevant ranks of the share relevant up to there; 0 if none is."""
    upto = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rel = F.col("relevant").cast("int")
    rows = judged.withColumn("_p", F.when(F.col("relevant"), F.sum(rel).over(upto) / F.col("rank")))
    return rows.groupBy("qid").agg(F.round(F.coalesce(F.avg("_p"), F.lit(0.0)), 6).alias("ap"))


def support_ratio(flags: Column, statements: Column) -> Column:
    """Share of statements that are flagged; missing flags count as false, surplus ones not at all; 0 without statements."""
    yes = F.size(F.filter(F.slice(flags, 1, F.greatest(F.size(statements), F.lit(1))), lambda f: f))
    return F.when(F.size(statements) > 0, yes / F.size(statements)).otherwise(F.lit(0.0))


def answer_relevancy(answers: DataFrame, regenerated: DataFrame) -> DataFrame:
    """(qid, relevancy) of answers (qid, vector of the question, refused): the mean cosine to regenerated (qid, vector).

    Refusals and answers without regenerated questions have 0.
    """
    asked = answers.select("qid", "vector", F.coalesce("refused", F.lit(False)).alias("refused"))
    found = asked.join(regenerated.select("qid", F.col("vector").alias("_v")), "qid").groupBy("qid").agg(F.avg(cosine(F.col("vector"), F.col("_v"))).alias("_mean"))
    value = F.when(F.col("refused"), 0.0).otherwise(F.coalesce("_mean", F.lit(0.0)))
    return asked.join(found, "qid", "left").select("qid", F.round(value, 6).alias("relevancy"))


def judge_calibration(rows: DataFrame) -> DataFrame:
    """Of rows (human, judge): n, tp, precision and recall (denominators of 1 at least), agreement."""
    count = lambda c: F.sum(c.cast("long"))
    tp, said, true = count(F.col("human") & F.col("judge")), count(F.col("judge")), count(F.col("human"))
    ratio = lambda a, b: F.round(a / F.greatest(b, F.lit(1)), 6)
    return rows.agg(F.count(F.lit(1)).alias("n"), tp.alias("tp"), ratio(tp, said).alias("precision"), ratio(tp, true).alias("recall"), F.round(F.avg((F.col("human") == F.col("judge")).cast("double")), 6).alias("agreement"))


def regressions(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """(id) of the items that the reference hits and the candidate (id, hit) misses, a row each."""
    both = reference.filter("hit").select("id").join(candidate.select("id", "hit"), "id")
    return both.filter("NOT hit").select("id")


def regression_gate(reference: DataFrame, candidate: DataFrame, drop: float = 0.05) -> DataFrame:
    """Compares (id, hit) of two runs on ids in both: rates, how many ids are lost (see regressions) and missing, whether the candidate passes.

    A row per lost id, named in `regressed` and each with the same figures; one row with a null there if none is lost.
    """
    both = stored(reference.select("id", F.col("hit").alias("r")).join(candidate.select("id", F.col("hit").alias("c")), "id", "left"), "gate")
    rate = lambda c: F.avg(F.when(F.col("c").isNotNull(), F.col(c).cast("double")))
    rows = both.agg(F.round(rate("r"), 6).alias("ref_rate"), F.round(rate("c"), 6).alias("cand_rate"), F.count_if(F.col("r") & ~F.col("c")).alias("n_regressed"), F.count_if(F.col("c").isNull()).alias("n_missing"))
    rows = rows.withColumn("passed", (F.col("ref_rate") - F.col("cand_rate") <= drop) & (F.col("n_regressed") == 0))
    lost = both.filter("r AND NOT c").select(F.col("id").alias("regressed"))
    return F.broadcast(rows).join(lost, F.lit(True), "left").select("ref_rate", "cand_rate", "n_regressed", "regressed", "n_missing", "passed")  # one row to all lost


def grouped_latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    means = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"))
    return means.join(quantiles(rows, value, {"median": 0.5, "p95": 0.95}, by, 6), means[by].eqNullSafe(F.col("_by"))).drop("_by")


def box_plot(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, low, q1, median, q3, high): what a box plot of a value shows."""
    found = quantiles(rows, value, {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}, by, 6)
    return found.withColumnRenamed("_by", by)


#: Rows that Spark's own percentile, which keeps all distinct values of a group in one place, is trusted with.
IN_MEMORY = 5_000_000


def quantiles(rows: DataFrame, value: str | Column, shares: dict[str, float], by: str | None = None, digits: int = 4) -> DataFrame:
    """Exact interpolated quantiles, a column each, rounded; one row, or one a group with `_by`.  Nulls don't count.

    Beyond IN_MEMORY rows values are counted, dealt out by ranges and numbered range by range, so that no task sees
    more than its range and the two values next to each quantile are picked by their numbers.
    """
    key = F.col(by) if by else F.lit(0)
    some = rows.select(key.alias("_by"), (F.col(value) if isinstance(value, str) else value).cast("double").alias("v")).filter("v is not null")
    if some.count() <= IN_MEMORY:
        found = some.groupBy("_by").agg(*(F.round(F.percentile("v", p), digits).alias(n) for n, p in shares.items()))
    else:
        counted = some.groupBy("_by", "v").agg(F.count(F.lit(1)).alias("n"))
        dealt = stored(counted.repartitionByRange("_by", "v").withColumn("range", F.spark_partition_id()), "counts")
        before = Window.partitionBy("_by").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        sums = dealt.groupBy("_by", "range").agg(F.sum("n").alias("own"))  # a row a range
        sums = sums.select("_by", "range", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"), F.sum("own").over(Window.partitionBy("_by")).alias("total"))
        upto = Window.partitionBy("_by", "range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        placed = dealt.withColumn("upto", F.sum("n").over(upto)).join(sums.withColumnsRenamed({"_by": "_b", "range": "_r"}), F.col("_by").eqNullSafe(F.col("_b")) & (F.col("range") == F.col("_r")))
        placed = placed.withColumns({"upto": F.col("base") + F.col("upto"), "from": F.col("base") + F.col("upto") - F.col("n")})

        def at(p: float) -> Column:
            place = F.lit(p) * (F.col("total") - 1)
            pick = lambda k: F.max(F.when((F.col("from") <= k) & (k < F.col("upto")), F.col("v")))
            low, high, part = pick(F.floor(place)), pick(F.ceil(place)), F.max(place - F.floor(place))
            return F.round(low + (high - low) * part, digits)

        found = placed.groupBy("_by").agg(*(at(p).alias(n) for n, p in shares.items()))
    if by:
        return found
    # one row even where nothing counts
    return found.agg(*(F.max(n).alias(n) for n in shares))
