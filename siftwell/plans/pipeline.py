"""A retrieval pipeline as one plan: queries are rows, a configuration picks the operators."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from typing import Literal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.vectors import hash_embed
from siftwell.operators import context, dense, evaluate, fusion, lexical, monitor, rerank, transform
from siftwell.operators.block_index import BlockIndex
from siftwell.operators.filters import Filter
from siftwell.sources.scratch import stored


@dataclass(frozen=True)
class PipelineConfig:
    """k hits from prefetch_k candidates.  status None searches all versions; enforce_acl False ignores roles."""

    retrieval: Literal["dense", "sparse", "hybrid"] = "hybrid"
    k: int = 5
    prefetch_k: int = 20
    fusion: Literal["rrf", "dbsf"] = "rrf"
    rerank: Literal["none", "lexical", "pairs", "listwise"] = "none"
    transform: Literal["none", "rewrite", "multi_query", "decompose", "hyde", "step_back"] = "none"
    parent_expand: bool = False
    reorder: Literal["none", "lost_in_middle"] = "none"
    max_context_chars: int = 6000
    status: str | None = "current"
    department: str | None = None
    enforce_acl: bool = True
    name: str | None = None

    def __post_init__(self):
        known = {"retrieval": ("dense", "sparse", "hybrid"), "fusion": ("rrf", "dbsf"), "rerank": ("none", "lexical", "pairs", "listwise"), "transform": transform.KINDS, "reorder": ("none", "lost_in_middle")}
        for key, values in known.items():
            if getattr(self, key) not in values:
                raise ValueError(f"{key} must be one of {values}")

    @property
    def label(self) -> str:
        parts = [self.retrieval, self.fusion if self.retrieval == "hybrid" else "", *(x for x in (self.transform, self.rerank) if x != "none"), "parents" if self.parent_expand else "", f"k{self.k}"]
        return self.name or "+".join(p for p in parts if p)


@dataclass
class Index:
    """chunks (chunk_id, doc_id, text, title, version, access, status, department; parent_id for children), and vectors (chunk_id, vector).

    With `postings`, a stored lexical index of the chunks, no search tokenises them again.
    """

    chunks: DataFrame
    vectors: DataFrame | None = None
    parents: DataFrame | None = None
    postings: BlockIndex | None = None
    chat: transform.Chat = field(default=transform.offline)
    scorer: rerank.Scorer | str | None = None  # or the name of a registered one

    @classmethod
    def of(cls, chunks: DataFrame, **more) -> Index:
        """With vectors by the hashing embedder."""
        return cls(chunks, hash_embed(chunks, "chunk_id", "text"), **more)

    @classmethod
    def built(cls, chunks: DataFrame, path: str, **more) -> Index:
        """The same with vectors and postings written below `path`, a folder of the index's own, for many searches."""
        vectors = stored(hash_embed(chunks, "chunk_id", "text"), "vectors", f"{path}/vectors")
        return cls(chunks, vectors, postings=BlockIndex.build(chunks, f"{path}/postings"), **more)

    def count(self) -> int:
        return self.chunks.count()


def search(config: PipelineConfig, index: Index, queries: DataFrame, n: int, roles: tuple[str, ...] | None) -> DataFrame:
    """hits of queries (qid, query) by the configured retrieval; filters hold in every ranking that is fused."""
    where = Filter(roles if config.enforce_acl else None, config.status, config.department)
    depth = config.prefetch_k if config.retrieval == "hybrid" else n
    found = []
    if config.retrieval != "dense":
        found.append(index.postings.search(queries, depth, where(index.chunks)) if index.postings else lexical.search(queries, index.chunks, depth, where))
    if config.retrieval != "sparse":
        asked = hash_embed(queries, "qid", "query")
        allowed = where(index.chunks).select("chunk_id")
        found.append(dense.search(asked, index.vectors.join(allowed, "chunk_id", "left_semi"), depth))
    if len(found) == 1:
        return found[0]
    return (fusion.rrf if config.fusion == "rrf" else fusion.dbsf)(found[0].unionByName(found[1]), n)


def candidates(config: PipelineConfig, index: Index, queries: DataFrame, roles: tuple[str, ...] | None = None) -> DataFrame:
    """hits before reranking: prefetch_k if they are reranked or fused over variants, else k."""
    variants = transform.transformed(queries, config.transform, index.chat)
    if config.transform != "none":
        variants = stored(variants, "variants")  # a model is asked once, however many rankings read its reply
    several = config.transform in ("multi_query", "decompose", "step_back")
    n = config.prefetch_k if several or config.rerank != "none" else config.k
    if not several:
        return search(config, index, variants.select("qid", "query"), n, roles)
    keyed = variants.select(F.concat_ws("#", F.col("qid").cast("string"), "variant").alias("vid"), "qid", "variant", "query")
    found = search(config, index, keyed.select(F.col("vid").alias("qid"), "query"), n, roles).withColumnRenamed("qid", "vid")
    return fusion.multi_query(found.join(keyed.select("vid", "qid", "variant"), "vid").drop("vid"), n)


def retrieve(config: PipelineConfig, index: Index, queries: DataFrame, roles: tuple[str, ...] | None = None) -> DataFrame:
    """The k best hits of each query, with doc_id; reranking sees the original query."""
    return reranked(config, index, queries, candidates(config, index, queries, roles))


def reranked(config: PipelineConfig, index: Index, queries: DataFrame, hits: DataFrame) -> DataFrame:
    """The k best of candidates by the configured reranker, with doc_id, and as parents if asked for."""
    if config.rerank == "lexical" or (config.rerank == "pairs" and index.scorer is None):
        hits = rerank.lexical(hits, queries, index.chunks, config.k)
    elif config.rerank == "pairs":
        score = rerank.scorer(index.scorer) if isinstance(index.scorer, str) else index.scorer
        hits = rerank.paired(hits, queries, index.chunks, score, config.k)
    elif config.rerank == "listwise":
        shown = rerank.passages(hits, queries, index.chunks)
        ask = F.concat(F.lit("Ordne die Passagen nach Relevanz, als JSON-Liste ihrer Nummern. Frage: "), "query", F.lit("\n"), "passages")
        hits = rerank.listwise(hits, shown.select("qid", transform.chat(ask, index.chat).alias("raw")), config.k)
    hits = hits.filter(F.col("rank") <= config.k)
    owner = index.chunks.select("chunk_id", "doc_id", *(["parent_id"] if "parent_id" in index.chunks.columns else []))
    hits = hits.join(owner, "chunk_id")
    if config.parent_expand:
        hits = context.expand_parents(hits, index.parents).join(index.parents.select("chunk_id", "doc_id"), "chunk_id", "left")
    return hits


def packed(config: PipelineConfig, index: Index, hits: DataFrame) -> DataFrame:
    """Blocks of the context, in the order that the model sees."""
    columns = "chunk_id", "title", "version", "text"
    texts = index.chunks.select(*columns)
    if index.parents is not None:
        texts = texts.unionByName(index.parents.select(*columns))
    rows = context.dedupe(hits)
    if config.reorder == "lost_in_middle":
        rows = context.lost_in_middle(rows)
    return context.pack(rows.join(texts, "chunk_id"), config.max_context_chars)


def run(config: PipelineConfig, index: Index, queries: DataFrame, roles: tuple[str, ...] | None = None, system: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, sources): answers with text, tokens, cost, is_no_answer and cited documents; sources as packed.

    Sources come after deduplication, reordering and the budget, so metrics on them differ from those on `retrieve`.
    `system` replaces what the answering model is told, for variants of a prompt to be compared.
    """
    sources = stored(packed(config, index, retrieve(config, index, queries, roles)), "sources")
    return _answers(index, queries, sources, system), sources


def _answers(index: Index, queries: DataFrame, sources: DataFrame, system: str | None) -> DataFrame:
    contexts = queries.select("qid", "query").join(context.joined(sources), "qid", "left")
    answers = context.refusals(stored(transform.answered(contexts, index.chat, system), "answers"))
    answers = answers.withColumn("cost_usd", monitor.cost(F.col("input_tokens"), F.col("output_tokens")))
    return answers.join(context.cited(answers, sources), "qid")


def logged_run(config: PipelineConfig, index: Index, queries: DataFrame, roles: tuple[str, ...] | None = None, system: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, sources, log): a run with a row a query in the shape of a request log (see monitor.flattened), and qid.

    A batch is one plan a stage, so each query has the stage's time, divided by the number of queries: retrieval, reranking
    (0 without a reranker), generation (which packs the context too), and all of it.  The stages write their tables.
    """
    n, marks = max(1, queries.count()), [time.perf_counter()]

    def timed(df: DataFrame, what: str) -> DataFrame:
        out = stored(df, what)
        marks.append(time.perf_counter())
        return out

    found = timed(candidates(config, index, queries, roles), "candidates")
    hits = timed(reranked(config, index, queries, found), "hits")
    sources = stored(packed(config, index, hits), "sources")
    answers = timed(_answers(index, queries, sources, system), "answered")
    retrieval, rerank_, generation = ((b - a) * 1000 / n for a, b in zip(marks, marks[1:], strict=False))
    ms = {"t_retrieval_ms": retrieval, "t_rerank_ms": 0.0 if config.rerank == "none" else rerank_, "t_generation_ms": generation, "t_total_ms": (marks[-1] - marks[0]) * 1000 / n}
    best = hits.groupBy("qid").agg(F.max("score").alias("top_score"))
    docs = sources.groupBy("qid").agg(F.collect_set("doc_id").alias("doc_ids"))
    rows = queries.select("qid", "query").join(answers, "qid").join(best, "qid", "left").join(docs, "qid", "left")
    trace = F.struct(*(F.lit(v).alias(k) for k, v in ms.items()), "input_tokens", "output_tokens", "cost_usd", F.lit(None).cast("string").alias("cache"))
    rows = rows.withColumns({"doc_ids": F.coalesce("doc_ids", F.array().cast(docs.schema["doc_ids"].dataType)), "no_answer": F.col("is_no_answer"), "trace": trace})
    return answers, sources, monitor.flattened(rows, "qid")


def evaluate_retrieval(config: PipelineConfig, index: Index, golden: DataFrame, roles: tuple[str, ...] | None = None, include_acl: bool = False) -> DataFrame:
    """Retrieval rows of golden items (id, type, question, source_docs) that have sources, marked with the configuration.

    Items of type acl have sources that the asking role must not see, so they are left out unless asked for.
    """
    asked = golden.filter(F.size("source_docs") > 0)
    if not include_acl:
        asked = asked.filter(~F.col("type").eqNullSafe("acl"))
    hits = retrieve(config, index, asked.select(F.col("id").alias("qid"), F.col("question").alias("query")), roles)
    return evaluate.retrieval_rows(asked, hits, config.k).withColumn("config", F.lit(config.label))


def compare(configs: list[PipelineConfig], index: Index, golden: DataFrame, roles: tuple[str, ...] | None = None, include_acl: bool = False) -> DataFrame:
    """One row of summary a configuration."""
    rows = None
    for config in configs:
        own = evaluate_retrieval(config, index, golden, roles, include_acl)
        rows = own if rows is None else rows.unionByName(own)
    return evaluate.summary(rows, "config")


def run_golden(config: PipelineConfig, index: Index, golden: DataFrame, roles: tuple[str, ...] | None = None, judge: transform.Chat | None = transform.offline, include_acl: bool = False) -> DataFrame:
    """Answers golden items, judges them (not at all if judge is None) and names each failure.

    Items of type acl are left out unless asked for: other roles ask them.  Ranks are those of the packed context.
    """
    asked = golden if include_acl else golden.filter(~F.col("type").eqNullSafe("acl"))
    answers, sources = run(config, index, asked.select(F.col("id").alias("qid"), F.col("question").alias("query")), roles)
    rows = evaluate.retrieval_rows(asked, sources, 1 << 30)
    seen = context.distinct_docs(sources).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("d"))
    seen = seen.select(F.col("qid").alias("id"), F.col("d.doc_id").alias("retrieved_docs"))
    said = answers.select(F.col("qid").alias("id"), F.col("text").alias("answer"), "is_no_answer", "cited_doc_ids", "cost_usd")
    rows = rows.join(said, "id").join(seen, "id", "left")
    rows = rows.withColumn("retrieved_docs", F.coalesce("retrieved_docs", F.array().cast("array<string>")))
    if judge is None:
        rows = rows.withColumns({"correct": F.lit(None).cast("boolean"), "judge_reason": F.lit("")})
    else:
        rows = stored(transform.judged(rows, judge), "judged")
    return rows.withColumn("failure", evaluate.failure_class())
