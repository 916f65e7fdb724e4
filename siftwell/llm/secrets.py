"""Secret scans by an incremental blob ledger, in DataFrame functions only.

Every text is a blob named by its SHA-256.  The ledger says which rule versions each blob was scanned under, and what
they found; a scan takes only the pairs of blob and rule version that it has not yet seen, each once, however many paths
or historical versions hold the blob, and joins the findings back to all of them.

Rules are regular expressions in Java's dialect; matches of one rule are leftmost and don't overlap.  Offsets come
without a loop: between two matches lies the text that splitting at the rule leaves, so a running sum over lengths
of gaps and matches, in code points, gives each match its place.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm.common import scratch


@dataclass(frozen=True)
class Rule:
    """A match counts if the group's text has at least `least` characters."""

    kind: str
    pattern: str
    group: int
    least: int


#: The base rules, in the order that breaks ties of spans with equal starts.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: What the method adds: well-known credential formats.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
)
RULES = BASE + MORE
FOUND = "array<struct<start:int,kind:int,end:int>>"


#: A row of the ledger: the rule versions that an update has scanned a blob under, and what these found there.
LEDGER = "blob string, rules array<string>, found array<struct<start:int,rule:string,end:int>>"


def version(rule: Rule) -> str:
    return hashlib.sha256(repr(rule).encode()).hexdigest()[:16]


def _matches(text: Column, number: int, rule: Rule, todo: Column | None) -> Column:
    """Per match: kind, ordinal, length of the gap before it, its length, and whether it counts; null if it is not to do."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, rule.pattern, -1)
    if rule.group:
        zipped = F.zip_with(F.zip_with(whole, value, lambda m, v: F.struct(F.length(m).alias("m"), F.length(v).alias("v"))), gaps, lambda x, g: F.struct(x.alias("x"), F.length(g).alias("g")))
    else:
        zipped = F.zip_with(whole, gaps, lambda m, g: F.struct(F.struct(F.length(m).alias("m"), F.length(m).alias("v")).alias("x"), F.length(g).alias("g")))
    rows = F.transform(zipped, lambda r, i: F.struct(F.lit(number).alias("kind"), i.alias("at"), r["g"].alias("gap"), r["x"]["m"].alias("size"), (r["x"]["v"] >= rule.least).alias("counts")))
    # the last gap has no match
    found = F.when(text.rlike(rule.pattern), F.filter(rows, lambda r: r["size"].isNotNull()))
    return found if todo is None else F.when(F.getbit(todo, F.lit(number)) == 1, found)


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text) with distinct blobs to rows of the ledger; with a column `todo`, by the rules of its bits only."""
    versions, some = F.array(*(F.lit(version(r)) for r in rules)), "todo" in blobs.columns
    empty = F.array().cast("array<struct<kind:int,at:int,gap:int,size:int,counts:boolean>>")
    rows = F.flatten(F.array(*(F.coalesce(_matches(F.col("text"), k, r, F.col("todo") if some else None), empty) for k, r in enumerate(rules))))
    matches = blobs.select("blob", *(["todo"] if some else []), F.inline_outer(rows))  # a clean blob keeps one row of nulls
    so_far = Window.partitionBy("blob", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    matches = matches.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far).cast("int"))
    span = F.struct((F.col("end") - F.col("size")).alias("start"), F.get(versions, F.col("kind")).alias("rule"), "end")
    found = matches.groupBy("blob").agg(F.collect_list(F.when(F.col("counts"), span)).alias("found"), *([F.first("todo").alias("todo")] if some else []))
    done = F.filter(versions, lambda _, k: F.getbit(F.col("todo"), k) == 1) if some else versions
    return found.select("blob", done.alias("rules"), "found")


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _updates(spark: SparkSession, ledger: str) -> list[str]:
    """The paths of the updates that Spark has committed."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(ledger)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    past = [str(s.getPath()) for s in files.listStatus(top)] if files.exists(top) else []
    return sorted(p for p in past if files.exists(jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS")))


def update(ledger: str, texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what `ledger` lacks of the pairs of a blob of `texts` (column text) and a rule, and records it there.

    `ledger` is the path of a shared folder.  Each update is a table of its own in it, which counts once Spark has
    committed it, so a failed run leaves nothing half done.  Returns the findings for these rules of all updates:
    (blob, found), found empty where a blob has none.
    """
    spark = texts.sparkSession
    blobs = texts.select(blob_of(F.col("text")).alias("blob"), F.coalesce(F.col("text"), F.lit("")).alias("text")).dropDuplicates(["blob"])
    past = _updates(spark, ledger)
    if past:
        seen = spark.read.schema(LEDGER).parquet(*past).groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("seen"))
        left = [F.when(F.coalesce(F.array_contains("seen", version(r)), F.lit(False)), 0).otherwise(1 << k) for k, r in enumerate(rules)]
        blobs = blobs.join(seen, "blob", "left").select("blob", "text", sum(left, F.lit(0)).cast("int").alias("todo")).filter("todo > 0")
    fresh = f"{ledger}/{uuid.uuid4().hex}"
    scan(blobs, rules).write.parquet(fresh)
    return findings(spark, ledger, rules)


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, found) of all blobs in the ledger: spans of these rules, sorted by start, then by the order of the rules."""
    past = _updates(spark, ledger)
    rows = spark.read.schema(LEDGER).parquet(*past)
    if len(past) > 1:  # else each blob has one row
        rows = rows.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    versions = F.array(*(F.lit(version(r)) for r in rules))
    known = F.filter("found", lambda s: F.array_contains(versions, s["rule"]))
    spans = F.transform(known, lambda s: F.struct(s["start"].alias("start"), (F.array_position(versions, s["rule"]) - 1).cast("int").alias("kind"), s["end"].alias("end")))
    return rows.select("blob", F.array_sort(spans).alias("found"))


def compact(spark: SparkSession, ledger: str) -> None:
    """Makes one update of all there are.  If it fails before the old ones are gone, some rows are there twice, which changes nothing."""
    past = _updates(spark, ledger)
    if len(past) < 2:
        return
    rows = spark.read.schema(LEDGER).parquet(*past).groupBy("blob")
    both = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("rules", "found")]
    rows.agg(*both).write.parquet(f"{ledger}/{uuid.uuid4().hex}")
    for path in past:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def find(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row, found): every row of docs as a struct, and its findings; null if none.  Null text counts as empty."""
    texts = docs.select("text")
    spans = update(ledger or scratch(docs.sparkSession, "ledger"), texts, rules).filter("size(found) > 0")
    return docs.select(F.struct("*").alias("row"), blob_of(F.col("text")).alias("blob")).join(spans, "blob", "left").select("row", "found")


def report(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of docs (doc_id, text; other columns are ignored): the digest of its findings.

    doc_id, n_assign, n_access, n_hex (long), base_sha256 (of `kind:start:end` of the base findings, comma-joined in
    order), spans (all findings, joined likewise).  Null and empty texts have none; an empty table gives no rows.  Repeated
    rows and rows without a doc_id give a row each; a long text is held by one task as a whole.
    """
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    found = F.coalesce("found", F.array().cast(FOUND))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter(found, lambda s: s["kind"] == k)).cast("long")
    rows = find(docs.select("doc_id", "text"), ledger, rules)
    return rows.select(
        "row.doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(shown(F.filter(found, lambda s: s["kind"] < len(BASE))), 256).alias("base_sha256"), shown(found).alias("spans"),
    )


def redacted(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with each stretch of findings in `text` replaced by `mark`, and n_chars (if there) brought up to date.

    A null text stays null; repeated rows and rows without a doc_id stay as they are but for their texts; an empty table
    gives none.  A long text is held by one task as a whole.
    """
    text, found = F.col("row.text"), F.col("found")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, span: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, F.greatest(span["start"] - done["at"], F.lit(0)))
        fresh = F.concat(done["out"], gap, F.when(span["start"] >= done["at"], F.lit(mark)).otherwise(F.lit("")))
        return F.struct(F.greatest(done["at"], span["end"]).alias("at"), fresh.alias("out"))

    cut = F.aggregate(found, start, step, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))
    rows = find(docs, ledger, rules).withColumn("cut", F.when(found.isNotNull(), cut))
    changed = {"text": F.coalesce("cut", text), "n_chars": F.when(F.col("cut").isNull(), F.col("row.n_chars")).otherwise(F.length("cut")) if "n_chars" in docs.columns else None}
    return rows.select(*(changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in docs.columns))
