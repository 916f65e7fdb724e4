"""Injection scans, the ingest gate, access checks, audit rows."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

# Patterns of instructions hidden in documents, and their labels.
PATTERNS = [
    (r"ignorier\w*\s+(alle|saemtliche|sämtliche|die|alle anderen)\s+\w*", "Anweisung 'ignoriere ...'"),
    (r"\bignore\s+(all|previous|prior|the)\b", "Anweisung 'ignore ...' (EN)"),
    (r"\b(system|assistent|assistant|ki-assistent)\s*(anweisung|instruction)?\s*:", "Rollen-/Systemanweisung im Text"),
    (r"wenn\s+(du|der\s+assistent)\s+.*(gefragt|verwendest|nutzt).*antworte", "bedingte Antwortanweisung"),
    (r"(erwaehne|erwähne|verrate)\s+(diese|die)\s+anweisung\s+nicht", "Verschleierungsanweisung"),
    (r"<!--.*?-->", "versteckter HTML-Kommentar"),
    (r"https?://[^\s)]+", "URL im Dokument (Phishing-Risiko)"),
    (r"(passwort|password)\s+(eingeben|erforderlich|required)", "Aufforderung zur Passworteingabe"),
    (r"empfiehl\w*\s+.*\b(anbieter|produkt|shop)\b", "Produktempfehlung (Werbe-Injection)"),
]
REQUIRED = ("doc_id", "department", "version", "access")
#: For each pattern, groups of literals: a match holds one of each group, letters in either case.
LITERALS = [
    [("ignorier",)],
    [("ignore",)],
    [("system", "assistent", "assistant")],
    [("wenn",), ("gefragt", "verwendest", "nutzt"), ("antworte",)],
    [("erwaehne", "erwähne", "verrate"), ("anweisung",)],
    [("<!--",), ("-->",)],
    [("http://", "https://")],
    [("passwort", "password"), ("eingeben", "erforderlich", "required")],
    [("empfiehl",), ("anbieter", "produkt", "shop")],
]


def folded(text: str) -> str:
    """Letters that a pattern takes for the same in either case become the same."""
    return text.replace("\u0130", "i").upper().lower()


def hints(texts: Iterable[str]) -> list[int]:
    """Bits of the patterns that may match each text: one pass of an automaton over the literals of all patterns."""
    import ahocorasick

    groups = [(p, g) for p, pattern in enumerate(LITERALS) for g in range(len(pattern))]
    bits: dict[str, int] = {}
    for k, (p, g) in enumerate(groups):
        for literal in LITERALS[p][g]:
            bits[literal] = bits.get(literal, 0) | 1 << k
    automaton = ahocorasick.Automaton()
    for literal in bits:
        automaton.add_word(literal, sum(b for other, b in bits.items() if other in literal))
    automaton.make_automaton()
    need = [sum(1 << k for k, (q, _) in enumerate(groups) if q == p) for p in range(len(LITERALS))]
    out = []
    for text in texts:
        met = 0
        for _, found in automaton.iter(folded(text)):
            met |= found
        out.append(sum(1 << p for p, n in enumerate(need) if met & n == n))
    return out


@F.arrow_udf(IntegerType())
def hinted(texts: pa.Array) -> pa.Array:
    return pa.array(hints(t or "" for t in texts.to_pylist()), pa.int32())


def matches(text: Column, hint: Column | None = None) -> Column:
    """All findings of a text, in the order of the patterns: (pattern, snippet of up to 120 characters).

    With `hint`, only the patterns of its bits are tried.
    """
    none = F.array().cast("array<struct<pattern:string,snippet:string>>")

    def of(k: int, pattern: str, label: str) -> Column:
        snippet = lambda m: F.substring(F.regexp_replace(m, r"(?U)\s+", " "), 1, 120)
        found = F.transform(F.regexp_extract_all(text, F.lit("(?isuU)" + pattern), F.lit(0)), lambda m: F.struct(F.lit(label).alias("pattern"), snippet(m).alias("snippet")))
        return found if hint is None else F.when(F.getbit(hint, F.lit(k)) == 1, found).otherwise(none)

    return F.flatten(F.array(*(of(k, *p) for k, p in enumerate(PATTERNS))))


def found(docs: DataFrame) -> DataFrame:
    """docs with `_found`, the findings of the text: an automaton tells which patterns to try, most often none."""
    rows = docs.withColumn("_hint", hinted(F.coalesce("text", F.lit(""))))
    none = F.array().cast("array<struct<pattern:string,snippet:string>>")
    return rows.withColumn("_found", F.when(F.col("_hint") == 0, none).otherwise(matches(F.coalesce("text", F.lit("")), F.col("_hint")))).drop("_hint")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, pattern, snippet), a row a finding."""
    return found(docs.select("doc_id", "text")).select("doc_id", F.inline("_found"))


def gate(docs: DataFrame, trusted: Iterable[str] | None = None, required: Iterable[str] = REQUIRED, block: bool = True, max_findings: int = 0) -> DataFrame:
    """docs with accepted, reasons and n_findings: missing metadata, untrusted department, more findings than allowed.

    Metadata is missing if it is null, an empty text or an empty list.
    """
    empty = [F.when(F.col(c).isNull() | (F.size(c) == 0 if docs.schema[c].dataType.typeName() == "array" else F.col(c).cast("string") == ""), F.lit(f"'{c}'")) for c in required]
    missing = F.array_compact(F.array(*empty))
    reasons = [F.when(F.size(missing) > 0, F.concat(F.lit("fehlende Metadaten: ["), F.array_join(missing, ", "), F.lit("]")))]
    if trusted is not None:
        known = F.coalesce(F.col("department").isin(list(trusted)), F.lit(False))
        reasons.append(F.when(~known, F.concat(F.lit("nicht vertrauenswuerdige Quelle: "), F.coalesce("department", F.lit("None")))))
    if block:
        reasons.append(F.when(F.size("_found") > max_findings, F.concat(F.lit("Injection-Verdacht: "), F.array_join(F.transform(F.slice("_found", 1, 3), lambda f: f["pattern"]), "; "))))
    rows = found(docs)
    rows = rows.withColumns({"n_findings": F.size("_found"), "_reasons": F.array_compact(F.array(*reasons))}).drop("_found")
    return rows.withColumns({"accepted": F.size("_reasons") == 0, "reasons": F.array_join("_reasons", " | ")}).drop("_reasons")


def gate_report(gated: DataFrame) -> DataFrame:
    return gated.groupBy("accepted").agg(F.count(F.lit(1)).alias("n"))


def leak_matrix(hits: DataFrame, docs: DataFrame, roles: DataFrame) -> DataFrame:
    """(role, qid, permitted, leaked, leak): protected documents that a role's hits hold without being allowed to.

    hits (role, qid, doc_id); docs (doc_id, access); roles (role).  `leaked` lists the documents in order.
    """
    open_ = F.arrays_overlap("access", F.array(F.lit("all"), F.col("role")))
    seen = hits.join(docs.select("doc_id", "access"), "doc_id").select("role", "qid", "doc_id", open_.alias("ok")).distinct()
    ids = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("doc_id"))))
    return seen.join(roles.select("role"), "role").groupBy("role", "qid").agg(F.count_if("ok").alias("permitted"), F.array_join(ids, ",").alias("leaked"), (F.count_if(~F.col("ok")) > 0).alias("leak"))


def audit(requests: DataFrame) -> DataFrame:
    """Rows without clear text: short SHA-256 sums of user and query, sorted roles, the first ten candidates.

    requests (ts, user, query, roles, candidates); what else they have (times, tokens, citations) is kept, so hand in
    no other texts.
    """
    short = lambda c: F.substring(F.sha2(c, 256), 1, 16)
    rest = [c for c in requests.columns if c not in ("ts", "user", "query", "roles", "candidates")]
    return requests.select("ts", short("user").alias("user_sum"), short("query").alias("query_sum"), F.length("query").alias("query_len"), *rest, F.array_join(F.array_sort("roles"), ",").alias("roles"), F.array_join(F.slice("candidates", 1, 10), ",").alias("candidates"))


def tally(answers: DataFrame, by: str, outcomes: dict[str, str]) -> DataFrame:
    """How many answers of each variant hold each phrase."""
    return answers.groupBy(by).agg(*(F.count_if(F.contains("text", F.lit(phrase))).alias(name) for name, phrase in outcomes.items()))
