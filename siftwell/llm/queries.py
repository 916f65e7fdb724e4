"""The queries of this subpackage, under the names that the entry module registers."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import audit, conversations, fingerprints, mixing, neardup, packing, quality, rules, secrets, substring, tokens, topk, urls
from siftwell.llm.common import scratch

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.linked(table(spark, sf_dir, "documents"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.report(docs, rules.fit(docs, table(spark, sf_dir, "labels")))


def tokenizer() -> str:
    """The path of the public tokenizer that the queries use; it must be installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The rules that op2 judges by.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), urls.rules_table(spark, URL_RULES))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read(tokens.write(table(spark, sf_dir, "documents"), tokenizer()))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In two deliveries, short texts first: the second scans only what the ledger lacks, and reports on all rows."""
    docs, ledger = table(spark, sf_dir, "documents"), scratch(spark, "ledger")
    secrets.update(ledger, docs.filter(F.length("text") < 1500).select("text"))
    return secrets.report(docs, ledger)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_quality, op2_url_filter, op3_token_files, op4_near_duplicates, op5_top_k, op6_repeated_passages, op7_quality_rules, op8_mixing, op9_packing, op10_secret_scan, op11_fingerprints, op12_filter_audit, op13_conversation_repair)}
ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": """
        WITH r AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), u AS (
            SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
        ), f AS (
            SELECT *, host = 'example.org' OR host LIKE '%.example.org' AS example, host = 'org' OR host LIKE '%.org' AS org, host = 'com' OR host LIKE '%.com' AS com FROM u
        ), j AS (
            SELECT page_id, host, path, CASE
                WHEN example AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN example AND starts_with(path, '/es/') THEN 'example.org/es/'
                WHEN org AND starts_with(path, '/') THEN 'org/' WHEN com AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN com AND starts_with(path, '/de/') THEN 'com/de/'
            END AS rule FROM f
        )
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM j""",
    "op4_near_duplicates": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
        ), u AS (
            SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w
        ), s AS (SELECT DISTINCT doc_id, sh FROM u),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        l AS (SELECT p.a, p.b FROM p JOIN n AS x ON x.doc_id = p.a JOIN n AS y ON y.doc_id = p.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
        c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
        SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id""",
    "op6_repeated_passages": """
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
        h AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS h FROM p),
        m AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h),
        f AS (SELECT doc_id, i FROM h JOIN m USING (h) WHERE doc_id > least),
        c AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 50)) AS j FROM f)),
        k AS (SELECT doc_id, j, ws[j] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM w)),
        t AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.j) AS kept, count(*) AS n FROM k LEFT JOIN c ON c.doc_id = k.doc_id AND c.j = k.j WHERE c.j IS NULL GROUP BY k.doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(t.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN t ON t.doc_id = w.doc_id""",
    "op5_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS c
            FROM embeddings WHERE embedding IS NOT NULL
        ), s AS (
            SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_inner_product(q.c, v.c) AS BIGINT) AS score
            FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM s
        )
        SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 10""",
    "op12_filter_audit": """
        WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        m AS (SELECT text, min(doc_id) AS least FROM w GROUP BY text),
        l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
        f AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CAST(len(ws) < 200 AS INTEGER)
                + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INTEGER)
                + 4 * CAST(100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 3 * length(w.text) AS INTEGER)
                + 8 * CAST(regexp_matches(w.text, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(w.doc_id > least, false) AS INTEGER) AS fails
            FROM w JOIN m USING (text) LEFT JOIN l ON l.doc_id = w.doc_id
        ), g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
        s AS (
            SELECT p.part, u.s, coalesce(sum(n) FILTER (fails & s = 0), 0) AS n, coalesce(sum(good) FILTER (fails & s = 0), 0) AS good, coalesce(sum(toxic) FILTER (fails & s = 0), 0) AS toxic
            FROM (SELECT DISTINCT part FROM g) AS p CROSS JOIN (SELECT unnest(range(32)) AS s) AS u JOIN g USING (part) GROUP BY p.part, u.s
        ), c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
        o AS (
            SELECT a.c || b.c || d.c || e.c || f.c AS filter_order FROM c AS a JOIN c AS b ON b.c <> a.c JOIN c AS d ON d.c NOT IN (a.c, b.c)
                JOIN c AS e ON e.c NOT IN (a.c, b.c, d.c) JOIN c AS f ON f.c NOT IN (a.c, b.c, d.c, e.c)
        ), t AS (
            SELECT filter_order, CAST(k AS INTEGER) AS step, filter_order[k] AS filter, CAST(1 << (strpos('ABCDE', filter_order[k]) - 1) AS INTEGER) AS own,
                CAST(list_sum(list_transform(range(1, k), lambda i: 1 << (strpos('ABCDE', filter_order[i]) - 1))) AS INTEGER) AS before
            FROM o, (SELECT unnest(range(1, 6)) AS k)
        ), r AS (
            SELECT x.part, filter_order, step, filter, y.n AS kept, x.n - y.n AS removed, z.n - h.n - (x.n - y.n) AS redundant, v.n - q.n AS unique_fails, x.good - y.good AS good_lost, x.toxic - y.toxic AS toxic_lost
            FROM t JOIN s AS x ON x.s = coalesce(before, 0) JOIN s AS y ON y.part = x.part AND y.s = coalesce(before, 0) | own JOIN s AS z ON z.part = x.part AND z.s = 0
                JOIN s AS h ON h.part = x.part AND h.s = own JOIN s AS v ON v.part = x.part AND v.s = 31 - own JOIN s AS q ON q.part = x.part AND q.s = 31
        )
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
            CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r""",
    "op13_conversation_repair": """
        WITH RECURSIVE k AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS bytes
            FROM conversations
        ), d AS (
            SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes),
                lambda crc, b: list_reduce(list_prepend(xor(crc, b), CAST(range(8) AS BIGINT[])), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) % 20 AS kind
            FROM k
        ), e AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM d
        ), o AS (
            SELECT conv_id, turn, role, text, row_number() OVER w AS pos, substr(role, 1, 1) AS initial, lead(substr(role, 1, 1)) OVER w AS following,
                right(rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 1) AS final
            FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)
        ), f AS (
            SELECT *, CASE WHEN final = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o
        ), r AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, '00000000' AS st, CAST(NULL AS VARCHAR) AS sy, CAST(NULL AS VARCHAR) AS us, CAST(NULL AS VARCHAR) AS ai FROM conversations
            UNION ALL
            SELECT conv_id, pos, DELETE(st), least(CASE WHEN free AND initial = 's' THEN KEEP(st) END, DELETE(sy)),
                least(DELETE(u), CASE WHEN free THEN least(REROLE(st), REROLE(sy), REROLE(a)) END, CASE WHEN free AND initial = 'u' THEN least(KEEP(st), KEEP(sy), KEEP(a)) END),
                least(DELETE(a), CASE WHEN free THEN REROLE(u) END, CASE WHEN free AND initial = 'a' THEN KEEP(u) END)
            FROM (SELECT *, least(ai, INSERT(u)) AS a FROM (
                SELECT r.conv_id, f.pos, st, sy, ai, initial, fault NOT IN ('blank', 'duplicate') AS free, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more, least(us, INSERT(st), INSERT(sy), INSERT(ai)) AS u
                FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.pos = r.pos + 1))
        ), z AS (
            SELECT conv_id, max_by(least(st, a), pos) AS best FROM (SELECT *, least(ai, INSERT(u)) AS a FROM (SELECT *, least(us, INSERT(st), INSERT(sy), INSERT(ai)) AS u FROM r)) GROUP BY conv_id
        ), l AS (SELECT conv_id, substr(best, 9) AS audit, unnest(range(1, length(best) - 7)) AS i FROM z),
        m AS (SELECT conv_id, i, audit[i] AS edit, count(*) FILTER (audit[i] <> 'I') OVER w AS pos, count(*) FILTER (audit[i] <> 'D') OVER w AS nth FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
        t AS (
            SELECT m.conv_id, i, edit, m.nth, f.role, f.text, max(CASE WHEN edit = 'K' AND m.nth = 1 AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY m.conv_id) AS system
            FROM m LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.pos = m.pos AND edit <> 'I' WHERE edit <> 'D'
        ), h AS (
            SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY i) AS repaired FROM t GROUP BY conv_id
        ), c AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (initial || following NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
        )
        SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            CAST(best[1:8] AS BIGINT) AS cost, substr(best, 9) AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
        FROM z LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM z.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM z.conv_id""",
}
#: In op13's SQL an item is its cost, in eight digits, and its audit, so the least of some strings is the least item.
for _edit, _cost in {"KEEP": "more", "REROLE": "3 + more", "DELETE": "4", "INSERT": "3"}.items():
    ORACLE_SQL["op13_conversation_repair"] = re.sub(_edit + r"\((\w+)\)", lambda m: f"lpad(CAST(CAST(substr({m[1]}, 1, 8) AS INTEGER) + {_cost} AS VARCHAR), 8, '0') || substr({m[1]}, 9) || '{_edit[0]}'", ORACLE_SQL["op13_conversation_repair"])  # noqa: B023
