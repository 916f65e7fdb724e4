"""Fingerprints, the filter audit and conversation repair against plain versions over hard cases and empty tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwell.llm import audit, conversations, fingerprints, queries


@pytest.fixture(scope="module")
def rows():
    return brute.hard_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return brute.docs(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], brute.SCHEMA)


# --- fingerprints ---------------------------------------------------------------------------------------------------

M64 = (1 << 64) - 1


def mixed(h: int) -> int:
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & M64
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & M64
    return h ^ h >> 31


def plain_fingerprint(text: str) -> str:
    """Order MinHash one k-mer and one function at a time."""
    points, seen, found = [ord(c) for c in text] + [0x10FFFF] * (fingerprints.K - 1), Counter(), []
    for at in range(len(text)):
        h = 0
        for c in points[at : at + fingerprints.K]:
            h = (h * 0x9E3779B97F4A7C15 + c) & M64
        h = mixed(h + 1 & M64)
        numbered = mixed(h + (seen[h] + 1) * 0xD1B54A32D192ED03 & M64) >> 32
        seen[h] += 1
        found.append((numbered, at, h))
    out = ""
    for f in range(1, fingerprints.FUNCTIONS + 1):
        a = mixed(f * 0x9E3779B97F4A7C15 & M64) >> 32 | 1
        least = sorted((n * a & 0xFFFFFFFF, at, h) for n, at, h in found)[: fingerprints.ORDER]
        total = 0
        for _, _, h in sorted(least, key=lambda x: x[1]):
            total = mixed(total * 3 + h + 1 & M64)
        out += f"{total >> 48:04x}"
    return out


def like(a: str, b: str) -> float:
    n = fingerprints.FUNCTIONS
    return sum(a[4 * k : 4 * k + 4] == b[4 * k : 4 * k + 4] for k in range(n)) / n


def test_fingerprints(spark, docs, rows, none):
    ordered = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    hashes = {r["t"]: r["h"] for r in docs.select(F.coalesce("text", F.lit("")).alias("t")).distinct().select("t", F.xxhash64("t").alias("h")).collect()}
    ordered.sort(key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]], r[1].encode()))
    want, shown = Counter(), {t: plain_fingerprint(t) for _, t in ordered}
    for k, (doc_id, text) in enumerate(ordered):
        new = ordered[(k + 1) % len(ordered)][1]
        cut = len(text) - len(text) // 3
        edited = text[:cut] + new[: len(text) - cut]
        shown[edited] = shown.get(edited) or plain_fingerprint(edited)
        want[doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), shown[text], shown[edited], like(shown[text], shown[edited]), like(shown[text], shown[new])] += 1
    got = fingerprints.compared(docs)
    assert Counter(map(tuple, got.collect())) == want
    assert Counter(map(tuple, fingerprints.fingerprinted(docs).collect())) == Counter((i, shown[t]) for i, t in ordered)
    stored = got.select("near_edited", fingerprints.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("again")).collect()
    assert all(r["near_edited"] == r["again"] for r in stored)
    assert fingerprints.compared(none).count() == 0
    one = spark.createDataFrame([(4, "a text of its own, alone")], "doc_id long, text string")
    assert fingerprints.compared(one).first()["near_next"] == 1.0


def test_fingerprints_see_order_and_edits():
    rng = random.Random(2)
    words = brute.prose(rng, 400).split()
    text, swapped = " ".join(words), " ".join(words[200:] + words[:200])
    typo, other = text.replace(words[50], "other", 1), brute.prose(rng, 400)
    found, _ = fingerprints.signatures([text, swapped, typo, other], [(0, "")] * 4)
    to = [(found[0] == f).mean() for f in found]
    assert to[0] == 1 and to[2] > 0.8 > to[1] > 0.2 > 0.05 > to[3]


def test_numbers_of_repeats_that_fall_together():
    h = np.array([5, 5, 6, 5, 6, 5, 5, 6], np.uint64) << np.uint64(3)  # too few bits are kept to tell 5 from 6
    got = fingerprints._numbers(h, np.array([0, 0, 0, 0, 0, 1, 1, 1], np.int32), np.array([0, 0, 0, 1, 1, 2, 2, 2], np.uint8))
    assert got.tolist() == [0, 1, 0, 2, 1, 0, 1, 0]


# --- the filter audit -----------------------------------------------------------------------------------------------


def plain_audit(rows, labels) -> Counter:
    marks = {c: {i for i, *flags in labels if flags[k] == 1} for k, c in enumerate("qt")}
    least: dict[str, int] = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    items = []
    for i, text, lang, *_ in rows:
        text, w = text or "", brute.words(text)
        upper = sum("A" <= c <= "Z" for c in text)
        fails = {f for f, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * upper > 3 * len(text), any(c in "#$%&*|" for c in text), i is not None and least[text] < i), strict=True) if bad}
        items.append((lang or "", fails, i in marks["q"], i in marks["t"]))
    out = Counter()
    for part in {x[0] for x in items}:
        own = [x for x in items if x[0] == part]
        table, shapley = [], Counter()
        for order in itertools.permutations("ABCDE"):
            alive = own
            for step, f in enumerate(order, 1):
                gone = [x for x in alive if f in x[1]]
                redundant = sum(f in x[1] for x in own) - len(gone)
                alive = [x for x in alive if f not in x[1]]
                shapley[f] += len(gone)
                table.append((part, "".join(order), step, len(alive), len(gone), redundant, sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone), f))
        for *row, f in table:
            out[(*row, shapley[f])] += 1
    return out


def test_filter_audit(spark, docs, rows, none):
    labels = [(k, k % 3 % 2, int(k % 5 == 0)) for k in range(20)] + [(5, 1, None), (6, None, 0), (None, 1, 1), (100, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    labels = [x for x in labels if x[0] is not None]
    assert Counter(map(tuple, audit.report(docs, table).collect())) == plain_audit(rows, labels)
    langs = [(*r[:2], None if k % 7 == 0 else f"l{k % 5}", *r[3:]) for k, r in enumerate(rows)]
    assert Counter(map(tuple, audit.report(brute.docs(spark, langs), table).collect())) == plain_audit(langs, labels)
    assert audit.report(none, table).count() == 0
    assert Counter(map(tuple, audit.report(docs, table.limit(0)).collect())) == plain_audit(rows, [])


def test_audit_of_many_parts_and_long_texts(monkeypatch):
    rng = np.random.default_rng(1)
    n = 9000
    fails, labels, parts = rng.integers(0, 32, n), rng.random((2, n)) < 0.3, rng.integers(0, 300, n)
    batch = pa.RecordBatch.from_arrays([pa.array([f"p{p}" for p in parts]), pa.array(fails, pa.int32()), *map(pa.array, labels)], ["part", "fails", "good", "toxic"])
    got = Counter()
    monkeypatch.setattr(audit, "HELD", 100)
    for out in audit._indexed(iter([batch.slice(0, 5000), batch.slice(5000)])):
        for part, s, *found in zip(*(c.to_pylist() for c in out.columns), strict=True):
            for k, v in enumerate(found):
                got[part, s, k] += v
    for p, s in ((0, 0), (7, 3), (299, 31), (150, 16)):
        alive = (parts == p) & (fails & s == 0)
        assert [got[f"p{p}", s, k] for k in range(3)] == [alive.sum(), (alive & labels[0]).sum(), (alive & labels[1]).sum()]
    texts = ["a b " * 200, "", "A" * 50 + " b" * 500, "x" * 3000, "w " * 150 + "|"]
    short = [audit.failed(t) for t in texts]
    monkeypatch.setattr(audit, "LONG", 10)
    assert [audit.failed(t) for t in texts] == short


# --- conversations --------------------------------------------------------------------------------------------------


def cheapest(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """(cost, audit) over rows (initial, must go, truncated), built from the end: the best way on from each state."""
    accept = {"": "", "s": None, "u": None, "a": ""}
    follow = {"": {"u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {s: (0, "") if v is not None else None for s, v in accept.items()}

    def inserted(best):
        for _ in range(4):  # more insertions in a row are never cheaper
            for s in follow:
                for t in follow[s]:
                    if best[t]:
                        best[s] = min(x for x in (best[s], (best[t][0] + 3, "I" + best[t][1])) if x)
        return best

    best = inserted(best)
    for initial, must_go, truncated in reversed(rows):
        more = 3 if truncated else 0
        fresh = {}
        for s in follow:
            ways = [(best[s][0] + 4, "D" + best[s][1])]
            if not must_go:
                if s == "" and initial == "s":
                    ways.append((best["s"][0] + more, "K" + best["s"][1]))
                for t in follow[s]:
                    ways.append((best[t][0] + more + 3, "R" + best[t][1]))
                    if initial == t:
                        ways.append((best[t][0] + more, "K" + best[t][1]))
            fresh[s] = min(ways)
        best = inserted(fresh)
    return best[""]


def plain_repairs(rows) -> Counter:
    of = defaultdict(list)
    for conv_id, turn, role, text, *_ in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv_id, turn)).encode()) % 20
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        of[conv_id] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = Counter()
    for conv_id, own in of.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        count, seen, marked = Counter(), set(), []
        for _, role, text in own:
            said = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
            seen.add((role, text))
            count[fault] += 1
            marked.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, edits = cheapest(marked)
        left, turns, state = iter(own), [], ""
        for e in edits:
            _, role, text = (None, "", "") if e == "I" else next(left)
            if e == "D":
                continue
            state = "s" if e == "K" and role[:1] == "s" else "a" if state == "u" else "u"
            turns.append((role if e == "K" else {"u": "user", "a": "assistant"}[state]) + ":" + text)
        out[conv_id, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, edits, hashlib.sha256("\n".join(turns).encode()).hexdigest()] += 1
    return out


ROLES = ("user", "assistant", "system", "user", "assistant", "tool", "", None)
TEXTS = ("Yes.", "No!", "cut of", "", None, " \t", "Well? ", "Fine.", "ä\U0001f642.", "\xa0", "x" * 3000 + ".")


def talk(seed: int, conversations: int, most: int, hot: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in [*range(conversations), None]:
        n = hot if c == 3 else rng.randint(1, most)
        for t in range(n):
            role = ("user", "assistant")[t % 2] if rng.random() < 0.7 else rng.choice(ROLES)
            rows.append((c, None if rng.random() < 0.05 else t if rng.random() < 0.9 else rng.randint(0, n), role, rng.choice(TEXTS) if rng.random() < 0.5 else f"text {rng.random()}."))
    rows += rows[:20] + [(7, 10**15, "user", "far."), (8, -(2**40), "assistant", "early")]
    rng.shuffle(rows)
    return [(*r, "x", 1, 2) for r in rows]


TALK = "conv_id long, turn long, role string, text string, task string, kind int, start int"


@pytest.mark.parametrize(("seed", "conversations_", "most", "hot"), [(0, 150, 9, 20), (1, 12, 5, 2600), (2, 1, 3, 5)])
def test_conversation_repair(spark, seed, conversations_, most, hot):
    rows = talk(seed, conversations_, most, hot)
    got = conversations.report(spark.createDataFrame(rows, TALK).repartition(3))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert Counter(map(tuple, got.collect())) == plain_repairs(rows)


def test_no_conversations(spark):
    none = spark.createDataFrame([], TALK)
    assert conversations.report(none).count() == 0


def test_chart_is_cheapest():
    rng = random.Random(4)
    marks = {"s": ("s", False, False), "u": ("u", False, False), "a": ("a", False, False), "o": ("t", False, False), "S": ("s", False, True), "U": ("u", False, True), "A": ("a", False, True), "O": ("t", False, True), "x": ("u", True, False)}
    for _ in range(3000):
        row = "".join(rng.choice("suauaoSUAOx") for _ in range(rng.randint(0, 9)))
        assert conversations.ended(conversations.chart(row))[:2] == cheapest([marks[c] for c in row]), row


@pytest.mark.parametrize("most", [1, 2, 7])
def test_chunks_of_any_size_give_the_same_repairs(monkeypatch, most):
    """Every task's rows through the four streams, without Spark, with chunks of a few rows."""
    monkeypatch.setattr(conversations, "ROWS", most)
    rng = random.Random(most)
    rows = [(c, t, rng.choice(("user", "assistant", "system", "tool")), rng.choice(("Yes.", "no", "", f"{rng.random()}."))) for c in range(8) for t in range(rng.randint(1, 60))]
    sha = lambda t: hashlib.sha256(t.encode()).digest()
    own, firsts = [], {}
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        role, text = "user" if kind == 4 else role, "" if kind == 1 else text.translate({ord(x): None for x in ".!?"}) if kind == 2 else text
        copies = {0: 0, 3: 2}.get(kind, 1)
        own.append((c, 1 if copies else 2, t, role, sha(text), text, copies))
        if copies:
            firsts.setdefault((c, role, sha(text)), t)
    own += [(c, 0, t, role, s, None, None) for (c, role, s), t in firsts.items()]
    own.sort(key=lambda r: (r[0], r[2], r[3], r[4], r[1]))
    border = sorted((r[0], r[2]) for r in own)[len(own) // 2]
    names = ["task", "conv_id", "kind", "turn", "role", "sha", "text", "copies"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int32()]
    done, chunks = [], []
    for task, part in enumerate(([r for r in own if (r[0], r[2]) < border], [r for r in own if (r[0], r[2]) >= border])):
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*((task, *r) for r in part), strict=True), kinds, strict=True)], names)
        for out in conversations._parsed(iter([batch.slice(0, 11), batch.slice(11)])):
            for r in out.to_pylist():
                (done if r["task"] is None else chunks).append(r)
    columns = [x.split()[0] for x in conversations.DONE.split(", ")]
    chunks.sort(key=lambda r: (r["conv_id"], r["task"], r["seq"]))
    table = pa.Table.from_pylist(chunks, schema=conversations._schema(conversations.DONE, conversations.CHUNK))
    forward = pa.Table.from_batches(conversations._forward(table.select(["conv_id", "task", "seq", "costs", "places"]).to_batches(max_chunksize=3)))
    backward = pa.Table.from_batches(conversations._traced(forward.take(list(range(len(forward)))[::-1]).to_batches(max_chunksize=4)))
    back = {(r["conv_id"], r["task"], r["seq"]): (r["start"], r["stop"]) for r in backward.to_pylist()}
    states = [back[r["conv_id"], r["task"], r["seq"]] for r in chunks]
    table = table.append_column("start", pa.array([s for s, _ in states])).append_column("stop", pa.array([s for _, s in states]))
    done += [r for out in conversations._joined(iter(table.to_batches(max_chunksize=5))) for r in out.to_pylist()]
    assert Counter(tuple(r[c] for c in columns) for r in done) == plain_repairs(rows)


def test_whole_tables(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(map(tuple, queries.op13_conversation_repair(spark, sf_dir).collect())) == plain_repairs(rows)
