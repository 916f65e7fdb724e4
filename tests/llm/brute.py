"""Plain versions of the operators, and a table of hard cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, target int, rank string, key string, start string, score string, node long, component string, n int, rule string, kind int, blob string, _blob string, _found int, _flags int, _turn int, _size int, _kept string, _copy int"


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(n))


def hard_rows(seed: int = 0) -> list[tuple]:
    """Nulls, blanks, very long texts, exact and near copies, shared passages, repeated rows, a hot source, clashing columns."""
    rng = random.Random(seed)
    a, b, passage = prose(rng, 120), prose(rng, 300), prose(rng, 60)
    near = b.split()
    near[7], near[150] = "changed", "CHANGED"
    texts = [
        None, "", " \t\n", "word", "two words", "one two three four", "ONE two THREE four", a, a.upper(), a, b, " ".join(near), b.replace(" ", "\n"), f"{prose(rng, 30)} {passage} {prose(rng, 30)}",
        f"{prose(rng, 80)}\u00a0{passage}", f"{prose(rng, 80)} {passage}", passage, prose(rng, 6000), " ".join(["same"] * 400), "x" * 50_000, "\u00e4\u00f6\u00fc \u65e5\u672c\u8a9e \U0001f642 " * 20,
        "### $$$ %%% " * 40, "line one here\nline one here\n\n  \nline one here \nother", "token: 'abcdef123456' AKIA" + "Z" * 16 + " " + "0a" * 14 + " secret=ab Password = hunter22 \U0001f642 api_key:\"zzzzzz\"", "<|endoftext|> it's <|ENDOFTEXT|>",
        "eins zwei\x0bdrei\x0cvier\rf\u00fcnf\x1csechs", "ghp_" + "a1B2" * 9 + " secret=token: abcdef",
    ]
    rows = [(k, t, "en", ["s1", "s1", "s1", None, "s2", "a"][k % 6]) for k, t in enumerate(texts)]
    rows += [rows[7], rows[10], (None, a, None, "s1"), (None, None, None, None), (100, b, "en", "s1"), (7, "another text with the id of an earlier row " * 8, "en", "s2")]
    rng.shuffle(rows)
    return [(*r, None if r[1] is None else len(r[1]), 1, 2, "r", "k", "s", "c", 5, "o", 3, "u", 4, "b", "x", 6, 7, 8, 9, "y", 10) for r in rows]


def docs(spark, rows=None):
    return spark.createDataFrame(hard_rows() if rows is None else rows, SCHEMA).repartition(3)


def shingles(text: str | None, width: int) -> frozenset:
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def linked(rows: list[tuple], width: int = 4, percent: int = 80) -> Counter:
    ids = {r[0]: r[0] for r in rows if r[0] is not None}

    def root(i):
        while ids[i] != i:
            i = ids[i]
        return i

    sets = [(r[0], shingles(r[1], width)) for r in rows]
    live = [(i, s) for i, s in sets if i is not None and s]
    for i, s in live:
        for j, t in live:
            if i < j and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(i), root(j)))
                ids[y] = x
    return Counter((i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets)


def kept_words(rows: list[tuple], window: int = 50) -> Counter:
    first: dict[tuple, int] = {}
    for r in rows:
        w = words(r[1])
        for k in range(len(w) - window + 1):
            if r[0] is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, r[0]), r[0])
    out = Counter()
    for r in rows:
        w, gone = words(r[1]), set()
        for k in range(len(w) - window + 1):
            if r[0] is not None and first[tuple(w[k : k + window])] < r[0]:
                gone |= set(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[r[0], len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()] += 1
    return out


def line_counts(text: str | None) -> tuple:
    text = text or ""
    w, seen, again = words(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    count = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if count[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def line_features(text: str | None) -> list[tuple[list[float], int]]:
    """(features, words) of each line with a word, one character at a time."""
    out, seen = [], set()
    lines = (text or "").split("\n")
    for k, line in enumerate(lines):
        w = words(line)
        if not w:
            continue
        chars, size = sum(map(len, w)), len(line.encode()) + (k < len(lines) - 1)
        count = lambda of: sum(c in of for c in line)  # noqa: E731, B023
        symbols, marks = count("#*$%&|<>"), count("!?.,;:-_/\\()[]{}\"'=+~^`@")
        upper, digits = sum("A" <= c <= "Z" for c in line), sum("0" <= c <= "9" for c in line)
        wide = sum(b >= 0x80 for b in line.encode())
        out.append(([
            1.0, min(20 * symbols / chars, 3), min(5 * upper / chars, 3), min(5 * digits / chars, 3), min(max(20 * marks / chars - 1, 0), 3), float(line in seen), math.exp(-len(w) / 4),
            min(max(math.log(chars / len(w)) - 1.6, -1.5), 3), float(line[-1] in ".!?"), wide / size,
        ], len(w)))
        seen.add(line)
    return out


def content_share(text: str | None, weights, pairs, start: float) -> float:
    """The share of words in content lines on the best path, found by trying each pair of neighbouring labels in turn."""
    lines = line_features(text)
    best = [((0.0, ()), (start, ()))] if lines else []
    for k, (features, _) in enumerate(lines):
        score = sum(a * b for a, b in zip(features, weights, strict=True))
        before = best[-1]
        best.append(tuple(max(((before[x][0] + (pairs[x][y] if k else 0) + score * y, (*before[x][1], y)) for x in ((0, 1) if k else (y,))), key=lambda v: v[0]) for y in (0, 1)))
    total = sum(n for _, n in lines)
    path = max(best[-1], key=lambda v: v[0])[1] if lines else ()
    return sum(n for (_, n), y in zip(lines, path, strict=True) if y) / max(total, 1)


def statistics(text: str | None) -> list[float]:
    """What the quality classifier sees of a text, by counting."""
    text, w = text or "", words(text)
    if not w:
        return [0.0] * 21
    n, sizes = len(w), [len(x) for x in w]
    chars, lines = sum(sizes), [x for x in text.split("\n") if WORD.search(x)]
    count = lambda of: sum(c in of for c in text)
    _, _, symbols, again, covered, _ = line_counts(text)
    mean, per_word = chars / n, Counter(w)
    upper, digits = sum("A" <= c <= "Z" for c in text), sum("0" <= c <= "9" for c in text)
    return [
        math.log1p(n), mean, math.sqrt(max(sum(s * s for s in sizes) / n - mean * mean, 0)), math.log1p(max(sizes)), sum(s <= 3 for s in sizes) / n, symbols / chars, upper / chars, digits / chars, text.count("!") / chars, text.count("|") / n,
        count("?.,;:-_/()[]\"'=+") / chars, sum(b >= 0xC0 for b in text.encode()) / chars, math.log1p(len(lines)), math.log1p(n / len(lines)), sum(x[-1] in ".!?" for x in lines) / len(lines), again / len(lines), covered / n, len(per_word) / n,
        max(per_word.values()) / n, sum(a == b for a, b in zip(w, w[1:], strict=False)) / n, sum("A" <= x[0] <= "Z" for x in w) / n,
    ]


def walked(row: list[float], base: float, feature, threshold, value) -> float:
    """The score of one row of statistics, tree by tree and node by node."""
    total = base
    for f, t, v in zip(feature, threshold, value, strict=True):
        node = 0
        while node < len(f):
            node = 2 * node + 1 + (row[f[node]] > t[node])
        total += v[node - len(f)]
    return 1 / (1 + math.exp(-total))


KINDS = ("assign", "access", "hex")
RULES = (re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+"))


def secrets(text: str | None) -> tuple:
    spans = []
    for k, (rule, group, least) in enumerate(zip(RULES, (2, 0, 0), (6, 20, 24), strict=True)):
        spans += [(m.start(), k, m.end()) for m in rule.finditer(text or "") if len(m[group]) >= least]
    shown = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(shown.encode()).hexdigest()
