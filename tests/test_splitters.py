"""The splitters, piece by piece, against plain ones that are written from their rules, one character or line at a time."""

from __future__ import annotations

import re

from siftwell.operators import chunking


def plain_pieces(text, size, overlap, separators=("\n\n", "\n", " ", "")):
    """Cut at the coarsest separator that occurs; short parts are joined up to `size`, each run beginning with the end of the last."""
    separator = next(s for s in separators if s == "" or s in text)
    finer = separators[separators.index(separator) + 1 :]
    parts, begin = [], 0
    if separator:
        for k in range(len(text)):
            if k > begin and text.startswith(separator, k) and (k >= begin + len(separator) or begin == 0):
                parts.append(text[begin:k])
                begin = k
        parts.append(text[begin:])
    else:
        parts = list(text)
    parts = [p for p in parts if p]
    out, run = [], []

    def close():
        nonlocal run
        joined, window, held = [], [], 0
        for p in run:
            if window and held + len(p) > size:
                joined.append("".join(window))
                while window and (held > overlap or held + len(p) > size):
                    held -= len(window[0])
                    window = window[1:]
            window, held = [*window, p], held + len(p)
        joined.append("".join(window))
        out.extend(j.strip() for j in joined if j.strip())
        run = []

    for p in parts:
        if len(p) < size or not finer:
            run.append(p)
        else:
            close()
            out.extend(plain_pieces(p, size, overlap, finer))
    close()
    return out


def plain_sections(text):
    """Lines gathered under the headings that are open; a heading closes those of its level and below."""
    out, h, fence, open_ = [], {}, None, None
    for line in text.split("\n"):
        bare = line.strip()
        if bare.startswith(("```", "~~~")):
            if fence is None:
                fence = bare[:3]
            elif fence == bare[:3]:
                fence = None
        m = None if fence else re.match(r"(#{1,3})[ \t]+(.+)$", bare)
        if m:
            h = {k: v for k, v in h.items() if k < len(m[1])} | {len(m[1]): m[2].strip()}
            continue
        path = tuple(h.get(k) for k in (1, 2, 3))
        if open_ is None or open_[0] != path:
            open_ = (path, [])
            out.append(open_)
        open_[1].append(line)
    return [(p, "\n".join(lines).strip()) for p, lines in out if "\n".join(lines).strip()]


def plain_tables(text, size):
    if len(text) <= size:
        return [text]
    out, held = [], ""
    for block in (b for b in re.split(r"\n\s*\n", text) if b):
        table = block.lstrip().startswith("|")
        if len(block) > size and not table:
            out += [held] if held else []
            held = ""
            out += plain_pieces(block, size, 80)
        elif held and len(held) + len(block) + 2 > size:
            out.append(held)
            held = block
        else:
            held = f"{held}\n\n{block}" if held else block
    return out + ([held] if held else [])


def plain_headings(title, text, size):
    out = []
    for path, body in plain_sections(text):
        names = [x for x in (path if path[0] else (title, *path)) if x]
        out += [(" > ".join(names), p) for p in plain_tables(body, size) if p.strip()]
    return out


def table(spark, sf_dir):
    """Documents as they are, and with headings, tables, fences and blank lines put in."""
    rows = [(r["doc_id"], f"Doc {r['doc_id']}", r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    marks = ["\n\n## Part {k}\n", "\n\n| a | b |\n| 1 | {k} |\n\n", "\n# Top {k}\n\n### Deep\n", "\n```\n# no heading {k}\n```\n", "\n \n\n"]
    more = []
    for n, (i, title, text) in enumerate(rows):
        lines = (text or "").split("\n")
        more.append((100_000 + i, title, "".join(line + marks[(n + k) % len(marks)].format(k=k) for k, line in enumerate(lines))))
    return [*rows, *more, (-1, "none", None), (-2, "blank", " \n\n "), (-3, "long", "x" * 5000)]


def found(chunks, *more):
    out = {}
    for r in chunks.orderBy("doc_id", "chunk_index", *more).collect():
        out.setdefault(r["doc_id"], []).append((r["section"], r["text"]))
    return out


def test_splitters_on_documents(spark, sf_dir):
    rows = table(spark, sf_dir)
    docs = spark.createDataFrame(rows, "doc_id long, title string, text string").repartition(4)
    for size, overlap in ((800, 100), (120, 30)):
        got = found(chunking.fixed(docs, size, overlap))
        assert got == {i: [("", p) for p in pieces] for i, _, text in rows if (pieces := plain_pieces(text or "", size, overlap))}
    got = found(chunking.by_headings(docs))
    want = {i: own for i, title, text in rows if (own := plain_headings(title, text or "", 1500))}
    assert got == {i: [(s, f"[{s}]\n{p}") for s, p in own] for i, own in want.items()}
    children, parents = chunking.parent_child(docs)
    assert found(parents) == got
    assert found(children, "child_index") == {i: [(s, f"[{s}]\n{c}") for s, p in own for c in plain_pieces(p, 350, 40)] for i, own in want.items()}
    ids = [(r["chunk_id"], r["parent_id"]) for r in children.select("chunk_id", "parent_id").collect()]
    assert len({c for c, _ in ids}) == len(ids) and all(c.rsplit("::", 1)[0] == p for c, p in ids)
