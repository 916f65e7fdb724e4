"""Each operator against brute force over hard cases, and over empty tables."""

from __future__ import annotations

import zlib
from collections import Counter

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import graph, mixing, neardup, packing, quality, queries, rules, secrets, substring, tokens, topk, urls


@pytest.fixture(scope="module")
def rows():
    return brute.hard_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return brute.docs(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], brute.SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, int(k not in (18, 21)), 0) for k in range(28)] + [(5, 0, 0), (6, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer())
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def counted(df) -> Counter:
    return Counter(tuple(r) for r in df.collect())


# --- quality --------------------------------------------------------------------------------------------------------


def test_quality(docs, labels, rows, none):
    got = quality.scored(docs, quality.train(docs, labels)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert quality.scored(none, quality.train(none, labels.limit(0))).count() == 0


def test_scores_are_those_of_a_plain_walk(docs, labels, rows):
    import pyarrow as pa

    texts = [r[1] for r in rows]
    got = quality.statistics(pa.array(texts, pa.string()))
    assert np.allclose(got, np.array([brute.statistics(t) for t in texts], np.float32), atol=1e-5)
    model = quality.train(docs, spread_labels(docs))
    assert len(model.feature) == quality.TREES and np.isfinite(model.threshold).any()
    want = Counter((i, round(brute.walked(x.tolist(), model.base, model.feature.tolist(), model.threshold.tolist(), model.value.tolist()), 9)) for (i, *_), x in zip(rows, got, strict=True))
    assert Counter((r["doc_id"], round(r["score"], 9)) for r in quality.scored(docs, model).collect()) == want


def spread_labels(docs):
    return docs.filter("doc_id is not null").selectExpr("doc_id", "cast(doc_id % 2 as int) as quality", "0 as toxic").distinct()


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    model = quality.grown(x[:3000], y[:3000])
    assert (np.round(model.scores(x[3000:])) == y[3000:]).mean() > 0.97


def test_held_out_accuracy(spark, sf_dir):
    got = queries.op1_quality(spark, sf_dir.replace("sf0.001", "sf0.01")).join(spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/labels.parquet"), "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.97


# --- urls -----------------------------------------------------------------------------------------------------------

URLS = [
    "http://a.example.org/es/" + "x/" * 20_000, "http://" + "a." * 2_000 + "example.org/en/1",
    None, "", "example.org/es/", "http://example.org/es/x", "https://A.EXAMPLE.ORG/en/12?x=1", "https://a.example.org/en/2", "http://notexample.org/es/", "http://org/", "http://org", "x://com/fr/", "x://a.com/de/1#x", "x://a.com:80/de/1",
    "http://", "http:///fr/", "http://example.org?/es/", "http://b.c.com/fr/a://z/de/", "http://.com/fr/", "http://com./fr/", "http://\u00c4.com/de/", "http://example.org/es/",
]


def test_urls(spark):
    pages = spark.createDataFrame([(k, u, "h", "p", "r") for k, u in enumerate(URLS * 30)] + [(None, "http://a.org/", "h", "p", "r")], "page_id long, url string, host string, path string, rule string").repartition(5)
    got = counted(urls.judged(pages, urls.rules_table(spark, queries.URL_RULES)).select("page_id", "host", "path", "rule", "verdict"))
    want = Counter()
    for page_id, url in [*enumerate(URLS * 30), (None, "http://a.org/")]:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, path = rest[:end].translate(brute.LOWER), rest[end:].split("?")[0].split("#")[0]
        fits = [(h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, "allow"))
        want[page_id, host, path, rule, verdict] += 1
    assert got == want
    assert urls.judged(pages.limit(0), urls.rules_table(spark, queries.URL_RULES)).count() == 0


def test_nested_rules_and_ties():
    s = urls.Sweep()
    for key, host, path, verdict in (("org.", "org", "/", "allow"), ("org.a.", "a.org", "/x/y", "block"), ("org.a.", "a.org", "/x/", "allow"), ("org.a.", "a.org", "/x/", "block"), ("org.a.b.", "b.a.org", "/", "allow")):
        s.add(key, host, path, verdict)
    assert s.longest("org.a.b.", "/x/z") == ("b.a.org/", "allow")  # as long as a.org/x/y, but of the longer host
    assert s.longest("org.ab.", "/x/") == ("org/", "allow")
    assert s.longest("com.", "/") is None


# --- token files ----------------------------------------------------------------------------------------------------


def test_token_files(docs, rows, none, encode):
    files = tokens.write(docs, queries.tokenizer())
    got = tokens.read(files).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    want = Counter((r[0], len(ids), zlib.crc32(ids.tobytes())) for r in rows for ids in (encode(r[1]),))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert tokens.read(tokens.write(none, queries.tokenizer())).count() == 0


def test_reader_takes_single_documents_and_finds_damage(tmp_path):
    import pyarrow as pa
    import zstandard

    data = [np.arange(k, dtype="<u4").tobytes() for k in (1, 0, 5000)]
    with (tmp_path / "f").open("wb") as out:
        w = tokens.Writer(out)
        for k, d in enumerate(data):
            w.add(None if k == 1 else k, d)
        w.finish()
    raw = (tmp_path / "f").read_bytes()
    r = tokens.Reader(pa.BufferReader(raw))
    assert [r.ids(k) for k in (2, 0, 1)] == [data[2], data[0], data[1]]
    assert r.doc_ids.tolist() == [0, tokens.NO_ID, 2]
    with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as whole:
        assert whole.read() == b"".join(data)
    bad = bytearray(raw)
    bad[int(r.at[2]) + 20] ^= 255
    with pytest.raises(Exception):  # noqa: B017
        tokens.Reader(pa.BufferReader(bytes(bad))).ids(2)


def test_encoder_is_the_tokenizer(encode):
    import random

    import pyarrow as pa

    rng, e = random.Random(4), tokens.Encoder(queries.tokenizer(), 1)
    parts = ["'s", "'ll", "don't", "\u03a3\u03b1\u03c2", "\u0130x", "<|endoftext|>", "a\u0301", "e\u0301,", "--", "...", "\u00a0", "\u3000", "\u65e5\u672c", "x1y2", "\u00bd", "\u01c5", "\u017ft", "\x1c", "\x85", "\U0001f642", "A", "T,", "\ufb01", "\u1100\u1161", "x\u0338", "<\u0338", "\u212b", "9.", "n.'s", "Word.", "word"]
    for _ in range(600):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", "\n", "\t "]) for _ in range(rng.randint(0, 12)))
        assert e(pa.array([text, None, text])) == [encode(text).tobytes(), encode("").tobytes(), encode(text).tobytes()], text


# --- near-duplicates ------------------------------------------------------------------------------------------------


def test_near_duplicates(docs, rows, none):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.linked(docs).collect())
    assert got == brute.linked(rows)
    assert neardup.linked(none).count() == 0


def test_near_duplicates_of_a_group_without_a_centre(spark):
    import random

    rng = random.Random(2)
    base, rows = brute.prose(rng, 200).split(), []
    for k in range(60):
        rows.append((k, " ".join(base)))
        for _ in range(2):
            base[rng.randrange(200)] = brute.prose(rng, 1)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.linked(df).collect()) == brute.linked(rows)


def test_near_copies_just_below_and_above_the_threshold(spark):
    """A large group whose texts differ from each other by about 20 %, with and without the text they come from."""
    import random

    rng = random.Random(5)
    rows = []
    for group, changes in enumerate((2, 3, 4)):
        base = brute.prose(rng, 150).split()
        for k in range(70):
            text = base[: 150 - 3 * (k % 4)]
            for _ in range(changes):
                text[rng.randrange(len(text))] = brute.prose(rng, 1)
            if k % 5 == 0:  # a paragraph that some share, and that the base lacks
                text += [f"shared{group}x{k % 10}w{w}" for w in range(12)]
            rows.append((1000 * group + k, " ".join(text)))
    rng.shuffle(rows)
    want = brute.linked(rows)
    assert 20 < len({c for _, _, c, _ in want}) < 190
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.linked(df).collect()) == want


def test_representatives(docs, rows):
    got = Counter(r["doc_id"] for r in neardup.representatives(docs).collect())
    keep = {i for i, _, _, kept in brute.linked(rows, 5) if kept and i is not None}
    assert got == Counter(list(keep) + [r[0] for r in rows if r[0] is None])


def test_components(spark):
    links = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(100, 200), (200, 100), (300, 300)], "a long, b long")
    got = dict(map(tuple, graph.components(links).collect()))
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 200: 100}
    assert graph.components(links.limit(0)).count() == 0


# --- top-k ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 3, 700])
def test_top_k(spark, n):
    rng = np.random.default_rng(n)
    v = [(k, (rng.normal(size=6) * 10.0 ** rng.integers(-1, 3)).tolist(), 1) for k in range(n)]
    v += [(k + n, v[k][1], 2) for k in range(n // 3)]  # ties
    odd = [(-100, None, 0), (-200, [1.0, None, 2.0, 0.0, 0.0, 0.0], 0), (-300, [float("nan")] * 6, 0), (-400, [float("inf")] * 6, 0), (None, [1.0] * 6, 0), (-600, [1.0, 2.0], 0), (-601, [0.5, 0.5], 0)]
    df = spark.createDataFrame(v + odd, "vec_id long, embedding array<double>, score int").repartition(4)
    got = sorted(map(tuple, topk.search(df, F.col("vec_id") % 100 == 0).select("query_id", "rank", "vec_id", "score").collect()))
    want = [(-600, 1, -601, 512 * 1024 + 512 * 2048)]
    cells = {i: [int(np.floor(1024 * x)) for x in e] for i, e, _ in v}
    for q in (i for i in cells if i % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(cells[q], c, strict=True)), i) for i, c in cells.items() if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_of_large_components(spark):
    """Finite components of any size take part; scores beyond a long are ranked by their true value."""
    rng = np.random.default_rng(1)
    sizes = (1.0, 3e6, 1e12, 1e20, 1e200, 1e307)
    v = [(k, (rng.normal(size=3) * sizes[k % len(sizes)]).tolist()) for k in range(320)]
    v += [(900, [3e6, 1.0, 0.0]), (1000, [1.0, 2.0, 0.0]), (1001, [3e6, 1.0, 0.0]), (1002, [0.0, 2.0**53, 0.0]), (1003, [0.0, 2.0**53 - 1, 0.0]), (1004, [0.0, -(2.0**53), 0.0])]
    got = sorted(map(tuple, topk.search(spark.createDataFrame(v, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 100 == 0).collect()))
    cells = {i: [topk.scaled(x) for x in e] for i, e in v}
    assert cells[900] == [3_072_000_000, 1024, 0] and cells[5] == [int(x) * 1024 for x in v[5][1]]
    want = []
    for q in (i for i in cells if i % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(cells[q], c, strict=True)), i) for i, c in cells.items() if i != q)[:10]
        want += [(q, k + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_copies_of_one_vector_do_not_meet_in_pairs(spark):
    """A vector that most rows have is read k + 1 times; its copies' results are those with the smallest ids."""
    rows = [(k, [1.0, 2.0] if k % 4 else [float(k), -1.0]) for k in range(1200)] + [(1, [1.0, 2.0])] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert topk._few_copies(df, 10).count() == 11 + 3 + 300
    got = sorted(map(tuple, topk.search(df, F.col("vec_id") % 50 == 1).collect()))
    cells, want = [(i, [topk.scaled(x) for x in e]) for i, e in rows], []
    for q, c in [x for x in cells if x[0] % 50 == 1]:
        best = sorted((-sum(a * b for a, b in zip(c, d, strict=True)), i) for i, d in cells if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_few_exact_vectors_are_read(spark):
    """The cells alone rule out nearly all, and the first exact scores most of the others."""
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(k, rng.normal(size=8).tolist()) for k in range(4000)], "vec_id long, embedding array<double>").repartition(4)
    cells = topk.approximation(rows)
    assert sum(len(r["ids"]) // 8 for r in cells.collect()) == 4000 and cells.columns == ["size", "ids", "low", "width", "codes"]
    queries = [next(topk.integers(b)) for b in rows.filter("vec_id % 400 = 0").toArrow().combine_chunks().to_batches()]
    sent = spark.sparkContext.broadcast([(8, queries[0][1], queries[0][2])])
    near = topk.candidates(cells, sent, 10)
    assert 100 <= near.count() < 0.02 * 10 * 4000
    read = topk._neighbours(rows, near, sent, 10).count()
    assert 100 <= read <= near.count()


# --- repeated passages ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [1000, 1])
def test_repeated_passages(docs, rows, none, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.report(docs).collect())
    assert got == brute.kept_words(rows)
    assert substring.report(none).count() == 0


def test_cut_keeps_columns(docs, rows):
    cut = substring.cut(docs)
    assert cut.columns == docs.columns
    assert sum(len(brute.words(r["text"])) for r in cut.collect()) == sum((n - gone) * c for (_, n, gone, _), c in brute.kept_words(rows).items())


# --- quality rules --------------------------------------------------------------------------------------------------


def test_rule_counts(docs, rows, none, labels):
    model = rules.fit(docs, labels)
    got = Counter(tuple(r)[:7] for r in rules.report(docs, model).collect())
    assert got == Counter((r[0], *brute.line_counts(r[1])) for r in rows)
    assert all(not r["kept"] for r in rules.report(docs, model).collect() if r["base_failed"])
    assert rules.report(none, rules.fit(none, labels.limit(0))).count() == 0
    assert rules.kept(docs, model).columns == docs.columns


def test_kept_follows_from_the_best_labelling(docs, rows, labels):
    model = rules.fit(docs, labels)
    got = Counter((r["doc_id"], r["kept"], round(r["content_share"], 9)) for r in rules.report(docs, model).collect())
    want = Counter()
    for r in rows:
        share = brute.content_share(r[1], model.weights, model.pairs, model.start)
        want[r[0], not brute.line_counts(r[1])[-1] and share >= model.share, round(share, 9)] += 1
    assert got == want
    kept = Counter(r["doc_id"] for r in rules.kept(docs, model).collect())
    assert kept == Counter(i for (i, k, _), n in want.items() for _ in range(n) if k)


def test_lines_of_mixed_documents_are_told_apart(spark):
    """Labels are of documents only: bad ones hold good lines too, and the field finds out which."""
    import random

    rng = random.Random(7)
    menu = lambda: " | ".join(brute.prose(rng, 1).title() for _ in range(8))
    line = lambda: brute.prose(rng, rng.randint(8, 20)).capitalize() + "."
    good = ["\n".join(line() for _ in range(rng.randint(3, 9))) for _ in range(60)]
    bad = ["\n".join([line(), *(menu() for _ in range(rng.randint(3, 6))), line(), menu()]) for _ in range(60)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 60), 0) for k in range(120)], "doc_id long, quality int, toxic int")
    model = rules.fit(docs, labels)
    page = "\n".join([menu(), menu(), line(), line(), line(), line(), line(), line(), menu()])
    import pyarrow as pa

    found = rules.Lines(pa.array([page]))
    decoded = model.decode((found.features @ np.array(model.weights)).tolist(), found.line_ends.tolist())
    assert decoded.tolist() == [False, False, True, True, True, True, True, True, False]
    shares = [r["content_share"] for r in rules.report(docs, model).orderBy("doc_id").collect()]
    assert min(shares[:60]) == 1 and all(0 < s < 0.7 for s in shares[60:])


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(1)
    for _ in range(30):
        (bb, bc), (cb, cc) = pairs = rng.normal(size=(2, 2)).tolist()
        scores = rng.normal(size=6).tolist()
        model = rules.Field(pairs=tuple(map(tuple, pairs)), start=0.7)
        value = lambda p: 0.7 * p[0] + sum(s * x for s, x in zip(scores, p, strict=True)) + sum(pairs[a][b] for a, b in zip(p, p[1:], strict=False))  # noqa: E731, B023
        best = max(itertools.product((0, 1), repeat=6), key=value)
        assert model.decode(scores, [6]).tolist() == [bool(x) for x in best]


def test_rules_keep_good_documents(spark, sf_dir):
    path = sf_dir.replace("sf0.001", "sf0.01")
    got = queries.op7_quality_rules(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").filter("not base_failed")
    assert got.filter("content_share > 0 and content_share < 1").count() > 10
    by = {r["quality"]: r["s"] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    assert by[1] > 0.98 and by[0] < 0.2


# --- mixing ---------------------------------------------------------------------------------------------------------


def test_mixing(docs, rows, none):
    got = mixing.report(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(brute.words(r[1]))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([sizes[s] for s in names], [5, 2, 1][: len(names)] + [5] * (len(names) - 3)), strict=True))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(brute.words(r[1]))) for r in rows)
    by_size = {r["source_size"]: r["target"] for r in got}
    assert by_size == {sizes[s]: pytest.approx(float(goal[s])) for s in names}
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    for s in names:
        assert abs(sum(r["taken"] for r in got if r["source_size"] == sizes[s]) - float(goal[s])) <= mixing.BLOCK
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.report(docs.repartition(2)).collect()))
    assert mixing.report(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_taken_words_are_those_of_the_blocks_drawn(docs, rows):
    """Words of a source in order, cut into blocks; every pass through a source takes each of its blocks once at most."""
    mix = mixing.Mix(docs)
    sources = {r["source_no"]: r for r in mix.sources.collect()}
    number = {r["source"]: k for k, r in sources.items()}
    slots = mix.slots.collect()
    assert len({(r["shard"], r["slot"]) for r in slots}) == len(slots)
    times = Counter((r["source_no"], r["block"]) for r in slots)
    for k, s in sources.items():
        drawn = [times[k, b] for b in range(s["blocks"])]
        assert sum(drawn) == s["slots"] and (not drawn or max(drawn) - min(drawn) <= 1)
    want, at = Counter(), Counter()
    for known, i, source, size in sorted(((r[0] is not None, r[0] or 0, r[3], len(brute.words(r[1]))) for r in rows), key=lambda x: (x[0], x[1], x[3])):
        k = number[source]
        taken = sum(times[k, w // mixing.BLOCK] for w in range(at[k], at[k] + size))
        at[k] += size
        want[i if known else None, size, taken] += 1
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in mix.taken().collect()) == want


@pytest.mark.parametrize("shards", [1, 2, 7, 100])
def test_shards_are_the_same_for_any_number_of_tasks(shards):
    left = np.array([shards * mixing.SHARD // 2, 3, shards * mixing.SHARD - shards * mixing.SHARD // 2 - 10])
    whole = list(mixing.Mix._shards(0, shards, 0, shards, left, np.zeros(3, np.int64), 5))
    parts = [x for k in range(shards) for x in mixing.Mix._shards(k, k + 1, 0, shards, left, np.zeros(3, np.int64), 5)]
    assert [(k, c.tolist(), b.tolist()) for k, c, b in whole] == [(k, c.tolist(), b.tolist()) for k, c, b in parts]
    assert (sum(c for _, c, _ in whole) == left).all() and all(c.sum() == mixing.SHARD for _, c, _ in whole[:-1])
    assert all((b == sum((c for _, c, _ in whole[:k]), np.zeros(3, np.int64))).all() for k, (_, _, b) in enumerate(whole))


def test_targets_are_capped_and_reshared():
    assert [float(t) for t in mixing.targets([10, 100, 890], [5, 2, 1])] == [30.0, 300.0, 670.0]
    assert mixing.targets([0, 0], [5, 2]) == [0, 0]
    assert [float(t) for t in mixing.targets([0, 8], [5, 2])] == [0.0, 8.0]


def test_mixed_documents_have_the_words_taken(docs):
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    words = Counter()
    for r in got.collect():
        words[r["doc_id"]] += len(brute.words(r["text"]))
    taken = Counter()
    for r in mixing.report(docs).collect():
        taken[r["doc_id"]] += r["taken"]
    assert +words == +taken


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000])
def test_permutations(n):
    for key in (1, 99):
        assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64)).tolist()) == list(range(n))


# --- packing --------------------------------------------------------------------------------------------------------


def test_packing(docs, rows, none, encode):
    got = packing.pack(docs, queries.tokenizer()).collect()
    texts = Counter((r[0], len(ids)) for r in rows for ids in (encode(r[1]),))
    whole = Counter()
    for r in got:
        whole[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert whole == Counter({(i, n): n * c for (i, n), c in texts.items()})
    sums: dict[tuple, list] = {}
    for r in rows:
        ids = encode(r[1])
        sums.setdefault((r[0], len(ids)), []).append(ids)
    for r in got:
        found = [zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for ids in sums[r["doc_id"], r["doc_tokens"]]]
        assert r["ids_crc32"] in found
    place: dict[int, list] = {}
    for r in got:
        place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in place.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(none, queries.tokenizer()).count() == 0


def test_plan_uses_up_the_demand_and_wastes_little():
    rng = np.random.default_rng(3)
    demand = Counter(rng.integers(1, 257, size=5000).tolist())
    plan, used = packing.planned(demand, 256), Counter()
    for times, pattern in plan:
        assert sum(c * n for c, n in pattern.items()) <= 256
        for c, n in pattern.items():
            used[c] += n * times
    assert used == demand
    least = sum(c * n for c, n in demand.items()) / 256
    assert sum(times for times, _ in plan) <= 1.02 * least + 2
    assert packing.planned({}, 256) == []


# --- secrets --------------------------------------------------------------------------------------------------------


def test_secrets(docs, rows, none):
    got = Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in secrets.report(docs).collect())
    assert got == Counter((r[0], *brute.secrets(r[1])) for r in rows)
    assert any("forge:" in r["spans"] for r in secrets.report(docs).collect())
    assert secrets.report(none).count() == 0


def test_ledger_scans_each_blob_once(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    first = spark.createDataFrame([(1, "password=abcdef"), (2, "password=abcdef"), (3, "clean"), (4, None)], "doc_id long, text string")
    second = first.union(spark.createDataFrame([(5, "token=123456"), (6, "clean")], "doc_id long, text string"))
    assert secrets.update(ledger, first).count() == 3
    assert secrets.update(ledger, second).count() == 4
    assert {r["doc_id"]: r["n_assign"] for r in secrets.report(second, ledger).collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 1, 6: 0}
    updates = lambda: secrets._updates(spark, ledger)
    rows = lambda path: sorted((len(r["rules"]), len(r["found"])) for r in spark.read.schema(secrets.LEDGER).parquet(path).collect())
    sizes = Counter(len(rows(p)) for p in updates())
    assert sizes == {4: 1, 1: 1, 0: 1} or sizes == {3: 1, 1: 1, 0: 1}  # the report had nothing left to scan
    # a rule that is new is scanned, and no other one
    before, more = set(updates()), (*secrets.RULES, secrets.Rule("word", "clean", 0, 1))
    got = {r["blob"]: r["found"] for r in secrets.update(ledger, second, more).collect()}
    (new,) = set(updates()) - before
    assert rows(new) == [(1, 0), (1, 0), (1, 0), (1, 1)] and sorted(len(f) for f in got.values()) == [0, 1, 1, 1]
    # without it, and for fewer rules, nothing is left to scan
    assert sorted(len(r["found"]) for r in secrets.update(ledger, first, secrets.BASE).collect()) == [0, 0, 1, 1]
    assert rows(next(iter(set(updates()) - before - {new}))) == []
    want = sorted(map(str, secrets.findings(spark, ledger, more).collect()))
    secrets.compact(spark, ledger)
    assert len(updates()) == 1 and sorted(map(str, secrets.findings(spark, ledger, more).collect())) == want


def test_spans_of_all_kinds(spark, docs, rows):
    """Every rule, the added ones too, against the same patterns by another engine."""
    import re

    rng = __import__("random").Random(3)
    pieces = ["-----BEGIN RSA PRIVATE KEY-----\nabc+/=\n-----END RSA PRIVATE KEY-----", "ghp_" + "a1B2" * 9, "gho_" + "z" * 40, "xoxb-123456789-abc", "xoxz-123456789", "eyJabcdefghi.eyJabcdefghi.abcdefgh_-", "AKIA" + "Q" * 16, "AKIAQ", "0f" * 13, "0f" * 9, "token=abc", "api_key: 'abcdef'", "\u00e4\U0001f642", " ", "\n", "plain"]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", "", "\n"]) for _ in range(rng.randint(1, 9))) for _ in range(300)] + [r[1] for r in rows]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    python = [re.compile(r.pattern.replace("(?i:", "(?ai:")) for r in secrets.RULES]
    want = {}
    for k, text in enumerate(texts):
        spans = [(m.start(), n, m.end()) for n, (p, r) in enumerate(zip(python, secrets.RULES, strict=True)) for m in p.finditer(text or "") if len(m[r.group]) >= r.least]
        want[k] = ",".join(f"{secrets.RULES[n].kind}:{a}:{b}" for a, n, b in sorted(spans))
    assert {r["doc_id"]: r["spans"] for r in secrets.report(table).collect()} == want
    assert all(any(f"{r.kind}:" in s for s in want.values()) for r in secrets.RULES)


def test_redaction(docs, rows):
    got = secrets.redacted(docs)
    assert got.columns == docs.columns
    for r in got.collect():
        assert brute.secrets(r["text"])[:3] == (0, 0, 0) or r["text"] is None
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    clean = Counter(r[1] for r in rows if brute.secrets(r[1])[:3] == (0, 0, 0) and "ghp_" not in (r[1] or ""))
    assert clean <= Counter(r["text"] for r in got.collect())


def test_empty_tables(none):
    """Of the functions that other tests only call with rows."""
    model = rules.Field()
    for df in (rules.kept(none, model), neardup.representatives(none), neardup.representatives(none, texts=True), secrets.redacted(none), substring.cut(none)):
        assert df.columns == none.columns and df.count() == 0


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import json

    import pyarrow as pa
    from tokenizers import Tokenizer

    made = json.loads(Tokenizer.from_file(queries.tokenizer()).to_str())
    assert tokens.by_words(made)
    made["normalizer"] = {"type": "NFC"}
    (tmp_path / "other.json").write_text(json.dumps(made))
    plain, e = Tokenizer.from_file(str(tmp_path / "other.json")), tokens.Encoder(str(tmp_path / "other.json"), 1)
    assert e.whole
    for text in ("Word, word.  WORD", "", None, "a-b c"):
        assert e(pa.array([text], pa.string()))[0] == np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()


# --- all ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    from compare import rows

    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.sql(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    assert rows(queries.QUERIES[name](spark, sf_dir).toPandas()) == rows(con.sql(queries.ORACLE_SQL[name]).df())


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        frames[name] = docs
        if name != "packing":
            assert docs.columns == before.columns
    ids = {name: {r["doc_id"] for r in df.select("doc_id").collect()} for name, df in frames.items()}
    assert ids["near-duplicates"] == ids["secret scans"] and ids["mixing"] == ids["packing"]
    assert all(brute.secrets(r["text"])[:3] == (0, 0, 0) for r in frames["secret scans"].collect())
    kept = [(r["doc_id"], r["text"]) for r in frames["quality rules"].collect()]
    assert ids["near-duplicates"] == {i for i, _, c, _ in brute.linked(kept, 5) if i == c}
    assert corpus_pipeline.run(spark, sf_dir).count() == frames["packing"].count()


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_hard_rows(spark, tmp_path, docs, none, labels, empty):
    import corpus_pipeline

    (none if empty else docs).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, now = now, stage(spark, now, str(tmp_path))
        if name != "packing":
            assert now.columns == before.columns
            now.write.parquet(f"{tmp_path}/{k}")
            now = spark.read.parquet(f"{tmp_path}/{k}")
            ids = [{r["doc_id"] for r in df.select("doc_id").collect()} for df in (before, now)]
            assert ids[1] <= ids[0]
    assert (now.count() == 0) == empty
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str) == sorted(map(tuple, now.collect()), key=str)
