"""An index after any sequence of changes is the one built afresh; readers keep their version."""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor

import pytest

from siftwell.functions.vectors import hash_embed
from siftwell.operators import dense, lexical, monitor
from siftwell.operators.filters import Filter
from siftwell.plans.index_store import Alias, IndexStore
from siftwell.sources.versions import Conflict, Versions

CHUNKS = "chunk_id long, text string, status string"


def rows(df):
    return sorted((r["qid"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())


def text(rng):
    return " ".join(rng.choices(["urlaub", "reise", "kosten", "probe", "zeit", "monat", "vertrag", "konto"], k=rng.randint(0, 9)))


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "urlaub reise"), (2, "konto"), (3, "zeit monat probe")], "qid long, query string")


def test_any_sequence_of_changes_gives_the_index_built_afresh(spark, asked, tmp_path):
    rng, live = random.Random(3), {}
    store = IndexStore(spark, f"file://{tmp_path}/index")
    assert store.snapshot().version == 0 and store.snapshot().sparse(asked, 3).count() == 0
    pinned = None
    for step, change in enumerate(["upsert", "upsert", "delete", "upsert", "compact small", "delete", "compact"]):
        if change == "upsert":
            new = {k: (text(rng), rng.choice(["current", "old"])) for k in rng.sample(range(60), 25)}
            store.upsert(spark.createDataFrame([(k, *v) for k, v in new.items()], CHUNKS))
            live |= new
        elif change == "delete":
            gone = rng.sample(range(70), 15)
            store.delete(spark.createDataFrame([(k,) for k in gone], "chunk_id long"))
            live = {k: v for k, v in live.items() if k not in gone}
        else:
            store.compact(most=25 if change == "compact small" else None)
        if step in (0, 3, 4, 6):
            now, fresh = store.snapshot(), spark.createDataFrame([(k, *v) for k, v in live.items()], CHUNKS)
            assert sorted(map(tuple, now.chunks.collect())) == sorted((k, *v) for k, v in live.items())
            assert rows(now.sparse(asked, 7)) == rows(lexical.search(asked, fresh, 7))
            where = Filter(roles=None, status="old")
            assert rows(now.sparse(asked, 3, where)) == rows(lexical.search(asked, fresh, 3, where))
            vectors = hash_embed(asked, "qid", "query")
            assert rows(now.dense(vectors, 7)) == rows(dense.search(vectors, hash_embed(fresh, "chunk_id", "text"), 7))
        if step == 3:
            pinned = now, rows(now.sparse(asked, 7))
    assert rows(pinned[0].sparse(asked, 7)) == pinned[1]  # a reader that began before what came after
    assert len(store.snapshot().manifest["segments"]) == 1 and store.snapshot().manifest["tombs"] == []
    assert store.restore(pinned[0].version) == 8 and rows(store.snapshot().sparse(asked, 7)) == pinned[1]


def test_a_version_is_committed_once(spark, tmp_path):
    versions = Versions(spark, f"file://{tmp_path}/v")
    assert versions.latest() == 0

    def claim(k):
        try:
            return versions.commit({"by": k}, 0)
        except Conflict:
            return None

    with ThreadPoolExecutor(6) as pool:
        won = list(pool.map(claim, range(6)))
    assert sorted(won, key=str) == [1, None, None, None, None, None] and versions.all() == [1]
    assert versions.read(1) == {"by": won.index(1)}
    with pytest.raises(Conflict):
        versions.commit({}, 0)
    assert versions.commit({"by": 9}, 1) == 2 and versions.latest() == 2 and not list((tmp_path / "v").glob("**/.draft-*[!c]"))


def test_switch_between_indexes(spark, asked, tmp_path):
    blue, green, alias = (f"file://{tmp_path}/{n}" for n in ("blue", "green", "alias"))
    with pytest.raises(LookupError):
        Alias(spark, alias).snapshot()
    IndexStore(spark, blue).upsert(spark.createDataFrame([(1, "urlaub", "current")], CHUNKS))
    IndexStore(spark, green).upsert(spark.createDataFrame([(1, "urlaub", "current"), (2, "konto", "current")], CHUNKS))
    Alias(spark, alias).switch(blue)
    reader = Alias(spark, alias).snapshot()
    running = reader.sparse(asked, 3)
    Alias(spark, alias).switch(green)
    IndexStore(spark, blue).delete(spark.createDataFrame([(1,)], "chunk_id long"))
    other = Alias(spark.newSession(), alias).snapshot()
    assert other.path == green and {r["chunk_id"] for r in other.sparse(asked, 3).collect()} == {1, 2}
    assert {r["chunk_id"] for r in running.collect()} == {1} and {r["chunk_id"] for r in reader.sparse(asked, 3).collect()} == {1}
    compared = monitor.compare_indexes(*Alias(spark, alias).both(lambda s: s.sparse(asked, 3)))
    assert sorted((r["qid"], r["n_blue"], r["n_green"]) for r in compared.collect()) == [(1, 1, 1), (2, 0, 1)]
