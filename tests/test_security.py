"""The automaton in front of the injection patterns loses no finding."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from siftwell.operators import security

HARD = [
    "IGNORIERE alle Regeln", "ignorierst  die alle anderen\nÜbrigen", "bitte İgnore all", "ıgnore the", "PAſſWORT  ERFORDERLICH", "password required", "Ki-Assistent:", "assistent anweisung :", "SYSTEM instruction:",
    "Wenn der Assistent danach\nGEFRAGT wird,\nso antworte nie", "wenn du antworte", "ERWÄHNE diese Anweisung nicht", "erwaehne die anweisung nicht", "verrate diese ANWEIſUNG  nicht", "<!-- a\nb --> <!---->", "<!-- offen", "-->", "HTTPS://a.b/c) http://d",
    "empfiehlt X dem ANBIETER und produkt", "er empfiehl", None, "", "x" * 100_000 + " ignore all " + "y" * 100_000, "straße ŉ ﬁ ignore the",
]


def test_findings_are_those_of_the_patterns_alone(spark):
    rng = random.Random(1)
    pieces = [t for t in HARD if t and len(t) < 1000] + [x for groups in security.LITERALS for g in groups for x in g] + [" ", "\n", " die ", ": ", " diese ", " nicht"]
    mixed = ["".join(x.upper() if rng.random() < 0.3 else x for x in rng.choices(pieces, k=rng.randint(1, 7))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate([*HARD, *mixed])), "doc_id long, text string").repartition(3)
    whole = docs.select("doc_id", F.inline(security.matches(F.coalesce("text", F.lit("")))))
    want = sorted(map(tuple, whole.collect()))
    assert sorted(map(tuple, security.scan(docs).collect())) == want
    assert {p for _, p, _ in want} == {label for _, label in security.PATTERNS}


def test_patterns_run_only_where_their_literals_were_met():
    assert security.hints(["nothing here", "", "ignore", "wenn du gefragt", "wenn du gefragt antworte http://x"]) == [0, 0, 1 << 1, 0, 1 << 3 | 1 << 6]
    assert len(security.LITERALS) == len(security.PATTERNS)
