"""Column builders for text: tokens, ids of tokens, parts of model replies, citations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on: token pattern, stop words, endings in the order they are tried, refusal phrase.
TOKEN = r"[a-zA-ZäöüÄÖÜß0-9][a-zA-ZäöüÄÖÜß0-9\-]*"
STOPWORDS = """
der die das den dem des ein eine einer eines einem einen und oder aber in im am an auf aus bei mit
von vom zu zum zur fuer für ist sind war waren wird werden wurde wurden hat haben hatte hatten sich nicht
kein keine keinen auch nur noch als wie wenn dann dass da so es er sie ich wir ihr sein seine ihre ihren
ihrem ihres dieser diese dieses diesem diesen welche welcher welches was wer wo wann bis über ueber unter
nach vor durch ohne um bzw z b etc the of and to a is
""".split()
ENDINGS = ("ungen", "en", "er", "es", "e", "n", "s")
REFUSAL = "keine Information"
HIDDEN_CHARACTERS = "​‌‍⁠﻿"


def stem(token: Column) -> Column:
    """Drops the first ending that fits, once, from tokens of six characters or more."""
    out = F.when(F.length(token) < 6, token)
    for ending in ENDINGS:
        out = out.when(F.endswith(token, F.lit(ending)), F.left(token, F.length(token) - len(ending)))
    return out.otherwise(token)


def tokenize(text: Column) -> Column:
    """Lower-cased tokens without stop words and single characters, stemmed; null text has none."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)
    return F.transform(F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(STOPWORDS)), stem)


def token_id(token: Column) -> Column:
    """A token's number below 2**31 - 1, from the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % (2**31 - 1)


def json_list(raw: Column, fallback: Column | None = None) -> Column:
    """The list of strings between the first `[` and the last `]` of a reply; else the fallback (an empty list)."""
    fallback = F.array().cast("array<string>") if fallback is None else fallback
    body = F.regexp_extract(raw, r"(?s)\[.*\]", 0)
    parsed = F.from_json(body, "array<string>")
    # numbers and objects parse as strings too: a list of strings has as many quoted items as items
    strings = F.from_json(body, "array<variant>")
    plain = F.forall(strings, lambda v: F.schema_of_variant(v) == "STRING")
    return F.when((F.size(parsed) > 0) & F.coalesce(plain, F.lit(False)), parsed).otherwise(fallback)


def json_object(raw: Column, schema: str) -> Column:
    """The object between the first `{` and the last `}` of a reply, null if it can't be parsed."""
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.when(body != "", F.from_json(body, schema, {"mode": "PERMISSIVE"}))


def rank_list(raw: Column) -> Column:
    """The first bracketed list of numbers of a reply, null if there is none."""
    found = F.regexp_extract(raw, r"\[[\d,\s]+\]", 0)
    return F.when(found != "", F.from_json(found, "array<int>"))


def citations(answer: Column) -> Column:
    """Distinct numbers cited as [n], ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.cast("int"))))


def is_refusal(answer: Column) -> Column:
    return F.contains(answer, F.lit(REFUSAL))


def strip_hidden(text: Column) -> Column:
    """Without HTML comments and zero-width characters."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), f"[{HIDDEN_CHARACTERS}]", "")


def family(doc_id: Column) -> Column:
    """A document's family: its id without a trailing model or year number."""
    return F.regexp_replace(doc_id, r"-(ax\d+|20\d\d|\d+)$", "")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
