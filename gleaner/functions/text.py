"""Scalar functions on text, cards and canonical JSON."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

BANK_PREFIX = "mem_"


#: The characters of Unicode's property White_Space (fixed values).
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def is_text(c: Column) -> Column:
    """True for a string with something besides white space."""
    return F.coalesce(F.length(strip(c)) > 0, F.lit(False))


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none at the ends. The four information separators count as white space here."""
    return strip(F.regexp_replace(c, r"(?U)[\s\x{1C}-\x{1F}]+", " "))


@F.pandas_udf(StringType())
def nfc(c: pd.Series) -> pd.Series:
    """Unicode normal form C, which Spark has no function for."""
    return c.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(ArrayType(StringType()))
def nfc_all(c: pd.Series) -> pd.Series:
    """Normal form C of every text of an array."""
    return c.map(lambda xs: None if xs is None else [None if x is None else unicodedata.normalize("NFC", x) for x in xs])


def canonical_json(c: Column) -> Column:
    """Compact JSON of a struct whose fields stand in alphabetical order; nulls are kept."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def digest(c: Column) -> Column:
    """SHA-256 of a struct's canonical JSON."""
    return F.sha2(canonical_json(c), 256)


def stable_hash(text: Column, n: int = 32) -> Column:
    """The first n hex digits of a text's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, n)


def safe_name(c: Column) -> Column:
    """Characters other than letters, digits, dot, dash and underscore become underscores, a run of them one."""
    return F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "_")


CARD_FIELDS = ("concept_name", "definition", "trigger", "decision", "pitfall")


def content_key(subject: Column, card: Column) -> Column:
    """SHA-256 of the subject and the card with normal texts; case and item order count. card: struct of CARD_FIELDS."""
    lists = [card[x] for x in ("trigger", "decision", "pitfall")]
    # one pass through Python for all texts of a card, as one array; the lists are cut out of it again by their sizes
    texts = nfc_all(F.concat(F.array(card["concept_name"], card["definition"]), *[F.coalesce(x, F.expr("cast(array() as array<string>)")) for x in lists]))
    size = [F.greatest(F.size(x), F.lit(0)) for x in lists]
    start = [F.lit(3), size[0] + 3, size[0] + size[1] + 3]
    trigger, decision, pitfall = (F.transform(F.slice(texts, a, n), collapse) for a, n in zip(start, size))
    normal = F.struct(
        collapse(F.get(texts, F.lit(0))).alias("concept_name"), decision.alias("decision"), collapse(F.get(texts, F.lit(1))).alias("definition"), pitfall.alias("pitfall"), trigger.alias("trigger"),
    )
    return digest(F.struct(normal.alias("card"), subject.alias("subject")))


def memory_id(key: Column, prefix: str = BANK_PREFIX) -> Column:
    return F.concat(F.lit(prefix), key)


def render_card(card: Column, fields: tuple[str, ...] = CARD_FIELDS) -> Column:
    """The card as text of its description and lists; `fields` leaves parts out."""
    parts = []
    if "definition" in fields:
        parts.append(F.array(F.concat(F.lit("Description: "), card["definition"])))
    for name in ("trigger", "decision", "pitfall"):
        if name in fields:
            parts.append(F.concat(F.array(F.lit(name.capitalize() + ":")), F.transform(card[name], lambda x: F.concat(F.lit("- "), x))))
    return F.array_join(F.concat(*parts), "\n") if parts else F.lit("")


def article_of(passage_id: Column) -> Column:
    return F.split(passage_id, "#")[0]
