"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no search meaning.
STOPWORDS = (
    "a an and are as at be by can do does for from how i if in is it its of on or "
    "should that the their there this to was what when where which who why will with"
).split()
TOKEN = r"[a-z0-9]+(?:\.[0-9]+)?"
#: Instruction some embedding models expect before a query (fixed value), and the part of a model name that tells them.
QUERY_PREFIX, PREFIXED = "Represent this sentence for searching relevant passages: ", "bge-"


def tokens(c: Column) -> Column:
    """Lower-case word tokens, decimals kept whole, without stop words; null for null."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0)), lambda t: ~F.array_contains(stop, t))


def normalized(c: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def stripped(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def query_prefix(model: str) -> str:
    return QUERY_PREFIX if PREFIXED in model.lower() else ""


def preview(c: Column, n: int = 200) -> Column:
    return F.substring(c, 1, n)
