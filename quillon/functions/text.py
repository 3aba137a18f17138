"""Text as arrays: tokens, words, sentences, n-grams. All are JVM expressions.

A token is a run of letters, digits and underscores; a word is what white space separates; a sentence ends with
``.``, ``!`` or ``?`` before white space.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
SENTENCE_END = r"[.!?]+\s+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value computed once per row; a plain reference inside a lambda is computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column, lower: bool = True) -> Column:
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def word_set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")


def ngrams(items: Column, n: int) -> Column:
    """The n-grams of an array as blank-joined strings, repeats included."""

    def make(own: Column) -> Column:
        last = F.size(own) - n
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(own, i + 1, n), " "))

    return let(items, make)


def count_of(text: Column, part: Column) -> Column:
    """How often a string occurs in another without overlap; an empty part never does."""
    gone = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return F.when(F.length(part) > 0, gone / F.length(part)).otherwise(0.0)
