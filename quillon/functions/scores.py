"""Scores of text pairs and labels of queries, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import text as T

#: Words that keyword scoring skips.
KEYWORD_STOP = ("the", "a", "an", "and", "in", "on", "at", "of", "to", "for", "with", "by", "about", "is", "are")

#: Query types and the patterns that tell them, in the order in which they are tried.
QUERY_TYPES = (
    ("definition", r"what is|define|meaning of|definition of"),
    ("factual", r"who|when|where|how many|which|what country|what year"),
    ("procedural", r"how to|how do|steps|process|procedure"),
    ("comparative", r"difference between|compare|versus|vs|similarities|better"),
    ("causal", r"why|cause|effect|impact|result in"),
    ("exploratory", r"tell me about|explain|describe"),
)


def jaccard_sets(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct items; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def jaccard(a: Column, b: Column) -> Column:
    return T.let(T.word_set(a), lambda x: T.let(T.word_set(b), lambda y: jaccard_sets(x, y)))


def query_type(query: Column) -> Column:
    out = F.lit("exploratory")
    for name, pattern in reversed(QUERY_TYPES):
        out = F.when(F.lower(query).rlike(pattern), name).otherwise(out)
    return out


def keyword_density(query: Column, text: Column) -> Column:
    """Ten times keyword and (twice) phrase occurrences per word of the text, and 5 more if it holds the whole query.

    Phrases are the query's two- and three-token sequences; keywords its tokens without stop words.
    """
    length = F.greatest(F.lit(1), F.size(T.words(text)))
    bonus = F.when(F.contains(F.lower(text), F.lower(query)), 5.0).otherwise(0.0)

    def counted(asked: Column) -> Column:
        keywords = F.filter(asked, lambda w: ~w.isin(*KEYWORD_STOP))
        phrases = F.concat(T.ngrams(asked, 2), T.ngrams(asked, 3))
        total = lambda low, items: F.aggregate(items, F.lit(0.0), lambda acc, p: acc + T.count_of(low, p))
        return T.let(F.lower(text), lambda low: total(low, keywords) + 2 * total(low, phrases))

    return 10 * T.let(T.tokens(query), counted) / length + bonus


def lexical_diversity(text: Column) -> Column:
    """Distinct words per word; 0 for a text without words."""
    ratio = lambda own: F.when(F.size(own) > 0, F.size(F.array_distinct(own)) / F.size(own)).otherwise(0.0)
    return T.let(T.words(F.lower(text)), ratio)


def overlap_f1(answer: Column, expected: Column) -> Column:
    """F1 of the two word sets (the set form of ROUGE-1)."""

    def f1(a: Column, b: Column) -> Column:
        both = F.size(F.array_intersect(a, b))
        return F.when(both > 0, 2 * both / (F.size(a) + F.size(b))).otherwise(0.0)

    return T.let(T.word_set(answer), lambda a: T.let(T.word_set(expected), lambda b: f1(a, b)))


def ngram_f1(answer: Column, expected: Column, n: int) -> Column:
    """F1 over n-gram multisets, the full form of ROUGE-n."""

    def f1(a: Column, b: Column) -> Column:
        times = lambda items, g: F.size(F.filter(items, lambda x: x == g))
        both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, g: acc + F.least(times(a, g), times(b, g)))
        return F.when(both > 0, 2 * both / (F.size(a) + F.size(b))).otherwise(0.0)

    grams = lambda text: T.ngrams(T.tokens(text), n)
    return T.let(grams(answer), lambda a: T.let(grams(expected), lambda b: f1(a, b)))


def faithfulness(answer: Column, context: Column) -> Column:
    """Mean share of the answer's bigrams and trigrams that the context has; bigrams only if there is no trigram; 1 without either."""

    def share(own: Column, other: Column, n: int) -> Column:
        among = lambda grams, known: F.size(F.filter(grams, lambda g: F.array_contains(known, g))) / F.size(grams)
        return T.let(T.ngrams(own, n), lambda grams: T.let(F.array_distinct(T.ngrams(other, n)), lambda known: among(grams, known)))

    def both(own: Column, other: Column) -> Column:
        return F.when(F.size(own) < 2, 1.0).when(F.size(own) == 2, share(own, other, 2)).otherwise((share(own, other, 2) + share(own, other, 3)) / 2)

    return T.let(T.tokens(answer), lambda own: T.let(T.tokens(context), lambda other: both(own, other)))


def relevance_precision(query: Column, text: Column) -> Column:
    """Share of the query's words that the text has."""
    q = T.word_set(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, T.word_set(text))) / F.size(q)).otherwise(0.0)


def citation_rate(answer: Column) -> Column:
    low = F.lower(answer)
    return F.when(answer.contains("[") & answer.contains("]"), 1.0).when(low.contains("according to") | low.contains("mentioned in"), 0.8).otherwise(0.0)


def correctness(answer: Column, expected: Column) -> Column:
    """.8 with over five common words, .6 with over two, else .5."""
    both = F.size(F.array_intersect(T.word_set(answer), T.word_set(expected)))
    return F.when(both > 5, 0.8).when(both > 2, 0.6).otherwise(0.5)
