"""Pluggable models: embedders, pair scorers and language models, each with a deterministic offline default.

A provider is a Python callable on a batch; Spark calls it on Arrow batches, and loads it once per worker.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 256
#: Frequent English words that carry no topic.
STOP_WORDS = frozenset(
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your".split()
)
_TOKEN = re.compile(r"\w+")


def _bucket(term: Column) -> tuple[Column, Column]:
    """Place and sign of a term: from the first eight hex digits of its MD5, and the parity of the ninth."""
    digest = F.md5(term)
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % DIMENSIONS
    sign = F.when(F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    return place, sign


def hashed_terms(terms: DataFrame, keys: list[str]) -> DataFrame:
    """From rows of keys and term, the signed hashed term counts at length one, as rows (keys, bucket, weight)."""
    place, sign = _bucket(F.col("term"))
    counts = terms.groupBy(*keys, "term").count()
    sums = counts.select(*keys, place.alias("bucket"), (sign * F.col("count")).alias("x")).groupBy(*keys, "bucket").agg(F.sum("x").alias("x"))
    norms = sums.groupBy(*keys).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return sums.join(norms, keys).where("norm > 0 and x <> 0").select(*keys, "bucket", (F.col("x") / F.col("norm")).alias("weight"))


_places: dict[str, tuple[int, int]] = {}
#: Terms whose place and sign a worker keeps.
_PLACES = 200_000


def _place(term: str) -> tuple[int, int]:
    if (got := _places.get(term)) is None:
        if len(_places) >= _PLACES:
            _places.clear()
        digest = hashlib.md5(term.encode("utf-8", "surrogatepass")).hexdigest()
        got = _places[term] = int(digest[:8], 16) % DIMENSIONS, 1 if int(digest[8], 16) % 2 == 0 else -1
    return got


class _Wholes(dict):
    """The first eight hex digits of terms' MD5, as numbers; a worker keeps some of them."""

    def __missing__(self, term: str) -> int:
        if len(self) >= _PLACES:
            self.clear()
        got = self[term] = int(hashlib.md5(term.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)
        return got


wholes = _Wholes()


def place(term: str) -> int:
    """The first eight hex digits of a term's MD5, as a number."""
    return wholes[term]


def terms(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def hashed_counts(text: str | None) -> np.ndarray:
    """A text's signed hashed term counts, before they are brought to length one."""
    if not (own := terms(text)):
        return np.zeros(DIMENSIONS)
    at, sign = zip(*map(_place, own), strict=True)
    return np.bincount(at, sign, DIMENSIONS)


def hash_embed(texts: list[str], cancel: bool = True) -> np.ndarray:
    """The same vectors in numpy, dense. Without ``cancel``, a text whose signed counts cancel each other out, as those of
    two terms in one place may, has its counts without signs: then only texts without a term have the zero vector."""
    out = np.array([hashed_counts(t) for t in texts]).reshape(len(texts), DIMENSIONS)
    if not cancel:
        for i in np.flatnonzero(~out.any(axis=1)):
            if own := terms(texts[i]):
                out[i] = np.bincount([_place(term)[0] for term in own], minlength=DIMENSIONS)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


EMBEDDERS: dict[str, Callable[[], Callable[[list[str]], np.ndarray]]] = {"hash": lambda: hash_embed}
#: Well-known embedders by what they are good for, as a menu. All but ``hash`` must be registered first.
MENU = {
    "Offline": ["hash"],
    "Lightweight (Fast)": ["all-MiniLM-L6-v2", "BAAI/bge-small-en-v1.5"],
    "Balanced": ["all-mpnet-base-v2"],
    "Specialized": ["multi-qa-mpnet-base-dot-v1"],
    "Commercial API": ["text-embedding-ada-002"],
}
SCORERS: dict[str, Callable[[], Callable[[list[str], list[str]], list[float]]]] = {}
MODELS: dict[str, Callable[[], Callable[[list[str]], list[str]]]] = {"echo": lambda: lambda prompts: [f"Response to: {p}" for p in prompts], "rating": lambda: rate, "extractive": lambda: quote}
_loaded: dict[tuple[str, str, str], Callable] = {}


def _words(text: str) -> set[str]:
    return {w for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w}


def rate(prompts: list[str]) -> list[str]:
    """An offline model that rates what follows ``Document:`` against the line after ``Query:``, by their words: 1 without a
    common one, 10 for the same."""
    out = []
    for prompt in prompts:
        query, _, document = prompt.partition("Query: ")[2].partition("\nDocument: ")
        a, b = _words(query), _words(document)
        out.append(str(math.floor(1 + 9 * (len(a & b) / len(a | b) if a and b else 0.0) + 0.5)))
    return out


def quote(prompts: list[str]) -> list[str]:
    """An offline model that answers with the sentence of the context that shares most words with the question, the first
    of equal ones; with nothing if none does."""
    out = []
    for prompt in prompts:
        head, _, tail = prompt.rpartition("\n\nQuestion: ") if "\n\nQuestion: " in prompt else prompt.rpartition("\n\nUser: ")
        asked = _words(re.split(r"\n\nAnswer", tail)[0])
        context = head.partition("Context:")[2]
        shared = [(len(asked & _words(s)), -i, s.strip()) for i, s in enumerate(re.split(r"[.!?]+\s+", context))]
        best = max(shared, default=(0, 0, ""))
        out.append(best[2] if best[0] else "")
    return out


class _Registered:
    """A loader with a key of its own, so a worker that knows an earlier provider of the same name does not use that."""

    def __init__(self, load: Callable[[], Callable]):
        self.load, self.key = load, uuid.uuid4().hex

    def __call__(self) -> Callable:
        return self.load()


def register(kind: str, name: str, load: Callable[[], Callable]) -> None:
    """kind: embedder, scorer or model. ``load`` runs once per worker and returns the callable."""
    {"embedder": EMBEDDERS, "scorer": SCORERS, "model": MODELS}[kind][name] = _Registered(load)


def loaded(kind: str, name: str, load: Callable[[], Callable]) -> Callable:
    """What ``load`` returns, called once per worker."""
    key = kind, name, getattr(load, "key", "")
    if key not in _loaded:
        for old in [k for k in _loaded if k[:2] == key[:2]]:
            del _loaded[old]  # a worker holds one provider of a name
        _loaded[key] = load()
    return _loaded[key]


def embedder(name: str) -> Callable[[list[str]], np.ndarray]:
    if name not in EMBEDDERS:
        raise KeyError(f"no embedder named {name}; registered: {sorted(EMBEDDERS)}")
    return loaded("embedder", name, EMBEDDERS[name])


def embed(text: Column, name: str = "hash") -> Column:
    load = EMBEDDERS[name]

    @F.pandas_udf("array<double>")
    def run(batches: pd.Series) -> pd.Series:
        model = loaded("embedder", name, load)
        return pd.Series(list(np.asarray(model(batches.fillna("").tolist()), dtype="float64")))

    return run(text)


def pair_cosine(query: Column, text: Column, name: str = "hash") -> Column:
    """The cosine of two texts' vectors."""
    load = EMBEDDERS[name]

    @F.pandas_udf("double")
    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        model = loaded("embedder", name, load)
        asked = queries.fillna("")
        own = {q: i for i, q in enumerate(asked.unique())}
        a, b = np.asarray(model(list(own)), float)[asked.map(own)], np.asarray(model(texts.fillna("").tolist()), float)
        norm = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
        return pd.Series((a * b).sum(1) / np.where(norm == 0, np.inf, norm))

    return run(query, text)


def menu() -> list[tuple[str, str, bool]]:
    """(tier, embedder, whether it is registered) of all in the menu."""
    return [(tier, name, name in EMBEDDERS) for tier, names in MENU.items() for name in names]


def generate(prompt: Column, name: str = "echo") -> Column:
    load = MODELS[name]

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        model = loaded("model", name, load)
        return pd.Series(model(prompts.fillna("").tolist()))

    return run(prompt)


def pair_score(query: Column, text: Column, name: str | None = None) -> Column:
    """A registered pair scorer, or the word overlap that stands in for one offline."""
    from quillon.functions.scores import jaccard

    if name is None:
        return jaccard(query, text)
    load = SCORERS[name]

    @F.pandas_udf("double")
    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        model = loaded("scorer", name, load)
        return pd.Series(model(queries.tolist(), texts.tolist()), dtype="float64")

    return run(query, text)


def reply_score(reply: Column) -> Column:
    """A 1-10 rating in a model's reply as 0.1 to 1: its first number, 5 without one, held within the range."""
    found = F.coalesce(F.try_to_number(F.nullif(F.substring(F.regexp_extract(reply, r"\d+", 0), 1, 9), F.lit("")), F.lit("999999999")).cast("double"), F.lit(5.0))
    return F.least(F.greatest(found, F.lit(1.0)), F.lit(10.0)) / 10
