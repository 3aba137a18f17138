"""Counterfactual-regularised toxicity classifier.

A logistic model over the presence of words and of character n-grams inside words (so inflected forms of a
word share features). Each labelled text gives a pair of counterfactuals: a text that names a group and a copy in
which the group terms are swapped for others of the same kind or, where it names none, two copies into which two
terms of one kind are put. Fitting penalises the squared change of the score within the pairs, so a neutral mention
of a group does not move it.

Fitting takes at most ``train`` labelled texts of each class, in the order of a hash of their ids (a
parameter); weights bring the classes back to their share among all labelled rows. The model has ``FEATURES``
weights, for the features most strongly linked to the label. Scoring reads every text whole.

Defined results: null and empty texts get the score of a text without known features; texts of any length are scored
whole; repeated rows get equal scores and are learned from once, of texts under one id one; an id with both labels
counts for both; of equally strong features the smaller hashes are kept; without labelled rows of both classes every
score is the share of toxic labels (0 if none); an empty table gives no rows; further columns, of whatever names, are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import crc_mod, least_hashed, small_batches

TRAIN = 3000
#: Features kept, by the strength of their link with the label, those that so few texts hold last.
FEATURES, LEAST = 1000, 6
GRAMS = (4, 5)
RIDGE, FAIRNESS = 2e-4, 1.0
#: Terms that name groups of people; terms of one line are swapped for each other.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "foreigners", "refugees", "natives"),
    ("elderly", "young", "disabled", "deaf", "blind"),
)
_SWAP = {term: (group, i) for group in IDENTITY for i, term in enumerate(group)}
_WORD = re.compile(r"\w+")
_CACHE = 300_000
#: Places of features, as a power of two.
PLACES = 20
#: Steps of the fit.
STEPS = 400


def features(word: str) -> set[int]:
    """Places of the word and of its n-grams, its start marked."""
    marked = "^" + word
    parts = {"=" + word, *(marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1))}
    return {xxhash.xxh32_intdigest(p.encode("utf-8", "surrogatepass"), 7) >> (32 - PLACES) for p in parts}


def counterfactuals(words: set[str]) -> tuple[set[str], set[str]]:
    """Two word sets that differ in group terms only: the text's own ones and the next of each kind, else two put in."""
    named = words & _SWAP.keys()
    if not named:
        every = sorted(_SWAP)
        named = {every[xxhash.xxh32_intdigest(" ".join(sorted(words)).encode("utf-8", "surrogatepass")) % len(every)]}
    return words | named, (words - named) | {_SWAP[w][0][(_SWAP[w][1] + 1) % len(_SWAP[w][0])] for w in named}


def held(words: set[str]) -> np.ndarray:
    return np.array(sorted(set().union(*map(features, words))), np.uint32)


def changes(words: set[str]) -> np.ndarray:
    """The places that only one of the two counterfactuals has: those of the first, then those of the second negated."""
    a, b = map(held, counterfactuals(words))
    return np.concatenate([np.setdiff1d(a, b).astype(np.int64), ~np.setdiff1d(b, a).astype(np.int64)]).astype(np.int32)


class Model:
    """Weights by place, and the score without any."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def __getstate__(self):
        return self.weights, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def score(self, text: str | None) -> float:
        if len(self.known) > _CACHE:
            self.known.clear()
        known, weights, held = self.known, self.weights, set()
        for word in set(_WORD.findall((text or "").lower())):
            got = known.get(word)
            if got is None:
                got = known[word] = tuple(f for f in features(word) if f in weights)
            if got:
                held.update(got)
        z = self.bias + sum(weights[f] for f in sorted(held))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def objective(theta: np.ndarray, bias: float, x: np.ndarray, label: np.ndarray, weigh: np.ndarray, change: np.ndarray, often: np.ndarray, fairness: float) -> tuple[float, np.ndarray]:
    """Weighted logistic loss, ridge and mean squared change of the counterfactual pairs, with the gradient (bias last).

    change: a row per distinct difference of a pair, often: its share of all pairs.
    """
    z = np.clip(x @ theta.astype(x.dtype) + bias, -40, 40).astype(np.float64)
    p = 1 / (1 + np.exp(-z))
    moved = change @ theta.astype(x.dtype)
    loss = weigh @ (np.logaddexp(0, z) - label * z) + RIDGE / 2 * theta @ theta + fairness / 2 * often @ moved.astype(np.float64) ** 2
    error = weigh * (p - label)
    grad = x.T @ error.astype(x.dtype) + RIDGE * theta + fairness * (change.T @ (often * moved).astype(x.dtype))
    return float(loss), np.append(grad, error.sum())


def solve(rows: list[tuple[np.ndarray, np.ndarray, int]], share: float, fairness: float = FAIRNESS) -> Model:
    """rows: places of the features, places that differ between the counterfactuals, label. share: of toxic labels among all."""
    label = np.array([r[2] for r in rows], np.float64)
    toxic, clean = label.sum(), len(label) - label.sum()
    if not toxic or not clean:
        return Model({}, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    count, hit = np.zeros(1 << PLACES), np.zeros(1 << PLACES)
    for places, _, y in rows:
        count[places] += 1
        hit[places] += y
    z = np.log((hit + 0.5) / (toxic + 1)) - np.log((count - hit + 0.5) / (clean + 1))
    z = np.abs(z / np.sqrt(1 / (hit + 0.5) + 1 / (count - hit + 0.5)))
    z[count < LEAST] *= 1e-6  # rare features come last
    z[count == 0] = 0
    pairs = Counter(r[1].tobytes() for r in rows)
    patterns = [np.frombuffer(p, np.int32) for p in pairs]
    at = np.concatenate(patterns)
    z[np.where(at < 0, ~at, at)] = np.inf  # the features that a swap changes always stay, so the penalty can hold them down
    kept = np.sort(np.argsort(-z, kind="stable")[: min(max(FEATURES, int(np.isinf(z).sum())), int((z > 0).sum()))])
    column = np.full(1 << PLACES, -1, np.int32)
    column[kept] = np.arange(len(kept))
    x = np.zeros((len(rows), len(kept)), np.float32)
    for row, (places, _, _) in zip(x, rows, strict=True):
        own = column[places]
        row[own[own >= 0]] = 1
    change = np.zeros((len(patterns), len(kept)), np.float32)
    for row, own in zip(change, patterns, strict=True):
        row[column[own[own >= 0]]] = 1
        row[column[~own[own < 0]]] = -1
    often = np.array(list(pairs.values()), np.float64) / len(rows)
    weigh = np.where(label == 1, share / toxic, (1 - share) / clean)
    theta, bias = np.zeros(len(kept)), float(np.log(share / (1 - share)))
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for step in range(1, STEPS + 1):
        _, grad = objective(theta, bias, x, label, weigh, change, often, fairness)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta, bias = theta - move[:-1], bias - float(move[-1])
    return Model({int(n): float(t) for n, t in zip(kept, theta, strict=True) if abs(t) > 1e-6}, bias)


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, train: int = TRAIN, fairness: float = FAIRNESS) -> Model:
    """Learns from labelled rows that are not held out. Rows with a null id or label are left out."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(~held_out).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).distinct()
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = least_hashed(known, "toxic", "doc_id", train).select("doc_id", "toxic").collect()
    chosen = spark.createDataFrame([(r.doc_id, r.toxic) for r in chosen], "doc_id long, toxic int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [set(_WORD.findall((text or "").lower())) for text in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), *(pa.array([f(w).tobytes() for w in words], pa.binary()) for f in (held, changes))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "toxic", "held", "changes"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    picked = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    one = picked.mapInArrow(run, "doc_id long, toxic int, held binary, changes binary").groupBy("doc_id", "toxic").agg(F.min(F.struct("held", "changes")).alias("f"))
    got = sorted(one.select("doc_id", "toxic", "f.*").collect(), key=lambda r: (r.doc_id, r.toxic))
    rows = [(np.frombuffer(r.held, np.uint32), np.frombuffer(r.changes, np.int32), r.toxic) for r in got]
    return solve(rows, counts.get(1, 0) / max(1, sum(counts.values())), fairness)


def swap_gap(model: Model, texts: list[str | None]) -> float:
    """The mean change of the score when group terms are swapped."""
    gaps = []
    for text in texts:
        a, b = counterfactuals(set(_WORD.findall((text or "").lower())))
        gaps.append(abs(model.score(" ".join(a)) - model.score(" ".join(b))))
    return float(np.mean(gaps)) if gaps else 0.0


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score per row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """Fits on the labels of all but one fold of the ids and scores every row."""
    held_out = crc_mod("doc_id", folds) == fold
    out = score(docs, fit(docs, labels, held_out))
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
