"""Reranking and fusion of candidate rankings (query_id, doc_id, score, rank)."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon import providers
from quillon.functions import scores as S
from quillon.functions import text as T
from quillon.operators.retrieval import top

RRF_K = 60
#: Candidates per query that the greedy rerankers look at.
CANDIDATES = 100


def score_texts(candidates: DataFrame, score: Column, k: int | None = None) -> DataFrame:
    """Candidates with query and text (query_id, doc_id, query, text), ranked by a score expression."""
    return top(candidates.select("query_id", "doc_id", score.alias("score")), k or CANDIDATES)


def jaccard(candidates: DataFrame, k: int | None = None) -> DataFrame:
    return score_texts(candidates, S.jaccard(F.col("query"), F.col("text")), k)


_SPACED = re.compile(r"[^ \t\n\x0b\f\r]+")
_TOKEN = re.compile(r"\w+")


def _asked(query: str) -> tuple[list[str], list[str]]:
    """A query's keywords, and its two- and three-token phrases."""
    tokens = _TOKEN.findall(query.lower())
    phrases = [" ".join(tokens[i : i + n]) for n in (2, 3) for i in range(len(tokens) - n + 1)]
    return [t for t in tokens if t not in S.KEYWORD_STOP], phrases


def _keyword_density(queries: pd.Series, texts: pd.Series) -> pd.Series:
    known: dict[str, tuple[list[str], list[str]]] = {}
    out = []
    for query, text in zip(queries, texts, strict=True):
        if query is not None and query not in known:
            known[query] = _asked(query)
        if query is None or text is None:
            out.append(0.0 if query is not None and not any(known[query]) else None)
            continue
        low = text.lower()
        found = sum(map(low.count, known[query][0])) + 2 * sum(map(low.count, known[query][1]))
        out.append(10 * found / max(1, len(_SPACED.findall(text))) + (5.0 if query.lower() in low else 0.0))
    return pd.Series(out, dtype="float64")


def keywords(candidates: DataFrame, k: int | None = None) -> DataFrame:
    """By ``scores.keyword_density``, counted in Arrow batches: a text is searched for each of a query's hundred
    keywords and phrases, which as column expressions would copy the text each time."""
    return score_texts(candidates, F.pandas_udf(_keyword_density, "double")("query", "text"), k)


def cross_encoder(candidates: DataFrame, name: str | None = None, k: int | None = None) -> DataFrame:
    """A registered pair scorer; offline the word overlap."""
    return score_texts(candidates, providers.pair_score(F.col("query"), F.col("text"), name), k)


def model_rating(candidates: DataFrame, model: str = "echo", k: int | None = None) -> DataFrame:
    """A language model's rating from 1 to 10, as .1 to 1."""
    prompt = F.concat(F.lit("Rate from 1 to 10 how relevant the document is.\nQuery: "), F.col("query"), F.lit("\nDocument: "), F.col("text"))
    return score_texts(candidates, providers.reply_score(providers.generate(prompt, model)), k)


def contextual_query(history: DataFrame, last: int = 3) -> DataFrame:
    """(conv_id, turn, query): each user turn with the user turns before it, up to ``last``."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-last, -1)
    users = history.where("role = 'user'")
    return users.select("conv_id", "turn", F.concat_ws(" ", F.collect_list("text").over(before), "text").alias("query"))


def rrf(rankings: DataFrame, k: int = 10, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of the union of rankings."""
    return top(rankings.groupBy("query_id", "doc_id").agg(F.sum(1 / (F.lit(float(constant)) + F.col("rank"))).alias("score")), k)


def fuse(rankings: list[DataFrame], k: int = 10) -> DataFrame:
    """``rrf`` of several rankings."""
    return rrf(reduce(DataFrame.unionByName, [r.select("query_id", "doc_id", "rank") for r in rankings]), k)


def _greedy(relevance: np.ndarray, similarity: np.ndarray, ids: np.ndarray, weight: float, k: int, least: float) -> list[int]:
    """Maximal marginal relevance. Ties go to the smaller id."""
    left, chosen = list(np.argsort(ids, kind="stable")), []
    nearest = np.zeros(len(ids))
    while left and len(chosen) < k:
        value = np.round(weight * relevance[left] - (1 - weight) * nearest[left], 6)
        best = int(np.argmax(value))
        if value[best] <= least:
            break
        pick = left.pop(best)
        nearest = similarity[pick].copy() if not chosen else np.maximum(nearest, similarity[pick])
        chosen.append(pick)
    return chosen


def _mmr(rows: DataFrame, similarity, weight: float, k: int, least: float = -np.inf) -> DataFrame:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        order = _greedy(group["score"].to_numpy(float), similarity(group), group["doc_id"].to_numpy(), weight, k, least)
        out = group.iloc[order][["query_id", "doc_id", "score"]].copy()
        out["place"] = np.arange(1, len(order) + 1)
        return out

    return rows.groupBy("query_id").applyInPandas(run, "query_id long, doc_id long, score double, place long")


def mmr_vectors(ranking: DataFrame, vectors: DataFrame, weight: float = 0.5, k: int = 10, fetch: int | None = None, scale: bool = False) -> DataFrame:
    """Greedy MMR by cosine over each query's best ``fetch`` candidates; vectors: (doc_id, embedding).

    ``scale`` divides scores by the query's largest first.
    """
    fetch = max(fetch or max(20, 2 * k), k)
    rows = ranking.where(F.col("rank") <= fetch).join(vectors.select("doc_id", "embedding"), "doc_id")
    if scale:
        most = F.max("score").over(Window.partitionBy("query_id"))
        rows = rows.withColumn("score", F.when(most > 0, F.col("score") / most).otherwise(F.col("score")))

    def similarity(group: pd.DataFrame) -> np.ndarray:
        m = np.stack(group["embedding"].to_numpy()).astype(float)
        n = np.linalg.norm(m, axis=1)
        return np.round((m @ m.T) / np.outer(np.where(n == 0, np.inf, n), np.where(n == 0, np.inf, n)), 6)

    return _mmr(rows.select("query_id", "doc_id", F.col("score").cast("double").alias("score"), "embedding"), similarity, weight, k)


def mmr_words(candidates: DataFrame, weight: float = 0.5, k: int = CANDIDATES) -> DataFrame:
    """Greedy MMR by word sets: candidates (query_id, doc_id, query, text); stops where no candidate scores above -1."""
    rows = candidates.select("query_id", "doc_id", F.round(S.jaccard(F.col("query"), F.col("text")), 6).alias("score"), T.word_set(F.col("text")).alias("words"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("n") <= CANDIDATES)

    def similarity(group: pd.DataFrame) -> np.ndarray:
        sets = [set(w) for w in group["words"]]
        out = np.zeros((len(sets), len(sets)))
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                out[i, j] = out[j, i] = len(a & b) / len(a | b) if a and b else 0.0
        return np.round(out, 6)

    return _mmr(rows.select("query_id", "doc_id", "score", "words"), similarity, weight, k, least=-1.0)


def semantic(candidates: DataFrame, model: str = "hash", k: int | None = None) -> DataFrame:
    """The cosine of query and text, of exactly the given pairs."""
    return score_texts(candidates, providers.pair_cosine(F.col("query"), F.col("text"), model), k)


def diversify(ranking: DataFrame, texts: DataFrame, weight: float = 0.7, model: str = "hash") -> DataFrame:
    """A ranking in the order of greedy MMR: scores over the query's largest, cosines of the texts' vectors."""
    vectors = texts.select("doc_id", "text").dropDuplicates(["doc_id"]).select("doc_id", providers.embed(F.col("text"), model).alias("embedding"))
    out = mmr_vectors(ranking, vectors, weight, CANDIDATES, CANDIDATES, scale=True)
    return out.select("query_id", "doc_id", F.col("place").alias("rank")).join(ranking.select("query_id", "doc_id", "score"), ["query_id", "doc_id"]).select("query_id", "doc_id", "score", "rank")


def multi_stage(candidates: DataFrame, vector: DataFrame | None = None, stages: tuple[str, ...] = ("semantic", "keyword", "cross_encoder"), k: int = 10, mode: str = "fused", keep: Callable[[DataFrame], DataFrame] = lambda rows: rows.persist(StorageLevel.MEMORY_AND_DISK)) -> DataFrame:
    """Several scorers over the best candidates: fused by reciprocal ranks, or one after the other.

    In a sequence each stage sorts what the one before passed on: equal scores stay in the order that they came in, at
    first the candidates', and none is dropped before the cut to k.
    vector: scores of a vector search (query_id, doc_id, score) for the stage "semantic", which computes them if left out.
    A stage "diversity" reorders all that was fused, or in a sequence what it is passed. The candidates with their
    texts are kept on the executors while the stages use them, or as ``keep`` says.
    """
    diverse, scored = "diversity" in stages, tuple(s for s in stages if s != "diversity")
    first = Window.partitionBy("query_id").orderBy("rank", "doc_id")
    capped = candidates.withColumn("n", F.row_number().over(first)).where(F.col("n") <= CANDIDATES).drop("n").transform(keep)
    cut = lambda ranking: (diversify(ranking, capped) if diverse else ranking).where(F.col("rank") <= k)
    known = lambda c: top(vector.select("query_id", "doc_id", "score").join(c.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi"), CANDIDATES)
    scorers = {"keyword": keywords, "cross_encoder": cross_encoder, "semantic": semantic if vector is None else known}
    if mode == "sequential":
        out = capped.select("query_id", "doc_id", "score", "rank")
        for stage in stages:
            if stage == "diversity":
                out = diversify(out, capped)
                continue
            here = scorers[stage](capped).drop("rank").join(out.select("query_id", "doc_id", F.col("rank").alias("before")), ["query_id", "doc_id"])
            order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "before", "doc_id")
            out = here.select("query_id", "doc_id", "score", F.row_number().over(order).cast("long").alias("rank"))
        return out.where(F.col("rank") <= k)
    parts = [scorers[s](capped).select("query_id", "doc_id", "score", "rank") for s in scored]
    return cut(parts[0] if len(parts) == 1 else fuse(parts, CANDIDATES))
