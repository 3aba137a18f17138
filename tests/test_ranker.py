"""The trained pair scorer: its features, its optimum, and that it learns."""

import random

import numpy as np
from pyspark.sql import functions as F

from quillon.operators import metrics, ranker, reranking
from quillon.plans.config import Config
from quillon.plans.pipeline import Pipeline


def made(spark, queries=30):
    """Long texts that hold the query, and short ones that hold its words in another order."""
    r, rows, relevant = random.Random(6), [], []
    for q in range(queries):
        words = [f"w{r.randrange(40)}" for _ in range(5)]
        for d in range(8):
            other = [f"w{r.randrange(40)}" for _ in range(r.randint(2, 40))]
            if d == q % 8:
                text, other = [*other, *words, *[f"v{r.randrange(99)}" for _ in range(30)]], relevant.append((q, 100 * q + d))
            else:
                text = [*other, *r.sample(words, 4)]
            rows.append((q, 100 * q + d, r.random() * 9, " ".join(words), " ".join(text)))
    return spark.createDataFrame(rows, "query_id long, doc_id long, score double, query string, text string"), spark.createDataFrame(relevant, "query_id long, doc_id long")


def mrr(ranking, relevant, some):
    return metrics.ranking_metrics(ranking.where(some), relevant.where(some)).agg(F.avg("mrr")).first()[0]


def test_it_learns_what_word_overlap_misses(spark):
    candidates, relevant = made(spark)
    weights = ranker.fit(candidates.where("query_id % 2 = 0"), relevant)
    held_out = F.col("query_id") % 2 == 1
    trained, plain = mrr(ranker.rerank(candidates, weights), relevant, held_out), mrr(reranking.jaccard(candidates, 10), relevant, held_out)
    assert trained > 0.9 > plain + 0.2


def test_weights_are_the_optimum(spark):
    candidates, relevant = made(spark, 12)
    weights = np.array(ranker.fit(candidates, relevant))
    good = {(r.query_id, r.doc_id) for r in relevant.collect()}
    rows = {}
    for r in ranker.features(candidates).collect():
        assert all(0 <= r[n] <= 1 for n in ranker.FEATURES)
        rows.setdefault(r.query_id, []).append(((r.query_id, r.doc_id) in good, np.array([r[n] for n in ranker.FEATURES])))

    def loss(w):
        total = [np.mean([np.log1p(np.exp(-(a - b) @ w)) for x, a in own if x for y, b in own if not y]) for own in rows.values()]
        return np.mean(total) + ranker.PENALTY / 2 * w @ w

    best = loss(weights)
    r = np.random.default_rng(1)
    assert all(loss(weights + d) > best for d in r.normal(0, 0.01, (40, len(weights))))


def test_features_of_edges(spark):
    rows = [(1, 1, 2.0, "a b c", "a b c"), (1, 2, None, "a b c", None), (1, 3, -1.0, "a b c", "c b a"), (2, 4, 0.0, None, "a"), (2, 5, 0.0, "", "")]
    frame = spark.createDataFrame(rows, "query_id long, doc_id long, score double, query string, text string")
    got = {r.doc_id: [round(r[n], 4) for n in ranker.FEATURES] for r in ranker.features(frame).collect()}
    assert got[1] == [1.0, 1.0, 1.0, 1.0, 1.0, round(1 / (1 + np.log(4)), 4), 1.0]
    assert got[2] == [0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0] and got[3][:5] == [1.0, 1.0, 0.0, 0.0, 1.0] and got[3][-1] == 0.0
    assert got[4][0] == 0.0 and got[5][:5] == [0.0] * 5
    nothing = spark.createDataFrame([], "query_id long, doc_id long")
    assert ranker.fit(frame, nothing) == (0.0,) * len(ranker.FEATURES) == ranker.fit(frame.limit(0), nothing)
    assert [r.doc_id for r in ranker.rerank(frame.where("query_id = 1"), (0.0,) * 7, 2).orderBy("rank").collect()] == [1, 2]


def test_in_the_pipeline(spark):
    docs = spark.createDataFrame([(0, "the cat sat on the mat and slept all day long."), (1, "mat the on sat cat the.")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "cat sat on the mat")], "query_id long, text string")
    with Pipeline(Config(chunking_strategy="sentence_pack", reranking_method="trained", ranker_weights=(0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0), retrieval_top_k=1), docs) as pipeline:
        assert [r.doc_id for r in pipeline.rank(queries).join(pipeline.chunks.selectExpr("doc_id d", "source_id"), F.col("doc_id") == F.col("d")).select(F.col("source_id").alias("doc_id")).collect()] == [0]
