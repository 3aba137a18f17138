"""A trained pair scorer: features of a query and a text as column expressions, weighted as pairs of texts have taught.

Fitting takes candidates with a relevance mark. Within a query each relevant text is paired with each other one, and
the weights are those under which the difference of their features best tells the two apart (a logistic model, each
query counting once, with a small penalty). Every Newton step is one pass in which tasks add up gradients and
curvatures of their queries; the driver sees one row of numbers per step.

Queries without both kinds of candidates teach nothing; without any pair all weights are zero and ties go to the
smaller id. A null text or query has no words. Features lie between 0 and 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import scores as S
from quillon.functions import text as T
from quillon.operators.retrieval import top

FEATURES = ("coverage", "jaccard", "phrases", "in_order", "early", "brief", "retrieved")
#: Newton steps, the penalty on squared weights, and candidates of a query that are learned from.
STEPS, PENALTY, CANDIDATES = 12, 0.01, 100


def features(candidates: DataFrame) -> DataFrame:
    """Candidates (query_id, doc_id, score, query, text) with their features as columns."""
    tokens = lambda c: F.coalesce(T.tokens(F.col(c)), F.array().cast("array<string>"))
    rows = candidates.withColumn("_q", tokens("query")).withColumn("_t", tokens("text"))
    rows = rows.withColumn("_set", F.array_distinct("_q")).withColumn("_two", F.array_distinct(T.ngrams(F.col("_q"), 2))).withColumn("_three", F.array_distinct(T.ngrams(F.col("_q"), 3)))
    share = lambda part, whole: F.coalesce(F.size(F.array_intersect(part, whole)) / F.nullif(F.size(part), F.lit(0)), F.lit(0.0))
    first = F.array_min(F.filter(F.transform("_set", lambda w: F.array_position("_t", w)), lambda i: i > 0))
    most = F.max(F.greatest(F.col("score"), F.lit(0.0))).over(Window.partitionBy("query_id"))
    made = {
        "coverage": share(F.col("_set"), F.col("_t")),
        "jaccard": F.coalesce(S.jaccard(F.col("query"), F.col("text")), F.lit(0.0)),
        "phrases": share(F.col("_two"), T.ngrams(F.col("_t"), 2)),
        "in_order": share(F.col("_three"), T.ngrams(F.col("_t"), 3)),
        "early": F.coalesce(10.0 / (9.0 + first), F.lit(0.0)),
        "brief": 1 / (1 + F.log(1.0 + F.size("_t"))),
        "retrieved": F.coalesce(F.greatest(F.col("score"), F.lit(0.0)) / F.nullif(most, F.lit(0.0)), F.lit(0.0)),
    }
    return rows.select(*candidates.columns, *[made[n].cast("double").alias(n) for n in FEATURES])


def _steps(groups: DataFrame, weights: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """How many queries teach, and the sums of their gradients and curvatures at the weights."""
    n = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + n + n * n)
        for batch in batches:
            for rows in batch.column(0).to_pylist():
                x = np.array([r["f"] for r in rows])
                good = np.array([r["relevant"] for r in rows], bool)
                apart = (x[good][:, None, :] - x[~good][None, :, :]).reshape(-1, n)
                if not len(apart):
                    continue
                p = 1 / (1 + np.exp(np.clip(apart @ weights, -500, 500)))  # how likely the pair is still told wrong
                total[0] += 1
                total[1 : n + 1] += apart.T @ p / len(apart)
                total[n + 1 :] += ((apart * (p * (1 - p))[:, None]).T @ apart / len(apart)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), pa.array(total)], ["at", "x"])

    got = groups.mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas().sort_values("at")["x"].to_numpy()
    got = got if len(got) else np.zeros(1 + n + n * n)
    return int(round(got[0])), got[1 : n + 1], got[n + 1 :].reshape(n, n)


def fit(candidates: DataFrame, relevant: DataFrame, penalty: float = PENALTY) -> tuple[float, ...]:
    """Weights of ``FEATURES`` from candidates and the pairs (query_id, doc_id) that are relevant."""
    marks = relevant.select("query_id", "doc_id").distinct().withColumn("relevant", F.lit(True))
    best = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "doc_id")
    rows = features(candidates).withColumn("n", F.row_number().over(best)).where(F.col("n") <= CANDIDATES).join(marks, ["query_id", "doc_id"], "left")
    one = F.struct(F.coalesce("relevant", F.lit(False)).alias("relevant"), F.array(*FEATURES).alias("f"))
    groups = rows.groupBy("query_id").agg(F.collect_list(one).alias("rows")).select("rows").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        weights = np.zeros(len(FEATURES))
        for _ in range(STEPS):
            queries, up, curved = _steps(groups, weights)
            if not queries:
                break
            step = np.linalg.solve(curved / queries + penalty * np.eye(len(weights)), up / queries - penalty * weights)
            weights = weights + step
            if np.abs(step).max() < 1e-9:
                break
        return tuple(float(w) for w in weights)
    finally:
        groups.unpersist()


def score(weights: tuple[float, ...]) -> Column:
    """The weighted sum of feature columns."""
    out = F.lit(0.0)
    for name, weight in zip(FEATURES, weights, strict=True):
        out = out + F.col(name) * F.lit(float(weight))
    return out


def rerank(candidates: DataFrame, weights: tuple[float, ...], k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank) by the trained scorer."""
    return top(features(candidates).select("query_id", "doc_id", score(weights).alias("score")), k)
