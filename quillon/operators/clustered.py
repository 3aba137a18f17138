"""A stored vector index of lists around centroids, and exact cosine search that skips lists by the triangle inequality.

Vectors are taken at length one, where the nearest by distance is the nearest by angle. Centroids are fitted on a
bounded sample; every vector goes to the list of its nearest centroid, and its distance from there is stored. A list
lies between its least and its largest such distance, so the distance of a query from the centroid bounds that from any
member. Each query's nearest lists give a k-th score; only lists whose bound reaches it are read, and in these only
members whose own stored distance allows it are multiplied. The answer is the same as that of a full scan.

Tables below the path: ``vectors`` (list, doc_id, embedding, away) by list, and ``lists`` (list, centroid, n, least, most).
Zero vectors lie in list -1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import retrieval
from quillon.operators.retrieval import _RANKED, _Best, _matrix, _stack, _unit, top

#: Vectors of the sample that centroids are fitted on, rounds of fitting, and lists at most.
SAMPLE, ROUNDS, LISTS = 20_000, 8, 1024
#: Lists of a query that are read first. Rounded scores and distances differ from exact ones by less than the slack.
FIRST, SLACK = 2, 2e-6

_VECTORS = "list int, doc_id long, embedding array<double>, away double"


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    square = np.maximum((x * x).sum(1)[:, None] + (centroids * centroids).sum(1)[None] - 2 * x @ centroids.T, 0)
    at = square.argmin(1)
    return at, np.linalg.norm(x - centroids[at], axis=1)


def _fit(sample: np.ndarray, n: int) -> np.ndarray:
    """Centroids by farthest-first seeds and a few rounds of means."""
    seeds, gap = [0], np.full(len(sample), np.inf)
    for _ in range(min(n, len(sample)) - 1):
        gap = np.minimum(gap, ((sample - sample[seeds[-1]]) ** 2).sum(1))
        if gap.max() <= 0:
            break
        seeds.append(int(gap.argmax()))
    centroids = sample[seeds].copy()
    for _ in range(ROUNDS):
        at, _ = _nearest(sample, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, sample)
        count = np.bincount(at, minlength=len(centroids))
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
    return centroids


def build(vectors: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE) -> ClusteredIndex:
    """Writes the index of (doc_id, embedding) below a shared path. Every vector that is not null is in one list."""
    spark = vectors.sparkSession
    rows = vectors.selectExpr("cast(doc_id as long) doc_id", "embedding").where("embedding is not null")
    n = rows.count()
    # The sample: ids that come first by their hash, about as many as the bound.
    bound = F.lit(2.0**64 * min(1.0, sample / max(1, n)) - 2.0**63)
    some = rows.where(F.xxhash64("doc_id") <= bound).limit(2 * sample).toPandas().sort_values("doc_id")
    units = _unit(_stack(some["embedding"])) if len(some) else np.zeros((0, 1))
    units = units[~np.isnan(units).any(1)]
    wanted = lists or max(1, min(LISTS, int(np.sqrt(n))))
    centroids = _fit(units, wanted) if len(units) else np.zeros((1, len(some["embedding"].iloc[0]) if len(some) else 1))
    given = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                unit = _unit(x)
                zero = np.isnan(unit).any(1)
                at, away = _nearest(np.where(zero[:, None], 0, unit), given.value)
                at[zero], away[zero] = -1, 0
                ends = pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(0), pa.ListArray.from_arrays(ends, pa.array(x.ravel())), pa.array(away)], ["list", "doc_id", "embedding", "away"])

    # Ranges of list and id: a list of very many equal vectors is split over tasks.
    rows.mapInArrow(run, _VECTORS).repartitionByRange("list", "doc_id").sortWithinPartitions("list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")
    sizes = spark.read.schema(_VECTORS).parquet(f"{path}/vectors").groupBy("list").agg(F.count("*").alias("n"), F.min("away").alias("least"), F.max("away").alias("most"))
    middle = spark.createDataFrame(list(enumerate([[0.0] * centroids.shape[1], *centroids.tolist()], -1)), "list int, centroid array<double>")
    sizes.join(F.broadcast(middle), "list").write.mode("overwrite").parquet(f"{path}/lists")
    return ClusteredIndex(spark, path)


class ClusteredIndex:
    """An index that ``build`` stored, opened by its path."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.vectors = path, spark.read.schema(_VECTORS).parquet(f"{path}/vectors")
        self.lists = spark.read.parquet(f"{path}/lists").orderBy("list").toPandas()  # one row per list, of a bounded number

    def _reach(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and list the distance to the centroid, and the highest score that a member can have."""
        centre = _stack(self.lists["centroid"])
        if not len(centre) or not len(units):
            return np.zeros((len(units), len(centre))), np.zeros((len(units), len(centre)))
        far = np.sqrt(np.maximum((units * units).sum(1)[:, None] + (centre * centre).sum(1)[None] - 2 * units @ centre.T, 0))
        gap = np.maximum(np.maximum(far - self.lists["most"].to_numpy()[None], self.lists["least"].to_numpy()[None] - far), 0)
        reach = 1 - gap * gap / 2 + SLACK
        reach[:, self.lists["list"].to_numpy() < 0] = -2.0  # zero vectors come after all others
        return far, np.where(np.isnan(reach), np.inf, reach)  # a zero query has no score: it has to look everywhere

    def _scan(self, ids: np.ndarray, units: np.ndarray, far: np.ndarray, wanted: np.ndarray, bar: np.ndarray, k: int) -> DataFrame:
        """Each task's best of the wanted (query, list) pairs."""
        numbers = self.lists["list"].to_numpy()
        read = numbers[wanted.any(0)].tolist()
        place = {int(n): i for i, n in enumerate(numbers)}
        given = self.vectors.sparkSession.sparkContext.broadcast((ids, units, far, wanted, bar))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, units, far, wanted, bar = given.value
            best: dict[bytes, tuple[np.ndarray, _Best]] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                own, docs, away, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_numpy(), _matrix(batch.column(2))
                for number in np.unique(own):
                    at = place[int(number)]
                    asked = np.flatnonzero(wanted[:, at])
                    rows = np.flatnonzero(own == number)
                    # By its stored distance alone a member's score is bounded as its list's is.
                    gap = np.abs(far[asked, at][:, None] - away[rows][None])
                    near = (~(1 - gap * gap / 2 + SLACK < bar[asked][:, None])).any(0)
                    rows = rows[near] if number >= 0 else rows
                    key = asked.tobytes()
                    if key not in best:
                        best[key] = asked, _Best(ids[asked], units[asked], k)
                    best[key][1].add(docs[rows], x[rows])
            for _, found in best.values():
                yield found.batch()

        return self.vectors.where(F.col("list").isin(read)).select("list", "doc_id", "embedding", "away").mapInArrow(run, _RANKED)

    def _plan(self, few: pd.DataFrame, k: int) -> tuple[np.ndarray, ...]:
        """Queries, and the lists that each has to read."""
        ids, units = few["query_id"].to_numpy(np.int64), _unit(_stack(few["embedding"]))
        far, reach = self._reach(units)
        n_lists = reach.shape[1]
        bar = np.full(len(ids), -np.inf)
        if n_lists and len(ids):
            first = np.zeros_like(reach, bool)
            near = np.argsort(-reach + far * 1e-9, axis=1, kind="stable")[:, :FIRST]
            first[np.arange(len(ids))[:, None], near] = True
            found = top(self._scan(ids, units, far, first, bar, k), k).groupBy("query_id").agg(F.count("score").alias("n"), F.min("score").alias("bar")).toPandas()  # a row per query
            whole = found[found["n"] >= k].set_index("query_id")["bar"]
            bar = pd.Series(ids).map(whole).fillna(-np.inf).to_numpy()
        return ids, units, far, ~(reach < bar[:, None]), bar

    def _few(self, queries: DataFrame) -> pd.DataFrame | None:
        queries = queries.selectExpr("cast(query_id as long) query_id", "embedding").where("embedding is not null")
        first = queries.selectExpr("size(embedding) n").first()
        most = max(1, retrieval.BROADCAST_BYTES // (8 * max(1, first.n + len(self.lists)))) if first else 1
        few = queries.limit(most + 1).toPandas()
        return few if len(few) <= most else None

    def topk(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """``retrieval.vector_topk`` of the indexed vectors, exactly. queries: (query_id, embedding).

        Queries too many to be broadcast meet the stored vectors in blocks, without skipping."""
        few = self._few(queries)
        if few is None:
            return retrieval.vector_topk(self.vectors, queries, k)
        ids, units, far, wanted, bar = self._plan(few, k)
        return top(self._scan(ids, units, far, wanted, bar, k), k)

    def pruning(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """Per query: lists, and those of them that are read."""
        few = self._few(queries)
        if few is None:
            return queries.select("query_id", F.lit(len(self.lists)).cast("long").alias("lists"), F.lit(len(self.lists)).cast("long").alias("lists_read"))
        ids, _, _, wanted, _ = self._plan(few, k)
        out = pd.DataFrame({"query_id": ids, "lists": wanted.shape[1], "lists_read": wanted.sum(1)})
        return self.vectors.sparkSession.createDataFrame(out, "query_id long, lists long, lists_read long")
