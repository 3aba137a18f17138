"""A stored lexical index in blocks, and exact BM25 from it that skips blocks which cannot reach the k-th score.

Texts whose most frequent words agree lie in the same block of documents. A posting row holds one term in one block:
ids, counts and lengths. What a term can add to a score in a block at most is its head. The index is four Parquet
tables below one path:

- ``postings`` (shard, block, term, ids, tfs, dls), by shard and sorted by term; the row without a term lists a block's documents,
- ``heads`` (bucket, term, shard, block, top) and ``terms`` (bucket, term, df), by bucket of the term's hash and sorted by term,
- ``stats``, one row with the corpus' sizes and the parameters.

A search joins the queries' terms to the heads. Their sum bounds the score of any document of a block. The blocks with
the highest bounds are scored first; their k-th score is a bar, and only blocks whose bound reaches it are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import text as T
from quillon.operators import index
from quillon.operators.retrieval import small, top

#: Documents of a block; documents, and words of them, that are ordered together; folders of postings and of terms.
BLOCK, BUFFER, BUFFER_WORDS, SHARDS, BUCKETS = 32, 8192, 4_000_000, 256, 64
#: Blocks of a query that are scored first. Rounded scores differ from their bounds by less than the slack.
FIRST, SLACK = 4, 2e-6

_POSTINGS = "shard int, block long, term string, ids array<long>, tfs array<int>, dls array<int>"


def _groups(starts: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.append(starts, n), pa.int32())


def _posting_rows(ids: np.ndarray, tokens: list[pa.Array], shard: int, first: int, size: int) -> tuple[pa.RecordBatch, int]:
    """Documents ordered by their most frequent words, cut into blocks numbered from ``first``; how many blocks."""
    lengths = np.array([len(t) for t in tokens], np.int64)
    coded = pa.concat_arrays(tokens).dictionary_encode() if len(tokens) else None
    codes, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    key, tf = np.unique(np.repeat(np.arange(len(ids)), lengths) * max(1, len(names)) + codes, return_counts=True)
    doc, code = key // max(1, len(names)), key % max(1, len(names))
    overall = np.bincount(codes, minlength=len(names))
    by = np.lexsort((code, -overall[code], -tf, doc))
    place = np.arange(len(by)) - np.searchsorted(doc[by], doc[by])
    leading = np.full((3, len(ids)), -1)
    for i in range(3):
        own = by[place == i]
        leading[i, doc[own]] = code[own]
    order = np.lexsort((ids, leading[2], leading[1], leading[0]))
    block = np.empty(len(ids), np.int64)
    block[order] = np.arange(len(ids)) // size
    n_blocks = -(-len(ids) // size)
    by = np.lexsort((ids[doc], code, block[doc]))
    doc, code, tf = doc[by], code[by], tf[by]
    new = np.flatnonzero(np.diff(block[doc] * max(1, len(names)) + code, prepend=-1))
    starts = np.arange(0, len(ids), size)
    held = np.concatenate([doc, order])
    columns = [
        np.full(len(new) + n_blocks, shard),
        first + np.concatenate([block[doc[new]], np.arange(n_blocks)]),
        pa.concat_arrays([names.take(pa.array(code[new])).cast(pa.string()), pa.nulls(n_blocks, pa.string())]),
    ]
    offsets = _groups(np.concatenate([new, len(doc) + starts]), len(held))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((ids[held], pa.int64()), (np.concatenate([tf, np.zeros(len(order), np.int64)]), pa.int32()), (lengths[held], pa.int32()))]
    arrays = [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), columns[2], *lists]
    return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in _POSTINGS.split(", ")]), n_blocks


def _postings(docs: DataFrame, size: int) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(T.tokens(F.col("text")), F.array().cast("array<string>")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        number, ids, tokens, held = part << 32, [], [], 0
        for batch in batches:
            ids += batch.column(0).to_pylist()
            for row in batch.column(1):
                tokens.append(row.values)
                held += len(row.values)
                if len(tokens) >= BUFFER or held >= BUFFER_WORDS:
                    rows, n = _posting_rows(np.array(ids[: len(tokens)], np.int64), tokens, part % SHARDS, number, size)
                    yield rows
                    del ids[: len(tokens)]
                    number, tokens, held = number + n, [], 0
        if tokens:
            yield _posting_rows(np.array(ids, np.int64), tokens, part % SHARDS, number, size)[0]

    return own.mapInArrow(run, _POSTINGS)


def build(docs: DataFrame, path: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, block: int = BLOCK) -> LexicalIndex:
    """Writes the index of (doc_id, text), ids without repeats, below a shared path. The texts are read once."""
    spark = docs.sparkSession
    _postings(docs, block).sortWithinPartitions("shard", "term", "block").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/postings")
    stored = spark.read.schema(_POSTINGS).parquet(f"{path}/postings")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + x)
    size = stored.where("term is null").agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n_docs"), F.coalesce(F.sum(total("dls")) / F.nullif(F.sum(F.size("ids")), F.lit(0)), F.lit(0.0)).alias("avgdl"), F.count("*").alias("n_blocks")).first()
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket")
    named = stored.where("term is not null")

    def save(rows: DataFrame, name: str, *keys: str) -> None:
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")

    save(named.groupBy("term").agg(F.sum(F.size("ids")).alias("df")).select(bucket, "term", "df"), "terms", "bucket", "term")
    share = F.zip_with("tfs", "dls", lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(size.avgdl or 1.0))))
    save(named.select(bucket, "term", "shard", "block", F.array_max(share).alias("top")), "heads", "bucket", "term", "block")
    terms = spark.read.schema("bucket int, term string, df long").parquet(f"{path}/terms")
    mean = terms.agg(F.avg(F.log(size.n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("mean_idf"))
    own = {"n_docs": size.n_docs, "avgdl": float(size.avgdl), "n_blocks": size.n_blocks, "k1": k1, "b": b, "epsilon": epsilon}
    mean.select("mean_idf", *[F.lit(v).alias(k) for k, v in own.items()]).write.mode("overwrite").parquet(f"{path}/stats")
    return LexicalIndex(spark, path)


class LexicalIndex:
    """An index that ``build`` stored, opened by its path."""

    def __init__(self, spark: SparkSession, path: str):
        read = lambda schema, name: spark.read.schema(schema).parquet(f"{path}/{name}")
        self.path, self.stats = path, spark.read.parquet(f"{path}/stats").first()
        self.postings = read(_POSTINGS, "postings").where("term is not null")
        self.heads = read("bucket int, term string, shard int, block long, top double", "heads")
        self.terms = read("bucket int, term string, df long", "terms")

    def _weights(self, queries: DataFrame) -> DataFrame:
        """(query_id, bucket, term, w) of the queries' terms that the corpus has: their count there times their idf."""
        s = self.stats
        asked = index.postings(queries, "query_id").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        raw = F.log(s.n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        idf = F.when(raw < 0, s.epsilon * F.lit(s.mean_idf)).otherwise(raw)
        return small(self.terms.join(small(asked), ["bucket", "term"]).select("query_id", "bucket", "term", (F.col("tf") * idf).alias("w")))

    def _bounds(self, weights: DataFrame) -> DataFrame:
        """(query_id, shard, block, bound): no document of the block scores more."""
        reach = F.sum(F.greatest(F.col("w") * F.col("top"), F.lit(0.0))).alias("bound")
        return self.heads.join(weights, ["bucket", "term"]).groupBy("query_id", "shard", "block").agg(reach)

    def _scored(self, weights: DataFrame, pairs: DataFrame) -> DataFrame:
        s = self.stats
        rows = self.postings.join(weights.select("query_id", "term", "w"), "term").join(pairs.select("query_id", "shard", "block"), ["query_id", "shard", "block"])
        one = rows.select("query_id", "w", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p")).select("query_id", F.col("p.ids").alias("doc_id"), "w", F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"))
        part = F.col("w") * F.col("tf") * (s.k1 + 1) / (F.col("tf") + s.k1 * (1 - s.b + s.b * F.col("dl") / F.lit(s.avgdl)))
        return one.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))

    def _open(self, weights: DataFrame, k: int) -> DataFrame:
        """The bounds, with whether the block has to be scored."""
        bounds = self._bounds(weights)
        best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        first = bounds.withColumn("place", F.row_number().over(best)).where(F.col("place") <= FIRST)
        bar = top(self._scored(weights, first), k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("bar"))
        return bounds.join(small(bar), "query_id", "left").withColumn("open", F.col("bar").isNull() | (F.col("bound") + SLACK >= F.col("bar")))

    def topk(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """``retrieval.bm25`` of the indexed documents, exactly. queries: (query_id, text)."""
        weights = self._weights(queries)
        return top(self._scored(weights, small(self._open(weights, k).where("open"))), k)

    def pruning(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """Per query: blocks that hold one of its terms, and those of them that are scored."""
        marked = self._open(self._weights(queries), k)
        return marked.groupBy("query_id").agg(F.count("*").alias("blocks"), F.count_if("open").alias("blocks_scored"))
