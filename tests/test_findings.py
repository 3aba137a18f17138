"""Faults found on odd inputs and larger tables."""

import itertools
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import catalog, providers
from quillon.operators import index, latent, metrics, onepass, retrieval
from quillon.plans.config import Config
from quillon.plans.grid import Chunks, Grid
from quillon.sources import readers, writers


def peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def moved(frame):
    """How often the plan moves rows by a hash of their keys."""
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def cancelling():
    """Two terms in one place with opposite signs."""
    seen = {}
    for i in range(100_000):
        at, sign = providers._place(f"w{i}")
        if (other := seen.get((at, -sign))) is not None:
            return f"{other} w{i}"
        seen[at, sign] = f"w{i}"


def test_latent_embedder_holds_few_entries_at_once():
    r = random.Random(1)
    texts = [" ".join(f"t{r.randrange(9000)}" for _ in range(120)) for _ in range(2500)]
    model = latent.Latent(np.ones(latent.COLUMNS), r.random() + np.ones((latent.COLUMNS, 80)), np.zeros(0))
    assert peak_mb(lambda: model(texts)) < 100


def test_questions_of_many_tasks_are_all_read(spark, tmp_path):
    q = spark.range(0, 300, 1, 40).select(F.col("id").cast("string").alias("question"), F.lit("a").alias("expected_answer"), F.array(F.lit("d")).alias("relevant_docs"), F.lit("c").alias("category"), F.lit("m").alias("difficulty"))
    writers.save_questions(q, f"{tmp_path}/q", "n")
    assert {r.question for r in readers.questions_json(spark, f"{tmp_path}/q").collect()} == {str(i) for i in range(300)}


def test_index_holds_texts_whose_counts_cancel(spark):
    chunks = spark.createDataFrame([("a", cancelling()), ("b", "!!"), ("c", "one two")], "chunk_id string, text string")
    assert {r.chunk_id: round(sum(x * x for x in r.embedding), 6) for r in index.build(chunks).collect()} == {"a": 1, "b": 0, "c": 1}


def test_menu_counts_texts_without_terms(spark, tmp_path):
    rows = spark.createDataFrame([(1, cancelling()), (2, "!!"), (3, None), (4, "x")], "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.name: r for r in catalog.QUERIES["embedder_menu"](spark, str(tmp_path)).collect()}
    assert (got["hash"].n_texts, got["hash"].n_empty) == (4, 2)


def test_containment_inside_words(spark):
    docs = spark.createDataFrame([(1, "xa b cy"), (2, "b a b"), (3, "a c"), (4, "za c"), (5, "xx")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a b c"), (2, "a c"), (3, "x"), (4, " "), (5, None), (6, "a q c")], "query_id long, text string")
    want = {(1, 1), (2, 3), (2, 4), (3, 1), (3, 5)} | {(4, i) for i in range(1, 6)}
    assert {(r.query_id, r.doc_id) for r in metrics.containment_qrels(docs, queries).collect()} == want


def made(spark, n=300, parts=2):
    r = random.Random(3)
    word = lambda: f"w{int(r.expovariate(0.08))}"
    docs = [(i, " ".join(word() for _ in range(r.randint(1, 30))), i % parts) for i in range(n)] + [(n + i, "w0 w1 w2", 0) for i in range(40)] + [(n + 50, None, 0), (n + 51, "", 1)]
    asked = [(i, " ".join(word() for _ in range(6)), i % parts) for i in range(12)] + [(90, "unknown", 0), (91, None, 1), (92, "w1 w1 w0", 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, c int").repartition(5), spark.createDataFrame(asked, "query_id long, text string, c int")


@pytest.mark.parametrize("by", [None, "c"])
def test_scored_texts_stay_where_they_are(spark, by, monkeypatch):
    docs, queries = made(spark)
    want = sorted(map(tuple, retrieval.top(retrieval.bm25(docs, queries, None, by=by), 7).select("query_id", "doc_id", "score", "rank").collect()))
    found = retrieval.bm25(docs, queries, 7, by=by)
    assert moved(found) <= 1
    assert sorted(map(tuple, found.select("query_id", "doc_id", "score", "rank").collect())) == want
    monkeypatch.setattr(retrieval, "_ROWS", 3)
    monkeypatch.setattr(retrieval, "_WAITING", 5)
    assert sorted(map(tuple, retrieval.bm25(docs, queries, 7, by=by).select("query_id", "doc_id", "score", "rank").collect())) == want


def test_fused_searches_move_only_their_best(spark, tmp_path):
    docs, queries = made(spark)
    docs.drop("c").write.parquet(f"{tmp_path}/documents.parquet")
    queries.select(F.col("query_id").alias("item_id"), "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = catalog.QUERIES["fusion_vector_bm25"](spark, str(tmp_path))
    assert moved(found) <= 4  # the two rankings, the sums of their ranks, the fused ranking
    scores = {}
    for ranking in (retrieval.text_topk(docs, queries, 20), retrieval.top(retrieval.bm25(docs, queries, None), 20)):
        for r in ranking.collect():
            scores.setdefault(r.query_id, {}).setdefault(r.doc_id, []).append(1 / (60 + r["rank"]))
    best = {q: sorted((-round(sum(x), 6), d) for d, x in own.items())[:10] for q, own in scores.items()}
    want = [(q, d, -score, i + 1) for q, own in best.items() for i, (score, d) in enumerate(own)]
    assert sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in found.collect()) == sorted(want)


def test_relevance_lists_stay_where_they_are(spark, monkeypatch):
    docs, queries = made(spark)
    found = metrics.pseudo_qrels(docs, queries)
    assert moved(found) <= 1
    got = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(metrics, "BROADCAST_QUERIES", 0)
    assert got == sorted(map(tuple, metrics.pseudo_qrels(docs, queries).collect()))
    ranking = retrieval.bm25(docs, queries, 5).select("query_id", "doc_id", "rank").localCheckpoint()
    pairs = found.select("query_id", "doc_id")
    plain = sorted(map(tuple, metrics.ranking_metrics(ranking, pairs, queries).collect()))
    assert plain == sorted(map(tuple, metrics.ranking_metrics(ranking, pairs, queries, store=lambda rows: rows.localCheckpoint()).collect()))


def test_classes_are_counted_without_their_pairs(spark):
    rows = [(i, None if i % 7 == 0 else i % 3) for i in range(40)]
    classes = spark.createDataFrame(rows, "doc_id long, label int")
    ranking = spark.createDataFrame([(q, d, r + 1) for q in (0, 5, 10, 39, 99) for r, d in enumerate(random.Random(q).sample(range(45), 6))], "query_id long, doc_id long, rank long")
    queries = spark.createDataFrame([(q,) for q in (0, 5, 10, 20, 39, 99)], "query_id long")
    pairs = classes.withColumnRenamed("doc_id", "query_id").join(classes, "label").select("query_id", "doc_id")
    want = sorted(map(tuple, metrics.ranking_metrics(ranking, pairs, queries).collect()))
    assert sorted(map(tuple, metrics.class_metrics(ranking, classes, queries).collect())) == want


def test_vector_scan_holds_few_scores_at_once():
    r = np.random.default_rng(1)
    asked, vectors = retrieval._unit(r.normal(size=(400, 16))), r.normal(size=(20_000, 16))
    best = retrieval._Best(np.arange(400), asked, 10)
    assert peak_mb(lambda: best.add(np.arange(20_000), vectors)) < 100


def test_csv_texts_come_back_as_they_are(spark, tmp_path):
    texts = ["".join(x) for n in range(4) for x in itertools.product('a"\\\0\n\r, ', repeat=n)] + [None, "null", "\t", "\u0001", " both\t"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.title: r.text for r in catalog.QUERIES["source_csv"](spark, str(tmp_path)).collect()}
    assert got == {f"Doc {i}": text for i, text in enumerate(texts)}


def test_latent_embedder_reads_texts_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    r = random.Random(4)
    texts = [" ".join(f"t{r.randrange(300)}" for _ in range(r.randrange(90))) for _ in range(150)] + [None, "", "!!", "x " * 70_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = latent.fit(frame.withColumn("text", F.udf(seen, "string").asNondeterministic()("text")), dimensions=5, columns=512)
    assert read.value == len(texts)
    got = {row.doc_id: row.embedding for row in latent.embedded(model, latent.counted(frame, 512, "doc_id")).collect()}
    assert len(got) == len(texts) and np.allclose([got[i] for i in range(len(texts))], model(texts))


def test_searches_of_a_grid_read_the_chunks_once(spark, tmp_path):
    docs, queries = made(spark)
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    class Seen(Chunks):
        def of(self, config):
            return super().of(config).withColumn("text", F.udf(seen, "string")("text"))

    base = Config(chunking_strategy="fixed_tokens", chunk_size=4, chunk_overlap=0, use_reranking=False)
    corpus, methods = Seen(docs.select("doc_id", "text"), str(tmp_path)), ("vector", "bm25", "hybrid")
    Grid([base.with_(retrieval_method=m) for m in methods], corpus, queries.select("query_id", "text")).ranking().collect()
    assert 0 < read.value == Chunks.of(corpus, base).count()


@pytest.mark.parametrize("limit", [5, 200_000])
def test_one_reading_equals_its_searches(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(onepass, "_TERMS", limit)
    monkeypatch.setattr(retrieval, "_CHARS", 700)
    docs, queries = made(spark)
    docs = docs.withColumn("doc_id", F.col("doc_id") * 2 + F.col("c")).unionByName(spark.createDataFrame([(7001, "É w1 ß_1 " * 400, 1), (7002, "!!", 0)], "doc_id long, text string, c int"))
    asked = retrieval.few_vectors(index.dense_vectors(queries, "query_id", keep=("c",)).withColumnRenamed("c", "part"))
    few = retrieval.asked_terms(queries, ["c"]).toPandas()
    names = sorted(set(few["term"]))
    onepass.read(docs.repartition(3), "c", asked, names, {0, 1}, 6).write.parquet(f"{tmp_path}/read")
    stored = spark.read.parquet(f"{tmp_path}/read")
    rows = lambda df: sorted(map(str, df.select("query_id", "doc_id", "score", "rank").collect()))
    assert rows(onepass.bm25(stored, few, "c", names, 6)) == rows(retrieval.top(retrieval.bm25(docs, queries, None, by="c"), 6))
    assert rows(onepass.vector_topk(stored, 6)) == rows(retrieval.vector_topk(index.dense_vectors(docs, keep=("c",)), index.dense_vectors(queries, "query_id", keep=("c",)), 6, by="c"))
