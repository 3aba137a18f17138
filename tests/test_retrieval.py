import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import expansion, index, reranking, retrieval

DOCS = [(1, "the cat sat on the mat"), (2, "the dog sat"), (3, "cats and dogs"), (4, ""), (5, "a mat for the cat"), (6, "something else entirely"), (7, "more filler text here")]
QUERIES = [(1, "cat mat"), (2, "zzz"), (3, "dog dog sat")]


def frames(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(QUERIES, "query_id long, text string")


def okapi(query):
    texts = {d: t.split() for d, t in DOCS}
    n, avg = len(texts), np.mean([len(t) for t in texts.values()])
    df = {w: sum(w in t for t in texts.values()) for t in texts.values() for w in t}
    raw = {w: math.log(n - x + 0.5) - math.log(x + 0.5) for w, x in df.items()}
    idf = {w: 0.25 * np.mean(list(raw.values())) if x < 0 else x for w, x in raw.items()}
    return {d: round(s, 6) for d, t in texts.items() for s in [sum(idf.get(q, 0) * t.count(q) * 2.5 / (t.count(q) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for q in query.split())] if any(q in t for q in query.split())}


def test_bm25_equals_the_formula(spark):
    docs, queries = frames(spark)
    got = {}
    for r in retrieval.bm25(docs, queries).collect():
        got.setdefault(r.query_id, {})[r.doc_id] = r.score
    assert got.keys() == {1, 3}
    for q, text in QUERIES:
        assert got.get(q, {}) == pytest.approx(okapi(text), abs=2e-6)


def test_padding_fills_with_zero_scores(spark):
    docs, queries = frames(spark)
    got = retrieval.pad_zero(retrieval.bm25(docs, queries), docs, queries, 3).where("query_id = 2").orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in got] == [(1, 0), (2, 0), (3, 0)]


def test_vector_search_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=4).tolist()) for i in range(50)] + [(50, [0.0] * 4), (51, [1.0, 0.0, 0.0, 0.0]), (52, [2.0, 0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    queries = spark.createDataFrame([(9, [1.0, 0.0, 0.0, 0.0]), (8, [0.0] * 4), (7, [0.0, 1.0, 0.0, 0.0])], "query_id long, embedding array<double>")
    once = sorted(map(tuple, retrieval.vector_topk(vectors, queries, 5).collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 1)
    monkeypatch.setattr(retrieval, "BLOCK", 2)
    assert sorted(map(tuple, retrieval.vector_topk(vectors, queries, 5).collect()), key=str) == sorted(once, key=str)
    nine = [x for x in once if x[0] == 9]
    assert [(x[1], x[2]) for x in sorted(nine, key=lambda x: x[3])][:2] == [(51, 1.0), (52, 1.0)]
    m = np.array([v for _, v in rows[:50]])
    cos = np.round(m[:, 1] / np.linalg.norm(m, axis=1), 6)
    assert [x[1] for x in sorted((x for x in once if x[0] == 7), key=lambda x: x[3])] == sorted(range(50), key=lambda i: (-cos[i], i))[:5]
    every = retrieval.vector_topk(vectors, queries, 53).where("query_id = 9").orderBy(F.desc("rank")).first()
    assert every.doc_id == 50 and every.score is None


def test_hybrid_ends_are_the_single_rankings(spark):
    docs, queries = frames(spark)
    lexical = retrieval.bm25(docs, queries, 20)
    vector = retrieval.text_topk(docs, queries, 20)
    order = lambda df: [(r.query_id, r.doc_id) for r in df.where("score > 0").orderBy("query_id", "rank").collect()]
    assert order(retrieval.hybrid(vector, lexical, 1.0)) == order(vector.where("rank <= 10"))
    assert order(retrieval.hybrid(vector, lexical, 0.0)) == order(lexical.where("rank <= 10"))
    with pytest.raises(ValueError):
        retrieval.retrieve("x", vector, lexical)


def ranking(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, score double, rank long")


def test_rrf(spark):
    both = ranking(spark, [(1, 1, 9.0, 1), (1, 2, 8.0, 2), (1, 2, 0.9, 1), (1, 3, 0.8, 2)])
    got = reranking.rrf(both).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [2, 1, 3]
    assert got[0].score == round(1 / 62 + 1 / 61, 6)
    assert [r.doc_id for r in reranking.rrf(both.withColumn("score", F.col("score") * 100)).orderBy("rank").collect()] == [2, 1, 3]


def test_merge_variants_keeps_the_first_place(spark):
    rows = spark.createDataFrame([(1, 0, 5, 1), (1, 0, 6, 2), (1, 1, 6, 1), (1, 1, 7, 2)], "query_id long, variant long, doc_id long, rank long")
    assert [(r.doc_id, r.place) for r in retrieval.merge_variants(rows).orderBy("place").collect()] == [(5, 1), (6, 2), (7, 3)]


def brute_mmr(rel, sim, weight, k):
    left, out = sorted(rel), []
    while left and len(out) < k:
        best = max(left, key=lambda d: (round(weight * rel[d] - (1 - weight) * max((sim(d, o) for o in out), default=0), 6), -d))
        out.append(best)
        left.remove(best)
    return out


def test_mmr_equals_brute_force(spark):
    r = np.random.default_rng(2)
    vectors = {i: r.normal(size=3) for i in range(12)}
    rel = {i: round(float(r.random()), 3) for i in vectors}
    cos = lambda a, b: round(float(vectors[a] @ vectors[b] / np.linalg.norm(vectors[a]) / np.linalg.norm(vectors[b])), 6)
    ranked = ranking(spark, [(1, d, rel[d], n + 1) for n, d in enumerate(sorted(rel, key=rel.get, reverse=True))])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "doc_id long, embedding array<double>")
    for weight in (1.0, 0.5, 0.2):
        got = [x.doc_id for x in reranking.mmr_vectors(ranked, frame, weight, 6).orderBy("place").collect()]
        assert got == brute_mmr(rel, cos, weight, 6)


def test_mmr_on_words(spark):
    rows = [(1, i, "a b c", t) for i, t in enumerate(["a b c", "a b c", "a x y", "z"])]
    frame = spark.createDataFrame(rows, "query_id long, doc_id long, query string, text string")
    assert [r.doc_id for r in reranking.mmr_words(frame, 0.4, 4).orderBy("place").collect()] == [0, 3, 2, 1]


def test_multi_stage_modes(spark):
    docs, queries = frames(spark)
    found = retrieval.bm25(docs, queries).join(docs, "doc_id").join(queries.withColumnRenamed("text", "query"), "query_id")
    for mode in ("fused", "sequential"):
        assert reranking.multi_stage(found, k=2, mode=mode).where("query_id = 1").count() == 2


def test_stages_of_a_sequence_work_on_what_the_one_before_passed_on(spark):
    texts = {1: "a b x y", 2: "a y b x", 3: "x a b y", 4: "b x a y", 5: "a b"}
    rows = [(7, d, 1.0 / r, r, "a b", texts[d]) for r, d in enumerate([4, 2, 5, 3, 1], 1)]
    frame = spark.createDataFrame(rows, "query_id long, doc_id long, score double, rank long, query string, text string")
    order = lambda *stages, k=9: [r.doc_id for r in reranking.multi_stage(frame, stages=stages, k=k, mode="sequential").orderBy("rank").collect()]
    assert order("cross_encoder") == [5, 4, 2, 3, 1]  # all but 5 have equal word overlap
    assert order("keyword", "cross_encoder") == [5, 3, 1, 4, 2]  # 3 and 1 hold the phrase
    assert order("keyword", "cross_encoder", k=3) == [5, 3, 1]
    assert order("diversity", "keyword") == order("diversity", "keyword", k=5) != order("keyword", "diversity")


def test_contextual_query(spark):
    turns = spark.createDataFrame([(1, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(10)], "conv_id long, turn long, role string, text string")
    got = {r.turn: r.query for r in reranking.contextual_query(turns).collect()}
    assert got[0] == "t0" and got[8] == "t2 t4 t6 t8"


def test_variants(spark):
    q = spark.createDataFrame([(1, "what is it"), (2, "please explain")], "query_id long, text string")
    got = lambda df, i: [r.variant_text for r in df.where(f"query_id = {i}").orderBy("variant").collect()]
    assert got(expansion.templates(q), 1) == ["what is it", "information about what is it", "explain what is it"]
    assert got(expansion.rules(q, 3), 1) == ["what is it", "Please what is it", "I want to know what is it"]
    assert got(expansion.rules(q, 3), 2) == ["please explain", "What about please explain", "I want to know please explain"]
    table = spark.createDataFrame([("what", "which", 1), ("what", "a_b", 2), ("what", "third", 3), ("it", "that", 1)], "term string, synonym string, rank int")
    assert got(expansion.synonyms(q, table), 1) == ["what is it", "which is it"]
    assert got(expansion.parse_lines(q, F.lit('1. "one"\n\n2. two\n')), 1) == ["what is it", "one", "two"]
    assert got(expansion.parse_lines(q, F.lit("")), 1)[1:] == ["Information about what is it", "Tell me about what is it"]
    for method in ("none", "multi_query", "expansion", "hyde"):
        assert expansion.transform(q, method).count() >= 2


def test_hypothetical_documents_and_vectors(spark):
    q = spark.createDataFrame([(1, "how to cook")], "query_id long, text string")
    assert expansion.hyde_prompt(q).first().query_type == "procedural"
    assert expansion.hyde_documents(q, 3).count() == 3
    v = spark.createDataFrame([(1, [3.0, 0.0]), (1, [0.0, 3.0])], "query_id long, embedding array<double>")
    mean = expansion.mean_vector(v)
    assert mean.first().embedding == pytest.approx([0.5**0.5] * 2)
    one = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert expansion.blend_vectors(one, mean, 1.0).first().embedding == [1.0, 0.0]
