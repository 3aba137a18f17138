import random
import time

import pytest
from pyspark.sql import functions as F

from quillon import providers
from quillon.functions import scores as S
from quillon.functions import vectors as V
from quillon.operators import answering, metrics


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_word_scores(spark):
    j = lambda a, b: value(spark, S.jaccard(F.lit(a), F.lit(b)))
    assert j("a b", "B c") == pytest.approx(1 / 3) and j("", "a") == 0 and j("a", "a") == 1
    assert value(spark, S.lexical_diversity(F.lit("a A b"))) == pytest.approx(2 / 3)
    assert value(spark, S.lexical_diversity(F.lit(""))) == 0
    assert value(spark, S.relevance_precision(F.lit("a b"), F.lit("b c"))) == 0.5


def test_keyword_density(spark):
    k = lambda q, t: value(spark, S.keyword_density(F.lit(q), F.lit(t)))
    assert k("the cat", "cat cats dog") == pytest.approx(10 * 2 / 3)
    assert k("red cat", "a red cat") == pytest.approx(10 * (2 + 2) / 3 + 5)
    assert k("x", "") == 0


def test_query_types(spark):
    kinds = {"What is it": "definition", "who did it": "factual", "how to do": "procedural", "cats versus dogs": "comparative", "a cause": "causal", "tell me about": "exploratory", "zzz": "exploratory"}
    for q, kind in kinds.items():
        assert value(spark, S.query_type(F.lit(q))) == kind


def test_faithfulness(spark):
    f = lambda a, c: value(spark, S.faithfulness(F.lit(a), F.lit(c)))
    assert f("", "x") == 1 and f("one", "x") == 1 and f("a b", "a b c") == 1 and f("a b", "b a") == 0
    assert f("a b c d", "a b c x") == pytest.approx((2 / 3 + 1 / 2) / 2)


def test_rouge(spark):
    assert value(spark, S.overlap_f1(F.lit("a b"), F.lit("b c d"))) == pytest.approx(0.4)
    assert value(spark, S.overlap_f1(F.lit(""), F.lit(""))) == 0
    assert value(spark, S.ngram_f1(F.lit("a a b"), F.lit("a b b"), 1)) == pytest.approx(2 * 2 / 6)
    rows = spark.createDataFrame([(1, "a b c d", "a x c d"), (2, "", "a"), (3, None, None)], "id long, answer string, expected string")
    assert {r.id: r.rouge_l for r in metrics.rouge_l(rows).collect()} == {1: 0.75, 2: 0.0, 3: 0.0}


def test_answer_heuristics(spark):
    rows = spark.createDataFrame([(1, "according to x", "x", "x"), (2, "see [1]", "a", "b"), (3, "a b c d e f", "a b c d e f", "a b c d e f")], "id long, answer string, expected string, context string")
    got = {r.id: r for r in metrics.answer_metrics(rows).collect()}
    assert (got[1].citation_rate, got[2].citation_rate, got[3].citation_rate) == (0.8, 1.0, 0.0)
    assert got[3].correctness == 0.8 and got[3].answer_correctness == 1.0


def test_vectors(spark):
    v = lambda x: F.array(*map(F.lit, x))
    assert value(spark, V.cosine(v([1.0, 0.0]), v([1.0, 1.0]))) == pytest.approx(0.5**0.5)
    assert value(spark, V.cosine(v([0.0, 0.0]), v([1.0, 1.0]))) is None
    assert value(spark, V.unit(v([0.0, 0.0]))) is None


def test_ranking_metrics(spark):
    ranking = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "query_id long, doc_id long, rank long")
    qrels = spark.createDataFrame([(1, 11), (1, 12), (1, 13), (1, 14), (3, 1)], "query_id long, doc_id long")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    got = {r.query_id: r for r in metrics.ranking_metrics(ranking, qrels, queries).collect()}
    assert (got[1].p_at_1, got[1].p_at_3, got[1].p_at_5) == (0, 0.666667, 0.666667)
    assert (got[1].r_at_3, got[1].mrr) == (0.5, 0.5)
    assert got[2].mrr == 0 and got[3].p_at_5 == 0 and got[3].r_at_5 == 0


def test_relevance_lists(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b"), (3, "x  a\nb c y"), (4, "z")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a b c"), (2, "z"), (3, "d q r s")], "query_id long, text string")
    assert {(r.query_id, r.doc_id) for r in metrics.pseudo_qrels(docs, queries).collect()} == {(1, 1), (1, 3), (2, 4), (3, 1)}
    assert {(r.query_id, r.doc_id) for r in metrics.containment_qrels(docs, queries).collect()} == {(1, 1), (1, 3), (2, 4)}


def test_failed_questions_leave_the_means(spark):
    rows = spark.createDataFrame([(1, 1.0, None), (2, 0.0, "x"), (3, 0.5, None)], "id long, mrr double, error string")
    r = metrics.aggregate_run(rows, ["mrr"]).first()
    assert (r.avg_mrr, r.question_count, r.failed_count) == (0.75, 3, 1)


def contexts(spark, rows):
    return spark.createDataFrame(rows, "query_id long, rank long, query string, text string")


def test_extractive_answers(spark):
    long = "cat one two three four five six seven eight nine ten"
    rows = [(1, 1, "the cat", "The cat sat. Nothing here! A cat ran."), (2, 1, "zebra", "no match."), (3, 1, "cat", f"{long}. {long} eleven. cat a b c d e f g h i j k l")]
    got = {r.query_id: r.answer for r in answering.extractive(contexts(spark, rows)).collect()}
    assert got[1] == "The cat sat A cat ran." and got[2] == answering.NO_ANSWER
    assert got[3] == long
    assert "Question: zebra" in {r.query_id: r.prompt for r in answering.prompt(contexts(spark, rows)).collect()}[2]
    assert answering.generated(contexts(spark, rows)).where("answer like 'Response to:%'").count() == 3


def test_comparison(spark):
    row = answering.compare(spark.createDataFrame([(1, "a b", "a b c d")], "id long, answer string, other string")).first()
    assert (row.words, row.other_words, row.difference_percent) == (2, 4, 50.0)


def test_providers(spark):
    for reply, score in {"8": 0.8, "Score: 12": 1.0, "none": 0.5, "": 0.5, "0": 0.1}.items():
        assert value(spark, providers.reply_score(F.lit(reply))) == pytest.approx(score)
    providers.register("scorer", "length", lambda: lambda q, t: [float(len(x)) for x in t])
    df = spark.createDataFrame([("a", "bcd")], "q string, t string")
    assert df.select(providers.pair_score(F.col("q"), F.col("t"), "length")).first()[0] == 3
    dense = providers.hash_embed(["a b a", ""])
    terms = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a")], "id long, term string")
    for r in providers.hashed_terms(terms, ["id"]).collect():
        assert dense[0][r.bucket] == pytest.approx(r.weight)
    assert list(df.select(providers.embed(F.col("q"))).first()[0]) == pytest.approx(providers.hash_embed(["a"])[0].tolist())
    with pytest.raises(KeyError):
        providers.embedder("missing")


def test_keyword_density_in_batches_equals_the_expression(spark):
    from quillon.operators import reranking

    texts = ["the cat sat on the mat", "Cat CAT concatenate  cat sat", "", "\n", "what is a cat sat on", None, "é cat\u00a0sat"]
    rows = [(q, i, query, text) for q, query in enumerate(["cat sat on", "The cat", "", "what is a", "é cat"]) for i, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, query string, text string")
    got = {(r.query_id, r.doc_id): r.score for r in reranking.keywords(df).collect()}
    for r in df.select("query_id", "doc_id", F.round(S.keyword_density(F.col("query"), F.col("text")), 6).alias("score")).collect():
        assert got[r.query_id, r.doc_id] == r.score or got[r.query_id, r.doc_id] is None and r.score is None


def test_common_subsequences_by_bits():
    r = random.Random(7)

    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            diagonal = 0
            for j, y in enumerate(b, 1):
                diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for _ in range(300):
        a, b = ([r.choice("abcde") for _ in range(r.randint(0, 90))] for _ in range(2))
        assert metrics.common_subsequence(a, b) == table(a, b)
    a, b = ([f"w{r.randrange(500)}" for _ in range(20_000)] for _ in range(2))
    began = time.time()
    assert metrics.common_subsequence(a, b) > 1000 and time.time() - began < 1
