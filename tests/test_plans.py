import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quillon.plans.config import Config
from quillon import providers
from quillon.plans.experiments import GRIDS, METRICS, Tracker, compare, evaluate, evaluate_answers, labs, report, run_all, run_experiment, stage_seconds
from quillon.plans.grid import Chunks, Grid
from quillon.plans.pipeline import Pipeline

TOPICS = ["the cat sat on the mat and slept all day long.", "dogs run in the park every single morning.", "the sun is a star made of hot burning gas.", "rivers carry water from mountains to the sea."]
BASE = Config(chunking_strategy="sentence_pack", retrieval_top_k=2)


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame([(i, t * 2) for i, t in enumerate(TOPICS)], "doc_id long, text string").cache()
    queries = spark.createDataFrame([(1, "where did the cat sat sleep"), (2, "what is the sun made of")], "query_id long, text string").cache()
    return docs, queries


def test_config():
    config = Config.merged({"chunk_size": 5}, {"reranking_stages": ["keyword"]})
    assert config.chunk_size == 5 and config.reranking_stages == ("keyword",)
    with pytest.raises(ValueError):
        Config.merged({"nope": 1})
    assert Config.from_json(config.to_json()) == config
    assert Config().needs_rebuild(config) and not Config().needs_rebuild(Config(retrieval_alpha=0.1))
    assert Config().needs_rebuild(Config(retrieval_method="bm25"))


@pytest.mark.parametrize("changes", [{"retrieval_method": "vector", "use_reranking": False}, {"retrieval_method": "bm25", "use_query_expansion": True}, {"query_transformation": "multi_query", "reranking_method": "keyword"}, {"reranking_method": "diversity"}, {"reranking_method": "multi_stage"}, {"use_hyde": True, "answer_mode": "model"}, {"use_hyde": True, "hyde_num_docs": 3, "hyde_method": "hybrid", "retrieval_method": "vector"}, {"use_mmr": True, "retrieval_method": "vector", "use_reranking": False}, {"reranking_method": "fusion"}, {"reranking_method": "cross_encoder_fusion"}, {"reranking_method": "multi_stage", "reranking_stages": ("semantic", "keyword", "diversity")}, {"query_transformation": "model", "reranking_method": "keyword"}])
def test_pipeline_finds_the_right_document(corpus, changes):
    docs, queries = corpus
    got = {r.query_id: r for r in Pipeline(BASE.with_(**changes), docs).run(queries).collect()}
    assert got[1].contexts[0].source_id == 0 and got[2].contexts[0].source_id == 2
    assert all(r.answer for r in got.values())


def test_hyde_searches_by_the_mean_of_hypothetical_documents(spark, corpus, monkeypatch):
    docs, queries = corpus
    monkeypatch.setitem(providers.MODELS, "rivers", lambda: lambda prompts: ["rivers carry water to the sea"] * len(prompts))
    plain = BASE.with_(retrieval_method="vector", use_reranking=False, retrieval_top_k=1, use_hyde=True, language_model="rivers")
    top = lambda config: {r.query_id: r.contexts[0].source_id for r in Pipeline(config, docs).run(queries).collect()}
    assert top(plain) == {1: 3, 2: 3}
    assert top(plain.with_(hyde_method="hybrid", hyde_weight=0.95)) == {1: 0, 2: 2}
    assert top(plain.with_(hyde_method="hybrid", hyde_weight=0.05, hyde_num_docs=2)) == {1: 3, 2: 3}


def test_prompt_templates_reach_the_model(corpus):
    docs, queries = corpus
    got = Pipeline(BASE.with_(answer_mode="model", prompt_template="citation"), docs).run(queries).collect()
    assert all(r.answer.startswith("Response to: System: You are a helpful assistant... Include citations") for r in got)


def test_stages_labs_and_reports(spark, corpus, tmp_path):
    docs, queries = corpus
    assert set(stage_seconds(BASE, docs, queries)) == {"chunking", "ranking", "answering"}
    got = labs(docs, queries, [{"chunking_strategy": "sentence_pack"}], [{"retrieval_method": m} for m in ("vector", "bm25")], [{"use_reranking": False}], str(tmp_path))
    assert got.select("config").distinct().count() == 2 and got.where("rank = 1").count() >= 3
    run = spark.createDataFrame([("a", [(1, [1.0])], (0.5,))], "config_name string, question_results array<struct<q: int, list: array<double>>>, aggregate_metrics struct<mrr: double>")
    summary, details = report(run)
    assert summary.first().mrr == 0.5 and details.columns == ["config_name", "q"]


def test_history_and_other_embedders(spark, corpus):
    docs, queries = corpus
    history = spark.createDataFrame([(1, 0, "user", "cat")], "query_id long, turn long, role string, text string")
    assert Pipeline(BASE.with_(reranking_method="contextual"), docs).rank(queries, history).count() == 4
    turns = [(1, 0, "user", "rivers"), (1, 1, "assistant", "dogs park"), (1, 2, "user", "carry water"), (1, 3, "user", "mountains sea"), (1, 4, "user", "to the sea")]
    earlier = spark.createDataFrame(turns, "query_id long, turn long, role string, text string")
    asked = spark.createDataFrame([(1, "and then"), (2, "what is the sun made of")], "query_id long, text string")
    talk = Pipeline(BASE.with_(conversational=True, retrieval_method="bm25"), docs)
    assert sorted(r.text for r in talk._with_history(asked, earlier).collect()) == ["carry water mountains sea to the sea and then", "what is the sun made of"]
    got = {r.query_id: r for r in talk.run(asked, earlier).collect()}
    assert got[1].contexts[0].source_id == 3 and got[1].query == "and then" and got[2].contexts[0].source_id == 2
    assert Pipeline(BASE, docs).run(queries.limit(0)).count() == 0


def test_experiments(spark, corpus, tmp_path):
    docs, queries = corpus
    row = evaluate(BASE, docs, queries).first()
    assert row.p_at_1 == 1.0
    tracker = Tracker(spark, "small", f"{tmp_path}/runs")
    out = run_experiment(tracker, [{"retrieval_method": "bm25"}, {"retrieval_method": "wrong"}], docs, queries, base=BASE).orderBy("seq").collect()
    assert out[0].metric_mrr == 1.0 and out[1].error
    assert tracker.best().first().seq == 0 and tracker.report().count() > 0
    assert len(GRIDS["chunking"]()) == 33 and len(GRIDS["retrieval"]()) == 8
    questions = spark.createDataFrame([(1, "where did the cat sat", "on the mat")], "query_id long, text string, expected_answer string")
    scored = evaluate_answers(BASE, docs, questions)
    assert compare({"a": scored, "b": scored}, ["rouge1"]).count() == 2


MANY = [
    {"retrieval_method": "vector", "use_reranking": False},
    {"retrieval_method": "bm25", "use_reranking": False, "use_query_expansion": True},
    {"retrieval_method": "hybrid", "retrieval_alpha": 0.7, "query_transformation": "multi_query"},
    {"reranking_method": "fusion", "chunking_strategy": "fixed_tokens", "chunk_size": 4, "chunk_overlap": 0},
    {"reranking_method": "multi_stage", "reranking_stages": ("semantic", "keyword", "diversity")},
    {"reranking_method": "diversity", "chunking_strategy": "fixed_tokens", "chunk_size": 8, "chunk_overlap": 2},
    {"reranking_method": "llm", "language_model": "rating"},
    {"use_hyde": True, "hyde_prompts": "same", "hyde_method": "hybrid", "retrieval_method": "vector", "use_reranking": False},
]


def test_a_grid_ranks_as_its_pipelines_do(spark, corpus, tmp_path):
    docs, queries = corpus
    table = spark.createDataFrame([("star", "sun", 1), ("made", "formed", 1), ("sleep", "rest", 1)], "term string, synonym string, rank int")
    configs = [BASE.with_(**c) for c in MANY]
    grid = Grid(configs, Chunks(docs, str(tmp_path)), queries, table)
    got = {}
    for r in grid.ranking().collect():
        got.setdefault(r.config_id, []).append((r.query_id, r.doc_id, round(r.score, 5), r.rank))
    for i, config in enumerate(configs):
        with Pipeline(config, docs, table) as pipeline:
            assert sorted(got[i]) == sorted((r.query_id, r.doc_id, round(r.score, 5), r.rank) for r in pipeline.rank(queries).collect()), MANY[i]
    qrels = spark.createDataFrame([(1, 0), (2, 2)], "query_id long, doc_id long")
    means = {r.config_id: r for r in grid.means(qrels, METRICS).collect()}
    for i in (0, 2, 4):
        assert means[i].asDict() == evaluate(configs[i], docs, queries, qrels, table).first().asDict() | {"config_id": i}


def test_a_grid_scores_answers(spark, corpus, tmp_path):
    docs, queries = corpus
    questions = spark.createDataFrame([(1, "where did the cat sat sleep", "on the mat"), (2, "what is the sun made of", "hot gas")], "query_id long, text string, expected_answer string")
    configs = [BASE.with_(answer_mode=m, prompt_template=t, language_model=x) for m, t, x in (("extractive", "plain", "echo"), ("model", "citation", "echo"), ("model", "basic", "extractive"))]
    rows = Grid(configs, Chunks(docs, str(tmp_path)), queries).answers(questions).collect()
    assert len(rows) == 6
    for i, config in enumerate(configs):
        want = {r.id: r for r in evaluate_answers(config, docs, questions).collect()}
        for r in rows:
            if r.config_id == i:
                assert r.answer == want[r.query_id].answer and r.rouge1 == want[r.query_id].rouge1 and r.faithfulness == want[r.query_id].faithfulness
    assert {r.answer for r in rows if r.config_id == 2 and r.query_id == 2} <= {TOPICS[2] + TOPICS[2][:-1], TOPICS[2][:-1]}


def test_experiments_measure_what_they_name(spark, corpus, tmp_path):
    assert all(c["use_reranking"] is False for name in ("chunking", "retrieval", "query_processing") for c in GRIDS[name]())
    assert len(GRIDS["query_processing"]()) == 7 and len({str(c) for c in GRIDS["query_processing"]()}) == 7
    r = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(r.choice("abcdefghij") * r.randint(1, 3) for _ in range(30)) + ".") for i in range(40)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, " ".join(r.choice("abcdefghij") * r.randint(1, 3) for _ in range(4))) for i in range(6)], "query_id long, text string")
    grid = Grid([BASE.with_(**c) for c in GRIDS["retrieval"]()], Chunks(docs, str(tmp_path)), queries)
    rankings = {}
    for row in grid.ranking().collect():
        rankings.setdefault(row.config_id, set()).add((row.query_id, row.source_id, row.rank))
    assert rankings[0] != rankings[1] != rankings[2] and rankings[0] != rankings[3]
    questions = queries.select("query_id", F.col("text").alias("expected_answer"))
    out = run_all(spark, f"{tmp_path}/runs", docs, queries, ["retrieval", "generation"], questions=questions).collect()
    assert sum(r.experiment == "retrieval" for r in out) == 8
    assert all(r.metric_correctness is not None for r in out if r.experiment == "generation") and sum(r.experiment == "generation" for r in out) == 12


def test_driver_contract(spark):
    queries, oracle = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert oracle.keys() <= queries.keys() and len(queries) > 80
    assert __spark_entry__.entry(spark).limit(1).count() == 1
