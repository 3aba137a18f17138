"""Experiments: grids of configurations, each scored over all queries, as rows of one results table."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from quillon import providers
from quillon.operators import analytics, metrics
from quillon.plans.config import Config
from quillon.plans.grid import Chunks, Grid
from quillon.plans.pipeline import Pipeline
from quillon.sources import writers

ANSWER_METRICS = ["rouge1", "rouge2", "rougel", "faithfulness", "answer_correctness", "citation_rate", "correctness", "lexical_diversity"]
METRICS = [*(f"p_at_{k}" for k in metrics.CUTS), *(f"r_at_{k}" for k in metrics.CUTS), "mrr"]


class Tracker:
    """Collects iterations (settings, metrics, seconds) and appends each to a Parquet table by experiment."""

    def __init__(self, spark: SparkSession, experiment: str, path: str):
        self.spark, self.experiment, self.path, self.n = spark, experiment, path, 0

    def log(self, settings: dict, measured: dict, seconds: float, error: str | None = None) -> None:
        row = {"experiment": self.experiment, "seq": self.n, "ts": time.time(), "seconds": float(seconds), "error": error}
        row |= {k: str(v) for k, v in settings.items()} | {f"metric_{k}": None if v is None else float(v) for k, v in measured.items()}
        kind = lambda k: ty.LongType() if k == "seq" else ty.DoubleType() if k in ("ts", "seconds") or k.startswith("metric_") else ty.StringType()
        schema = ty.StructType([ty.StructField(k, kind(k)) for k in row])
        writers.append_run(self.spark.createDataFrame([tuple(row.values())], schema), self.path)
        self.n += 1

    def results(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(self.path).where(F.col("experiment") == self.experiment)

    def best(self, measure: str = "metric_mrr") -> DataFrame:
        return analytics.best(self.results(), measure, "seq")

    def report(self) -> DataFrame:
        frame = self.results()
        return analytics.describe(frame, [c for c in analytics.plottable(frame) if c != "seq"])


def grid(**options: Iterable) -> list[dict]:
    return [dict(zip(options, values, strict=True)) for values in itertools.product(*options.values())]


def chunking_grid() -> list[dict]:
    fixed = [{"chunking_strategy": "fixed_tokens", "chunk_size": s, "chunk_overlap": o} for s in (64, 128, 256) for o in (0, s // 4)]
    other = [{"chunking_strategy": s} for s in ("paragraphs", "sentence_pack", "semantic_seg", "topic_seg", "sliding_coherent")]
    return [c | {"retrieval_method": r, "use_reranking": False} for c in fixed + other for r in ("vector", "bm25", "hybrid")]


def retrieval_grid() -> list[dict]:
    """Retrieval alone, plain and with expanded queries."""
    plain = [{"retrieval_method": "vector"}, {"retrieval_method": "bm25"}, *({"retrieval_method": "hybrid", "retrieval_alpha": a} for a in (0.3, 0.5, 0.7))]
    return [c | {"use_reranking": False} for c in plain + [c | {"use_query_expansion": True} for c in (plain[0], plain[1], plain[3])]]


def query_grid() -> list[dict]:
    """The query itself, expanded, rephrased by a model, and hypothetical documents: asked for in the same words, by the
    query's type, several of them, and blended with the query."""
    vector = {"retrieval_method": "vector", "use_reranking": False}
    hyde = vector | {"use_hyde": True}
    return [vector, vector | {"use_query_expansion": True}, vector | {"query_transformation": "model"}, hyde | {"hyde_prompts": "same"}, hyde, hyde | {"hyde_num_docs": 4}, hyde | {"hyde_method": "hybrid"}]


def embedding_grid() -> list[dict]:
    """Every registered embedder, by dense retrieval alone."""
    return [{"embedding_model": name, "retrieval_method": "vector", "use_reranking": False} for name in sorted(providers.EMBEDDERS)]


def reranking_grid() -> list[dict]:
    stages = {"multi_stage": ("semantic", "cross_encoder", "diversity"), "keyword_fusion": ("semantic", "keyword", "diversity")}
    plain = [{"use_reranking": False}, *({"reranking_method": m} for m in ("cross_encoder", "llm", "fusion", "cross_encoder_fusion"))]
    return plain + [{"reranking_method": "multi_stage", "reranking_stages": s} for s in stages.values()]


def generation_grid() -> list[dict]:
    contexts = [{"retrieval_top_k": 3, "use_reranking": False}, {"retrieval_top_k": 5, "use_reranking": False}, {"retrieval_top_k": 3, "use_reranking": True}]
    return [{"answer_mode": "model", "prompt_template": t} | c for t in ("basic", "instructional", "extractive", "citation") for c in contexts]


GRIDS: dict[str, Callable[[], list[dict]]] = {"chunking": chunking_grid, "embedding": embedding_grid, "retrieval": retrieval_grid, "query_processing": query_grid, "reranking": reranking_grid, "generation": generation_grid}


def evaluate(config: Config, docs: DataFrame, queries: DataFrame, qrels: DataFrame | None = None, synonyms: DataFrame | None = None) -> DataFrame:
    """Mean ranking metrics of one configuration, on documents: a chunk counts for its document. One row."""
    pipeline = Pipeline(config, docs, synonyms)
    found = pipeline.rank(queries).join(pipeline.chunks.select("doc_id", "source_id"), "doc_id")
    first = found.groupBy("query_id", F.col("source_id").alias("doc_id")).agg(F.min("rank").alias("rank"))
    wanted = qrels if qrels is not None else metrics.pseudo_qrels(docs, queries)
    per_query = metrics.ranking_metrics(first, wanted, queries)
    return per_query.agg(*[F.round(F.avg(m), 6).alias(m) for m in METRICS])


def evaluate_grid(configs: list[Config], corpus: Chunks, queries: DataFrame, qrels: DataFrame, synonyms: DataFrame | None = None, questions: DataFrame | None = None) -> DataFrame:
    """``evaluate`` of many configurations in one plan: config_id, the mean ranking metrics and, for questions (query_id,
    expected_answer), the mean measures of the answers."""
    grid = Grid(configs, corpus, queries, synonyms)
    out = grid.means(qrels, METRICS)
    if questions is None:
        return out
    scored = grid.answers(questions).groupBy("config_id").agg(*[F.round(F.avg(m), 6).alias(m) for m in ANSWER_METRICS])
    return out.join(scored, "config_id", "left")


def _measured(configs: list[Config], corpus: Chunks, *rest) -> list[tuple[dict, float, str | None]]:
    """Of each configuration its measures, or its error: all in one action; if that fails, in halves down to the one at fault."""
    began = time.time()
    try:
        rows = {r.config_id: r.asDict() for r in evaluate_grid(configs, corpus, *rest).collect()}
        seconds = time.time() - began
        return [({k: v for k, v in rows[i].items() if k != "config_id"}, seconds, None) for i in range(len(configs))]
    except Exception as problem:  # noqa: BLE001 - recorded in the results
        if len(configs) == 1:
            return [({}, time.time() - began, (str(problem).splitlines() or [type(problem).__name__])[0][:500])]
        half = len(configs) // 2
        return _measured(configs[:half], corpus, *rest) + _measured(configs[half:], corpus, *rest)


def run_experiment(tracker: Tracker, configs: list[dict], docs: DataFrame | Chunks, queries: DataFrame, qrels: DataFrame | None = None, base: Config = Config(), synonyms: DataFrame | None = None, questions: DataFrame | None = None, together: bool = True) -> DataFrame:
    """All configurations in one action, or with ``together`` off one after the other, each with seconds of its own; one
    that fails is recorded with its error. docs: (doc_id, text), or their ``Chunks`` to share them between experiments."""
    corpus = docs if isinstance(docs, Chunks) else Chunks(docs, tracker.path + "-work")
    wanted = qrels if qrels is not None else metrics.pseudo_qrels(corpus.docs, queries)
    own: list[tuple[dict, Config]] = [(c, base.with_(**c)) for c in configs]
    for some in [own] if together else [[one] for one in own]:
        found = _measured([c for _, c in some], corpus, queries, wanted, synonyms, questions)
        for (changes, _), (measured, seconds, error) in zip(some, found, strict=True):
            tracker.log(changes, measured, seconds, error)
    return tracker.results()


def run_all(spark: SparkSession, path: str, docs: DataFrame, queries: DataFrame, names: Iterable[str] = tuple(GRIDS), synonyms: DataFrame | None = None, questions: DataFrame | None = None) -> DataFrame:
    """All experiments after each other, over chunks that are written once; the best configuration of one is the base of
    the next. questions (query_id, expected_answer) let the generation experiment score its answers."""
    base, frames, corpus = Config(), [], Chunks(docs, path + "-work")
    qrels = metrics.pseudo_qrels(docs, queries)
    for name in names:
        tracker = Tracker(spark, name, path)
        configs = GRIDS[name]()
        frames.append(run_experiment(tracker, configs, corpus, queries, qrels, base, synonyms, questions if name == "generation" else None))
        best = tracker.best("metric_correctness" if name == "generation" and questions is not None else "metric_mrr").select("seq").first()
        if best is not None:
            base = base.with_(**configs[best.seq])
    return analytics.union_runs(frames)


def evaluate_answers(config: Config, docs: DataFrame, questions: DataFrame) -> DataFrame:
    """Per question (query_id, text, expected_answer): the answer and its measures against the expected one."""
    out = Pipeline(config, docs).run(questions.select("query_id", "text"))
    rows = out.join(questions.select("query_id", "expected_answer"), "query_id")
    rows = rows.select(F.col("query_id").alias("id"), "answer", F.col("expected_answer").alias("expected"), F.array_join(F.transform("contexts", lambda c: c.text), " ").alias("context"))
    return metrics.answer_metrics(rows).join(rows.select("id", "answer"), "id")


def compare(frames: dict[str, DataFrame], measures: list[str]) -> DataFrame:
    """One row per configuration: means of the measures over its questions."""
    rows = [f.select(F.lit(name).alias("config"), *measures) for name, f in frames.items()]
    return analytics.group_mean(reduce(DataFrame.unionByName, rows), ["config"], measures)




def stage_seconds(config: Config, docs: DataFrame, queries: DataFrame) -> dict[str, float]:
    """Measured seconds of chunking, ranking and answering, each of the whole batch."""
    def seconds(frame: DataFrame) -> float:
        began = time.time()
        frame.write.format("noop").mode("overwrite").save()
        return time.time() - began

    pipeline = Pipeline(config, docs)
    chunking = seconds(pipeline.chunks)
    ranking = seconds(pipeline.rank(queries))
    return {"chunking": chunking, "ranking": ranking, "answering": max(0.0, seconds(pipeline.run(queries)) - ranking)}


def report(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From evaluation runs (config_name, config struct, question_results array of structs, aggregate_metrics struct): a
    row per configuration, and a row per question without the array columns."""
    summary = runs.select("config_name", "aggregate_metrics.*")
    rows = runs.select("config_name", F.inline("question_results"))
    return summary, rows.drop(*[f.name for f in rows.schema.fields if isinstance(f.dataType, ty.ArrayType)])


def labs(docs: DataFrame | Chunks, queries: DataFrame, chunkings: list[dict], retrievals: list[dict], rerankings: list[dict], work: str) -> DataFrame:
    """Every combination of the three lists, all queries each, in one plan: (config, query_id, doc_id, rank)."""
    corpus = docs if isinstance(docs, Chunks) else Chunks(docs, work)
    changes = [a | b | c for a, b, c in itertools.product(chunkings, retrievals, rerankings)]
    found = Grid([Config().with_(**c) for c in changes], corpus, queries).ranking()
    names = corpus.docs.sparkSession.createDataFrame(list(enumerate(map(str, changes))), "config_id int, config string")
    return found.join(F.broadcast(names), "config_id").select("config", "query_id", F.col("source_id").alias("doc_id"), "rank")
