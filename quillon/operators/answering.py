"""Answers from ranked contexts (query_id, rank, query, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon import providers
from quillon.functions import scores as S
from quillon.functions import text as T

#: What is said where no sentence matches.
NO_ANSWER = "I couldn't find a specific answer to your question in the available knowledge base."

#: Prompts of the generation experiment.
TEMPLATES = {
    "plain": "Context:\n{context}\n\nQuestion: {query}\n\nAnswer:",
    "basic": "Context: {context}\n\nQuestion: {query}\n\nAnswer:",
    "instructional": "System: You are a helpful assistant... Use ONLY the following context... If the context doesn't contain the answer, say you don't know.\n\nContext: {context}\n\nUser: {query}",
    "extractive": "System: You must extract the answer... Quote the relevant parts...\n\nContext: {context}\n\nQuestion: {query}\n\nAnswer:",
    "citation": "System: You are a helpful assistant... Include citations...\n\nContext: {context}\n\nQuestion: {query}\n\nAnswer with citations:",
}


def sentences(contexts: DataFrame) -> DataFrame:
    """(query_id, place, sentence, score): sentences that share words with the query, best first.

    Score: shared words / (1 + .1 * difference of the two word sets' sizes). Ties keep the contexts' order.
    """
    rows = contexts.select("query_id", "rank", T.word_set(F.col("query")).alias("q"), F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    own = T.word_set(F.col("sentence"))
    scored = rows.withColumn("both", F.size(F.array_intersect(own, "q"))).where("both > 0")
    scored = scored.withColumn("score", F.round(F.col("both") / (1 + 0.1 * F.abs(F.size(own) - F.size("q"))), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", "pos")
    return scored.withColumn("place", F.row_number().over(order).cast("long")).select("query_id", "place", "sentence", "score")


def extractive(contexts: DataFrame) -> DataFrame:
    """(query_id, answer): short best sentences joined, or the best and a second that differs enough."""
    best = sentences(contexts).where("place <= 3").groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "sentence"))), lambda s: s.sentence).alias("s"))
    short = F.forall("s", lambda x: F.size(T.words(x)) < 10)
    second = (F.size("s") > 1) & (S.jaccard(F.get("s", F.lit(0)), F.get("s", F.lit(1))) < 0.7)
    answer = F.when(short, F.array_join("s", " ")).when(second, F.concat(F.get("s", F.lit(0)), F.lit(" "), F.get("s", F.lit(1)))).otherwise(F.get("s", F.lit(0)))
    return contexts.select("query_id").distinct().join(best.select("query_id", answer.alias("answer")), "query_id", "left").select("query_id", F.coalesce("answer", F.lit(NO_ANSWER)).alias("answer"))


def contexts_of(ranking: DataFrame, docs: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, contexts): the texts of the best k, in order, with their ids and scores."""
    rows = ranking.where(F.col("rank") <= k).join(docs.select("doc_id", "text"), "doc_id")
    return rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "score", "text"))).alias("contexts"))


def prompt(contexts: DataFrame, template: str = "plain") -> DataFrame:
    """(query_id, prompt) from rows (query_id, rank, query, text). template: a name, or a text of its own."""
    template = TEMPLATES.get(template, template)
    rows = contexts.groupBy("query_id", "query").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda s: s.text).alias("t"))
    filled = F.replace(F.replace(F.lit(template), F.lit("{context}"), F.array_join("t", "\n\n")), F.lit("{query}"), F.col("query"))
    return rows.select("query_id", filled.alias("prompt"))


def generated(contexts: DataFrame, model: str = "echo", **how) -> DataFrame:
    """A language model's answers; where it gives none, the extractive ones."""
    asked = prompt(contexts, **how).select("query_id", F.nullif(providers.generate(F.col("prompt"), model), F.lit("")).alias("said"))
    return extractive(contexts).join(asked, "query_id", "left").select("query_id", F.coalesce("said", "answer").alias("answer"))


def compare(answers: DataFrame) -> DataFrame:
    """From (id, answer, other): word counts and their difference in percent of the larger."""
    a, b = F.size(T.words(F.col("answer"))).cast("long"), F.size(T.words(F.col("other"))).cast("long")
    return answers.select("id", a.alias("words"), b.alias("other_words"), F.round(100.0 * F.abs(a - b) / F.nullif(F.greatest(a, b), F.lit(0)), 6).alias("difference_percent"))
