"""The question-answering pipeline as one lazy plan over a batch of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon import providers
from quillon.operators import answering, chunking, expansion, index, ranker, reranking, retrieval
from quillon.plans.config import Config


#: Numbers that a document's chunks may have.
PLACES = 1 << 21


def chunked(config: Config, docs: DataFrame) -> DataFrame:
    """(doc_id, source_id, chunk_id, text): the rankers work on one integer id per chunk. It follows the document's id and
    the chunk's place, so ties go to what comes first; where these are no such numbers, it is a hash."""
    how = {"size": config.chunk_size, "overlap": config.chunk_overlap} if config.chunking_strategy in config.SIZED else {}
    chunks = chunking.validate(chunking.chunk(docs, config.chunking_strategy, **how), config.chunking_strategy, config.chunk_size, config.chunk_overlap)
    number, place = F.col("doc_id").try_cast("long"), F.col("chunk_index").cast("long")
    fits = (F.abs(number) < 1 << 41) & place.between(0, PLACES - 1)
    id = F.when(fits, number * PLACES + place).otherwise(F.xxhash64("chunk_id"))
    return chunks.select(id.alias("doc_id"), F.col("doc_id").alias("source_id"), "chunk_id", "text")


def variants_of(config: Config, queries: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """(query_id, variant, variant_text). Expansion puts synonyms in, where a table of them is given, else templates."""
    c = config
    if c.query_transformation not in ("none", "hyde"):
        how = {"multi_query": {"n": c.num_variations}, "model": {"model": c.language_model}}.get(c.query_transformation, {})
        if c.query_transformation == "expansion" and synonyms is not None:
            how = {"table": synonyms}
        return expansion.transform(queries, c.query_transformation, **how)
    if not c.use_query_expansion:
        return expansion.transform(queries)
    return expansion.templates(queries) if synonyms is None else expansion.synonyms(queries, synonyms)


def embedded(rows: DataFrame, id: str, model: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, the columns to keep, embedding)."""
    if model == "hash":
        return index.dense_vectors(rows, id, keep=keep)
    return rows.select(id, *keep, providers.embed(F.col("text"), model).alias("embedding"))


def asked_vectors(config: Config, queries: DataFrame) -> DataFrame:
    """The queries' vectors: their own, or with HyDE the mean of their hypothetical documents, blended with the query's
    own where the method says so."""
    c = config
    own = embedded(queries, "query_id", c.embedding_model)
    if not c.hyde():
        return own
    made = expansion.hyde_documents(queries, c.hyde_num_docs, c.language_model, c.hyde_prompts == "typed").withColumn("id", F.xxhash64("query_id", "pos"))
    mean = expansion.mean_vector(embedded(made, "id", c.embedding_model).join(made.select("id", "query_id"), "id").select("query_id", "embedding"))
    return expansion.blend_vectors(own, mean, c.hyde_weight) if c.hyde_method == "hybrid" else mean


def rerank(config: Config, candidates: DataFrame, found: DataFrame, lexical: Callable[[], DataFrame], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(query_id, doc_id, score, rank) by the configured reranker, cut to the wanted number. candidates: found rankings
    with text and query; lexical: gives the plain query's BM25 ranking to be fused; keep: holds rows that are used twice."""
    c, k = config, config.retrieval_top_k
    if c.reranking_method == "diversity":
        return reranking.mmr_words(candidates, c.diversity_alpha, k).withColumnRenamed("place", "rank")
    if c.reranking_method == "multi_stage":
        return reranking.multi_stage(candidates, found, c.reranking_stages, k, c.reranking_mode, keep)
    if c.reranking_method == "keyword":
        return reranking.keywords(candidates, k)
    if c.reranking_method == "trained":
        return ranker.rerank(candidates, c.ranker_weights, k)
    if c.reranking_method == "llm":
        return reranking.model_rating(candidates, c.language_model, k)
    if c.reranking_method == "fusion":
        return reranking.fuse([found, lexical()], k)
    if c.reranking_method == "cross_encoder_fusion":
        return reranking.fuse([found, reranking.cross_encoder(candidates, c.scorer)], k)
    if c.reranking_method in ("cross_encoder", "contextual"):
        return reranking.cross_encoder(candidates, c.scorer, k)
    return found.where(F.col("rank") <= k)


class Pipeline:
    """Chunks a corpus (doc_id, text) once; answers queries (query_id, text), optionally with their history.

    Variants, retrieval, fusion, reranking and answers compose as DataFrames; an action runs them.
    """

    def __init__(self, config: Config, docs: DataFrame, synonyms: DataFrame | None = None):
        self.config, self.docs, self.synonyms, self._kept = config, docs, synonyms, []
        self.chunks = self._stored(chunked(config, docs))

    def _stored(self, rows: DataFrame) -> DataFrame:
        """Kept on the executors' disks and memory for the uses to come; lost parts are computed again."""
        self._kept.append(rows.persist(StorageLevel.MEMORY_AND_DISK))
        return rows

    def close(self) -> None:
        """Gives up what the executors keep for this pipeline."""
        for rows in self._kept:
            rows.unpersist()
        self._kept.clear()

    def __enter__(self) -> Pipeline:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def variants(self, queries: DataFrame) -> DataFrame:
        return variants_of(self.config, queries, self.synonyms)

    def _vector(self, queries: DataFrame, k: int) -> DataFrame:
        c = self.config
        chunks = embedded(self.chunks, "doc_id", c.embedding_model)
        if not c.use_mmr:
            return retrieval.vector_topk(chunks, asked_vectors(c, queries), k)
        fetch = max(c.FETCH, 2 * k)
        found = retrieval.vector_topk(chunks, asked_vectors(c, queries), fetch)
        return reranking.mmr_vectors(found, chunks, c.diversity_alpha, k, fetch).withColumnRenamed("place", "rank")

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        c = self.config
        variants = self.variants(queries).withColumn("id", F.xxhash64("query_id", "variant"))
        asked = variants.select(F.col("id").alias("query_id"), F.col("variant_text").alias("text"))
        vector = self._vector(asked, 2 * k) if c.retrieval_method != "bm25" else None
        lexical = retrieval.bm25(self.chunks, asked, 2 * k, c.bm25_k1, c.bm25_b) if c.retrieval_method != "vector" else None
        ranked = retrieval.retrieve(c.retrieval_method, vector, lexical, c.retrieval_alpha, k)
        named = ranked.withColumnRenamed("query_id", "id").join(variants.select("id", "query_id", "variant"), "id")
        merged = retrieval.merge_variants(named.select("query_id", "variant", "doc_id", "rank"), k)
        best = named.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
        return merged.join(best, ["query_id", "doc_id"]).select("query_id", "doc_id", "score", F.col("place").alias("rank"))

    def _with_history(self, queries: DataFrame, history: DataFrame) -> DataFrame:
        """Queries behind the last user turns of their conversation."""
        n = self.config.history_turns
        last = F.slice(F.sort_array(F.collect_list(F.struct("turn", "text")), asc=False), 1, n)
        earlier = history.where("role = 'user'").groupBy("query_id").agg(F.transform(F.reverse(last), lambda x: x.text).alias("h"))
        return queries.join(earlier, "query_id", "left").withColumn("text", F.concat_ws(" ", "h", "text")).drop("h")

    def rank(self, queries: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """(query_id, doc_id, score, rank) after reranking, cut to the wanted number."""
        c = self.config
        own = queries
        if c.conversational and history is not None:
            queries = self._with_history(queries, history)
        if not c.use_reranking:
            return self.retrieve(queries, c.retrieval_top_k)
        found = self._stored(self.retrieve(queries, c.depth()))
        texts = retrieval.few_rows(found, queries, c.depth()).join(self.chunks.select("doc_id", "text"), "doc_id")
        asked = queries.select("query_id", F.col("text").alias("query"))
        if c.reranking_method == "contextual" and history is not None:
            asked = self._with_history(own, history).select("query_id", F.col("text").alias("query"))
        lexical = lambda: retrieval.bm25(self.chunks, queries, c.depth(), c.bm25_k1, c.bm25_b)
        return rerank(c, texts.join(asked, "query_id"), found, lexical, self._stored).select("query_id", "doc_id", "score", "rank")

    def run(self, queries: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """(query_id, query, contexts, answer); contexts keep their chunk and document ids. In a conversation the earlier
        turns (query_id, turn, role, text) are searched with the query; the answer is to the query alone."""
        ranked = self.rank(queries, history)
        rows = retrieval.few_rows(ranked, queries, self.config.retrieval_top_k).join(self.chunks, "doc_id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
        answers = answering.extractive(rows) if self.config.answer_mode == "extractive" else answering.generated(rows, self.config.language_model, template=self.config.prompt_template)
        contexts = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "source_id", "chunk_id", "score", "text"))).alias("contexts"))
        out = queries.select("query_id", F.col("text").alias("query")).join(contexts, "query_id", "left").join(answers, "query_id", "left")
        return out.select("query_id", "query", F.coalesce("contexts", F.array().cast("array<struct<rank:bigint,source_id:bigint,chunk_id:string,score:double,text:string>>")).alias("contexts"), F.coalesce("answer", F.lit(answering.NO_ANSWER)).alias("answer"))
