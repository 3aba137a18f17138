"""Many configurations as one plan: a column names the configuration, and what configurations share is done once.

Chunks are written once per chunking. Each distinct processing of the queries, each distinct vector search and each
distinct lexical search is one part of the plan; a small table says which configuration uses which. Rankings of all
configurations are fused, merged, reranked and measured together, by (config_id, query_id). Lexical searches and those by
the offline embedding share one reading of the chunks, those by another embedder take one each. What is found is few rows per query: searches, candidates, rankings and contexts are written once each, and
meet the chunks by broadcast where they are few, so chunks are not moved.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import answering, expansion, metrics, onepass, retrieval
from quillon.operators.retrieval import BROADCAST_QUERIES, small
from quillon.plans.config import Config
from quillon.plans.pipeline import asked_vectors, chunked, embedded, rerank, variants_of

_CHUNKS = "doc_id long, source_id long, chunk_id string, text string"


class Chunks:
    """A corpus' chunks, written below a shared folder once for each chunking that is asked for."""

    def __init__(self, docs: DataFrame, work: str):
        self.docs, self.folder, self.paths = docs, f"{work}/chunks-{uuid.uuid4().hex}", {}

    def of(self, config: Config) -> DataFrame:
        key = config.chunking()
        if key not in self.paths:
            path = f"{self.folder}/{len(self.paths)}"
            chunked(config, self.docs).selectExpr("doc_id", "cast(source_id as long) source_id", "chunk_id", "text").write.option("compression", "zstd").parquet(path)
            self.paths[key] = path
        return self.docs.sparkSession.read.schema(_CHUNKS).parquet(self.paths[key])

    def stored(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows written below the folder and read back, so plans that use them many times stay small."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _numbered(keys) -> dict:
    return {key: i for i, key in enumerate(dict.fromkeys(keys))}


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


class Grid:
    """Configurations over one corpus (a ``Chunks``) and one batch of queries (query_id, text).

    synonyms: the table of ``expansion.synonyms`` for configurations that expand queries. Conversations and MMR by
    vectors are for a ``Pipeline`` of their own.
    """

    def __init__(self, configs: list[Config], corpus: Chunks, queries: DataFrame, synonyms: DataFrame | None = None):
        if any(c.use_mmr or c.conversational for c in configs):
            raise ValueError("a grid does not hold conversations or retrieval by MMR")
        if unknown := {c.retrieval_method for c in configs} - {"vector", "bm25", "hybrid"}:
            raise ValueError(f"unknown retrieval method {unknown.pop()}")
        self.configs, self.corpus, self.synonyms = configs, corpus, synonyms
        self.spark = queries.sparkSession
        self.queries = queries.select("query_id", "text")
        self.chunkings = _numbered(c.chunking() for c in configs)
        own = {c.chunking(): c for c in configs}
        self.chunks = _union([corpus.of(own[key]).withColumn("c", F.lit(i)) for key, i in self.chunkings.items()])
        self._search()
        self._ranked = None

    # Searches that configurations share.

    def _search(self) -> None:
        configs = self.configs
        plain = ("none", False, 0, "")
        asks = _numbered([*(c.asking() for c in configs), plain])
        of = {c.asking(): c for c in configs}
        made = [variants_of(of[key], self.queries, self.synonyms) if key in of else expansion.transform(self.queries) for key in asks]
        said = _union([v.select(F.lit(i).alias("a"), "query_id", F.col("variant").cast("long").alias("variant"), "variant_text") for i, v in enumerate(made)])
        self.variants = said.withColumn("id", F.xxhash64("query_id", "variant"))
        vector = _numbered((c.chunking(), c.embedding_model, c.asking(), c.hyde()) for c in configs if c.retrieval_method != "bm25")
        fused = [c for c in configs if c.use_reranking and c.reranking_method == "fusion"]
        lexical = _numbered([*((c.chunking(), c.asking(), c.bm25_k1, c.bm25_b) for c in configs if c.retrieval_method != "vector"), *((c.chunking(), plain, c.bm25_k1, c.bm25_b) for c in fused)])
        deepest = max((2 * c.depth() for c in configs), default=1)
        number = lambda table, key: table.get(key, -1)
        rows = []
        for i, c in enumerate(configs):
            v = number(vector, (c.chunking(), c.embedding_model, c.asking(), c.hyde())) if c.retrieval_method != "bm25" else -1
            x = number(lexical, (c.chunking(), c.asking(), c.bm25_k1, c.bm25_b)) if c.retrieval_method != "vector" else -1
            own = number(lexical, (c.chunking(), plain, c.bm25_k1, c.bm25_b))
            rows.append((i, self.chunkings[c.chunking()], asks[c.asking()], v, x, own, asks[plain], c.retrieval_method, float(c.retrieval_alpha), c.depth(), c.retrieval_top_k))
        self.table = self.spark.createDataFrame(rows, "config_id int, c int, a int, v int, l int, own int, plain int, method string, alpha double, depth int, k int")
        asked, terms = self._vector_asked(vector, of, asks), self._lexical_asked(lexical, asks)
        deep = max(deepest, *(c.depth() for c in fused)) if fused else deepest
        read = self._read(asked, terms, deepest)
        self.vectors = self.corpus.stored(self._vector_search(asked, read, deepest), "vectors") if vector else None
        self.lexical = self.corpus.stored(self._lexical_search(terms, read, deep), "lexical") if lexical else None

    def _vector_asked(self, specs: dict, of: dict, asks: dict) -> dict[str, DataFrame]:
        """By embedder (c, query_id, embedding): query_id is the hash of a search's number and a variant's id."""
        found = {}
        for (chunk, model, ask, hyde), i in specs.items():
            config = next(c for c in self.configs if (c.chunking(), c.embedding_model, c.asking(), c.hyde()) == (chunk, model, ask, hyde))
            texts = self.variants.where(F.col("a") == asks[ask]).select(F.col("id").alias("query_id"), F.col("variant_text").alias("text"))
            found.setdefault(model, []).append(asked_vectors(config, texts).select(F.lit(self.chunkings[chunk]).alias("c"), F.xxhash64(F.lit(i), "query_id").alias("query_id"), "embedding"))
        return {model: _union(own) for model, own in found.items()}

    def _lexical_asked(self, specs: dict, asks: dict) -> dict[tuple, DataFrame]:
        """By k1 and b (c, query_id, text)."""
        found = {}
        for k1, b in dict.fromkeys(key[2:] for key in specs):
            rows = [(i, self.chunkings[chunk], asks[ask]) for (chunk, ask, *rest), i in specs.items() if tuple(rest) == (k1, b)]
            wanted = F.broadcast(self.spark.createDataFrame(rows, "l int, c int, a int"))
            found[k1, b] = self.variants.join(wanted, "a").select(F.xxhash64("l", "id").alias("query_id"), "c", F.col("variant_text").alias("text"))
        return found

    def _read(self, asked: dict[str, DataFrame], terms: dict[tuple, DataFrame], k: int) -> tuple:
        """What one reading of the chunks gives to the searches whose queries are few: the stored rows, whether they hold
        the hits of the offline embedding, the asked terms by k1 and b, and their names."""
        own = retrieval.few_vectors(asked["hash"].select(F.col("c").alias("part"), "query_id", "embedding").where("embedding is not null")) if "hash" in asked else None
        few = {key: retrieval.asked_terms(rows, ["c"]).limit(BROADCAST_QUERIES + 1).toPandas() for key, rows in terms.items()}
        few = {key: rows for key, rows in few.items() if len(rows) <= BROADCAST_QUERIES}
        names = sorted({name for rows in few.values() for name in rows["term"]})
        parts = {int(c) for rows in few.values() for c in rows["c"]}
        if not own and not parts:
            return None, own is not None, few, names
        texts = self.chunks.where(F.col("c").isin(sorted({*parts, *(own or ())})))
        return self.corpus.stored(onepass.read(texts, "c", own or {}, names, parts, k), "read"), own is not None, few, names

    def _vector_search(self, asked: dict[str, DataFrame], read: tuple, k: int) -> DataFrame:
        """(query_id, doc_id, score, rank)."""
        rows, held, *_ = read
        found = []
        for model, queries in asked.items():
            if model == "hash" and held and rows is not None:
                found.append(onepass.vector_topk(rows, k))
                continue
            numbers = sorted({self.chunkings[c.chunking()] for c in self.configs if c.embedding_model == model and c.retrieval_method != "bm25"})
            vectors = embedded(self.chunks.where(F.col("c").isin(numbers)), "doc_id", model, keep=("c",))
            found.append(retrieval.vector_topk(vectors, queries, k, by="c"))
        return _union(found)

    def _lexical_search(self, asked: dict[tuple, DataFrame], read: tuple, k: int) -> DataFrame:
        rows, _, few, names = read
        found = []
        for (k1, b), queries in asked.items():
            if (k1, b) in few and rows is not None:
                found.append(onepass.bm25(rows, few[k1, b], "c", names, k, k1, b))
            else:
                found.append(retrieval.bm25(self.chunks.select("c", "doc_id", "text"), queries, k, k1, b, by="c"))
        return _union([f.select("query_id", "doc_id", "score", "rank") for f in found])

    # All configurations together.

    def _named(self) -> DataFrame:
        """One row per configuration, query and variant, with the numbers under which its searches know it."""
        rows = self.variants.join(F.broadcast(self.table), "a")
        return small(rows.select("config_id", "query_id", "variant", "depth", "method", F.xxhash64("config_id", "query_id").alias("at"), F.xxhash64("config_id", "id").alias("one"), F.xxhash64("v", "id").alias("vq"), F.xxhash64("l", "id").alias("lq")))

    def _merged(self) -> DataFrame:
        """(query_id, doc_id, score, rank) before reranking; query_id stands for configuration and query."""
        named, parts = self._named(), []
        ranked = lambda found, id, method: found.withColumnRenamed("query_id", id).join(named.where(F.col("method").isin(*method)).select(id, "one", "config_id", "depth"), id).select(F.col("one").alias("query_id"), "config_id", "depth", "doc_id", "score", "rank")
        plain = ["query_id", "doc_id", "score", "rank"]
        if self.vectors is not None:
            parts.append(ranked(self.vectors, "vq", ("vector",)).where(F.col("rank") <= F.col("depth")).select(*plain))
        if self.lexical is not None:
            parts.append(ranked(self.lexical, "lq", ("bm25",)).where(F.col("rank") <= F.col("depth")).select(*plain))
        both = {}
        for i, c in enumerate(self.configs):
            if c.retrieval_method == "hybrid":
                both.setdefault((c.retrieval_alpha, c.depth()), []).append(i)
        if both:
            v, x = ranked(self.vectors, "vq", ("hybrid",)), ranked(self.lexical, "lq", ("hybrid",))
            for (alpha, depth), own in both.items():
                mine = F.col("config_id").isin(own)
                parts.append(retrieval.hybrid(v.where(mine), x.where(mine), float(alpha), depth).select(*plain))
        rows = _union(parts).withColumnRenamed("query_id", "one").join(named.select("one", F.col("at").alias("query_id"), "variant", "depth"), "one")
        best = rows.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.first("depth").alias("depth"))
        merged = retrieval.merge_variants(rows.select("query_id", "variant", "doc_id", "rank"), max(c.depth() for c in self.configs))
        out = merged.join(best, ["query_id", "doc_id"]).where(F.col("place") <= F.col("depth"))
        return out.select("query_id", "doc_id", "score", F.col("place").alias("rank"))

    def ranking(self) -> DataFrame:
        """(config_id, query_id, doc_id, source_id, score, rank) of every configuration, after its reranking."""
        if self._ranked is not None:
            return self._ranked
        found = self._merged()
        groups = _numbered(c.reranked() for c in self.configs)
        group = self.spark.createDataFrame([(i, groups[c.reranked()]) for i, c in enumerate(self.configs)], "config_id int, g int")
        pairs = self.queries.crossJoin(F.broadcast(self.table.join(group, "config_id")))
        pairs = small(pairs.select(F.xxhash64("config_id", "query_id").alias("at"), "config_id", F.col("query_id").alias("asked"), F.col("text").alias("query"), "c", "g", "k", F.xxhash64("own", F.xxhash64("query_id", F.lit(0).cast("long"))).alias("lq")))
        asked = pairs.withColumnRenamed("at", "query_id")
        found = self.corpus.stored(found, "found")
        few = F.broadcast if found.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES else lambda df: df
        texts = few(found.join(asked.where(F.col("g").isin([g for key, g in groups.items() if key])).select("query_id", "query", "c", "g"), "query_id")).join(self.chunks.select("c", "doc_id", "text"), ["c", "doc_id"])
        texts = self.corpus.stored(texts, "candidates") if any(c.use_reranking for c in self.configs) else texts
        out = []
        for key, g in groups.items():
            config = next(c for c in self.configs if c.reranked() == key)
            own = texts.where(F.col("g") == g).select("query_id", "doc_id", "score", "rank", "text", "query")
            if not config.use_reranking:
                own = found.join(asked.where(F.col("g") == g).select("query_id", "k"), "query_id").where(F.col("rank") <= F.col("k"))
                out.append(own.select("query_id", "doc_id", "score", "rank"))
                continue
            lexical = None
            if config.reranking_method == "fusion":
                lexical = self.lexical.withColumnRenamed("query_id", "lq").join(asked.where(F.col("g") == g).select("lq", "query_id"), "lq").where(F.col("rank") <= config.depth()).select("query_id", "doc_id", "score", "rank")
            ranked = own.select("query_id", "doc_id", "score", "rank")
            out.append(rerank(config, own, ranked, lambda lexical=lexical: lexical, keep=lambda rows: rows).select("query_id", "doc_id", "score", "rank"))
        named = _union(out).join(asked.select("query_id", "config_id", "asked", "c"), "query_id")
        rows = few(named).join(self.chunks.select("c", "doc_id", "source_id"), ["c", "doc_id"])
        rows = rows.select("config_id", F.col("asked").alias("query_id"), "doc_id", "source_id", "score", "rank")
        self._ranked = self.corpus.stored(rows, "ranking")
        return self._ranked

    def metrics(self, qrels: DataFrame) -> DataFrame:
        """(config_id, query_id, p_at_k, r_at_k, mrr) on documents: a chunk counts for its document."""
        first = self.ranking().groupBy("config_id", "query_id", F.col("source_id").alias("doc_id")).agg(F.min("rank").alias("rank"))
        every = self.queries.select("query_id").crossJoin(F.broadcast(self.table.select("config_id")))
        return metrics.ranking_metrics(first, qrels, every, by=("config_id",), store=lambda rows: self.corpus.stored(rows, "judged"))

    def means(self, qrels: DataFrame, measures: list[str]) -> DataFrame:
        """One row per configuration: the means over all queries."""
        rows = self.metrics(qrels).groupBy("config_id").agg(*[F.round(F.avg(m), 6).alias(m) for m in measures])
        return self.table.select("config_id").join(rows, "config_id", "left")

    def answers(self, expected: DataFrame) -> DataFrame:
        """(config_id, query_id, answer and its measures): answers of every configuration against (query_id, expected_answer)."""
        kinds = _numbered((c.answer_mode, c.prompt_template, c.language_model) for c in self.configs)
        rows = small(self.ranking().join(F.broadcast(self.table.select("config_id", "c")), "config_id")).join(self.chunks.select("c", "doc_id", "text"), ["c", "doc_id"]).join(small(self.queries.withColumnRenamed("text", "query")), "query_id")
        rows = self.corpus.stored(rows.select("config_id", F.xxhash64("config_id", "query_id").alias("query_id"), "rank", "query", "text"), "contexts")
        said = []
        for (mode, template, model), _ in kinds.items():
            own = rows.where(F.col("config_id").isin([i for i, c in enumerate(self.configs) if (c.answer_mode, c.prompt_template, c.language_model) == (mode, template, model)]))
            said.append(answering.extractive(own) if mode == "extractive" else answering.generated(own, model, template=template))
        context = rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda s: s.text), " ").alias("context"))
        every = expected.select(F.col("query_id").alias("asked"), "expected_answer").crossJoin(F.broadcast(self.table.select("config_id"))).withColumn("query_id", F.xxhash64("config_id", "asked"))
        full = every.join(_union(said), "query_id", "left").join(context, "query_id", "left")
        full = full.select(F.col("query_id").alias("id"), "config_id", F.col("asked").alias("query_id"), F.coalesce("answer", F.lit(answering.NO_ANSWER)).alias("answer"), F.col("expected_answer").alias("expected"), F.coalesce("context", F.lit("")).alias("context"))
        scored = metrics.answer_metrics(full.select("id", "answer", "expected", "context"))
        return full.select("id", "config_id", "query_id", "answer").join(scored, "id").drop("id")
