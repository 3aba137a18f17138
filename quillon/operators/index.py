"""Lexical and vector indexes as plain tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon import providers
from quillon.functions import text as T
from quillon.functions.vectors import unit


def postings(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, term, tf)."""
    terms = docs.select(id, F.explode(T.tokens(F.col(text))).alias("term"))
    return terms.groupBy(id, "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, dl): tokens per document, documents without any included."""
    return docs.select(id, F.coalesce(F.size(T.tokens(F.col(text))), F.lit(0)).cast("long").alias("dl"))


def corpus_stats(docs: DataFrame, id: str = "doc_id") -> DataFrame:
    """One row: n_docs, n_tokens, avgdl, n_terms."""
    size = lengths(docs, id).agg(F.count("*").alias("n_docs"), F.sum("dl").alias("n_tokens"), F.avg("dl").alias("avgdl"))
    terms = docs.select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).agg(F.count_distinct("term").alias("n_terms"))
    return size.crossJoin(F.broadcast(terms))


def document_frequency(docs: DataFrame) -> DataFrame:
    """(term, df), without a posting per occurrence: each text's distinct terms are counted."""
    return docs.select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _counted(docs: DataFrame, by: list[str]) -> DataFrame:
    """(by, term, df), and in the row without a term how many documents and tokens there are: one pass over the texts."""
    own = docs.select(*by, T.tokens(F.col("text")).alias("t"))
    none = F.struct(F.lit(None).cast("string").alias("term"), F.coalesce(F.greatest(F.size("t"), F.lit(0)), F.lit(0)).cast("long").alias("n"))
    terms = F.transform(F.coalesce(F.array_distinct("t"), F.array().cast("array<string>")), lambda x: F.struct(x.alias("term"), F.lit(0).cast("long").alias("n")))
    return own.select(*by, F.inline(F.concat(F.array(none), terms))).groupBy(*by, "term").agg(F.count("*").alias("df"), F.sum("n").alias("n"))


def idf(docs: DataFrame, epsilon: float = 0.25, sizes: bool = False, by: str | None = None) -> DataFrame:
    """(term, df, idf): ln(N - df + .5) - ln(df + .5); a negative one becomes epsilon times the mean over all terms.

    ``sizes`` adds avgdl, the documents' mean number of tokens. ``by`` names a column whose few values are corpora of
    their own.
    """
    own = [by] if by else []
    beside = lambda rows, one: rows.join(F.broadcast(one), own) if by else rows.crossJoin(F.broadcast(one))
    counted = _counted(docs, own)
    size = counted.where("term is null").select(*own, F.col("df").alias("n_docs"), (F.col("n") / F.col("df")).alias("avgdl"))
    raw = beside(counted.where("term is not null"), size).select(*own, "term", "df", "avgdl", (F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.groupBy(*own).agg(F.avg("raw").alias("mean"))
    out = beside(raw, mean).select(*own, "term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"), "avgdl")
    return out if sizes else out.drop("avgdl")


def weights_of(docs: DataFrame, wanted: pd.DataFrame, epsilon: float = 0.25, by: str | None = None) -> dict[int, tuple[dict[str, float], float]]:
    """``idf`` of wanted terms (part, term), on the driver: of each part its terms' weights and its mean length, from one
    pass over the texts. Other terms come as numbers of terms of equal df. ``by``: the column that is the part."""
    part = F.col(by).cast("long") if by else F.lit(0).cast("long")
    return weights_from(_counted(docs, [by] if by else []).select(part.alias("part"), "term", "df", "n"), wanted, epsilon)


def weights_from(counted: DataFrame, wanted: pd.DataFrame, epsilon: float = 0.25) -> dict[int, tuple[dict[str, float], float]]:
    """``weights_of`` from counts (part, term, df, n): df texts have the term, and without a term there are df texts of n tokens."""
    named = counted.sparkSession.createDataFrame(wanted.assign(wanted=True), "part long, term string, wanted boolean")
    counted = counted.join(F.broadcast(named), ["part", "term"], "left")
    kind = F.when(F.col("term").isNull(), 0).when(F.col("wanted"), 1).otherwise(2)
    rows = counted.groupBy("part", "df", kind.alias("kind"), F.when(F.col("wanted"), F.col("term")).alias("name")).agg(F.count("*").alias("terms"), F.sum("n").alias("n")).toPandas()
    out = {}
    for part, mine in rows.groupby("part"):
        size, terms = mine[mine["kind"] == 0].iloc[0], mine[mine["kind"] > 0]
        df = terms["df"].to_numpy(float)
        raw = np.log(float(size["df"]) - df + 0.5) - np.log(df + 0.5)
        mean = (raw * terms["terms"]).sum() / max(1, terms["terms"].sum())
        idf = np.where(raw < 0, epsilon * mean, raw)
        known = (terms["kind"] == 1).to_numpy()
        out[int(part)] = dict(zip(terms["name"][known], idf[known].tolist(), strict=True)), float(size["n"]) / float(size["df"])
    return out


def tfidf(docs: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, term, weight): tf * (ln((1 + N) / (1 + df)) + 1), each document at length one."""
    n = docs.agg(F.count("*").alias("n_docs"))
    weighted = postings(docs, id).join(document_frequency(docs), "term").crossJoin(F.broadcast(n))
    weighted = weighted.select(id, "term", (F.col("tf") * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = weighted.groupBy(id).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norm, id).select(id, "term", (F.col("w") / F.col("norm")).alias("weight"))


def hash_vectors(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, bucket, weight): the offline embedding, sparse, at length one."""
    return providers.hashed_terms(docs.select(id, F.explode(T.tokens(F.col(text))).alias("term")), [id])


#: Texts that are embedded together.
_TEXTS = 1024


def dense_vectors(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), cancel: bool = True) -> DataFrame:
    """(id, embedding): the offline embedding of each text, dense, by one pass over Arrow batches that passes the columns
    to ``keep`` on. cancel: see ``providers.hash_embed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _TEXTS):
                batch = whole.slice(at, _TEXTS)
                rows = providers.hash_embed(batch.column(batch.num_columns - 1).to_pylist(), cancel)
                ends = pa.array(range(0, rows.size + 1, providers.DIMENSIONS), pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))], [id, *keep, "embedding"])

    own = docs.select(F.col(id).cast("long").alias(id), *keep, F.col(text).cast("string").alias("_text"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own.schema.fields[1:-1])
    return own.mapInArrow(run, f"`{id}` long, {kept}embedding array<double>")


def build(chunks: DataFrame, model: str = "hash") -> DataFrame:
    """(chunk_id, text, embedding) of chunks, vectors at length one, also of texts whose signed counts cancel out: what
    ``writers.save_index`` stores."""
    if model == "hash":
        rows = chunks.select(F.lit(0).cast("long").alias("id"), "chunk_id", "text")
        return dense_vectors(rows, "id", keep=("chunk_id", "text"), cancel=False).select("chunk_id", "text", "embedding")
    return chunks.select("chunk_id", "text", unit(providers.embed(F.col("text"), model)).alias("embedding"))
