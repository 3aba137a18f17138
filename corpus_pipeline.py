"""A corpus pipeline of five stages over the documents table. Each stage gets what its predecessor kept.

Defined results, for every stage: a null text counts as empty, and an empty text is in no language, so it goes in the
first stage; rows with a null id are judged by their text like any other, but never learned from and never dropped as
a copy; repeated rows are judged alike, and one of them stays after ``near_duplicates``; texts of any length are read
whole; an empty table of documents gives an empty table, an empty benchmark drops nothing; columns of any further name
come along up to the last stage, which gives the columns of ``packing.pack``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontaminate, langid, neardup, packing, quality
from quillon.llm.common import crc_mod, materialize, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, as does every one if no language could be learned; a low score drops nothing."""
    return langid.keep_known(docs, langid.fit(docs, crc_mod("doc_id", 3) == 1))


def repetition(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Short and repetitive documents go."""
    return quality.keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of the documents linked by five-word shingles with a similarity of 0.8 or more stays.

    SimHash finds the closest; what differs in more bits than pigeonring can search comes from least hashes."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark text go."""
    return decontaminate.keep_unseen(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest, tokenised and packed."""
    path, ranks = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken"))
    return packing.pack(docs, path, ranks, public_tokenizers.PATTERN)


STAGES = [("language", language), ("repetition", repetition), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", pack)]

#: The stages learn models and hash in ways that SQL cannot express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
