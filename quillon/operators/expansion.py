"""Query processing: variants of a query, hypothetical documents, and their vectors. All on (query_id, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon import providers
from quillon.functions import text as T
from quillon.functions.scores import query_type
from quillon.functions.vectors import blend, unit

#: What a hypothetical document is asked to be, by query type.
PROMPTS = {
    "definition": "Write a clear, concise definition that would be a perfect answer to the question: '%s'\nThe definition should include key characteristics and examples where appropriate.\nKeep your answer focused and authoritative, like an encyclopedia entry.",
    "factual": "Write a factual, precise response to the question: '%s'\nInclude specific details, dates, numbers, or names that would be found in an authoritative reference.\nThe response should be objective and well-supported.",
    "procedural": "Write a step-by-step guide that addresses: '%s'\nInclude clear instructions, important considerations, and potential challenges.\nStructure the content as an expert how-to guide.",
    "comparative": "Write a balanced comparison addressing: '%s'\nInclude key similarities and differences, with specific criteria for comparison.\nPresent the information in a structured, objective manner.",
    "causal": "Write an explanatory response that addresses the causes and effects related to: '%s'\nInclude key factors, mechanisms, and supporting evidence.\nThe explanation should be logical and connect causes to their effects.",
    "exploratory": "Write a comprehensive yet concise overview that addresses: '%s'\nInclude key facts, concepts, and relevant context.\nThe content should be informative and well-structured, like an educational resource.",
}
#: Further angles of a hypothetical document, after the plain one.
ANGLES = ("", " from a technical perspective", " with practical examples", " with historical context")


def _variants(queries: DataFrame, texts: Column) -> DataFrame:
    out = queries.select("query_id", F.posexplode(F.array_compact(texts)).alias("variant", "variant_text"))
    return out.select("query_id", F.col("variant").cast("long").alias("variant"), "variant_text")


def templates(queries: DataFrame) -> DataFrame:
    q = F.col("text")
    return _variants(queries, F.array(q, F.concat(F.lit("information about "), q), F.concat(F.lit("explain "), q)))


def rules(queries: DataFrame, n: int = 3) -> DataFrame:
    """The query and the first n - 1 rephrasings that it does not already have."""
    q, low = F.col("text"), F.lower("text")
    made = F.array_compact(
        F.array(
            F.when(~low.startswith("please"), F.concat(F.lit("Please "), q)),
            F.when(~low.startswith("what"), F.concat(F.lit("What about "), q)),
            F.when(~low.startswith("i want to know"), F.concat(F.lit("I want to know "), q)),
            F.when(~low.startswith("how"), F.concat(F.lit("How does "), q, F.lit(" work"))),
            F.when(~low.contains("explain"), F.concat(F.lit("Explain "), q)),
        )
    )
    return _variants(queries, F.concat(F.array(q), F.slice(made, 1, max(0, n - 1))))


def synonyms(queries: DataFrame, table: DataFrame, per_term: int = 2) -> DataFrame:
    """The query, then one variant per substitution of a token of over three letters by one of its first synonyms.

    table: (term, synonym, rank). Synonyms equal to the token or with an underscore are passed over.
    """
    own = queries.select("query_id", T.tokens(F.col("text")).alias("t"))
    spots = own.select("query_id", "t", F.posexplode("t").alias("pos", "term")).where(F.length("term") > 3)
    usable = table.where(F.col("rank") <= per_term).where(~F.contains("synonym", F.lit("_"))).where("synonym <> term")
    put = spots.join(usable, "term")
    text = F.array_join(F.transform("t", lambda w, i: F.when(i == F.col("pos"), F.col("synonym")).otherwise(w)), " ")
    made = put.select("query_id", (F.col("pos") * 100 + F.col("rank")).cast("long").alias("variant"), text.alias("variant_text"))
    return queries.select("query_id", F.lit(0).cast("long").alias("variant"), F.col("text").alias("variant_text")).unionByName(made)


def parse_lines(queries: DataFrame, reply: Column) -> DataFrame:
    """The query, then a variant per line of a model's reply without numbering or quotes; two templates if it has none."""
    own = F.filter(F.split(reply, "\n"), lambda x: (x != "") & ~x.startswith("Generate"))
    lines = F.filter(F.transform(own, lambda x: F.btrim(x, F.lit("0123456789. \"'"))), lambda x: x != "")
    q = F.col("text")
    plain = F.array(F.concat(F.lit("Information about "), q), F.concat(F.lit("Tell me about "), q))
    return _variants(queries, F.concat(F.array(q), F.when(F.size(lines) > 0, lines).otherwise(plain)))


def asked_of_model(queries: DataFrame, model: str = "echo") -> DataFrame:
    """``parse_lines`` of a language model's reply."""
    prompt = F.concat(F.lit("Say this question in three other ways, one a line: "), F.col("text"))
    return parse_lines(queries.withColumn("reply", providers.generate(prompt, model)), F.col("reply"))


def hyde_prompt(queries: DataFrame) -> DataFrame:
    """(query_id, query_type, prompt)."""
    kind = query_type(F.col("text"))
    prompt = F.lit(None).cast("string")
    for name, text in PROMPTS.items():
        before, after = text.split("%s")
        prompt = F.when(kind == name, F.concat(F.lit(before), F.col("text"), F.lit(after))).otherwise(prompt)
    return queries.select("query_id", kind.alias("query_type"), prompt.alias("prompt"))


def hyde_documents(queries: DataFrame, n: int = 1, model: str = "echo", typed: bool = True) -> DataFrame:
    """(query_id, pos, text): n (up to four) hypothetical documents per query from a language model, asked for by the
    query's type or in the same words for all."""
    same = queries.select("query_id", F.concat(F.lit("Write a passage that answers the question: "), "text").alias("prompt"))
    asked = (hyde_prompt(queries) if typed else same).select("query_id", F.posexplode(F.array(*map(F.lit, ANGLES[: max(1, min(n, 4))]))).alias("pos", "angle"), "prompt")
    return asked.select("query_id", "pos", providers.generate(F.concat("prompt", "angle"), model).alias("text"))


def mean_vector(vectors: DataFrame) -> DataFrame:
    """The mean of a query's vectors (query_id, embedding), at length one."""
    long = vectors.select("query_id", F.posexplode("embedding").alias("d", "x"))
    mean = long.groupBy("query_id", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s.x).alias("embedding")).select("query_id", unit(F.col("embedding")).alias("embedding"))


def blend_vectors(queries: DataFrame, hypothetical: DataFrame, weight: float = 0.3) -> DataFrame:
    """weight * query + (1 - weight) * hypothetical document, at length one."""
    h = hypothetical.select("query_id", F.col("embedding").alias("h"))
    return queries.join(h, "query_id").select("query_id", blend(F.col("embedding"), F.col("h"), weight).alias("embedding"))


def transform(queries: DataFrame, method: str = "none", **how) -> DataFrame:
    """By name: none, multi_query, model, expansion, templates or hyde; the variants of each query, the query itself for other names."""
    if method == "multi_query":
        return rules(queries, **how)
    if method == "model":
        return asked_of_model(queries, **how)
    if method in ("expansion", "templates"):
        return synonyms(queries, **how) if "table" in how else templates(queries)
    if method == "hyde":
        docs = hyde_documents(queries, **how)
        return docs.select("query_id", F.col("pos").cast("long").alias("variant"), F.col("text").alias("variant_text"))
    return _variants(queries, F.array("text"))
