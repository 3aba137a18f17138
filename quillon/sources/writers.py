"""Sinks: corpora, indexes, evaluation sets, run results, and small report tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a report formatted on the driver may have.
REPORT_ROWS = 10_000
INDEX_COLUMNS = {"chunk_id", "text", "embedding"}


def save_corpus(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").parquet(path)


def save_index(index: DataFrame, path: str, fingerprint: str) -> None:
    """A vector index with the fingerprint of the configuration that made it, as one column."""
    index.withColumn("config", F.lit(fingerprint)).write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str, fingerprint: str | None = None) -> DataFrame | None:
    """The index, or None if another configuration made it; a wrong schema is an error."""
    df = spark.read.parquet(path)
    if lacking := INDEX_COLUMNS - set(df.columns):
        raise ValueError(f"not an index; columns are missing: {sorted(lacking)}")
    if fingerprint is not None and not df.where(F.col("config") == fingerprint).limit(1).count():
        return None
    return df.drop("config")


def save_questions(questions: DataFrame, path: str, name: str) -> None:
    """An evaluation set as JSON, one object of some questions in each file, as a reader of a JSON value sees only a file's
    first one; ``readers.questions_json`` puts them together."""
    fields = ("question", "expected_answer", "relevant_docs", "category", "difficulty")
    packed = questions.select(F.struct(*fields).alias("q")).groupBy(F.shiftright(F.monotonically_increasing_id(), 10).alias("part")).agg(F.collect_list("q").alias("questions"))
    packed.select(F.lit(name).alias("name"), F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("created_at"), "questions").write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def save_template(spark: SparkSession, path: str) -> None:
    """An example of the evaluation CSV."""
    row = [("What is retrieval?", "Finding relevant documents.", "Document 1|Document 2", "general", "medium")]
    spark.createDataFrame(row, "question string, expected_answer string, relevant_docs string, category string, difficulty string").coalesce(1).write.mode("overwrite").csv(path, header=True)


def append_run(rows: DataFrame, path: str) -> None:
    """Adds iterations to the results table, partitioned by experiment; earlier ones are not rewritten."""
    rows.write.mode("append").partitionBy("experiment").parquet(path)


def export_csv(df: DataFrame, path: str, digits: int = 4) -> None:
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("float", "double")]
    df.select(*[F.round(c, digits).alias(c) if c in numeric else c for c in df.columns]).write.mode("overwrite").csv(path, header=True)


def save_csv(df: DataFrame, path: str) -> None:
    """Texts as they are: quotes are doubled, and white space around a text, which Spark's writer drops, stays."""
    df.write.mode("overwrite").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def latex(df: DataFrame, best: dict[str, str], caption: str = "", digits: int = 3) -> str:
    """A LaTeX table of a small frame; in each column of ``best`` (name to max or min) the best cell is bold."""
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a LaTeX table of over {REPORT_ROWS} rows; aggregate or filter first")
    ends = {c: (max if how == "max" else min)((r[c] for r in rows if r[c] is not None), default=None) for c, how in best.items()}

    def cell(column: str, value) -> str:
        text = "--" if value is None else f"{value:.{digits}f}" if isinstance(value, float) else str(value).replace("_", r"\_")
        return rf"\textbf{{{text}}}" if value is not None and value == ends.get(column) else text

    body = [" & ".join(cell(c, r[c]) for c in df.columns) + r" \\" for r in rows]
    head = " & ".join(c.replace("_", " ").title() for c in df.columns) + r" \\"
    return "\n".join([r"\begin{table}", r"\centering", rf"\caption{{{caption}}}", rf"\begin{{tabular}}{{l{'r' * (len(df.columns) - 1)}}}", r"\toprule", head, r"\midrule", *body, r"\bottomrule", r"\end{tabular}", r"\end{table}"])


def to_json(value: dict) -> str:
    return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False)


def from_json(text: str) -> dict:
    return json.loads(text)


def save_json(spark: SparkSession, value: dict, path: str) -> None:
    """One JSON value in a folder that every machine reaches."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))
