"""Files to documents: (doc_id, title, text). Ids are hashes of the file and the place in it, so reading is one
distributed pass without a counter."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ty
from pyspark.sql.window import Window

UNTITLED = "Untitled Document"
#: Characters from which a page is split at blank lines.
LONG_PAGE = 2000
FIELDS = ty.StructType([ty.StructField("title", ty.StringType()), ty.StructField("text", ty.StringType())])
#: The folder of a file, or of a folder that Spark wrote as one.
_FOLDER = r"([^/]+)/[^/]+?(?:/part-[^/]+)?$"
_pdf: list[Callable[[bytes], list[str]]] = []


def _documents(rows: DataFrame, *place: str) -> DataFrame:
    return rows.select(F.xxhash64(*place).alias("doc_id"), "title", "text")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Plain text, split at blank lines; titles count the parts."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    parts = F.filter(F.transform(F.split("value", "\n\n"), lambda s: F.trim(s)), lambda p: p != "")
    rows = files.select("file", F.posexplode(parts).alias("i", "text"))
    return _documents(rows.withColumn("title", F.concat(F.lit("Paragraph_"), (F.col("i") + 1).cast("string"))), "file", "i")


def csv_files(spark: SparkSession, path: str) -> DataFrame:
    """Columns title and text, else the first two as text. An empty cell is null, a quoted empty one an empty text.

    What stands for null is a new name, so no text is taken for it; Spark's own, the empty text, would take those too."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', charToEscapeQuoteEscaping='"', nullValue=uuid.uuid4().hex)
    title, text = ("title", "text") if {"title", "text"} <= set(df.columns) else (df.columns[0], df.columns[min(1, len(df.columns) - 1)])
    rows = df.select(F.col("_metadata.file_path").alias("file"), F.col(f"`{title}`").cast("string").alias("title"), F.col(f"`{text}`").cast("string").alias("text"))
    return _documents(rows, "file", "title", "text")


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of objects per file, read object by object; those without text go, the rest are numbered for a default title."""
    rows = spark.read.schema(FIELDS).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), "title", "text")
    return _numbered(rows.where("text is not null"))


def jsonl_files(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line; broken lines are skipped. Default titles number the kept lines of each file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.from_json("value", FIELDS, {"mode": "PERMISSIVE"}).alias("d"))
    return _numbered(lines.where("d.text is not null").select("file", "at", "d.title", "d.text"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Documents of rows (file, at, title, text); a row without a title is named by its number among its file's rows.

    Rows are counted per file and partition first, so a large file is numbered by many tasks.
    """
    part = F.shiftright("at", 33)
    counts = rows.groupBy("file", part.alias("part")).agg(F.count("*").alias("n"))
    before = counts.select("file", "part", (F.sum("n").over(Window.partitionBy("file").orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("file", "part").orderBy("at"))
    every = rows.withColumn("part", part).select("file", "part", "at", "title", "text", own.alias("own")).join(F.broadcast(before), ["file", "part"])
    title = F.coalesce("title", F.concat(F.lit("Document_"), (F.col("own") + F.col("before")).cast("string")))
    return _documents(every.select("file", title.alias("title"), "text"), "file", "title", "text")


def register_pdf(pages: Callable[[bytes], list[str]]) -> None:
    """Sets the function that reads a PDF's pages; no PDF library is built in."""
    _pdf[:] = [pages]


def split_pages(pages: DataFrame) -> DataFrame:
    """(file, page, text) to documents: a long page becomes its parts between blank lines."""
    parts = F.filter(F.transform(F.split("text", "\n\n"), lambda s: F.trim(s)), lambda p: p != "")
    long = pages.where(F.length("text") > LONG_PAGE).select("file", "page", F.posexplode(parts).alias("i", "text"))
    long = long.withColumn("title", F.format_string("Page_%d_Section_%d", F.col("page"), F.col("i") + 1))
    short = pages.where((F.length("text") <= LONG_PAGE) & (F.trim("text") != "")).withColumn("i", F.lit(0)).withColumn("title", F.format_string("Page_%d", F.col("page")))
    return _documents(long.unionByName(short.select(*long.columns)), "file", "page", "i")


def _pages(spark: SparkSession, path: str) -> DataFrame:
    """(file, page, text) of PDF files, by the registered reader on Arrow batches."""
    if not _pdf:
        raise RuntimeError("no PDF reader is registered; see register_pdf")
    read = _pdf[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, i, text) for f, data in zip(batch["path"], batch["content"], strict=True) for i, text in enumerate(read(bytes(data)), 1)]
            yield pd.DataFrame(rows, columns=["file", "page", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, page int, text string")


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    return split_pages(_pages(spark, path))


def pdf_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): all pages of a PDF file, joined by blank lines."""
    pages = F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda p: p.text)
    return _pages(spark, path).groupBy("file").agg(F.array_join(pages, "\n\n").alias("text"))


def docx_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): the paragraphs of a DOCX file, joined by blank lines."""

    def text(data: bytes) -> str:
        with zipfile.ZipFile(io.BytesIO(data)) as packed:
            body = ElementTree.fromstring(packed.read("word/document.xml"))
        word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        parts = ("".join(t.text or "" for t in p.iter(f"{word}t")) for p in body.iter(f"{word}p"))
        return "\n\n".join(p for p in parts if p.strip())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"file": batch["path"], "text": [text(bytes(d)) for d in batch["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, text string")


def plain_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


TEXTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"txt": plain_texts, "pdf": pdf_texts, "docx": docx_texts, "doc": docx_texts}


def file_texts(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(file, text): each file as one text, by its ending."""
    kind = kind or path.rpartition(".")[2].lower()
    if kind not in TEXTS:
        raise ValueError(f"unsupported format {kind}; known: {sorted(TEXTS)}")
    return TEXTS[kind](spark, path)


def parquet_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


FORMATS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"txt": text_files, "csv": csv_files, "json": json_files, "jsonl": jsonl_files, "pdf": pdf_files, "parquet": parquet_corpus}


def read(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """By format name or file ending."""
    kind = kind or path.rstrip("/*").rpartition(".")[2].lower()
    if kind not in FORMATS:
        raise ValueError(f"unsupported format {kind}; known: {sorted(FORMATS)}")
    return FORMATS[kind](spark, path)


def document(text: Column, title: Column | None = None) -> Column:
    return F.struct(F.coalesce(title if title is not None else F.lit(None).cast("string"), F.lit(UNTITLED)).alias("title"), text.alias("text"))


def questions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions; relevant documents are separated by ``|``."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if lacking := {"question", "expected_answer"} - set(df.columns):
        raise ValueError(f"columns are missing: {sorted(lacking)}")
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    docs = F.filter(F.transform(F.split(have("relevant_docs"), r"\|"), lambda s: F.trim(s)), lambda d: d != "")
    return df.select("question", "expected_answer", F.coalesce(docs, F.array().cast("array<string>")).alias("relevant_docs"), F.coalesce(have("category"), F.lit("general")).alias("category"), F.coalesce(have("difficulty"), F.lit("medium")).alias("difficulty"))


def questions_json(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation sets {name, created_at, questions: [...]}, one row per question."""
    schema = "name string, created_at string, questions array<struct<question: string, expected_answer: string, relevant_docs: array<string>, category: string, difficulty: string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select("name", "created_at", F.inline("questions"))


def runs_csv(spark: SparkSession, path: str) -> DataFrame:
    """Results of runs in folders ``{experiment}_experiment_{date}_{time}``; all values as text or double, with experiment and time."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    folder = F.regexp_extract(F.col("_metadata.file_path"), _FOLDER, 1)
    return df.select(*[F.expr(f"try_cast(`{c}` as double)").alias(c) if c.startswith("metric_") or c.endswith("_sec") else F.col(f"`{c}`") for c in df.columns], experiment(folder).alias("experiment"), run_time(folder).alias("run_ts"))


def experiment(folder: Column) -> Column:
    """The experiment's name in a run's folder name."""
    return F.regexp_extract(folder, r"^(.*?)(?:_experiment)?_\d{8}_\d{6}$", 1)


def run_time(folder: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(F.regexp_extract(folder, r"(\d{8}_\d{6})$", 1), "_", " "), F.lit("yyyyMMdd HHmmss"))


def list_datasets(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, modified, bytes) of the evaluation sets below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("file"), F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def list_runs(spark: SparkSession, path: str) -> DataFrame:
    """(folder, experiment, run_ts, place) of the result folders below a path, newest first; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(path)
    folders = files.select(F.regexp_extract("path", _FOLDER, 1).alias("folder")).distinct()
    return newest_first(folders)


def newest_first(folders: DataFrame) -> DataFrame:
    """(folder, experiment, run_ts, place): result folders by the time in their names; those without a time come last."""
    rows = folders.select("folder", experiment(F.col("folder")).alias("experiment"), run_time(F.col("folder")).alias("run_ts"))
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("run_ts"), "folder"))
    return rows.withColumn("place", place.cast("long"))
