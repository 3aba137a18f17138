import json
import zipfile

import pytest

from quillon.sources import readers as R
from quillon.sources import writers as W
from quillon.streaming import latency


def texts(df):
    return sorted((r.title, r.text) for r in df.collect())


def test_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n\n\ntwo\nlines\n\n ")
    assert texts(R.read(spark, f"{tmp_path}/a.txt")) == [("Paragraph_1", "one"), ("Paragraph_2", "two\nlines")]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,text,title\n1,"t ""1""\nmore",T\n')
    assert texts(R.read(spark, f"{tmp_path}/a.csv")) == [("T", 't "1"\nmore')]
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    assert texts(R.read(spark, f"{tmp_path}/b.csv")) == [("1", "2")]


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"text": "a"}, {"title": "no"}, {"text": "b", "title": "B"}, {"text": "c"}]))
    assert texts(R.read(spark, f"{tmp_path}/a.json")) == [("B", "b"), ("Document_1", "a"), ("Document_3", "c")]
    (tmp_path / "a.jsonl").write_text('{"text": "a"}\nbroken\n{"text": "b", "title": "B"}\n')
    assert texts(R.read(spark, f"{tmp_path}/a.jsonl")) == [("B", "b"), ("Document_1", "a")]


def test_pdf_pages_and_dispatch(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    with pytest.raises(RuntimeError):
        R.read(spark, f"{tmp_path}/a.pdf")
    R.register_pdf(lambda data: ["short", "a" * 1500 + "\n\n" + "b" * 1500, " "])
    assert [t for t, _ in texts(R.read(spark, f"{tmp_path}/a.pdf"))] == ["Page_1", "Page_2_Section_1", "Page_2_Section_2"]
    with pytest.raises(ValueError):
        R.read(spark, "a.xyz")


def test_files_as_one_text(spark, tmp_path):
    word = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {word}><w:body><w:p><w:r><w:t>One </w:t><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>three</w:t></w:r></w:p></w:body></w:document>")
    (tmp_path / "a.txt").write_text("x\n\ny")
    (tmp_path / "a.pdf").write_bytes(b"x")
    R.register_pdf(lambda data: ["p1", "p2"])
    got = {k: R.file_texts(spark, f"{tmp_path}/a.{k}").first().text for k in ("docx", "txt", "pdf")}
    assert got == {"docx": "One two\n\nthree", "txt": "x\n\ny", "pdf": "p1\n\np2"}
    with pytest.raises(ValueError):
        R.file_texts(spark, "a.xyz")


def test_default_titles_count_the_kept_objects(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.jsonl").write_text("".join(json.dumps({"text": f"{k} {i}"} | ({"title": "T"} if i % 3 == 0 else {})) + "\n" + "broken\n" * (i % 2) for i in range(50)))
    got = R.jsonl_files(spark, f"{tmp_path}/*.jsonl").collect()
    assert sorted((r.title, r.text) for r in got) == sorted(("T" if i % 3 == 0 else f"Document_{i + 1}", f"{k} {i}") for k in range(2) for i in range(50))


def test_listings(spark, tmp_path):
    for folder in ("retrieval_experiment_20250419_010203", "chunking_experiment_20250418_171048", "other"):
        (tmp_path / "runs" / folder).mkdir(parents=True)
        (tmp_path / "runs" / folder / "results.csv").write_text("a\n1\n")
    got = R.list_runs(spark, f"{tmp_path}/runs").orderBy("place").collect()
    assert [(r.experiment, r.place) for r in got] == [("retrieval", 1), ("chunking", 2), ("", 3)]
    (tmp_path / "sets").mkdir()
    (tmp_path / "sets" / "one.json").write_text("{}")
    row = R.list_datasets(spark, f"{tmp_path}/sets").first()
    assert (row.name, row.bytes) == ("one", 2)
    W.save_json(spark, {"b": [1], "a": "é"}, f"{tmp_path}/v")
    assert W.load_json(spark, f"{tmp_path}/v") == {"a": "é", "b": [1]} == W.from_json(W.to_json({"b": [1], "a": "é"}))


def test_latex_tables_are_whole(spark, monkeypatch):
    monkeypatch.setattr(W, "REPORT_ROWS", 2)
    with pytest.raises(ValueError):
        W.latex(spark.range(3), {})


def test_questions(spark, tmp_path):
    W.save_template(spark, f"{tmp_path}/q")
    row = R.questions_csv(spark, f"{tmp_path}/q").first()
    assert row.relevant_docs == ["Document 1", "Document 2"]
    (tmp_path / "m.csv").write_text("question,expected_answer\nq,a\n")
    row = R.questions_csv(spark, f"{tmp_path}/m.csv").first()
    assert (row.relevant_docs, row.category, row.difficulty) == ([], "general", "medium")
    (tmp_path / "bad.csv").write_text("question\nq\n")
    with pytest.raises(ValueError):
        R.questions_csv(spark, f"{tmp_path}/bad.csv")
    W.save_questions(R.questions_csv(spark, f"{tmp_path}/m.csv"), f"{tmp_path}/j", "set")
    assert R.questions_json(spark, f"{tmp_path}/j").first().question == "q"


def test_runs(spark, tmp_path):
    for folder, more in (("query_processing_experiment_20250418_171048", ",x"), ("retrieval_experiment_20250419_010203", ",y")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "results.csv").write_text(f"technique,metric_mrr\na{more[1]},0.5\n")
    got = {r.experiment: r for r in R.runs_csv(spark, f"{tmp_path}/*/results.csv").collect()}
    assert got.keys() == {"query_processing", "retrieval"} and got["retrieval"].metric_mrr == 0.5
    assert str(got["query_processing"].run_ts) == "2025-04-18 17:10:48"


def test_sinks(spark, tmp_path):
    index = spark.createDataFrame([("c", "t", [1.0])], "chunk_id string, text string, embedding array<double>")
    W.save_index(index, f"{tmp_path}/i", "f1")
    assert W.load_index(spark, f"{tmp_path}/i", "f1").count() == 1
    assert W.load_index(spark, f"{tmp_path}/i", "other") is None
    W.save_corpus(spark.range(1), f"{tmp_path}/c")
    with pytest.raises(ValueError):
        W.load_index(spark, f"{tmp_path}/c")
    table = W.latex(spark.createDataFrame([("a_b", 0.5), ("c", 0.75), ("d", None)], "method string, mrr double"), {"mrr": "max"})
    assert r"\textbf{0.750}" in table and r"a\_b & 0.500" in table
    W.export_csv(spark.createDataFrame([(1.234567,)], "x double"), f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).first().x == "1.2346"


def test_latency_stream_equals_the_batch(spark, tmp_path):
    rows = [(f"2024-01-01 {h:02}:{m:02}:00", k, float(h + m)) for h in range(6) for m in (0, 30) for k in ("a", "b")]
    frame = spark.createDataFrame(rows, "t string, event_type string, value double").selectExpr("to_timestamp(t) ts", "event_type", "value")
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    latency.start(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    done = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    batch = sorted(map(tuple, latency.latency(frame).collect()))
    assert done and set(done) <= set(batch)
