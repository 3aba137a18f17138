"""The pipeline against a brute-force version of each stage."""

import corpus_pipeline
from quillon.llm import decontaminate, quality
from tests.llm import data
from tests.llm.test_decontaminate import brute as overlaps
from tests.llm.test_neardup import brute_set, brute_similar
from tests.llm.test_simhash import brute_roots


def test_stages_equal_brute_force(spark, tmp_path):
    item = data.text(7000, 40)
    base = " ".join(f"{w}{i}" for i, w in enumerate(data.words(1, 90)))
    rows = [(i, " ".join(f"{w}{j}" for j, w in enumerate(data.words(i, 70 + i % 30, ("xa", "ya")[i % 2]))), ("xa", "ya")[i % 2]) for i in range(80)]
    rows += [(200, base, "xa"), (201, base.upper(), "xa"), (202, base, "xa"), (203, data.text(8, 60) + " " + item, "xa"), (204, "123 456", "xa"), (205, None, "xa"), (206, " ".join([data.text(9, 20)] * 6), "xa"), (207, "too short", "xa")]
    data.docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = {r[0]: r[1] for r in rows}
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(texts)
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name == "packing":
            break
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        got = {r.doc_id for r in docs.collect()}
        if name == "language":
            kept = {d: t for d, t in kept.items() if t and any(map(str.isalpha, t))}
        elif name == "repetition":
            kept = {d: t for d, t in kept.items() if quality.measure(t)["kept"]}
        elif name == "near_duplicates":
            sets = {d: brute_set(t) for d, t in kept.items()}
            roots = brute_roots(kept, [(a, b) for a in kept for b in kept if a < b and brute_similar(sets[a], sets[b])])
            kept = {d: t for d, t in kept.items() if roots[d] == d}
        elif name == "decontamination":
            bad = {d for d, _ in overlaps(list(kept.items()), [(1, item)])}
            kept = {d: t for d, t in kept.items() if d not in bad}
        assert got == set(kept), name
    assert {200} <= set(kept) and not set(kept) & {201, 202, 203, 204, 205, 206, 207}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(kept)
    assert all(sum(r.length for r in pieces if r.doc_id == d) == next(r.doc_tokens for r in pieces if r.doc_id == d) for d in kept)
    assert decontaminate.SPAN == 8


def test_empty_tables_and_clashing_names(spark, tmp_path):
    rows = [*data.edge_rows(), *((100 + i, data.text(i, 80, ("xa", "ya")[i % 2]), ("xa", "ya")[i % 2]) for i in range(30))]
    named = data.docs(spark, rows).selectExpr("*", "1 _id", "2 _seen", "3 _again", "4 copy_id", "5 text_mark", "6 key", "7 rank")
    for name, docs, items in (("full", named, [(1, data.text(7000, 40))]), ("none", named.limit(0), [(1, data.text(7000, 40))]), ("free", named, [])):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        got = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for n, (stage, run) in enumerate(corpus_pipeline.STAGES[:-1]):
            out = run(spark, got, f"{tmp_path}/{name}")
            assert out.columns == named.columns, stage
            out.write.parquet(f"{tmp_path}/{name}/{n}")
            got = spark.read.parquet(f"{tmp_path}/{name}/{n}")
        pieces = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r.doc_id for r in pieces} == {r.doc_id for r in got.collect()}
        assert len(pieces) == 0 if name == "none" else {4, 7, 100, 129} <= {r.doc_id for r in pieces}
