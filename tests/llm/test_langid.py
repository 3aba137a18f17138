import numpy as np
from pyspark.sql import functions as F

from quillon.llm import langid
from quillon.llm.common import crc_mod, least_hashed
from tests.llm import data


def corpus(spark, more=()):
    rows = [(i, data.text(i, 5 + i % 60, lang), lang) for i in range(120) for lang in [("xa", "ya")[i % 2]]]
    return data.docs(spark, [*rows, *more])


def test_held_out_texts_are_recognised(spark):
    docs = corpus(spark)
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 120 and any(r.held_out for r in got)
    assert all(r.lang_pred == r.lang for r in got if r.held_out)
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_labels_are_never_read(spark):
    docs = corpus(spark)
    lied = docs.withColumn("lang", F.when(crc_mod("doc_id", 3) == 1, "zz").otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, langid.identify(d).collect())) for d in (docs, lied))
    assert a == b


def test_kernel_equals_shared_ngrams():
    texts = ["abc", "abd", "xyz abc"]
    grams = langid.presence(texts)

    def brute(t):
        t = " " + t + " "
        return {t[i : i + n] for n in langid.LENGTHS for i in range(len(t) - n + 1)}

    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert abs(float(grams[i] @ grams[j]) - len(brute(a) & brute(b))) <= 1  # one collision of places at most


def test_edges(spark):
    more = [(1000, None, "xa"), (1001, "", "xa"), (1002, "123 !?", "ya"), (1003, data.text(1, 40, "ya"), None), (None, data.text(2, 40), "xa"), (1004, data.text(3, 20_000), None)]
    got = {r.doc_id: r for r in langid.identify(corpus(spark, more)).collect()}
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert [got[i].score for i in (1000, 1001, 1002)] == [0, 0, 0]
    assert got[1003].lang_pred == "ya" and got[None].lang_pred == "xa" and got[1004].lang_pred == "xa" and got[None].held_out is False
    assert langid.identify(data.docs(spark, [])).count() == 0
    unlabelled = data.docs(spark, [(1, "abc", None), (2, "abc", None)])
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def test_filter(spark):
    docs = corpus(spark, [(1000, "123", "xa"), (1001, None, "xa")])
    kept = langid.keep_known(docs, langid.fit(docs, crc_mod("doc_id", 3) == 1))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(120))


def test_short_texts_in_a_learned_language_stay(spark):
    docs = corpus(spark, [(1000, "k", "xa"), (1001, "mq zz", "ya"), (1002, "漢", None)])
    kept = langid.keep_known(docs, langid.fit(docs, crc_mod("doc_id", 3) == 1))
    assert {1000, 1001, 1002} < {r.doc_id for r in kept.collect()}


def test_clashing_columns_and_repeated_ids(spark, monkeypatch):
    taken = {}
    solve = langid.solve
    monkeypatch.setattr(langid, "solve", lambda rows, languages, *a: taken.setdefault("n", len(rows)) and solve(rows, languages, *a))
    docs = corpus(spark, [(4, data.text(9, 20), "xa")] * 500 + [(4, data.text(10, 20), "xa")]).selectExpr("*", "1 _id", "2 rank", "3 bound", "4 n")
    got = langid.identify(docs).where("doc_id = 4").collect()
    assert len(got) == 502 and len({r.score for r in got if r.lang_pred == "xa"}) == 3
    assert taken["n"] == sum(not r.held_out for r in langid.identify(corpus(spark)).collect())
    stage = langid.keep_known(docs, langid.fit(docs, crc_mod("doc_id", 3) == 1))
    assert stage.columns == docs.columns and stage.count() == 621


def test_the_bound_holds_for_each_language(spark):
    rows = [(i, data.text(i, 5), "xa" if i % 50 else "ya") for i in range(2000)]
    got = [(r.lang, r.doc_id) for r in least_hashed(data.docs(spark, rows).select("doc_id", "lang").union(data.docs(spark, rows).select("doc_id", "lang")), "lang", "doc_id", 30).collect()]
    marks = {r.doc_id: r.h for r in data.docs(spark, rows).select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    want = [(lang, i) for lang in ("xa", "ya") for i in sorted((d for d, _, x in rows if x == lang), key=lambda d: marks[d])[:30]]
    assert sorted(got) == sorted(want)


def test_scores_equal_a_plain_kernel_regression():
    """Nystrom features by the landmarks' kernel matrix and one ridge regression per language, written out."""
    texts = [data.text(i, 12, lang) for i in range(30) for lang in ("xa", "ya")]
    names = ["xa", "ya"] * 30
    asked = [data.text(100 + i, 9, lang) for i in range(5) for lang in ("xa", "ya")] + ["kalo öbüv"]
    grams = {t: {i for i, x in enumerate(langid.presence([t])[0]) if x} for t in texts + asked}
    kernel = lambda a, b: len(grams[a] & grams[b]) / np.sqrt(len(grams[a]) * len(grams[b]))
    marks = texts[:16]
    inner = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(inner)
    root = vectors @ np.diag(1 / np.sqrt(values)) @ vectors.T
    features = lambda ts: np.array([[kernel(t, m) for m in marks] for t in ts]) @ root
    x, want = features(texts), []
    for name in ("xa", "ya"):
        y = np.array([float(n == name) for n in names])
        want.append(features(asked) @ np.linalg.solve(x.T @ x + langid.RIDGE * len(x) / 100 * np.eye(16), x.T @ y))
    model = langid.solve([np.packbits(langid.presence([t])[0].astype(bool)).tobytes() for t in texts], names, 16)
    labels, scores = model(asked)
    assert labels == [("xa", "ya")[i] for i in np.argmax(want, 0)]
    assert np.allclose(scores, np.clip(np.max(want, 0), 0, 1), atol=2e-3)
