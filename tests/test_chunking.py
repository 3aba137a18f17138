import random
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon import providers
from quillon.operators import chunking as C

PARAGRAPH = "one two three four five six seven eight nine ten"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def rows(df):
    return [(r.chunk_id, r.text) for r in df.orderBy("doc_id", "chunk_index").collect()]


def test_fixed_tokens(spark):
    text = " ".join(f"w{i}" for i in range(10))
    assert rows(C.fixed_tokens(docs(spark, text), 4, 0)) == [("0_0", "w0 w1 w2 w3"), ("0_1", "w4 w5 w6 w7"), ("0_2", "w8 w9")]
    assert rows(C.fixed_tokens(docs(spark, text), 4, 2))[1] == ("0_1", "w2 w3 w4 w5")
    assert rows(C.fixed_tokens(docs(spark, text), 6, 0)) == [("0_0", "w0 w1 w2 w3 w4 w5"), ("0_1", "w6 w7 w8 w9")]
    assert rows(C.fixed_tokens(docs(spark, "one", "", None), 4, 0)) == []
    with pytest.raises(ValueError):
        C.fixed_tokens(docs(spark, text), 4, 4)


def test_paragraphs(spark):
    got = rows(C.paragraphs(docs(spark, f"{PARAGRAPH}\n\nshort one\n\n{PARAGRAPH} x", f"{PARAGRAPH}\nb\n{PARAGRAPH}", "just one", "")))
    assert got == [("0_p0", PARAGRAPH), ("0_p2", PARAGRAPH + " x"), ("1_p0", PARAGRAPH), ("1_p2", PARAGRAPH), (None, "just one"), (None, "")]


def test_sentence_pack(spark):
    assert rows(C.sentence_pack(docs(spark, "a b c. d e! f g h i j k? l"), 5)) == [("0_s0", "a b c d e"), ("0_s1", "f g h i j k"), ("0_s2", "l")]
    assert rows(C.sentence_pack(docs(spark, "aa. bb. cc"), 4, "chars")) == [("0_s0", "aa bb"), ("0_s1", "cc")]


def test_sliding_windows(spark):
    text = " ".join(map(str, range(7)))
    assert [t for _, t in rows(C.sliding_windows(docs(spark, text), 4, 2))] == ["0 1 2 3", "2 3 4 5", "3 4 5 6"]
    assert rows(C.sliding_windows(docs(spark, "a  b", ""), 4, 2)) == [("0_sw0", "a  b")]


def test_semantic_segments(spark):
    topics = ["cat dog cow.", "cat dog pig.", "cat dog hen.", "sun moon star.", "sun moon sky.", "sun moon sea."]
    got = rows(C.semantic_segments(docs(spark, " ".join(topics), "a. b. c."), least_sentences=1))
    assert got[0] == ("0_semantic0", "cat dog cow cat dog pig cat dog hen")
    assert got[-1] == ("1_semantic0", "a b c.")


def test_topic_segments(spark):
    text = "\n\n".join(["cats dogs cats", "cats dogs cows", "stars moons stars", "stars moons suns"])
    assert [t for _, t in rows(C.topic_segments(docs(spark, text)))] == ["cats dogs cats\n\ncats dogs cows", "stars moons stars\n\nstars moons suns"]
    assert rows(C.topic_segments(docs(spark, "a\n\nb"))) == [("0_topic0", "a\n\nb")]


def test_sliding_coherent(spark):
    text = " ".join(["cat dog"] * 4 + ["sun moon"] * 4)
    assert [t for _, t in rows(C.sliding_coherent(docs(spark, text), 4, 4, 0.7))] == [" ".join(["cat dog"] * 4), " ".join(["sun moon"] * 4)]


def test_coherence_by_running_sums_equals_embedding_each_span(spark, monkeypatch):
    monkeypatch.setitem(providers.EMBEDDERS, "same", lambda: providers.hash_embed)
    r = random.Random(3)
    texts = [" ".join(r.choice([f"t{r.randrange(4)}{i // 60 % 3}", "the", "x-y", "!", "É"]) for i in range(n)) for n in (0, 3, 20, 21, 45, 200, 333, 1200)]
    for size, stride, threshold in ((20, 10, 0.7), (20, 7, 0.6), (30, 30, 0.8), (10, 15, 0.5)):
        for compat in (False, True):
            got = [rows(C.sliding_coherent(docs(spark, *texts), size, stride, threshold, embed, compat)) for embed in ("hash", "same")]
            assert got[0] == got[1] and len(got[0]) > 8


def test_coherence_of_a_very_long_text_in_linear_time(spark):
    began = time.time()
    text = " ".join(f"w{i % 50}" for i in range(400_000))
    assert [len(t) for _, t in rows(C.sliding_coherent(docs(spark, text), 200, 100, 0.5))] == [len(text)]
    assert time.time() - began < 60


@given(st.text(alphabet="ab \n.", max_size=200), st.integers(5, 40))
def test_recursive_split_keeps_all_and_bounds_size(text, size):
    parts = C.split_recursively(text, size, 0, C.SEPARATORS)
    assert all(len(p) <= size for p in parts)
    assert "".join("".join(parts).split()) == "".join(text.split())


def test_recursive_overlap():
    assert C.split_recursively("aa bb cc dd", 5, 2, (" ",)) == ["aa bb", "bb cc", "cc dd"]


def test_dispatch_validation_estimate(spark):
    d = docs(spark, "a b. c d", f"{PARAGRAPH}")
    assert C.chunk(d, "no such strategy").count() == C.recursive_chars(d).count()
    kept = C.validate(C.paragraphs(docs(spark, "only")), "paragraphs", 10, 0)
    assert kept.first().chunk_id == "paragraphs_10_0_0_0"
    n = spark.range(1).select(*[C.estimated_chunks(F.lit(x), 1000, 200).alias(str(x)) for x in (0, 10, 1000, 1900)]).first()
    assert list(n) == [0, 1, 2, 3] or list(n) == [0, 1, 2, 3]


def test_a_text_that_fails_does_not_stop_the_others(spark, monkeypatch):
    def split(text, *rest):
        if text == "bad":
            raise ValueError
        return [text]

    docs = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "fine")], "doc_id long, text string")
    before = C.failures(spark)
    assert [r.doc_id for r in C._per_text(docs, split, "_x").collect()] == [1, 3]
    assert C.failures(spark) == before + 1


def test_long_texts_split_in_linear_time():
    began = time.time()
    parts = C.split_recursively("ab " * 300_000, 1000, 200, ("\n\n", "\n", " ", ""))
    assert time.time() - began < 20 and len(parts) > 1000
    assert sum(len(C.split_recursively("x" * 200_000, 1000, 200, ("",)))for _ in range(1)) > 200
