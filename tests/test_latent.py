"""The learned embedder against numpy's singular value decomposition."""

import random

import numpy as np
import pytest

from quillon import providers
from quillon.operators import latent

WORDS = [f"term{i}" for i in range(60)]


def texts(n=240):
    r = random.Random(8)
    return [" ".join(r.choice(WORDS[10 * (i % 6) : 10 * (i % 6) + 12] if r.random() < 0.8 else WORDS) for _ in range(r.randint(3, 40))) for i in range(n)] + [None, "", "!!", "Term1 TERM1 term2"]


@pytest.mark.parametrize("columns", [1 << 12, 64])
def test_directions_equal_those_of_numpy(spark, columns, monkeypatch):
    monkeypatch.setattr(latent, "_BLOCK", 100 if columns > 64 else 64)
    rows = texts()
    frame = spark.createDataFrame([(t,) for t in rows], "text string").repartition(5)
    model = latent.fit(frame, dimensions=6, columns=columns, passes=8)
    dense = np.zeros((len(rows), columns))
    for i, t in enumerate(rows):
        for term in providers.terms(t):
            dense[i, providers.place(term) % columns] += 1
    df = (dense > 0).sum(0)
    dense *= np.log((1 + len(rows)) / (1 + df)) + 1
    norm = np.linalg.norm(dense, axis=1, keepdims=True)
    dense /= np.where(norm == 0, 1, norm)
    _, values, right = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(model.values, values[:6], rtol=1e-4)
    assert np.allclose(np.abs(np.sum(model.directions.T * right[:6], axis=1)), 1, atol=1e-3)
    made = dense @ right[:6].T
    cosine = lambda m: (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)) @ (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)).T
    assert np.allclose(cosine(model(rows)), cosine(made), atol=1e-3)
    assert not model([None, "", "!!"]).any()


def test_near_topics_without_common_terms_are_near(spark):
    pairs = [("car", "engine"), ("engine", "motor"), ("motor", "automobile"), ("apple", "pear"), ("pear", "fruit"), ("fruit", "banana")] * 20
    frame = spark.createDataFrame([(f"{a} {b}",) for a, b in pairs], "text string")
    model = latent.fit(frame, dimensions=2, columns=1 << 10)
    a, b, c = model(["car", "automobile", "banana"])
    assert a @ b > 0.9 and abs(a @ c) < 0.2
    empty = latent.fit(frame.limit(0), dimensions=2, columns=64)
    assert np.isfinite(empty(["car", None])).all()


def test_registered_by_name(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts(60))], "doc_id long, text string")
    try:
        model = latent.register(frame, "learned", dimensions=4, columns=256)
        got = {r.doc_id: r.e for r in frame.select("doc_id", providers.embed(frame.text, "learned").alias("e")).collect()}
        assert np.allclose(got[3], model([texts(60)[3]])[0]) and "learned" in providers.EMBEDDERS
        other = latent.register(frame.limit(20), "learned", dimensions=3, columns=256)  # workers must not use the first one
        got = {r.doc_id: r.e for r in frame.select("doc_id", providers.embed(frame.text, "learned").alias("e")).collect()}
        assert len(got[3]) == 3 and np.allclose(got[3], other([texts(60)[3]])[0])
    finally:
        providers.EMBEDDERS.pop("learned")
