import math
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quillon.llm import toxicity as X
from quillon.llm.common import crc_mod
from tests.llm import data

BAD = ["vilka", "vilkatu", "vilkalo", "grond"]


def rows_of(n):
    out, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = data.words(i, 20 + i % 50)
        if toxic:
            words[i % 20] = BAD[i // 4 % 4]
        out.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return out, labels


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_texts(spark):
    rows, labels = rows_of(400)
    got = {r.doc_id: r for r in X.classify(data.docs(spark, rows), labels_of(spark, labels)).collect()}
    held = [i for i in got if got[i].held_out]
    assert held and np.mean([got[i].predicted == labels[i][2] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_held_out_labels_are_never_read(spark):
    rows, labels = rows_of(200)
    docs, own = data.docs(spark, rows), labels_of(spark, labels)
    lied = own.withColumn("toxic", F.when(crc_mod("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, X.classify(docs, x).collect())) for x in (own, lied))
    assert a == b


def row(words, toxic):
    return X.held(words), X.changes(words), int(toxic)


def named(n):
    """Toxic texts that mostly name women, and clean ones that rarely do."""
    out = []
    for i in range(n):
        words = set(data.words(i, 15))
        if i % 3 == 0:
            words |= {"grond"}
        if i % 3 == 0 and i % 2 or i % 3 and i % 10 == 0:
            words |= {"women"}
        out.append((words, i % 3 == 0))
    return out


def test_swapping_group_terms_moves_the_score_less_when_penalised():
    rows, texts = [row(*r) for r in named(300)], [" ".join(w) for w, _ in named(300)]
    models = [X.solve(rows, 0.33, fairness) for fairness in (0.0, 5.0)]
    gaps = [abs(m.score("women kalo mitu") - m.score("men kalo mitu")) for m in models]
    assert gaps[1] < 0.3 * gaps[0] and X.swap_gap(models[1], texts) < 0.3 * X.swap_gap(models[0], texts)
    assert all(m.score("grond kalo") > 0.5 for m in models) and models[1].score("women kalo mitu") < 0.5


def test_texts_that_name_no_group_get_a_pair_too():
    for words in (set(data.words(1, 20)), set()):
        a, b = X.counterfactuals(words)
        assert a - words and b - words and words < a and words < b and not a & b - words
    assert X.counterfactuals({"kalo", "women"}) == ({"kalo", "women"}, {"kalo", "men"})
    assert len({tuple(sorted(X.counterfactuals(set(data.words(i, 9)))[0] - set(data.words(i, 9)))) for i in range(200)}) > 10


def brute_places(words):
    """Places of all features, straight from the definition."""
    parts = {p for w in words for p in ["=" + w, *(("^" + w)[i : i + n] for n in (4, 5) for i in range(len(w) + 2 - n))]}
    return {xxhash.xxh32_intdigest(p.encode(), 7) >> 12 for p in parts}


def brute_loss(model_theta, bias, texts, kept, share, fairness):
    """The objective as a sum over texts, one by one."""
    toxic = sum(y for _, y in texts)
    weight = dict(zip(kept, model_theta, strict=True))
    sum_of = lambda places: sum(weight.get(p, 0.0) for p in places)
    loss = X.RIDGE / 2 * sum(t * t for t in model_theta)
    for words, y in texts:
        z = bias + sum_of(brute_places(words))
        p = 1 / (1 + math.exp(-z))
        loss -= (share / toxic if y else (1 - share) / (len(texts) - toxic)) * math.log(p if y else 1 - p)
        a, b = X.counterfactuals(words)
        loss += fairness / 2 * (sum_of(brute_places(a)) - sum_of(brute_places(b))) ** 2 / len(texts)
    return loss


def test_objective_and_gradient_equal_brute_force():
    texts = named(60)
    pairs = [X.counterfactuals(w) for w, _ in texts]
    places = sorted(set().union(*(brute_places(w) for (w, _), p in zip(texts, pairs, strict=True) for w in (w, *p))))
    has = lambda w: np.array([p in brute_places(w) for p in places], np.float64)
    x, change = np.stack([has(w) for w, _ in texts]), np.stack([has(a) - has(b) for a, b in pairs])
    label = np.array([float(y) for _, y in texts])
    weigh = np.where(label == 1, 0.3 / label.sum(), 0.7 / (60 - label.sum()))
    value = lambda t, b: X.objective(t, b, x, label, weigh, change, np.full(60, 1 / 60), 2.0)
    r = np.random.default_rng(1)
    theta, bias = r.normal(size=len(places)) / 10, 0.3
    loss, grad = value(theta, bias)
    assert abs(loss - brute_loss(theta, bias, texts, places, 0.3, 2.0)) < 1e-9
    for j in r.integers(0, len(theta), 40):
        move = np.zeros(len(theta))
        move[j] = 1e-5
        assert abs((value(theta + move, bias)[0] - value(theta - move, bias)[0]) / 2e-5 - grad[j]) < 1e-7
    assert abs((value(theta, bias + 1e-5)[0] - value(theta, bias - 1e-5)[0]) / 2e-5 - grad[-1]) < 1e-7
    # The fit ends near the least value: no step along the gradient from its weights gains much.
    model = X.solve([row(*t) for t in texts], 0.3, 2.0)
    got = np.array([model.weights.get(p, 0.0) for p in places])
    end, slope = value(got, model.bias)
    assert end < 0.2 * value(np.zeros(len(places)), math.log(0.3 / 0.7))[0]
    assert end - min(value(got - t * slope[:-1], model.bias - t * slope[-1])[0] for t in (0.001, 0.01, 0.1, 1.0)) < 0.02


def test_scores_equal_brute_force():
    model = X.solve([row(*t) for t in named(200)], 0.33)
    for text in ("grond kalo", "women Mitu, kalo!", "", None, data.text(3, 500), "kalo kalo kalo"):
        words = set(re.findall(r"\w+", (text or "").lower()))
        z = model.bias + sum(model.weights.get(p, 0.0) for p in brute_places(words))
        assert abs(model.score(text) - 1 / (1 + math.exp(-z))) < 1e-9


def test_edges(spark):
    rows, labels = rows_of(100)
    rows += [(1000, None), (1001, ""), (None, "grond grond"), (1002, data.text(5, 20_000)), (1003, "grond"), (1003, "grond"), (4, "kalo")]
    own = labels_of(spark, [*labels, *labels[:9], (None, 1, 1), (5000, 1, 1), (1002, 1, None), (2, 1, 1)])
    got = X.classify(data.docs(spark, rows).selectExpr("*", "1 _id", "2 toxic", "3 held"), own).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1000].score == by[1001].score < 0.5 and by[None].held_out is False and by[1003].predicted == 1
    assert X.classify(data.docs(spark, []), labels_of(spark, [])).count() == 0
    assert X.classify(data.docs(spark, [(1, "a")]), labels_of(spark, [])).first().score < 1e-6


def test_the_bound_holds_with_repeated_ids(spark, monkeypatch):
    taken = []
    solve = X.solve
    monkeypatch.setattr(X, "solve", lambda rows, *a: taken.append(len(rows)) or solve(rows, *a))
    rows, labels = rows_of(100)
    own = labels_of(spark, labels)
    X.fit(data.docs(spark, rows + [rows[3]] * 300 + [(3, data.text(i, 9)) for i in range(300)]), own, F.lit(False), train=20)
    X.fit(data.docs(spark, rows), own, F.lit(False), train=20)
    assert taken == [40, 40]
