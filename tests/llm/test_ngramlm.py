import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import ngramlm as N
from quillon.llm.common import crc_mod
from tests.llm import data


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "</s>"]


def corpus(spark, n=150):
    rows = [(i, " ".join(w[:3].title() for w in data.words(i, 20 + i))) for i in range(n)]
    return rows + data.edge_rows()


def brute(rows, fold_of):
    """Base score and model score of each row, with weights by EM over all held-out tokens, unrounded."""

    def counts(texts):
        one, two = Counter(), Counter()
        for t in texts:
            s = ["<s>", *tokens(t)]
            one.update(s)
            two.update(zip(s, s[1:], strict=False))
        return one, two

    train = [(d, t) for d, t in rows if d is not None and fold_of[d] != 0]
    kept1, kept2 = counts(t for d, t in train if fold_of[d] != 1)
    all1, all2 = counts(t for _, t in train)
    n, v = sum(c for w, c in all1.items() if w != "<s>"), len(all1.keys() - {"<s>"})
    kn, kv = sum(c for w, c in kept1.items() if w != "<s>"), len(kept1.keys() - {"<s>"})
    bucket = lambda c: min(N.CONTEXTS - 1, c.bit_length())
    weights = np.full((N.CONTEXTS, 3), 1 / 3)
    held = []
    for d, t in train:
        if fold_of[d] == 1:
            s = ["<s>", *tokens(t)]
            held += [(bucket(kept1[u]), kept2[u, w] / kept1[u] if kept1[u] else 0.0, kept1[w] / kn, 1 / (kv + 1)) for u, w in zip(s, s[1:], strict=False)]
    k, p = np.array([h[0] for h in held]), np.array([h[1:] for h in held])
    for _ in range(N.ROUNDS):
        part = weights[k] * p
        part /= part.sum(1, keepdims=True)
        total = np.stack([np.bincount(k, part[:, i], N.CONTEXTS) for i in range(3)], 1)
        seen = total.sum(1) > 0
        weights[seen] = (total[seen] + N.PRIOR) / (total[seen] + N.PRIOR).sum(1, keepdims=True)
    for i in range(1, N.CONTEXTS):
        if not (k == i).any():
            weights[i] = weights[i - 1]
    out = []
    for d, t in rows:
        s = ["<s>", *tokens(t)]
        base = sum(math.log10((all1[w] + 0.1) / (n + 0.1 * (v + 1))) for w in s[1:])
        score = 0.0
        for u, w in zip(s, s[1:], strict=False):
            l2, l1, l0 = weights[bucket(all1[u])]
            rest = l1 * all1[w] / n + l0 / (v + 1)
            score += math.log10(l2 * all2[u, w] / all1[u] + rest if all1[u] else rest / (l1 + l0))
        out.append((d, len(s) - 1, sum(all1[w] > 0 for w in s[1:]), n, base, score))
    return out


def test_scores_equal_brute_force(spark):
    rows = corpus(spark)
    docs = data.docs(spark, rows)
    fold_of = {r.doc_id: r.f for r in docs.select("doc_id", crc_mod("doc_id", 10).alias("f")).collect()}
    got = N.score(docs.repartition(3), crc_mod("doc_id", 10) == 0, crc_mod("doc_id", 10) == 1, block_tokens=700, bucket_entries=500).collect()
    want = brute([r[:2] for r in rows], fold_of)
    key = lambda r: (r[0] is None, r[0], r[1])
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    want.sort(key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(abs(g[4] - w[4]) <= 1e-6 * abs(w[4]) for g, w in zip(got, want, strict=True))
    # EM reads probabilities rounded to a sixteenth of a binary logarithm, so its weights differ a little.
    assert all(abs(g[5] - w[5]) <= 0.01 * abs(w[5]) for g, w in zip(got, want, strict=True))


def test_model_beats_the_unigram_base_on_held_out_text(spark):
    phrase = data.words(1, 40)
    rows = [(i, " ".join(phrase[(i + j) % 40] for j in range(30))) for i in range(200)]
    got = [r for r in N.score_corpus(data.docs(spark, rows)).collect() if r.held_out]
    assert got and all(r.score > r.base_score for r in got)


def test_probabilities_sum_to_at_most_one():
    w = N._weights(np.array([[3, -16, -32, 5], [3, 1, -20, 7]]), 10)
    assert np.allclose(w.sum(1), 1) and (w >= 0).all()


def test_edges(spark):
    assert N.score_corpus(data.docs(spark, [])).count() == 0
    got = N.score_corpus(data.docs(spark, data.edge_rows())).collect()
    assert len(got) == len(data.edge_rows())
    none = N.score(data.docs(spark, [(1, "a b"), (2, None)]), F.lit(True), F.lit(False)).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in none} == {(1, 3, 0, 0), (2, 1, 0, 0)}
