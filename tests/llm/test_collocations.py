"""Collocations against counts of all phrases; fragments against every n-gram's rarest word."""

import re
from collections import Counter

import numpy as np

from quillon.llm import collocations as C
from tests.llm.data import docs, edge_rows, text


def brute(rows, least, top=C.TOP):
    """rows: (text, lang)."""
    f, n = {}, Counter()
    for t, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        scored = []
        for g, a in found.items():
            if any(len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h))) and 100 * b >= 50 * a for h, b in found.items()):
                continue
            cuts = [(1_000_000 * a * a // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g))]
            score, _, left, right = min(cuts)
            scored.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, g, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, g.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def found(spark, rows, least=3, **more):
    frame = C.collocations(docs(spark, [(i, t, lang) for i, (t, lang) in enumerate(rows)]), least=least, **more)
    return sorted(tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def chatter(seed, n, kinds=12):
    """Few different words, so that phrases, and words next to themselves, come often."""
    r = np.random.default_rng(seed)
    return "".join(f"w{min(int(x), kinds)}" + r.choice([" ", " ", " ", "\t", ". ", ",", "\n", " ! "]) for x in r.zipf(1.5, n))


def test_phrases_equal_counts_of_all(spark):
    rows = [(chatter(i, 300), "ya" if i % 3 else "xa") for i in range(9)] + [("New York, new YORK! new york", "xa"), ("a a a a a a", None), ("É é b É é b É é b", None)]
    want = brute(rows, 3)
    assert len(want) > 100 and any(r[0] == "und" for r in want)
    assert found(spark, rows) == want
    # Small blocks and buckets: messages of many blocks, pivots spread over several buckets.
    assert found(spark, rows, block=50, bucket=20) == want


def test_best_rows_only_and_ties(spark):
    rows = [("a b. c d. e f. g h. i j. " * 4, "xa"), ("k l. " * 9, "xa")]
    want = brute(rows, 3, top=3)
    assert [r[2] for r in want] == ["k l", "a b", "c d"]
    assert found(spark, rows, top=3) == want


def test_edges(spark):
    rows = [(r[1], r[2] if len(r) > 2 else "xa") for r in edge_rows()] + [("x" * 300_000 + " y. " + text(1, 20_000), "xa"), ("in one word\x1cstays " * 5, "ya")] + [("same words here", "xa")] * 4
    assert found(spark, rows) == brute(rows, 3)
    assert found(spark, []) == []
    assert found(spark, [(None, None), ("", "xa")]) == []


def test_large_counts_are_exact(spark):
    f, big = 3_000_000_007, 3_000_000_019  # the product of three such numbers passes 64 bits
    grams = spark.createDataFrame([("xa", 1, 2, -1, big, big + 2, 0, f)], "lang string, a long, b long, c long, fa long, fb long, fc long, f long")
    row = C._scores(grams).first()
    assert (row.score, row.l, row.r) == (1_000_000 * f * f // (big * (big + 2)), big, big + 2)


def test_every_n_gram_lies_in_one_fragment_of_its_rarest_word():
    r = np.random.default_rng(3)
    tokens = np.minimum(r.zipf(1.3, 4000), 30)
    none = 31
    tokens[r.random(4000) < 0.1] = none
    rows = C.fragments(tokens, none)
    shifted = np.where(rows == none, 0, rows + 1)  # 0: no word
    times = np.ones(rows.shape[1], np.int64)
    got = {}
    for grams, counts in C.mine(shifted, times):
        for g, c in zip(grams.T.tolist(), counts.tolist(), strict=True):
            got[tuple(x - 1 for x in g if x)] = c
    want = Counter()
    for k in (2, 3):
        for i in range(len(tokens) - k + 1):
            g = tuple(tokens[i : i + k].tolist())
            if none not in g:
                want[g] += 1
    assert got == dict(want)
    assert all((rows[i][rows[i] < none] <= rows[0][rows[i] < none]).all() for i in range(5))
    small, counts = C.merged(rows, none)
    assert counts.sum() == rows.shape[1] and small.shape[1] < rows.shape[1]
