"""Codebooks against plain rounds of Lloyd in Python's integers."""

import hashlib
import math

import numpy as np
import pytest

from quillon.llm import codebooks as C

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, "clash", -1) for i, v, lab in rows], SCHEMA)


def brute(rows, entries=C.ENTRIES, rounds=C.ROUNDS, parts=C.PARTS):
    whole = [(i, v, lab) for i, v, lab in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    scaled = [(i, [min(max(math.floor(256 * float(np.float32(x))), -C.MOST), C.MOST) for x in v], lab) for i, v, lab in whole]
    ordered = sorted((r for r in scaled if r[0] is not None), key=lambda r: (r[0], r[1]))
    dim = len((ordered or sorted(scaled, key=lambda r: r[1]))[0][1])
    scaled, ordered = [r for r in scaled if len(r[1]) == dim], [r for r in ordered if len(r[1]) == dim]
    width = dim // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in ordered[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            given = {}
            for _, v, _ in scaled:
                given.setdefault(near(cut(v, p), book)[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*given[e], strict=True)] if e in given else entry for e, entry in enumerate(book)]
    out, sums = [], {}
    for i, v, lab in scaled:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        sums[lab] = sums.get(lab, 0) + error
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, lab))
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(((i, code, error, sums[lab], digest) for i, code, error, lab in out), key=str)


def found(spark, rows, **more):
    return sorted((tuple(r) for r in C.codes(table(spark, rows), **more).collect()), key=str)


def test_codes_equal_plain_lloyd(spark):
    r = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in np.float32(r.normal(0, 0.1, 32))], int(i % 3) or None) for i in r.permutation(300)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, entries=10, rounds=4) == brute(rows, entries=10, rounds=4)


def test_ties_repeats_and_unused_entries(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) / 256 for x in r.integers(-2, 3, 16)], 1) for i in range(200)]  # many equal distances
    rows += rows[:40] + [(5, [0.0] * 16, None), (200, [1000.0] * 16, None), (201, [-1000.0] * 16, 2)]
    assert found(spark, rows, rounds=3) == brute(rows, rounds=3)


def test_edges(spark):
    good = [(i, [i / 7 - 1.0] * 16, None) for i in range(9)]
    bad = [(-1, None, 1), (-2, [], 1), (-3, [1.0] * 15 + [None], 1), (-4, [float("nan")] * 16, 1), (-5, [float("inf")] + [0.0] * 15, 1), (-6, [1.0] * 17, 1), (50, [1.0] * 32, 1)]
    odd = [(None, [0.5] * 16, 4), (7, [3e38] * 16, 5), (8, [-70000.0] * 16, 5)]
    rows = good + bad + odd
    want = brute(rows)
    assert len(want) == 12
    assert found(spark, rows) == want
    assert found(spark, bad[:6]) == [] and found(spark, []) == []
    assert found(spark, [(None, [0.5] * 16, 4)])[0][1] == "00" * 16
    with pytest.raises(ValueError):
        C.codes(table(spark, good), entries=300)


def test_bounds_skip_groups_and_hold(spark):
    r = np.random.default_rng(3)
    centres = r.normal(0, 1, (8, 64))
    rows = [(i, [float(x) for x in np.float32(centres[i % 8] + r.normal(0, 0.02, 64))], 0) for i in range(600)]
    blocks, books = C.fit(table(spark, rows))
    assert C.scanned_share(blocks, books) < 0.6
    x, entries = r.integers(-300, 300, (400, 4)), r.integers(-300, 300, (64, 4))
    group = C.grouped(entries)
    own, bounds, _ = C.first_bounds(x, entries, group)
    for _ in range(4):
        moved = entries + r.integers(-15, 16, entries.shape)
        own, bounds, scanned = C.next_bounds(x, moved, entries, group, own, bounds)
        entries = moved
        far = C.squared(x, entries)
        assert (own == far.argmin(1)).all() and scanned < far.size
        far = np.sqrt(far.astype(float))
        far[np.arange(len(x)), own] = np.inf
        assert all((bounds[:, g] <= far[:, group == g].min(1)).all() for g in range(group.max() + 1))
    big = r.integers(-C.MOST, C.MOST, (50, 8))
    exact = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(x, c, strict=True)) for c in big[:9]] for x in big])
    assert (C.squared(big, big[:9]) == exact).all()
