import itertools
import random
import time

import numpy as np

from quillon.llm import decontaminate as D
from tests.llm import data


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def brute(docs, tests):
    """All pairs with 13 aligned tokens in a row of which 80 % agree; items with fewer whole."""
    out = set()
    for d, text, *_ in docs:
        a = D.tokens(text)
        for i, other in tests:
            b = D.tokens(other)
            width = min(13, len(b))
            if not len(b) or len(a) < width:
                continue
            need = 11 if len(b) >= 13 else width
            if any((a[x : x + width] == b[y : y + width]).sum() >= need for x in range(len(a) - width + 1) for y in range(len(b) - width + 1)):
                out.add((d, i))
    return out


def changed(words, at):
    return [f"zz{i}" if i in at else w for i, w in enumerate(words)]


def test_seeds_meet_all_windows_with_two_substitutions():
    for bad in itertools.combinations(range(D.WINDOW), 2):
        assert any(not {o + p for p in seed} & set(bad) for seed in D.SEEDS for o in range(D.WINDOW - D.SPAN + 1))


def test_pairs_equal_brute_force(spark):
    r = random.Random(1)
    tests = [(i, data.text(100 + i, n)) for i, n in enumerate((40, 25, 13, 12, 9, 7, 60))] + [(20 + n, data.text(300 + n, n)) for n in range(1, 8)] + [(30, "kalo")] + [(50, None), (51, ""), (52, data.text(100, 40))]
    rows = [*data.edge_rows()]
    for n in range(60):
        words = tests[n % 7][1].split()
        words = words if n % 3 else tests[7 + n % 8][1].split()
        a = r.randrange(max(1, len(words) - 8))
        part = words[a : a + r.randint(8, 40)]
        part = changed(part, set(r.sample(range(len(part)), min(len(part), r.randint(0, len(part) // 5 + 1)))))
        rows.append((1000 + n, " ".join([*data.words(n, r.randint(0, 60)), *part, *data.words(n + 500, r.randint(0, 60))])))
    got = {(x.doc_id, x.item_id) for x in D.overlaps(data.docs(spark, rows), items(spark, tests)).collect()}
    want = brute(rows, tests)
    assert got == want and len(want) > 20


def test_joined_and_broadcast_hashes_agree(spark, monkeypatch):
    tests = [(i, data.text(i, 30)) for i in range(5)]
    rows = [(i, data.text(90 + i, 30) + " " + data.text(i % 7, 30)) for i in range(20)]
    some = [sorted(map(tuple, D.overlaps(data.docs(spark, rows), items(spark, tests)).collect()))]
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(D, "BROADCAST_CHARS", 0)
    monkeypatch.setattr(D, "BITMAP_BITS", 9)
    some.append(sorted(map(tuple, D.overlaps(data.docs(spark, rows), items(spark, tests)).collect())))
    assert some[0] == some[1] and {r[0] for r in some[0]} == {i for i in range(20) if i % 7 < 5}


def test_spans(spark):
    item = data.text(1, 40)
    row = D.overlaps(data.docs(spark, [(1, data.text(2, 10) + "\n" + item.upper() + ". " + data.text(3, 9))]), items(spark, [(9, item)])).first()
    assert (row.overlap_tokens, row.agreeing, row.doc_start, row.item_start) == (40, 13, 10, 0)
    assert D.best_overlap(np.arange(20, dtype=np.uint64), np.arange(5, 18, dtype=np.uint64), np.array([5])) == (13, 13, 5, 0)


def test_empty_tables_and_filter(spark):
    item = data.text(1, 30)
    docs = data.docs(spark, [(1, item), (2, data.text(5, 50)), (2, data.text(5, 50)), (None, data.text(6, 50)), (3, None), (None, item), (2, item), (None, None)])
    assert D.overlaps(docs, items(spark, [])).count() == 0
    assert D.overlaps(data.docs(spark, []), items(spark, [(1, item)])).count() == 0
    kept = D.keep_unseen(docs, items(spark, [(7, item)]))
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 2, 2, 3]
    named = docs.selectExpr("*", "1 _seen", "2 TEXT_MARK", "3 item_id", "4 begin")
    kept = D.keep_unseen(named, items(spark, [(7, item)]))
    assert kept.columns == named.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 2, 2, 3]


def test_a_short_item_is_found_whole(spark):
    docs = data.docs(spark, [(1, data.text(1, 40) + " The secret answer is forty-two. " + data.text(2, 40)), (2, "the secret answer is forty three"), (3, "the SECRET answer is forty two"), (4, data.text(3, 30))])
    got = D.overlaps(docs, items(spark, [(1, "the secret answer is forty two"), (2, "a"), (3, "!!"), (4, None)])).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (3, 1)}


def every_overlap(doc, item):
    """The best diagonal, token by token."""
    width = min(D.WINDOW, len(item))
    need = width if len(item) < D.WINDOW else 11
    best = None
    for d in range(-len(item), len(doc)):
        same = [0 <= d + i < len(doc) and doc[d + i] == item[i] for i in range(len(item))]
        inside = [0 <= d + s and d + s + width <= len(doc) for s in range(len(item) - width + 1)]
        agree = [sum(same[s : s + width]) * ok for s, ok in enumerate(inside)]
        good = [s for s, a in enumerate(agree) if a >= need]
        if good:
            covered = len({s + i for s in good for i in range(width)})
            found = (covered, max(agree), -(d + good[0]), -good[0])
            best = found if best is None else max(best, found)
    return best and (best[0], best[1], -best[2], -best[3])


def test_best_overlaps_of_repetitive_texts(spark):
    r = random.Random(5)
    tests = [(i, " ".join(r.choice("ab") for _ in range(n))) for i, n in enumerate((121, 60, 20, 9, 5))] + [(9, "a b c d " * 30)]
    rows = [(i, " ".join(r.choice("ab") for _ in range(n))) for i, n in enumerate((300, 40, 13, 8, 200))] + [(8, "a b c d " * 40), (9, "x " * 30 + "c d a b " * 50)]
    got = {(x.doc_id, x.item_id): (x.overlap_tokens, x.agreeing, x.doc_start, x.item_start) for x in D.overlaps(data.docs(spark, rows), items(spark, tests)).collect()}
    want = {(d, i): found for d, t in rows for i, other in tests if (found := every_overlap(t.split(), other.split()))}
    assert got == want and len(want) > 15


def test_a_very_long_repetitive_text(spark):
    began = time.time()
    got = D.overlaps(data.docs(spark, [(1, "a b c d " * 250_000)]), items(spark, [(i, "a b c d " * 30 + str(i)) for i in range(5)])).collect()
    assert [(r.overlap_tokens, r.agreeing, r.doc_start, r.item_start) for r in got] == [(121, 13, 0, 0)] * 5
    assert time.time() - began < 90
