import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillon.llm import packing
from tests.llm import data

PATHS = [public_tokenizers.path(f"byte_bpe_50k.{k}") for k in ("json", "tiktoken")]


@pytest.fixture(scope="module")
def slow():
    return Tokenizer.from_file(PATHS[0])


@pytest.fixture(scope="module")
def fast():
    return packing.Encoder(*PATHS, public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=60), st.text(alphabet="ab' \nst1é. \x85\x1c\t", max_size=60)))
def test_ids_equal_the_tokenizers_library(slow, fast, text):
    assert fast(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_special_strings_and_long_texts(slow, fast):
    for text in ("a<|endoftext|>b", data.text(1, 5000), "x" * 5000, "it's\nwe'll  go", " lead", "trail\n"):
        assert fast(text).tolist() == slow.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 1023), max_size=60))
def test_sequences_fill_without_gap_and_with_little_padding(lengths):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for piece, start, n, s, offset in packing.fill(np.array(lengths, np.int64)):
        assert n > 0
        pieces[piece].append((start, n))
        sequences[s].append((offset, n))
    for i, n in enumerate(lengths):
        at = 0
        for start, m in sorted(pieces[i]):
            assert start == at
            at += m
        assert at == n
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
        padding += 1024 - at if at & (at - 1) else 0
    assert padding <= 512 + sum(lengths) // 50


def test_cost_is_balanced():
    lengths = np.array([1000] * 20 + [24] * 20 + [512] * 40)
    parts = packing.fill(lengths)
    assert all(n == lengths[p] for p, _, n, _, _ in parts)


def brute(lengths):
    """Every choice by looking at all sequences; what needs more than three parts comes last, as (piece, length)."""
    sizes = packing._sizes(int(lengths.sum()), 1024)
    free, cost, out, rest = dict(enumerate(sizes)), dict.fromkeys(range(len(sizes)), 0.0), [], []
    for p in np.argsort(-lengths, kind="stable").tolist():
        n, plan, used = int(lengths[p]), [], set()
        roomy = [s for s in free if free[s] >= n]
        if roomy:
            plan = [(min(roomy, key=lambda s: (cost[s], s)), n)]
        left = 0 if roomy else n
        while left and len(plan) < 3 and any(free[s] for s in free if s not in used):
            gaps = {s: f for s, f in free.items() if f and s not in used}
            best = min((f for f in gaps.values() if f >= left), default=max(gaps.values()))
            s = min((s for s in gaps if gaps[s] == best), key=lambda s: (cost[s], s))
            plan.append((s, min(left, best)))
            used.add(s)
            left -= min(left, best)
        if left:
            rest.append((p, n))
            continue
        start = 0
        for s, m in plan:
            out.append((p, start, m, s, sizes[s] - free[s]))
            free[s] -= m
            cost[s] += m + packing.QUADRATIC * m * m
            start += m
    return out, rest, free


@pytest.mark.parametrize("seed", range(4))
def test_lowest_cost_with_room_and_few_cuts(seed):
    r = np.random.default_rng(seed)
    lengths = [np.minimum(1023, r.lognormal(5, 1, 2500).astype(np.int64) + 1), r.integers(1, 1024, 400), r.integers(1, 30, 300), np.sort(r.integers(1, 1024, 500))][seed]
    parts = packing.fill(lengths)
    out, rest, free = brute(lengths)
    assert parts[: len(out)] == out
    assert padded(parts) <= packing.PADDED * lengths.sum() + 512
    assert sorted({p for p, *_ in parts[len(out) :]}) == sorted(p for p, _ in rest)
    times = np.bincount([p for p, *_ in parts])
    assert (times > 3).sum() <= 3 and (times > 1).mean() < 0.4
    gaps = sum(f for s, f in free.items() if s < lengths.sum() // 1024)
    assert gaps <= 0.005 * lengths.sum()


def padded(parts):
    ends = defaultdict(int)
    for _, _, n, s, _ in parts:
        ends[s] += n
    return sum(1024 - n for n in ends.values() if n & (n - 1))


@pytest.mark.parametrize("lengths", [[900] * 1000 + [400] * 1000, [600] * 2000, [924] * 1000, [1000] * 300 + [700] * 300 + [30] * 50, [513] * 777, [1023] * 500, [341] * 999 + [342] * 999, [600, 900], [5] * 2000 + [1020] * 800])
def test_padding_is_bounded_for_any_lengths(lengths):
    lengths = np.array(lengths, np.int64)
    parts = packing.fill(lengths)
    assert padded(parts) <= packing.PADDED * lengths.sum() + 1024
    own, sequences = defaultdict(list), defaultdict(list)
    for piece, start, n, s, offset in parts:
        own[piece].append((start, n))
        sequences[s].append((offset, n))
    for spans in [*own.values(), *sequences.values()]:
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip([(0, 0), *spans], spans, strict=False))
    assert [sum(n for _, n in own[i]) for i in range(len(lengths))] == lengths.tolist()
    assert max(sum(n for _, n in s) for s in sequences.values()) <= 1024


def test_edges(spark, slow):
    rows = data.edge_rows()
    got = packing.pack(data.docs(spark, rows).repartition(3), *PATHS, public_tokenizers.PATTERN, buffer=3000).collect()
    sequences = defaultdict(int)
    for r in got:
        sequences[r.sequence_id] += r.length
    assert max(sequences.values()) <= 1024
    total = 0
    for doc, text, *_ in {(r[0], r[1]) for r in rows}:
        ids = [*slow.encode(text or "", add_special_tokens=False).ids, 0]
        copies = sum(r[:2] == (doc, text) for r in rows)
        own = [r for r in got if r.doc_id == doc]
        assert sum(r.length for r in own) == copies * len(ids)
        total += copies * len(ids)
        for r in own:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert sum(sequences.values()) == total
    assert packing.pack(data.docs(spark, []), *PATHS, public_tokenizers.PATTERN).count() == 0
