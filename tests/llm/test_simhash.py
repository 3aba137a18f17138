import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import simhash
from quillon.llm.components import components
from tests.llm import data


def brute_print(text, k=3):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(nodes, linked):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    return root


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aBé \n\t ", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_print(text)


def test_fingerprint_of_a_long_text_and_of_spark(spark):
    text = data.text(1, 2000)
    assert simhash.fingerprint(text) == brute_print(text)
    one = spark.sql("select xxhash64('a b c') as h").first().h
    assert simhash.fingerprint("a b c") == one % (1 << 64)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def near(seed, n, groups, flips):
    r = random.Random(seed)
    out = set()
    for _ in range(groups):
        base = r.getrandbits(64)
        for _ in range(n):
            x = base
            for b in r.sample(range(64), r.randint(0, flips)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


def check_links(spark, prints, distance, crowd):
    fps = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    found = {(r.a, r.b) for r in simhash.links(fps, distance, crowd).collect()}
    x = np.array(prints, np.uint64)
    close = [(signed(prints[i]), signed(prints[j])) for i, j in zip(*np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= distance), strict=True) if i < j]
    assert all(bin((a ^ b) % (1 << 64)).count("1") <= distance for a, b in found)
    nodes = [signed(p) for p in prints]
    assert brute_roots(nodes, found) == brute_roots(nodes, close)


def test_links_connect_all_within_the_distance(spark):
    for distance in (0, 1, 2):
        check_links(spark, near(1, 6, 30, 3), distance, 24)


def test_crowded_keys_lose_no_link(spark):
    check_links(spark, near(2, 60, 2, 4), 2, 3)
    check_links(spark, near(3, 40, 2, 3), 1, 3)


def test_components_of_a_long_chain(spark):
    n = 60
    order = random.Random(5).sample(range(n), n)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(100, 101), (101, 100), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(n), 0) | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes_and_edges(spark):
    base = data.text(3, 200)
    rows = [*data.edge_rows(), (30, base), (31, base.upper()), (12, base.replace(" ", "\n", 5)), (40, data.text(41, 200))]
    got = {(r.doc_id, r.component_id) for r in simhash.classes(data.docs(spark, rows)).collect()}
    want = {30: 12, 31: 12, 12: 12, 1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 40: 40}
    assert want.items() <= {(d, c) for d, c in got}
    assert simhash.classes(data.docs(spark, rows)).count() == len(rows)
    assert simhash.classes(data.docs(spark, [])).count() == 0


def test_one_of_each_group_stays(spark):
    base = data.text(3, 200)
    docs = data.docs(spark, [(5, base), (2, base), (7, base + " "), (9, data.text(10, 100)), (9, data.text(10, 100)), (None, data.text(11, 100))])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 2, 9]
