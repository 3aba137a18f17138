import random

import corpus_pipeline
import pyarrow as pa
from quillon.llm import common, neardup, simhash
from tests.llm import data
from tests.llm.test_simhash import brute_roots


def brute_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_similar(x, y):
    return not x and not y or 5 * len(x & y) >= 4 * len(x | y)


def rows():
    """Groups of texts with a few words replaced, some similar only over others, sizes from 1 word on."""
    out, r = [], random.Random(4)
    for group, n in enumerate((1, 3, 6, 9, 14, 20, 30, 45, 60, 90, 150, 400, 900)):
        base = [f"{w}{i}" for i, w in enumerate(data.words(group, n))]
        for copy in range(9):
            words = list(base)
            for _ in range(r.randint(0, max(1, n // 25))):
                words[r.randrange(n)] = f"new{r.randrange(10**6)}"
            out.append((100 * group + copy, " ".join(words[: n - r.randint(0, n // 12)])))
    # One common line in texts that are else unlike each other, and no text at all.
    line = data.text(77, 30)
    return out + [(5000 + i, data.text(800 + i, 30) + " " + line) for i in range(60)] + [(6000, None), (6001, ""), (6002, " \n")]


def test_all_similar_texts_are_linked(spark, monkeypatch):
    table = rows()
    sets = {d: brute_set(t) for d, t in table}
    pairs = [(a, b) for a in sets for b in sets if a < b and brute_similar(sets[a], sets[b])]
    far = [p for p in pairs if (simhash.fingerprint(dict(table)[p[0]]) ^ simhash.fingerprint(dict(table)[p[1]])).bit_count() > 2]
    assert len(far) > 20
    roots = brute_roots(list(sets), pairs)
    for crowd, cell in ((neardup.CROWD, neardup.CELL), (2, neardup.CELL), (2, 3)):
        monkeypatch.setattr(neardup, "CELL", cell)
        got = {r.doc_id: r.component_id for r in neardup.classes(data.docs(spark, table).repartition(3), crowd).collect()}
        assert got == roots


def test_joins_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    table = [r for r in rows() if r[0] % 100 < 6]
    sets = {d: brute_set(t) for d, t in table}
    pairs = [(a, b) for a in sets for b in sets if a < b and brute_similar(sets[a], sets[b])]
    kept = neardup.keep_one(data.docs(spark, table), 2).collect()
    assert sorted(r.doc_id for r in kept) == sorted(d for d, root in brute_roots(list(sets), pairs).items() if d == root)


def test_similar_sets_share_a_key():
    r = random.Random(9)
    for n in (1, 2, 4, 5, 9, 10, 20, 50, 200, 1000, 5000):
        for _ in range(60):
            x = {r.getrandbits(64) for _ in range(n)}
            y = set(x)
            gone = r.randint(0, n // 5)
            y -= set(r.sample(sorted(y), gone))
            while 5 * len(x & y) >= 4 * (len(x | y) + 1) and r.random() < 0.9:
                y.add(r.getrandbits(64))
            a, b = (neardup.np.array(sorted(s), neardup.np.uint64) for s in (x, y))
            assert neardup.similar(a, b) == (5 * len(x & y) >= 4 * len(x | y))
            if neardup.similar(a, b):
                assert set(neardup.keys(a).tolist()) & set(neardup.keys(b).tolist())


def test_edges(spark):
    base = data.text(3, 200)
    docs = data.docs(spark, [*data.edge_rows(), (30, base), (12, base.upper())])
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 4, 5, 6, 7, 8, 9, 12]
    assert neardup.keep_one(data.docs(spark, [])).count() == 0


def test_equal_ids_are_told_by_their_texts(spark):
    a, b = data.text(1, 80), data.text(2, 80)
    docs = data.docs(spark, [(1, a), (5, a), (5, b), (6, b), (5, b)]).selectExpr("*", "1 copy_id", "2 copy_mark", "3 COPY_ID_")
    for keep in (neardup.keep_one, simhash.keep_one):
        kept = keep(docs)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, a), (5, b)]


def test_the_stage_drops_copies_that_differ_in_many_bits(spark):
    words = data.words(3, 300)
    near = [*words[:40], "other", *words[41:150], "another", *words[151:]]
    texts = {1: " ".join(words), 2: " ".join(near), 3: data.text(5, 300)}
    assert brute_similar(brute_set(texts[1]), brute_set(texts[2]))
    assert (simhash.fingerprint(texts[1]) ^ simhash.fingerprint(texts[2])).bit_count() > 2
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert sorted(r.doc_id for r in stage(spark, data.docs(spark, texts.items()), "").collect()) == [1, 3]


def test_keys_are_read_a_few_at_a_time():
    r = neardup.np.random.default_rng(1)
    key = neardup.np.sort(r.integers(0, 400, 5000))
    node = neardup.np.concatenate([neardup.np.sort(r.integers(0, 30, n)) for n in neardup.np.unique(key, return_counts=True)[1]])
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + 70]), pa.array(node[i : i + 70]), pa.array(node[i : i + 70])], ["key", "node", "size"]) for i in range(0, 5000, 70)]
    parts = list(neardup._whole_keys(iter(batches)))
    assert max(len(p[0]) for p in parts) < 200 and len(parts) > 40
    got = [pair for p in parts for pair in zip(p[0].tolist(), p[1].tolist(), strict=True)]
    assert got == sorted(set(zip(key.tolist(), node.tolist(), strict=True)))
    assert all(a[0][-1] != b[0][0] for a, b in zip(parts, parts[1:], strict=False))
    assert list(neardup._whole_keys(iter([]))) == []


def test_cells_hold_few_sets_and_every_pair_of_close_sizes_once(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL", 20)
    r = random.Random(3)
    sets = [(7, i, i, r.choice([1, 2, 4, 5, 10, 80, 100, 125, 126, 1000]), bytes(neardup.BUCKETS // 8)) for i in range(200)]
    cells = neardup._cells(spark.createDataFrame(sets, "key long, set_id long, root long, size long, sketch binary"))
    rows = sorted(cells.collect(), key=lambda x: (x["cell"], x["set_id"]))
    assert max(sum(x["cell"] == c for x in rows) for c in {x["cell"] for x in rows}) <= 80
    columns = [pa.array([x[c] for x in rows]) for c in ("cell", "set_id", "root", "size", "sketch", "own", "block", "alone")]
    pairs = [pair for b in neardup._across(iter([pa.RecordBatch.from_arrays(columns, list("abcdefgh"))])) for pair in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    size = {i: n for _, i, _, n, _ in sets}
    want = {(a, b) for a in size for b in size if a < b and abs(size[a] - size[b]) <= (size[a] + size[b]) // 9}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
