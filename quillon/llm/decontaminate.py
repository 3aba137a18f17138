"""Benchmark decontamination with spaced seeds.

A spaced seed hashes the tokens at fixed positions of a window and ignores the others, so it still meets its
counterpart if only ignored tokens were substituted. The seeds below meet in every window of 13 tokens of
which at most two differ. Training and test hashes are joined; around each hit the aligned tokens are
compared, and a text overlaps an item where 13 tokens in a row agree in 80 % or more.

1. The test hashes set bits of a bitmap whose size is bounded, so it may be broadcast. It only keeps hashes
   that cannot meet from being shuffled.
2. One pass over the training texts emits, for texts with hits, the stretches of token hashes around them.
3. Each stretch's different hashes are joined to the test hashes, which gives pairs of a stretch and an item. A stretch
   meets its items in one row; there every diagonal on which a hash meets is verified, once, many at a time. So a text
   that repeats itself costs its length times the item's, and is moved once.

Tokens are runs of ASCII letters and digits and of all other non-ASCII characters, in lower case.

Defined results: null and empty texts and items overlap nothing; items of under 13 tokens must occur whole and
unchanged (those too short for a seed are hashed whole); very long texts are read whole, only the stretches around
hits are kept; of equally long overlaps the one with more agreeing tokens, then the first, is reported; repeated rows
and equal items are each reported; empty tables give no rows; further columns, of whatever names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import few, fresh, materialize, small_batches
from quillon.llm.quality import hash_words

WINDOW, AGREE = 13, 0.8
#: Positions that a seed reads. Together they meet all 13-token windows with up to two substitutions.
SEEDS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SPAN = 8
#: Bits of the bitmap, as a power of two: 8 MB, however many test hashes there are. A hash sets two of them.
BITMAP_BITS = 26
#: Test hashes up to this number are broadcast for the join, more are shuffled.
BROADCAST_ROWS = 100_000
#: Characters of all items up to which they are broadcast for the comparison.
BROADCAST_CHARS = 8 << 20
#: Tokens that are compared at once.
CELLS = 1 << 21

_GAP = np.array([c < 128 and not chr(c).isalnum() for c in range(256)], np.int8)
_STEP = np.uint64(0xBF58476D1CE4E5B9)


def tokens(text: str | None) -> np.ndarray:
    return hash_words((text or "").lower(), _GAP)[0]


def seed_hashes(words: np.ndarray) -> list[np.ndarray]:
    """For each seed the hash of every window."""
    n, out = len(words) - SPAN + 1, []
    for number, seed in enumerate(SEEDS):
        acc = np.full(max(n, 0), number + 1, np.uint64)
        if n > 0:
            for p in seed:
                acc = (acc ^ words[p : p + n]) * _STEP
                acc ^= acc >> np.uint64(32)
        out.append(acc)
    return out


def whole_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of every window of n tokens, for items too short for a seed."""
    acc = np.full(max(len(words) - n + 1, 0), len(SEEDS) + n, np.uint64)
    for p in range(n if len(acc) else 0):
        acc = (acc ^ words[p : p + len(acc)]) * _STEP
        acc ^= acc >> np.uint64(32)
    return acc


def item_hashes(words: np.ndarray) -> list[np.ndarray]:
    """Of an item: its seeds' hashes, or the hash of the whole if it is too short for a seed."""
    return seed_hashes(words) if len(words) >= SPAN else [whole_hashes(words, len(words))][: len(words)]


def meeting_diagonals(ats: np.ndarray, hashes: np.ndarray, n: int, item: np.ndarray) -> np.ndarray:
    """Where the item would begin in a text of n tokens whose hits are at ``ats`` (hashes in order), each place once."""
    met = np.zeros(n + len(item), bool)
    for own in item_hashes(item):
        for at, lo, hi in zip(range(len(own)), np.searchsorted(hashes, own), np.searchsorted(hashes, own, "right"), strict=True):
            if hi > lo:
                met[ats[lo:hi] - at + len(item)] = True
    return np.flatnonzero(met) - len(item)


def best_overlap(doc: np.ndarray, item: np.ndarray, diagonals: np.ndarray) -> tuple[int, int, int, int] | None:
    """Along doc[d + i] against item[i] for each diagonal d: tokens covered by agreeing windows, the best window's
    agreeing tokens, and where the cover begins in the text and in the item; of all diagonals the best."""
    n, m = len(doc), len(item)
    width = min(WINDOW, m)
    need = width if m < WINDOW else int(np.ceil(AGREE * width))
    padded = np.concatenate([np.zeros(m, np.uint64), doc, np.zeros(m, np.uint64)])
    starts, best = np.arange(m - width + 1), None
    step = max(1, CELLS // max(m, 1))
    for lo in range(0, len(diagonals), step):
        d = diagonals[lo : lo + step]
        same = padded[(d + m)[:, None] + np.arange(m)] == item
        sums = np.cumsum(np.pad(same, ((0, 0), (1, 0))), axis=1, dtype=np.int32)
        agree = sums[:, width:] - sums[:, :-width]
        begin = d[:, None] + starts
        agree[(begin < 0) | (begin + width > n)] = 0  # windows that reach out of the text
        good = agree >= need
        some = np.flatnonzero(good.any(1))
        if not len(some):
            continue
        good, agree, d = good[some], agree[some], d[some]
        ends = np.cumsum(np.pad(good, ((0, 0), (width, width - 1))), axis=1, dtype=np.int32)
        covered = (ends[:, width:] > ends[:, :-width]).sum(1)
        first = good.argmax(1)
        most = agree.max(1)
        i = np.lexsort((first, d + first, -most, -covered))[0]
        found = (int(covered[i]), int(most[i]), -int(d[i] + first[i]), -int(first[i]))
        best = found if best is None else max(best, found)
    return None if best is None else (best[0], best[1], -best[2], -best[3])


def _test_hashes(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = tokens(text)
                for hashes in item_hashes(words):
                    out[0] += [item] * len(hashes)
                    out[1] += hashes.view(np.int64).tolist()
                    out[2] += range(len(hashes))
                    out[3] += [len(words)] * len(hashes)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["item_id", "hash", "item_at", "n_item"])

    return items.mapInArrow(run, "item_id long, hash long, item_at long, n_item long")


def _stretches(docs: DataFrame, bitmap, around: int, short: list[int]) -> DataFrame:
    """Rows (doc_id, begin, words, ats, hashes): for texts with hits, the tokens around them. short: lengths of items
    without a seed; of their equal hits in a text the first counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, bits = bitmap.value
        high, low = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        marked = lambda place: marks[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = tokens(text)
                found = []
                for hashes in seed_hashes(words):
                    at = np.flatnonzero(marked(hashes >> high))
                    at = at[marked(hashes[at] & low) == 1]
                    found.append((at, hashes[at]))
                for n in short:
                    hashes, at = np.unique(whole_hashes(words, n), return_index=True)
                    some = (marked(hashes >> high) & marked(hashes & low)) == 1
                    found.append((at[some], hashes[some]))
                at, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, hashes = at[order], hashes[order]
                edges = np.flatnonzero(np.diff(at) > 2 * around) + 1
                for part, own in zip(np.split(at, edges), np.split(hashes, edges), strict=True):
                    begin, end = max(0, int(part[0]) - around), min(len(words), int(part[-1]) + SPAN + around)
                    out[0].append(doc)
                    out[1].append(begin)
                    out[2].append(words[begin:end].tobytes())
                    out[3].append(part.tolist())
                    out[4].append(own.view(np.int64).tolist())
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "begin", "words", "ats", "hashes"])

    return docs.mapInArrow(run, "doc_id long, begin long, words binary, ats array<long>, hashes array<long>")


def _bitmap(test: DataFrame) -> tuple[np.ndarray, int]:
    bits = BITMAP_BITS
    place = F.explode(F.array(F.shiftrightunsigned("hash", 64 - bits), F.col("hash").bitwiseAND(F.lit((1 << bits) - 1))))
    words = test.select(place.alias("place")).selectExpr("shiftright(place, 6) w", "shiftleft(1L, cast(place & 63 as int)) b")
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # 2**20 rows at most
    out = np.zeros(max(1, 1 << (bits - 6)), np.int64)
    out[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64)
    return out.view(np.uint8), bits


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each text and item that overlap: doc_id, item_id, overlap_tokens (covered by agreeing
    windows on the best diagonal), agreeing (tokens in its best window), doc_start and item_start."""
    spark = docs.sparkSession
    small_batches(spark)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    test = materialize(_test_hashes(items))
    rows, longest, short = test.agg(F.count("*"), F.max("n_item"), F.collect_set(F.when(F.col("n_item") < SPAN, F.col("n_item")))).first()
    chars = items.agg(F.sum(F.length("text") + F.lit(64))).first()[0] or 0
    marks = spark.sparkContext.broadcast(_bitmap(test))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = materialize(_stretches(texts, marks, longest or 0, sorted(short or [])).withColumn("stretch", F.monotonically_increasing_id()))
    own = test.select("hash", "item_id").distinct()
    own = F.broadcast(own) if rows <= BROADCAST_ROWS else own
    item = items.where("text is not null").select("item_id", F.col("text").alias("item_text"))
    item = F.broadcast(item) if chars <= BROADCAST_CHARS else item
    pairs = found.select("stretch", F.explode(F.array_distinct("hashes")).alias("hash")).join(own, "hash").select("stretch", F.col("item_id").alias("_item")).distinct()
    pairs = pairs.join(item, F.col("_item").eqNullSafe(F.col("item_id"))).groupBy("stretch").agg(F.collect_list(F.struct("item_id", "item_text")).alias("items"))
    rows_of = found.join(pairs, "stretch").select("doc_id", "begin", "words", "ats", "hashes", "items")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, known = [], {}
            for doc, begin, words, ats, hashes, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, ats, hashes = np.frombuffer(words, np.uint64), np.array(ats, np.int64) - begin, np.array(hashes, np.int64).view(np.uint64)
                order = np.argsort(hashes, kind="stable")
                ats, hashes = ats[order], hashes[order]
                for item in items:
                    text = item["item_text"]
                    if text not in known:
                        known[text] = tokens(text)
                    if got := best_overlap(words, known[text], meeting_diagonals(ats, hashes, len(words), known[text])):
                        out.append((doc, item["item_id"], got[0], got[1], begin + got[2], got[3]))
            columns = zip(*out, strict=True) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    names = ["doc_id", "item_id", "overlap_tokens", "agreeing", "doc_start", "item_start"]
    checked = rows_of.mapInArrow(verify, ", ".join(f"{n} long" for n in names))
    best = F.max(F.struct("overlap_tokens", "agreeing", (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i"))).alias("best")
    return checked.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.overlap_tokens", "best.agreeing", (-F.col("best.d")).alias("doc_start"), (-F.col("best.i")).alias("item_start"))


def keep_unseen(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows whose text overlaps no item, with all their columns. Each text is judged for itself, whatever its id."""
    mark, text = fresh(docs, "text_mark"), F.col("text").cast("string")
    seen = few(overlaps(docs.select(F.xxhash64(text).alias("doc_id"), text.alias("text")), items).select(F.col("doc_id").alias(mark)).distinct())
    return docs.join(seen, F.xxhash64(text) == F.col(mark), "left_anti")
