"""Collocations: contiguous phrases that occur together more often than their parts, mined by pivot partitioning.

Texts are cut into pieces and words, per language. Words that are too rare to be part of a phrase are blanked. Every
other word has a number, smaller for more frequent words, ties by the word; the pivot of an n-gram is its rarest word,
so the one with the largest number. Each occurrence of a word becomes a fragment for that word as pivot: the words
around it, up to the longest phrase, as far as they are more frequent. To the left these must be strictly so, and an
n-gram in which the pivot comes twice belongs to its first occurrence: each occurrence of an n-gram lies in exactly one
fragment. Fragments of one block that are equal are merged, and messages of packed fragments go from blocks to buckets
of pivots. A bucket mines its fragments locally and emits only n-grams that its pivots own.

A pivot of a share s of all words has at most 1 / s more frequent neighbours, so hot words have few different
fragments. Pivots of more than ``BUCKET`` occurrences are nevertheless spread by their fragments' hashes over several
buckets, whose partial counts are added up.

Defined results: a null text counts as empty, a null language as ``und``; very long texts are read whole, repeated rows
and rows with a null id count as often as they occur; an empty table gives no rows; ties of scores go to the more
frequent phrase, then to the smaller one by its bytes; further columns, of whatever names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import BROADCAST_ROWS, few, materialize, small_batches

LEAST, TOP, LONGEST = 10, 2000, 3
#: A phrase goes if a longer one that holds it has this share of its occurrences, in hundredths.
COVERED = 50
#: Words of a block, and fragments of a bucket.
BLOCK, BUCKET = 400_000, 1_000_000
#: Bytes of words that may be broadcast.
WORD_BYTES = 8 << 20
#: Sign that separates pieces once all of their signs are mapped to it.
_BREAK = b"."
_CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + b".,;:!?\x0a\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz" + _BREAK * 10)

_BLOCK_FIELDS = [("block", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("tokens", pa.binary())]
BLOCK_SCHEMA = "block long, lang string, n long, words array<string>, counts array<long>, tokens binary"
_MESSAGE_FIELDS = [("lang", pa.string()), ("bucket", pa.int64()), ("names", pa.binary()), ("often", pa.binary()), ("fragments", pa.binary()), ("times", pa.binary())]
MESSAGE_SCHEMA = "lang string, bucket long, names binary, often binary, fragments binary, times binary"
GRAM_SCHEMA = "lang string, a long, b long, c long, fa long, fb long, fc long, f long"


def _pack(values: np.ndarray) -> bytes:
    """Bytes of equal rank lie together, then zstd."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), 1)


def _unpack(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def words_of(text: str | None) -> list[bytes]:
    """The words, lower-cased, with a break between pieces."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_CLEAN).replace(_BREAK, b" . ").split()


class _Numbers(dict):
    """Numbers words in the order of their first occurrence."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _blocks(docs: DataFrame, size: int) -> DataFrame:
    """(text, lang) as blocks of one language each, numbered words in place of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        waiting: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
        held: dict[str, int] = {}

        def ready(lang: str) -> pa.RecordBatch:
            nonlocal number
            numbers, texts = waiting.pop(lang)
            held.pop(lang)
            tokens = np.concatenate(texts)
            counts = np.bincount(tokens, minlength=len(numbers))
            words = [w.decode("utf-8", "surrogatepass") for w in numbers][1:]
            row = [number, lang, int(counts[1:].sum()), words, counts[1:], _pack(tokens)]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, (_, kind) in zip(row, _BLOCK_FIELDS, strict=True)], [f for f, _ in _BLOCK_FIELDS])

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                numbers, texts = waiting.setdefault(lang, (_Numbers({_BREAK: 0}), []))
                texts.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                texts.append(np.zeros(1, np.uint32))
                held[lang] = held.get(lang, 0) + len(words) + 1
                if held[lang] >= size:
                    yield ready(lang)
                elif sum(held.values()) >= 4 * size:  # however many languages there are
                    yield ready(max(held, key=held.get))
        for lang in sorted(waiting):
            yield ready(lang)

    return docs.mapInArrow(run, BLOCK_SCHEMA)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fragments(tokens: np.ndarray, none: int) -> np.ndarray:
    """For every token that has a neighbour, the row (pivot, left, right, left but one, right but one).

    Tokens are ranks, frequent words first; ``none`` is the rank of blanks and breaks, above all others, and stands
    where a fragment ends."""
    t = np.concatenate([[none, none], tokens, [none, none]])
    p, l1, l2, r1, r2 = t[2:-2], t[1:-3], t[:-4], t[3:-1], t[4:]
    l1 = np.where(l1 < p, l1, none)
    l2 = np.where((l1 < none) & (l2 < p), l2, none)
    r1 = np.where(r1 <= p, r1, none)
    r2 = np.where((r1 < none) & (r2 <= p), r2, none)
    keep = (p < none) & ((l1 < none) | (r1 < none))
    return np.stack([x[keep] for x in (p, l1, r1, l2, r2)])


def merged(rows: np.ndarray, none: int, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different columns of a matrix of numbers up to ``none``, in order, and how often each occurs."""
    base = np.int64(none + 1)
    key = np.zeros(rows.shape[1], np.int64)
    span = 1
    for x in rows:
        if span > 1 and span * int(base) >= 1 << 62:  # then numbers of what is there take the keys' place
            names, key = np.unique(key, return_inverse=True)
            span = len(names)
        key, span = key * base + x, span * int(base)
    _, first, place = np.unique(key, return_index=True, return_inverse=True)
    counts = np.bincount(place, times, len(first)).astype(np.int64) if times is not None else np.bincount(place, minlength=len(first))
    return rows[:, first], counts


def _route(blocks: DataFrame, n_buckets: int, bucket: int) -> DataFrame:
    """Blocks with (at, id, f) of their frequent words, as messages of fragments to the buckets of their pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, tokens, n_words, at, ids, often in zip(*(batch.column(c).to_pylist() for c in ("lang", "tokens", "n_words", "at", "ids", "often")), strict=True):
                if not at:
                    continue
                pa.default_memory_pool().release_unused()
                order = np.argsort(ids, kind="stable")
                ids, often = np.array(ids, np.int64)[order], np.array(often, np.int64)[order]
                none = len(ids)
                rank = np.full(n_words + 1, none, np.int64)
                rank[np.array(at)[order]] = np.arange(none)
                rows, times = merged(fragments(rank[_unpack(tokens, np.uint32)], none), none)
                pivot = rows[0]
                # One fragment always goes to one of its pivot's buckets: the hash is of the neighbours' global numbers.
                known = np.append(ids, -1)
                spread = _mix(_mix(known[rows[1]].astype(np.uint64)) + _mix(known[rows[2]].astype(np.uint64) + np.uint64(1)))
                salt = spread % (1 + often[pivot] // bucket).astype(np.uint64)
                to = (_mix(ids[pivot].astype(np.uint64) + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n_buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                present, starts = np.unique(to[order], return_index=True)
                if not len(present):
                    continue
                out = []
                for b, own in zip(present.tolist(), np.split(order, starts[1:]), strict=True):
                    used, local = np.unique(rows[:, own], return_inverse=True)
                    names = known[used]  # no word, -1, comes last here, as its rank is the largest
                    out.append((lang, b, _pack(names), _pack(np.append(often, 0)[used]), _pack(local.reshape(-1).astype(np.uint32)), _pack(times[own].astype(np.uint32))))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*out, strict=True), _MESSAGE_FIELDS, strict=True)], [f for f, _ in _MESSAGE_FIELDS])

    return blocks.mapInArrow(run, MESSAGE_SCHEMA)


def mine(rows: np.ndarray, times: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The n-grams that the pivots own, of two and of three words, each with its count; 0 stands for no word."""
    p, l1, r1, l2, r2 = rows
    nothing = np.zeros_like(p)
    none = int(rows.max(initial=0))
    out = []
    for parts in ([(l1, p, nothing, l1), (p, r1, nothing, r1)], [(l2, l1, p, l2), (l1, p, r1, np.minimum(l1, r1)), (p, r1, r2, r2)]):
        have = [there > 0 for *_, there in parts]
        grams = np.concatenate([np.stack([x[h] for x in gram]) for (*gram, _), h in zip(parts, have, strict=True)], axis=1)
        out.append(merged(grams, none, np.concatenate([times[h] for h in have])))
    return out


def _grams(messages: DataFrame, least: int, bucket: int) -> DataFrame:
    """(lang, a, b, c, their counts as words, f): those of a pivot that is spread over buckets are still to be added up."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        pa.default_memory_pool().release_unused()
        names = [_unpack(x, np.int64) for x in group["names"]]
        often = np.concatenate([_unpack(x, np.int64) for x in group["often"]])
        ids, first, place = np.unique(np.concatenate([[-1], *names]), return_index=True, return_inverse=True)
        often = np.append(0, often)[first]
        starts = np.cumsum([1, *(len(x) for x in names)])
        rows = np.concatenate([place[s + _unpack(x, np.uint32).reshape(5, -1).astype(np.int64)] for s, x in zip(starts, group["fragments"], strict=False)], axis=1)
        times = np.concatenate([_unpack(x, np.uint32) for x in group["times"]])
        out = []
        for grams, counts in mine(rows, times):
            # The pivot is the rarest word, so the largest number, and counts of words fall with it.
            split = often[grams.max(0)] >= bucket
            keep = split | (counts >= least)
            grams = grams[:, keep]
            a, b, c = ids[grams]
            fa, fb, fc = often[grams]
            out.append(pd.DataFrame({"lang": group["lang"].iloc[0], "a": a, "b": b, "c": c, "fa": fa, "fb": fb, "fc": fc, "f": counts[keep]}))
        return pd.concat(out)

    return messages.groupBy("lang", "bucket").applyInPandas(run, GRAM_SCHEMA)


def counted(docs: DataFrame, least: int = LEAST, block: int = BLOCK, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (lang, word, f, id), totals (lang, n) and n-grams (lang, a, b, c or -1, fa, fb, fc, f) that occur often enough."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    blocks = materialize(_blocks(rows, block))
    totals = materialize(blocks.groupBy("lang").agg(F.sum("n").alias("n")))
    total = totals.agg(F.sum("n")).first()[0] or 0
    seen = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    words = seen.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f")).where(F.col("f") >= least)
    # Sorted into ranges, so later numbers are those of rarer words.
    words = materialize(words.orderBy(F.desc("f"), "lang", "word").withColumn("id", F.monotonically_increasing_id()))
    if (words.agg(F.sum(F.octet_length("word"))).first()[0] or 0) > WORD_BYTES:
        words.known_rows = BROADCAST_ROWS + 1
    asked = blocks.select("block", "lang", F.posexplode("words").alias("at", "word"))
    known = asked.join(few(words), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct((F.col("at") + 1).alias("at"), "id", "f")).alias("w"))
    given = blocks.select("block", "lang", F.size("words").alias("n_words"), "tokens").join(known, "block")
    given = given.select("lang", "tokens", "n_words", F.col("w.at").alias("at"), F.col("w.id").alias("ids"), F.col("w.f").alias("often"))
    messages = _route(given, max(1, -(-total // bucket)), bucket)
    grams = _grams(messages, least, bucket)
    return words, totals, grams.groupBy("lang", "a", "b", "c", "fa", "fb", "fc").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _scores(grams: DataFrame) -> DataFrame:
    """(lang, a, b, c, f, l, r, score) of phrases that no longer one covers, at their lowest-scoring cut."""
    wide = lambda c: f"cast({c} as decimal(16,0))"
    score = lambda l, r: F.expr(f"(cast(1000000 as decimal(7,0)) * ({wide('f')} * {wide('f')})) div ({wide(l)} * {wide(r)})")
    two, three = grams.where("c = -1").select("lang", "a", "b", "fa", "fb", "f"), grams.where("c <> -1")
    head = two.select("a", "b", F.col("f").alias("ab"))
    tail = two.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("f").alias("bc"))
    three = three.join(head, ["a", "b"]).join(tail, ["b", "c"]).withColumn("s1", score("fa", "bc")).withColumn("s2", score("ab", "fc"))
    pick = lambda x, y: F.when(F.col("s1") <= F.col("s2"), F.col(x)).otherwise(F.col(y))
    three = materialize(three.select("lang", "a", "b", "c", "f", pick("fa", "ab").alias("l"), pick("bc", "fc").alias("r"), pick("s1", "s2").alias("score")))
    inside = three.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("c").alias("b")))).alias("g"), "f").groupBy("g.a", "g.b").agg(F.max("f").alias("longer"))
    own = two.join(inside, ["a", "b"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < COVERED * F.col("f")))
    own = own.select("lang", "a", "b", F.lit(-1).cast("long").alias("c"), "f", F.col("fa").alias("l"), F.col("fb").alias("r"), score("fa", "fb").alias("score"))
    return own.unionByName(three)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    words, totals, grams = counted(docs, least, block, bucket)
    scored = materialize(_scores(materialize(grams)))
    # Scores are whole numbers up to a million, so there are few rows that say from which one on a language has its best.
    per = scored.groupBy("lang", "score").agg(F.count("*").alias("k"))
    above = F.sum("k").over(Window.partitionBy("lang").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    bar = per.withColumn("above", F.coalesce(above, F.lit(0))).where(F.col("above") < top).groupBy("lang").agg(F.min("score").alias("bar"))
    best = scored.join(few(bar), "lang").where(F.col("score") >= F.col("bar"))
    for c in ("a", "b", "c"):
        spelt = words.select(F.col("id").alias(c), F.col("word").alias(f"w{c}"))
        best = best.join(spelt, c, "left" if c == "c" else "inner")
    best = best.select("lang", F.concat_ws(" ", "wa", "wb", "wc").alias("phrase"), F.col("f").alias("a"), "l", "r", "score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.join(few(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
