"""Bigram language model by deleted interpolation, trained on and applied to a whole corpus.

P(w | u) = l2[k] c(u, w) / c(u) + l1[k] c(w) / N + l0[k] / (V + 1), where k buckets the context u by its
frequency c(u). One fold of the training texts is deleted from the counts and the weights l[k] maximise its
likelihood, found by expectation-maximisation; then the deleted fold's counts are added back.

All counts stay distributed. The corpus is cut into blocks of about half a million tokens, each stored compactly
(token numbers and word hashes). A block asks for the counts of its distinct words and bigrams: it sends their
sorted 64-bit hashes with its own counts, cut by hash range into buckets. Each bucket adds up what all blocks
sent, and answers each block with the totals, in the order asked. So a word, however frequent, is one entry
per block. A block asks only buckets for which it has entries, so messages never outnumber entries and what is moved
grows with the corpus; from some 10^9 tokens on, where buckets outnumber the entries of a block by and by, a message
holds few entries and costs more bytes for each.

Defined results: a null text counts as empty (its one token is the end); very long texts are scored whole; rows with a
null id are scored but not learned from; repeated rows are counted as often as they occur; ties cannot occur; with
nothing to learn from, the model is uniform; an empty table gives no rows; further columns, of whatever names, are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import crc_mod, materialize, small_batches

#: Tokens of a block and entries of a bucket; both bound the memory of a task.
BLOCK_TOKENS, BUCKET_ENTRIES = 500_000, 1_000_000
#: Context-frequency buckets: 0, 1, 2-3, 4-7, ... and from 2**14 on.
CONTEXTS = 16
#: Rounds of EM, and tokens that each component is taken to have explained beforehand, so no weight vanishes.
ROUNDS, PRIOR = 60, 0.5
HELD, DELETED, KEPT = 0, 1, 2
START, END = np.uint64(1), np.uint64(2)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Steps of the logarithm to which held-out probabilities are rounded before EM.
_FINE = 16

BLOCK_SCHEMA = "block long, kind int, ids array<long>, lengths array<int>, n_tokens long, n_pairs long, words binary, tokens binary"
ASK_SCHEMA = "bucket long, block long, kind int, words binary, word_counts binary, pairs binary, pair_counts binary"
REPLY_SCHEMA = "block long, bucket long, words binary, pairs binary, vocabulary long, kept_vocabulary long"
OUT_SCHEMA = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _shrink(values: np.ndarray) -> bytes:
    """Bytes of equal rank lie together, then zstd."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), 1)


def _grow(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _shrink_sorted(values: np.ndarray) -> bytes:
    return _shrink(np.diff(values, prepend=np.uint64(0)))


def _grow_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_grow(data, np.uint64), dtype=np.uint64)


def tokens_of(text: str | None) -> np.ndarray:
    """Hashes of the words, then the end."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Block:
    """A block's texts, decoded, with its distinct words and bigrams."""

    def __init__(self, words: bytes, tokens: bytes, lengths):
        self.words, self.tokens = _grow_sorted(words), _grow(tokens, np.uint32).astype(np.int64)
        self.starts = np.cumsum(np.append(0, np.asarray(lengths, np.int64)))[:-1]
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = np.searchsorted(self.words, START)
        self.before = before
        pairs, place, self.pair_counts = np.unique(before * len(self.words) + self.tokens, return_inverse=True, return_counts=True)
        hashes = _pair_hash(self.words[pairs // len(self.words)], self.words[pairs % len(self.words)])
        order = np.argsort(hashes, kind="stable")
        self.pairs, self.pair_counts = hashes[order], self.pair_counts[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.place = rank[place]
        self.word_counts = np.bincount(self.tokens, minlength=len(self.words))
        self.word_counts[np.searchsorted(self.words, START)] = len(self.starts)


def blocks(docs: DataFrame, size: int = BLOCK_TOKENS) -> DataFrame:
    """Rows of doc_id, text and kind as blocks of one kind each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        waiting: dict[int, tuple[list, list]] = {}

        def ready(kind: int) -> pa.RecordBatch:
            nonlocal number
            ids, texts = waiting.pop(kind)
            words, tokens = np.unique(np.concatenate([*texts, [START]]).astype(np.uint64), return_inverse=True)
            tokens = tokens[:-1]
            row = [number, kind, ids, [len(t) for t in texts], len(tokens), len(tokens), _shrink_sorted(words), _shrink(tokens.astype(np.uint32))]
            number += 1
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [f.split()[0] for f in BLOCK_SCHEMA.split(", ")])

        held: dict[int, int] = {}
        for batch in batches:
            for doc, text, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, texts = waiting.setdefault(kind, ([], []))
                ids.append(doc)
                texts.append(tokens_of(text))
                held[kind] = held.get(kind, 0) + len(texts[-1])
                if held[kind] >= size:
                    held[kind] = 0
                    yield ready(kind)
        for kind in sorted(waiting):
            yield ready(kind)

    return docs.mapInArrow(run, BLOCK_SCHEMA)


def _ask(stored: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in ASK_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
        for batch in batches:
            for row in batch.to_pylist():
                pa.default_memory_pool().release_unused()
                b = Block(row["words"], row["tokens"], row["lengths"])
                of = [x >> np.uint64(64 - bits) for x in (b.words, b.pairs)]
                present = np.union1d(*of)
                at = [(np.searchsorted(x, present), np.searchsorted(x, present, "right")) for x in of]
                out = []
                for i, bucket in enumerate(present.tolist()):
                    w, p = (slice(lo[i], hi[i]) for lo, hi in at)
                    out.append((bucket, row["block"], row["kind"], _shrink_sorted(b.words[w]), _shrink(b.word_counts[w].astype(np.uint32)), _shrink_sorted(b.pairs[p]), _shrink(b.pair_counts[p].astype(np.uint32))))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return stored.select("block", "kind", "lengths", "words", "tokens").mapInArrow(run, ASK_SCHEMA)


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """Adds up a bucket's counts and answers every block in the order it asked: all counts, then the kept ones."""
    pa.default_memory_pool().release_unused()  # a worker that is kept between tasks would hold what Arrow has freed
    answers: list[list[bytes]] = []
    vocabulary = kept_vocabulary = 0
    for hashes, counts in (("words", "word_counts"), ("pairs", "pair_counts")):
        asked = [_grow_sorted(x) for x in group[hashes]]
        own = np.concatenate([_grow(x, np.uint32) for x in group[counts]]).astype(np.int64)
        kind = np.repeat(group["kind"].to_numpy(), [len(x) for x in asked])
        names, place = np.unique(np.concatenate(asked), return_inverse=True)
        kept = np.bincount(place, own * (kind == KEPT), len(names)).astype(np.int64)
        full = kept + np.bincount(place, own * (kind == DELETED), len(names)).astype(np.int64)
        if hashes == "words":
            real = names != START
            vocabulary, kept_vocabulary = int((full[real] > 0).sum()), int((kept[real] > 0).sum())
        ends = np.cumsum([len(x) for x in asked])
        answers.append([_shrink(np.concatenate([full[p], kept[p]])) for p in np.split(place, ends[:-1])])
    out = pd.DataFrame({"block": group["block"], "bucket": group["bucket"], "words": answers[0], "pairs": answers[1], "vocabulary": 0, "kept_vocabulary": 0})
    out.iloc[0, 4:] = [vocabulary, kept_vocabulary]
    return out


def _counts(row: pd.Series, replies: pd.DataFrame) -> tuple[Block, np.ndarray, np.ndarray]:
    """The block with (all, kept) counts of its words and of its bigrams."""
    pa.default_memory_pool().release_unused()
    b = Block(row["words"], row["tokens"], row["lengths"])
    replies = replies.sort_values("bucket")
    both = []
    for name in ("words", "pairs"):
        parts = [_grow(x, np.int64).reshape(2, -1) for x in replies[name]]
        both.append(np.concatenate(parts, axis=1))
    return b, both[0], both[1]


def _context(counts: np.ndarray) -> np.ndarray:
    """0 for 0, else one more than the position of the highest bit, up to the last bucket."""
    return np.minimum(np.frexp(counts.astype(np.float64))[1], CONTEXTS - 1)


def _weights(cells: np.ndarray, vocabulary: int) -> np.ndarray:
    """EM on cells (context, rounded log2 of the bigram and of the word probability, how many). Rows: contexts."""
    weights = np.full((CONTEXTS, 3), 1 / 3)
    if not len(cells):
        return weights
    # A cell's probability is the rounded one; a logarithm above zero stands for probability zero.
    p = np.stack([np.where(cells[:, i] > 0, 0.0, np.exp2(cells[:, i] / _FINE)) for i in (1, 2)] + [np.full(len(cells), 1 / (vocabulary + 1))], 1)
    k, n = cells[:, 0], cells[:, 3].astype(np.float64)
    for _ in range(ROUNDS):
        part = weights[k] * p
        part *= (n / part.sum(1))[:, None]
        total = np.stack([np.bincount(k, part[:, i], CONTEXTS) for i in range(3)], 1)
        seen = total.sum(1) > 0
        weights[seen] = (total[seen] + PRIOR) / (total[seen] + PRIOR).sum(1, keepdims=True)
    for i in range(1, CONTEXTS):  # a context bucket without held-out tokens takes the weights of the one below
        if not (k == i).any():
            weights[i] = weights[i - 1]
    return weights


def score(docs: DataFrame, held_out: Column, deleted: Column, block_tokens: int = BLOCK_TOKENS, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score and train_tokens per row.

    held_out rows are not learned from; deleted rows are the fold on which the weights are learned.
    """
    small_batches(docs.sparkSession)
    known = F.col("doc_id").isNotNull()
    kind = F.when(~known | F.coalesce(held_out, F.lit(True)), HELD).when(deleted, DELETED).otherwise(KEPT)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), kind.alias("kind"))
    stored = materialize(blocks(rows, block_tokens))
    sums = stored.agg(F.sum(F.when(F.col("kind") != HELD, F.col("n_tokens"))).alias("n"), F.sum(F.when(F.col("kind") == KEPT, F.col("n_tokens"))).alias("kept"), F.sum("n_tokens").alias("all")).first()
    total, kept_total = sums["n"] or 0, sums["kept"] or 0
    bits = max(3, (max(1, (sums["all"] or 0) // bucket_entries)).bit_length())
    replies = materialize(_ask(stored, bits).groupBy("bucket").applyInPandas(_answer, REPLY_SCHEMA))
    vocabulary, kept_vocabulary = (x or 0 for x in replies.agg(F.sum("vocabulary"), F.sum("kept_vocabulary")).first())

    def cells(one: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        b, words, pairs = _counts(one.iloc[0], answers)
        above = words[1][b.before]
        with np.errstate(divide="ignore", invalid="ignore"):
            p = [np.log2(pairs[1][b.place] / above), np.log2(words[1][b.tokens] / max(kept_total, 1))]
        rounded = [np.where(np.isfinite(x), np.round(x * _FINE), 1).astype(np.int64) for x in p]
        out, n = np.unique(np.stack([_context(above), *rounded], 1), axis=0, return_counts=True)
        return pd.DataFrame({"k": out[:, 0], "two": out[:, 1], "one": out[:, 2], "n": n})

    pick = ["block", "ids", "lengths", "words", "tokens"]
    fold = stored.where(F.col("kind") == DELETED).select(*pick)
    asked = replies.join(F.broadcast(fold.select("block")), "block", "left_semi") if fold.count() < 100_000 else replies
    held = fold.groupBy("block").cogroup(asked.groupBy("block")).applyInPandas(lambda a, b: cells(a, b) if len(a) else pd.DataFrame({"k": [], "two": [], "one": [], "n": []}, dtype="int64"), "k long, two long, one long, n long")
    got = held.groupBy("k", "two", "one").agg(F.sum("n").alias("n")).toPandas()
    weights = _weights(got.sort_values(["k", "two", "one"]).to_numpy(np.int64).reshape(-1, 4), kept_vocabulary)

    def run(one: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = one.iloc[0]
        b, words, pairs = _counts(row, answers)
        c, above, both = words[0][b.tokens], words[0][b.before], pairs[0][b.place]
        base = np.log10((c + 0.1) / (total + 0.1 * (vocabulary + 1)))
        w = weights[_context(above)]
        p = w[:, 0] * both / np.maximum(above, 1) + w[:, 1] * c / max(total, 1) + w[:, 2] / (vocabulary + 1)
        short = above == 0  # an unknown context has no bigrams, so its share goes to the rest
        p[short] /= np.maximum(w[short, 1] + w[short, 2], 1e-300)
        if not total:
            p[:] = 1.0
        add = lambda x: np.add.reduceat(x, b.starts)
        return pd.DataFrame({"doc_id": pd.array(list(row["ids"]), dtype="Int64"), "n_tokens": np.asarray(row["lengths"], np.int64), "n_known": add((c > 0).astype(np.int64)), "base_score": add(base), "score": add(np.log10(p))})

    out = stored.select(*pick).groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(run, OUT_SCHEMA)
    return out.withColumn("train_tokens", F.lit(total).cast("long"))


def score_corpus(docs: DataFrame, folds: int = 10) -> DataFrame:
    """Fold 0 of the ids is held out, fold 1 is the deleted one."""
    out = score(docs, crc_mod("doc_id", folds) == 0, crc_mod("doc_id", folds) == 1)
    held_out = F.coalesce(crc_mod("doc_id", folds) == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
