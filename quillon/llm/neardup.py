"""Near-duplicates of the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from SimHash (``simhash``: pigeonring over the fingerprints of five-word shingles) and, as texts that
are 0.8 alike mostly differ in more bits than pigeonring can search, from least hashes: 64 keys, each made of a
set's least shingles under seven hash functions. Two sets at 0.8 share none with a probability of 3e-7, less if they
are more alike, while texts that only share a passage hardly ever meet. Every candidate counts only if the whole
shingle sets are similar.

A key with at most ``CROWD`` sets pairs them out. A crowded one first links each set to the key's smallest; only where
that leaves its sets in several components are pairs across components compared, in numpy, by size and by the
parities of 512 buckets (which never differ in more places than the sets do), and only what may be similar goes on. For
that the sets are dealt to cells of bounded size, by bands of close sizes and, within a large band, by pairs of blocks,
so no task holds a key; keys are read in order, a few at a time.

Defined results: ASCII letters are lowered and words end at ASCII white space, as in ``simhash``; texts of fewer
words are one shingle; null, empty and blank texts are equal; very long texts are compared whole; ties cannot occur,
as the smallest id of a class stays; rows with null ids are kept; of rows with equal ids and texts one stays, rows
with equal ids and different texts are judged each by its text; an empty table gives no rows; columns of any name
come along. Shingles are known by 64-bit hashes, sets by the 64-bit sum of these.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import simhash
from quillon.llm.common import few, fresh, materialize, small_batches
from quillon.llm.components import components

SHINGLE = 5
#: Least similarity, as a fraction.
NUM, DEN = 4, 5
BUCKETS = 512
#: Keys of a set, and least hashes of a key.
BANDS, ROWS = 64, 7
_FACTORS = np.random.default_rng(5).integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles hashed at once.
_STEP = 512
#: Sets of a key that are paired out.
CROWD = 16
#: Sets a task remembers in order to emit their keys once.
_SEEN = 500_000
#: Sets whose sizes and parities (some 90 bytes) may be broadcast.
BROADCAST_SETS = 50_000
#: Sets of a cell in which those of a crowded key are compared, and by what factor sizes in neighbouring bands may
#: differ; a little over DEN / NUM, so rounding loses nothing.
CELL, BAND = 4096, 1.26
#: Pairs looked at in one step of a cell.
_BLOCK = 1 << 17


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of all shingles."""
    return np.unique(simhash.shingle_hashes(text, SHINGLE))


def set_id(hashes: np.ndarray) -> int:
    return int(hashes.sum(dtype=np.uint64).view(np.int64))


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return len(x) == len(y) == 0 or (len(x) + len(y) - both) * NUM <= both * DEN


def keys(hashes: np.ndarray) -> np.ndarray:
    """The hash of each band of least hashes; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _STEP):
        np.minimum(least, (hashes[at : at + _STEP, None] * _FACTORS).min(0), out=least)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = (out ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def sketch(hashes: np.ndarray) -> bytes:
    """The parity of the number of shingles in each bucket."""
    odd = np.bincount((hashes % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text), set_id, size, sketch, fp and, once a task for each set, its keys."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "mark", "set_id", "size", "sketch", "fp", "keys"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                every = simhash.shingle_hashes(text, SHINGLE)
                hashes = np.unique(every)
                own = set_id(hashes)
                bands = [] if own in seen else keys(hashes)
                rows.append((own, len(hashes), sketch(hashes), simhash.signed(simhash.majority(every)), bands))
                if len(seen) < _SEEN:
                    seen.add(own)
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds[2:], strict=True))], names)

    rows = docs.where("doc_id is not null").selectExpr("cast(doc_id as long) doc_id", "xxhash64(cast(text as string)) mark", "cast(text as string) text")
    return rows.mapInArrow(run, "doc_id long, mark long, set_id long, size long, sketch binary, fp long, keys array<long>")


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of a partition that is sorted by the first one, some whole keys at a time; rows with the same first
    two values once."""
    held: list[np.ndarray] = []

    def once(cols: list[np.ndarray]) -> list[np.ndarray]:
        new = np.append(True, (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0))
        return [c[new] for c in cols]

    for batch in batches:
        if batch.num_rows:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = [np.concatenate(x) for x in zip(held, cols, strict=True)] if held else cols
            end = int(np.searchsorted(held[0], held[0][-1]))
            if end:
                yield once([c[:end] for c in held])
                held = [c[end:] for c in held]
    if held:
        yield once(held)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of sets with a key in common whose sizes allow that they are similar. Keys have few sets."""
    for key, node, size in _whole_keys(batches):
        for lag in range(1, len(key)):
            same = key[:-lag] == key[lag:]
            if not same.any():
                break
            ok = same & (DEN * np.minimum(size[:-lag], size[lag:]) >= NUM * np.maximum(size[:-lag], size[lag:]))
            yield pa.RecordBatch.from_arrays([pa.array(node[:-lag][ok]), pa.array(node[lag:][ok])], ["a", "b"])


def _matrix(sketches: list[bytes] | np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(-1, BUCKETS // 64)


def _may(size_a, sketch_a, size_b, sketch_b) -> np.ndarray:
    """Whether sizes and parities allow that two sets are similar."""
    most = (size_a + size_b) * (DEN - NUM) // (DEN + NUM)
    return (np.abs(size_a - size_b) <= most) & (np.bitwise_count(sketch_a ^ sketch_b).sum(-1, dtype=np.int64) <= most)


def _cells(rest: DataFrame) -> DataFrame:
    """Sets of crowded keys (key, set_id, root, size, sketch), dealt to cells in which all that have to be compared meet.

    Only sets of close sizes can be similar, so a key's sets are cut into bands of sizes, and each band meets itself and
    the one below. A band of many sets is cut into blocks, and each two of its blocks meet in a cell of their own. A
    column says whether a set is of the band itself, and in which block it lies."""
    band = F.floor(F.log(F.col("size").cast("double")) / math.log(BAND)).cast("long")
    own = rest.withColumn("both", F.array(F.struct(band.alias("band"), F.lit(True).alias("own")), F.struct((band + 1).alias("band"), F.lit(False).alias("own"))))
    own = own.select("key", "set_id", "root", "size", "sketch", F.inline("both"))
    sizes = own.groupBy("key", "band").agg(F.count("*").alias("n"), F.count_if("own").alias("m")).where("m > 0")
    sizes = few(sizes.select("key", "band", F.ceil(F.col("n") / CELL).alias("blocks")))
    dealt = own.join(sizes, ["key", "band"]).withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return dealt.select(F.xxhash64("key", "band", low, high).alias("cell"), "set_id", "root", "size", "sketch", "own", "block", (low == high).alias("alone"))


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of a cell's sets from different components that may be similar."""
    for cell, node, root, size, sketches, own, block, alone in _whole_keys(batches):
        at = [*np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell)]
        for lo, hi in zip(at, at[1:], strict=False):
            bits, step = _matrix(sketches[lo:hi]), max(1, _BLOCK // int(hi - lo))
            for first in range(0, int(hi - lo), step):
                i = lo + np.arange(first, min(first + step, int(hi - lo)))[:, None]
                j = lo + np.arange(hi - lo)[None, :]
                left, right = np.nonzero((j > i) & (root[i] != root[j]) & (own[i] | own[j]) & (alone[i] | (block[i] != block[j])))
                left += first
                ok = _may(size[lo + left], bits[left], size[lo + right], bits[right])
                yield pa.RecordBatch.from_arrays([pa.array(node[lo + left[ok]]), pa.array(node[lo + right[ok]])], ["a", "b"])


def _filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, size_a, sketch_a, size_b, sketch_b = batch.columns
        ok = _may(size_a.to_numpy(), _matrix(sketch_a.to_pylist()), size_b.to_numpy(), _matrix(sketch_b.to_pylist()))
        yield pa.RecordBatch.from_arrays([a.filter(pa.array(ok)), b.filter(pa.array(ok))], ["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, x, y = batch.columns
        ok = pa.array([similar(np.frombuffer(l, np.uint64), np.frombuffer(r, np.uint64)) for l, r in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(ok), b.filter(ok)], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(list(map(set_id, found)), pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())], ["node", "hashes"])


def _hashes(docs: DataFrame, first: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, hashes) of the given sets (node), read again from the texts that first had them."""
    lead = few(first.join(nodes, first.set_id == nodes.node, "left_semi").select("first_id"))
    texts = docs.selectExpr("cast(doc_id as long) first_id", "cast(text as string) text").join(lead, "first_id", "left_semi")
    return texts.select("text").mapInArrow(_sets, "node long, hashes binary").dropDuplicates(["node"])


def _verified(docs: DataFrame, first: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that are similar: by size and parities, then by their whole sets."""
    narrow = first.select("set_id", "size", "sketch")
    narrow = F.broadcast(narrow) if first.known_rows <= BROADCAST_SETS else narrow
    side = lambda c: narrow.select(F.col("set_id").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    likely = pairs.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "size_a", "sketch_a", "size_b", "sketch_b")
    likely = materialize(likely.mapInArrow(_filter, "a long, b long"))
    sets = materialize(_hashes(docs, first, likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()))
    left, right = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    return materialize(likely.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long"))


def _simhash_pairs(first: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints are equal or linked by pigeonring, one set for each fingerprint."""
    lead = few(first.groupBy("fp").agg(F.min("set_id").alias("set")))
    same = first.join(lead, "fp").where("set <> set_id").select(F.col("set").alias("a"), F.col("set_id").alias("b"))
    near = simhash.links(lead.select("fp")).select(F.col("a").alias("x"), F.col("b").alias("y"))
    near = near.join(lead.select(F.col("fp").alias("x"), F.col("set").alias("a")), "x").join(lead.select(F.col("fp").alias("y"), F.col("set").alias("b")), "y").select("a", "b")
    return same.union(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def links(docs: DataFrame, first: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(node, root) of the sets that have similar ones, root the smallest set that each reaches. first: set_id, first_id, size, sketch, fp, keys."""
    rows = first.select(F.explode("keys").alias("key"), "set_id", "size")
    often = few(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key"))
    pairs = rows.join(often, "key", "left_anti").repartition("key").sortWithinPartitions("key", "set_id").mapInArrow(_pairs, "a long, b long")
    full = materialize(rows.join(often, "key", "left_semi").select("key", "set_id"))
    least = few(full.groupBy("key").agg(F.min("set_id").alias("a")))
    stars = full.join(least, "key").where("set_id <> a").select("a", F.col("set_id").alias("b"))
    done = _verified(docs, first, _simhash_pairs(first).union(pairs).union(stars))
    roots = few(components(done))
    named = full.join(roots, full.set_id == roots.node, "left").select("key", "set_id", F.coalesce("root", "set_id").alias("root"))
    split = few(named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key"))
    rest = named.join(split, "key", "left_semi").join(first, "set_id").select("key", "set_id", "root", "size", "sketch")
    across = materialize(_cells(rest).repartition("cell").sortWithinPartitions("cell", "set_id").mapInArrow(_across, "a long, b long").distinct())
    return roots if across.isEmpty() else components(done.unionByName(_verified(docs, first, across)))


def classes(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, mark and component_id, the smallest id of all documents it is linked to, per row with an id."""
    found = materialize(prints(docs))
    same = [F.first(c).alias(c) for c in ("size", "sketch", "fp")]
    first = materialize(found.groupBy("set_id").agg(F.min("doc_id").alias("first_id"), *same, F.max("keys").alias("keys")))
    roots = few(links(docs, first, crowd))
    named = first.select("set_id", "first_id").join(roots, F.col("set_id") == roots.node)
    least = few(named.groupBy("root").agg(F.min("first_id").alias("component_id")))
    linked = few(named.join(least, "root").select("set_id", "component_id"))
    alone = first.select("set_id", "first_id")
    alone = F.broadcast(alone) if first.known_rows <= BROADCAST_SETS else alone
    out = found.select("doc_id", "mark", "set_id").join(alone, "set_id").join(linked, "set_id", "left")
    return out.select("doc_id", "mark", F.coalesce("component_id", "first_id").alias("component_id"))


def keep_one(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """The first document of each class, with all its columns; of rows with equal ids and texts one stays."""
    return simhash.first_of(docs, classes(docs, crowd))
