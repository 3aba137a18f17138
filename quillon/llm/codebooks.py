"""Product codes of vectors: one codebook per part of the vector, trained by Lloyd's rounds with Yinyang bounds.

Components become integers, so every distance that decides is an exact integer. The entries of each codebook are
clustered into groups once. For each part of a vector a round keeps its entry and, for each group, one lower bound of
the distance to all of the group's other entries. When entries move, a group's bound falls by the largest move in the
group; only groups whose bound does not surpass the distance to the own, moved entry are scanned. Bounds are floating
numbers rounded outwards, and a tie never passes them, so ties are settled by integers, to the lower index.

Vectors lie in blocks, packed, with their bounds; each round is one pass over the blocks. What goes to the driver and
back are the codebooks: entries times dimension numbers.

Defined results: rows whose vector is null, or holds null or non-finite components, are dropped, and so are vectors of
another length than that of the smallest kept id, or of one that the number of parts does not divide; scaled components
beyond +-2**24 are held there, so no sum of squares overflows; repeated rows are coded each, and of equal ids the one
with the smaller vector comes first among the first entries; rows with a null id are coded but give no first entry; with
fewer rows than entries, codebooks are that much shorter; without any row there is no result; further columns, of
whatever names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import few, fresh, join_hot, materialize, small_batches

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Scaled components lie within this; squares of differences over 2**11 components then fit 64 bits.
MOST = 1 << 24
#: Vectors of a block, and entries of a group on average.
BLOCK, GROUP = 8192, 8

_BLOCK_SCHEMA = "ids array<long>, labels array<long>, vectors binary, own binary, bounds binary, sums binary, scanned long"
_FIELDS = [("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("vectors", pa.binary()), ("own", pa.binary()), ("bounds", pa.binary()), ("sums", pa.binary()), ("scanned", pa.int64())]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer entries."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * largest * largest * x.shape[1] < 1 << 53:  # then every number on the way is an exact double
        x, c = x.astype(np.float64), c.astype(np.float64)
    out = (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T)
    return out.astype(np.int64)


def up(squares: np.ndarray) -> np.ndarray:
    """A square root, rounded up."""
    return np.nextafter(np.nextafter(np.sqrt(squares.astype(np.float64)), np.inf), np.inf)


def down(squares: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.nextafter(np.sqrt(squares.astype(np.float64)), -np.inf), -np.inf), 0.0)


def grouped(entries: np.ndarray, size: int = GROUP, rounds: int = 5) -> np.ndarray:
    """The group of each entry: a few rounds of Lloyd among the entries themselves."""
    n = max(1, -(-len(entries) // size))
    centres = entries[:: max(1, len(entries) // n)][:n].astype(np.float64)
    for _ in range(rounds):
        group = ((entries[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        for g in range(len(centres)):
            if (group == g).any():
                centres[g] = entries[group == g].mean(0)
    return np.unique(group, return_inverse=True)[1]


def first_bounds(x: np.ndarray, entries: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest entry and, for each group, a lower bound of the distance to its other entries."""
    far = squared(x, entries)
    own = far.argmin(1)
    scanned = far.size
    far[np.arange(len(x)), own] = np.iinfo(np.int64).max
    bounds = np.stack([down(far[:, group == g].min(1)) for g in range(group.max() + 1)], 1) if len(x) else np.zeros((0, group.max() + 1))
    return own, bounds, scanned


def next_bounds(x: np.ndarray, entries: np.ndarray, before: np.ndarray, group: np.ndarray, own: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The same after the entries moved from ``before``, scanning only groups whose bound fails."""
    moved = up(((entries - before) ** 2).sum(1))
    n_groups = bounds.shape[1]
    fall = np.array([moved[group == g].max() for g in range(n_groups)])
    bounds = np.nextafter(bounds - fall, -np.inf)
    mine = ((x - entries[own]) ** 2).sum(1)
    upper = up(mine)
    best, at = mine.copy(), own.copy()
    scanned = len(x)
    looked = bounds <= upper[:, None]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for g in range(n_groups):
        rows = np.flatnonzero(looked[:, g])
        if not len(rows):
            found.append((rows, rows, np.zeros((0, 0), np.int64)))
            continue
        members = np.flatnonzero(group == g)
        far = squared(x[rows], entries[members])
        scanned += far.size
        found.append((rows, members, far))
        near = far.argmin(1)
        value, name = far[np.arange(len(rows)), near], members[near]
        better = (value < best[rows]) | ((value == best[rows]) & (name < at[rows]))
        best[rows[better]], at[rows[better]] = value[better], name[better]
    # A left entry joins what its group's bound speaks for; a scanned group's bound is its least distance but the own one.
    left = np.flatnonzero(at != own)
    bounds[left, group[own[left]]] = np.minimum(bounds[left, group[own[left]]], down(mine[left]))
    for g, (rows, members, far) in enumerate(found):
        if len(rows):
            far[members[None, :] == at[rows][:, None]] = np.iinfo(np.int64).max
            bounds[rows, g] = down(far.min(1))
    return at, bounds, scanned


def _pack(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def _unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def whole_vectors(rows: DataFrame, embedding: str = "embedding") -> Column:
    """Whether a vector is there with finite components only."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.col(embedding).isNotNull() & F.coalesce(F.forall(embedding, finite), F.lit(False))


def _blocks(rows: DataFrame, dim: int) -> DataFrame:
    """(id, label, scaled components) packed into blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        labels: list = []
        held: list[np.ndarray] = []

        def ready(n: int) -> pa.RecordBatch:
            vectors = np.concatenate(held) if held else np.zeros((0, dim), np.int32)
            row = [ids[:n], labels[:n], _pack(vectors[:n]), b"", b"", b"", 0]
            del ids[:n], labels[:n]
            held[:] = [vectors[n:]]
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, (_, kind) in zip(row, _FIELDS, strict=True)], [f for f, _ in _FIELDS])

        for batch in batches:
            if batch.num_rows:
                ids += batch.column(0).to_pylist()
                labels += batch.column(1).to_pylist()
                held.append(batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, dim))
            while len(ids) >= BLOCK:
                yield ready(BLOCK)
        if ids:
            yield ready(len(ids))

    return rows.mapInArrow(run, _BLOCK_SCHEMA)


def _round(blocks: DataFrame, books: np.ndarray, groups: list[np.ndarray], before: np.ndarray | None) -> DataFrame:
    """Every block with its vectors assigned, their bounds, and the sums of what each entry was given."""
    given = blocks.sparkSession.sparkContext.broadcast((books, groups, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, groups, before = given.value
        parts, entries, width = books.shape
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["ids"])
                x = _unpack(row["vectors"], np.int32).reshape(n, parts, width).astype(np.int64)
                own, bounds, scanned = [], [], 0
                sums = np.zeros((parts, entries, width + 1), np.int64)
                if before is not None:
                    old = _unpack(row["own"], np.uint8).reshape(parts, n).astype(np.int64)
                    ends = np.cumsum([0, *(n * (int(g.max()) + 1) for g in groups)])
                    held = _unpack(row["bounds"], np.float64)
                for p in range(parts):
                    if before is None:
                        at, low, looked = first_bounds(x[:, p], books[p], groups[p])
                    else:
                        at, low, looked = next_bounds(x[:, p], books[p], before[p], groups[p], old[p], held[ends[p] : ends[p + 1]].reshape(n, -1))
                    scanned += looked
                    own.append(at)
                    bounds.append(low.ravel())
                    sums[p, :, width] = np.bincount(at, minlength=entries)
                    np.add.at(sums[p, :, :width], at, x[:, p])
                out = [row["ids"], row["labels"], row["vectors"], _pack(np.array(own, np.uint8)), _pack(np.concatenate(bounds)), _pack(sums), scanned]
                yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, (_, kind) in zip(out, _FIELDS, strict=True)], [f for f, _ in _FIELDS])

    return blocks.mapInArrow(run, _BLOCK_SCHEMA)


def _moved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The books after a round: the floored mean of what each entry was given; entries given nothing stay."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(parts * entries * (width + 1), np.int64)
        for batch in batches:
            for sums in batch.column(0).to_pylist():
                total += _unpack(sums, np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "total"])

    # One row per number of the codebooks: entries times dimension, whatever the number of vectors.
    got = blocks.select("sums").mapInArrow(run, "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total")).toPandas()
    total = np.zeros(parts * entries * (width + 1), np.int64)
    total[got["slot"].to_numpy()] = got["total"].to_numpy()
    total = total.reshape(parts, entries, width + 1)
    count = total[:, :, width:]
    return np.where(count > 0, total[:, :, :width] // np.maximum(count, 1), books)


def fit(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, parts: int = PARTS) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, embedding, label) as blocks with their final entries, and the codebooks (part, entry, component)."""
    if entries > 256:
        raise ValueError("a code has two hex digits for each part: 256 entries at most")
    small_batches(rows.sparkSession)
    size = F.size("embedding")
    whole = rows.where(whole_vectors(rows) & (size > 0) & (size % parts == 0))
    scaled = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(MOST)), F.lit(-MOST)).cast("int"))
    whole = whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), scaled.alias("v"))
    first = whole.where("vec_id is not null").orderBy("vec_id", "v").limit(1).collect()
    if not first:
        first = whole.orderBy("v").limit(1).collect()
    dim = len(first[0].v) if first else parts
    whole = whole.where(F.size("v") == dim)
    seeds = [r.v for r in whole.where("vec_id is not null").orderBy("vec_id", "v").limit(entries).collect()] or [r.v for r in first]
    books = np.array(seeds, np.int64).reshape(-1, parts, dim // parts).transpose(1, 0, 2)
    blocks = materialize(_blocks(whole, dim))
    if not books.shape[1]:
        return blocks, books
    groups = [grouped(book) for book in books]
    before = None
    for _ in range(rounds):
        blocks = materialize(_round(blocks, books, groups, before))
        before, books = books, _moved(blocks, books)
    return materialize(_round(blocks, books, groups, before)), books


def encode(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of the vectors in fitted blocks."""
    given = blocks.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = given.value
        parts, _, width = books.shape
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["ids"])
                x = _unpack(row["vectors"], np.int32).reshape(n, parts, width).astype(np.int64)
                own = _unpack(row["own"], np.uint8).reshape(parts, n)
                error = sum(((x[:, p] - books[p][own[p]]) ** 2).sum(1) for p in range(parts))
                codes = np.ascontiguousarray(own.T).tobytes().hex()
                texts = [codes[i : i + 2 * parts] for i in range(0, len(codes), 2 * parts)]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.int64()), pa.array(texts, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, "vec_id long, label long, code string, error long")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimals with commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def codes(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, parts: int = PARTS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every whole vector."""
    blocks, books = fit(rows, entries, rounds, parts)
    coded = encode(blocks, books)
    sums = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    out = join_hot(coded, sums, "label", "n")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def scanned_share(blocks: DataFrame, books: np.ndarray) -> float:
    """Distances computed in the last round, of all pairs of a vector's part and an entry."""
    seen = blocks.agg(F.sum("scanned").alias("s"), F.sum(F.size("ids")).alias("n")).first()
    return seen.s / (seen.n * books.shape[0] * books.shape[1]) if seen.n else 0.0
