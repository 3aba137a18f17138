"""A learned offline embedder: the leading singular directions of a corpus' TF-IDF matrix, found by randomised iteration.

Terms are hashed into a bounded number of columns, so the matrix' right side has a bounded size whatever the vocabulary.
Texts are read once: their counts of hashed terms are kept, as few bytes each, and every pass reads those. Each pass
multiplies some texts at a time with a thin matrix and back, dense in the columns that occur in them; what tasks have
summed is added up in two steps, block by block of columns. The driver keeps only columns times directions: it makes them orthogonal between
passes and solves the small problem at the end. A text is embedded by one product with the directions, on any worker.

Null and blank texts have the zero vector. Signs of directions are fixed by their largest entry, so equal corpora give
equal embedders up to rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon import providers

#: Columns that terms are hashed into, directions kept, further ones that speed up convergence, and passes.
COLUMNS, DIMENSIONS, EXTRA, PASSES = 1 << 14, 64, 16, 4
#: Columns of a block of sums, and tasks' sums that are added up in the first step apart from others.
_BLOCK, _FIRST = 512, 32
#: Texts whose terms are counted together, and texts that meet the directions together.
_TEXTS, _TOGETHER = 512, 64


def _counts(texts: list[str | None], columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and counts of the hashed terms of texts."""
    own = [providers.terms(text) for text in texts]
    size = np.fromiter(map(len, own), np.int64, len(own))
    at = np.fromiter(map(providers.wholes.__getitem__, chain.from_iterable(own)), np.int64, int(size.sum())) % columns
    key, n = np.unique(np.repeat(np.arange(len(own)), size) * columns + at, return_counts=True)
    return key // columns, key % columns, n


def _slices(texts: list, size: int) -> Iterator[list]:
    for i in range(0, len(texts), size):
        yield texts[i : i + size]


def _bytes(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    """Whole numbers, cut at ends, as an array of bytes."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(values.astype(np.uint32))])


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each entry's numbers end, from 0 on, and the numbers."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
    held = column.buffers()[2]
    return ends - ends[0], np.frombuffer(held, np.uint32, held.size // 4)[ends[0] : ends[-1]].astype(np.int64) if held else np.zeros(0, np.int64)


def counted(docs: DataFrame, columns: int = COLUMNS, id: str | None = None) -> DataFrame:
    """(id, at, n) of texts: the columns of a text's hashed terms and how often each occurs, as bytes."""
    own = docs.select((F.col(id).cast("long") if id else F.lit(0).cast("long")).alias(id or "id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, _TEXTS):
                batch = whole.slice(first, _TEXTS)
                row, at, n = _counts(batch.column(1).to_pylist(), columns)
                ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), _bytes(ends, at), _bytes(ends, n)], [id or "id", "at", "n"])

    return own.mapInArrow(run, f"`{id or 'id'}` long, at binary, n binary")


def _held(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a batch of ``counted`` some texts at a time: the first and last place, and rows, columns and counts."""
    (ends, at), (_, n) = _numbers(batch.column(1)), _numbers(batch.column(2))
    for first in range(0, batch.num_rows, _TOGETHER):
        last = min(first + _TOGETHER, batch.num_rows)
        own = slice(ends[first], ends[last])
        yield first, last, np.repeat(np.arange(last - first), np.diff(ends[first : last + 1])), at[own], n[own]


class Latent:
    """An embedder of texts: a weight for each column, and the directions."""

    def __init__(self, weights: np.ndarray, directions: np.ndarray, values: np.ndarray):
        self.weights, self.directions, self.values = weights, directions, values

    def met(self, size: int, row: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some texts' counts, as rows, columns and numbers: the columns that occur, the texts' weighted counts in these,
        each text at length one, and their products with the directions."""
        value = n * self.weights[at]
        norm = np.sqrt(np.bincount(row, value * value, size))
        place = np.zeros(len(self.weights), np.int64)
        place[at] = 1
        own = np.flatnonzero(place)
        place[own] = np.arange(len(own))
        dense = np.zeros((size, len(own)))
        dense[row, place[at]] = value / norm[row]
        return own, dense, dense @ self.directions[own]

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.directions.shape[1]))
        for i, some in enumerate(_slices(texts, _TOGETHER)):
            out[i * _TOGETHER : (i + 1) * _TOGETHER] = self.met(len(some), *_counts(some, len(self.weights)))[2]
        return _at_one(out)


def _at_one(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm == 0, 1, norm)


def embedded(model: Latent, rows: DataFrame) -> DataFrame:
    """(id, embedding) of texts that are ``counted``."""
    id, given = rows.columns[0], rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, given.value.directions.shape[1]))
            for first, last, row, at, n in _held(batch):
                out[first:last] = given.value.met(last - first, row, at, n)[2]
            ends = pa.array(range(0, out.size + 1, max(1, out.shape[1])), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(_at_one(out).ravel()))], [id, "embedding"])

    return rows.mapInArrow(run, f"`{id}` long, embedding array<double>")


def _weights(rows: DataFrame, columns: int) -> np.ndarray:
    """ln((1 + N) / (1 + df)) + 1 of each column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(columns + 1, np.int64)
        for batch in batches:
            df[:columns] += np.bincount(_numbers(batch.column(1))[1], minlength=columns)
            df[columns] += batch.num_rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["at", "n"])

    got = rows.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # columns + 1 rows at most
    df = np.zeros(columns + 1, np.int64)
    df[got["at"].to_numpy()] = got["n"].to_numpy()
    return np.log((1 + df[columns]) / (1 + df[:columns])) + 1


def _gram(rows: DataFrame, weights: np.ndarray, thin: np.ndarray) -> np.ndarray:
    """The matrix' transpose times the matrix times a thin one."""
    given = rows.sparkSession.sparkContext.broadcast(Latent(weights, thin, np.zeros(0)))
    columns, width = thin.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, own = TaskContext.get(), given.value
        total, some = np.zeros((columns, width)), False
        for batch in batches:
            for first, last, row, at, n in _held(batch):
                own_columns, dense, once = own.met(last - first, row, at, n)
                total[own_columns] += dense.T @ once
                some = some or len(row) > 0
        if some:
            blocks = range(0, columns, _BLOCK)
            part = (context.partitionId() if context else 0) % _FIRST
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(blocks)), pa.array(list(blocks)), pa.array([total[b : b + _BLOCK].tobytes() for b in blocks])], ["part", "block", "sums"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(group["sums"].iloc[0]) // 8)
        for sums in group["sums"]:
            total += np.frombuffer(sums)
        return pd.DataFrame({"part": [0], "block": [group["block"].iloc[0]], "sums": [total.tobytes()]})

    schema = "part long, block long, sums binary"
    sums = rows.mapInArrow(run, schema)
    for _ in range(2):
        sums = sums.groupBy("part", "block").applyInPandas(add, schema)
    out = np.zeros((columns, width))
    for r in sums.collect():  # columns times directions numbers
        out[r.block : r.block + _BLOCK] = np.frombuffer(r.sums).reshape(-1, width)
    return out


def fit(docs: DataFrame, dimensions: int = DIMENSIONS, columns: int = COLUMNS, passes: int = PASSES, seed: int = 7, store: Callable[[DataFrame], DataFrame] | None = None) -> Latent:
    """The embedder of (text): reads the texts once. Their counts lie on the executors' disks meanwhile, or as ``store`` says."""
    rows = counted(docs, columns)
    if store:
        return fit_counted(store(rows), dimensions, columns, passes, seed)
    kept = rows.persist(StorageLevel.DISK_ONLY)
    try:
        return fit_counted(kept, dimensions, columns, passes, seed)
    finally:
        kept.unpersist()


def fit_counted(rows: DataFrame, dimensions: int = DIMENSIONS, columns: int = COLUMNS, passes: int = PASSES, seed: int = 7) -> Latent:
    """``fit`` on texts that are ``counted``: reads the counts once for the weights and once for each pass."""
    weights = _weights(rows, columns)
    width = min(dimensions + EXTRA, columns)
    thin = np.linalg.qr(np.random.default_rng(seed).normal(size=(columns, width)))[0]
    gram = np.zeros((columns, width))
    for i in range(max(1, passes)):
        if i:
            thin = np.linalg.qr(gram)[0]
        gram = _gram(rows, weights, thin)
    small = thin.T @ gram
    squares, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-squares)[: min(dimensions, width)]
    directions = thin @ turn[:, order]
    lead = directions[np.abs(directions).argmax(0), np.arange(directions.shape[1])]
    return Latent(weights, (directions * np.where(lead < 0, -1, 1)).astype(np.float32), np.sqrt(np.maximum(squares[order], 0)))


def register(docs: DataFrame, name: str = "latent", **how) -> Latent:
    """Fits the embedder and makes it known by name."""
    latent = fit(docs, **how)
    providers.register("embedder", name, lambda: latent)
    return latent
