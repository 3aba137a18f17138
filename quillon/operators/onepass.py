"""Searches of several corpora for one batch of queries, from one reading of their texts.

``read`` tokenises every text once. On the way it meets the text's offline embedding with the queries' vectors and passes
on each task's best, counts in how many texts each term is, and keeps of each text its length and the terms that any query
asks for, as bytes. BM25 needs the counts of all texts first, so it is scored from what was kept, without the texts.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from hashlib import md5
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon import providers
from quillon.operators import index
from quillon.operators.latent import _bytes, _numbers
from quillon.operators.retrieval import _RANKED, Asked, _Best, slices_of, top, weighed, worth

#: Rows are a text's asked terms (doc_id, n tokens, at, tf), a term's texts (term, n; without a term n texts of doc_id
#: tokens), or a hit of a vector (query_id, doc_id, score).
_TEXT, _TERM, _HIT = 0, 1, 2
_SCHEMA = "kind int, part int, doc_id long, n long, at binary, tf binary, term string, query_id long, score double"
_TYPES = {"kind": pa.int32(), "part": pa.int32(), "doc_id": pa.int64(), "n": pa.int64(), "at": pa.binary(), "tf": pa.binary(), "term": pa.string(), "query_id": pa.int64(), "score": pa.float64()}
#: Terms that a task numbers before it passes on their counts and begins anew.
_TERMS = 200_000


class _Words(dict):
    """Numbers of terms as they are met. ``held`` has each one's place in the offline embedding, behind them its number
    among the asked terms from 1 on or 0, and a last bit for a negative sign there."""

    def __init__(self, asked: dict[str, int]):
        super().__init__()
        self.asked, self.held = asked, array("q")

    def __missing__(self, term: str) -> int:
        got = self[term] = len(self)
        digest = md5(term.encode("utf-8", "surrogatepass")).digest()  # ``providers._place``, not kept twice
        place, number = int.from_bytes(digest[:4]) % providers.DIMENSIONS, self.asked.get(term, -1) + 1
        self.held.append(((number * providers.DIMENSIONS + place) << 1) | (digest[4] >> 4 & 1))
        return got

    def forget(self) -> None:
        self.clear()
        self.held = array("q")


def _rows(n: int, /, **columns) -> pa.RecordBatch:
    own = [pa.nulls(n, kind) if name not in columns else columns[name] if isinstance(columns[name], pa.Array) else pa.array(columns[name], kind) for name, kind in _TYPES.items()]
    return pa.RecordBatch.from_arrays(own, list(_TYPES))


def read(texts: DataFrame, by: str, asked: dict[int, tuple[np.ndarray, np.ndarray]], names: list[str], parts: set[int], k: int) -> DataFrame:
    """One pass over texts (by, doc_id, text), to be stored: asked are the query ids and unit vectors of each corpus that
    is searched by vectors, names the terms that are asked of the corpora ``parts``."""
    given = texts.sparkSession.sparkContext.broadcast((asked, {name: i for i, name in enumerate(names)}, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, numbers, parts = given.value
        words, best = _Words(numbers), {part: _Best(*own, k) for part, own in asked.items()}
        df, size = np.zeros(0, np.int64), [0, 0]
        now = None

        def counts() -> Iterator[pa.RecordBatch]:
            nonlocal df
            if size[0]:
                at = np.flatnonzero(df)
                terms = list(words)
                found = [None, *(terms[i] for i in at)]
                yield _rows(len(found), kind=np.full(len(found), _TERM), part=np.full(len(found), now), doc_id=np.r_[size[1], np.zeros(len(at), np.int64)], n=np.r_[size[0], df[at]], term=found)
            df, size[:] = np.zeros(0, np.int64), [0, 0]

        for batch in batches:
            every = batch.column(0).to_numpy()
            for part in np.unique(every).tolist():
                own = batch if (every == part).all() else batch.filter(pa.array(every == part))
                if part != now or len(words) > _TERMS:
                    yield from counts()
                    now = part
                    if len(words) > _TERMS:
                        words.forget()
                for first, last, tokens in slices_of(own.column(2)):
                    ids = own.column(1).to_numpy()[first:last]
                    length = np.fromiter(map(len, tokens), np.int64, len(tokens))
                    code = np.fromiter(map(words.__getitem__, chain.from_iterable(tokens)), np.int64, int(length.sum()))
                    row = np.repeat(np.arange(len(tokens)), length)
                    held = np.array(words.held)
                    if part in best:
                        own_terms = held[code]
                        place, sign = (own_terms >> 1) % providers.DIMENSIONS, 1 - 2 * (own_terms & 1)
                        m = np.bincount(row * providers.DIMENSIONS + place, sign, len(tokens) * providers.DIMENSIONS).reshape(len(tokens), -1)
                        norm = np.linalg.norm(m, axis=1, keepdims=True)
                        best[part].add(ids, m / np.where(norm == 0, 1, norm))
                    if part in parts:
                        size[0] += len(tokens)
                        size[1] += len(code)
                        key, tf = np.unique(row * max(1, len(words)) + code, return_counts=True)
                        row, code = key // max(1, len(words)), key % max(1, len(words))
                        df = np.bincount(code, minlength=len(words)) + np.pad(df, (0, len(words) - len(df)))
                        number = (held[code] >> 1) // providers.DIMENSIONS - 1
                        met = number >= 0
                        n = np.bincount(row[met], minlength=len(tokens))
                        ends = np.r_[0, np.cumsum(n[n > 0])]
                        yield _rows(len(ends) - 1, kind=np.full(len(ends) - 1, _TEXT), part=np.full(len(ends) - 1, part), doc_id=ids[n > 0], n=length[n > 0], at=_bytes(ends, number[met]), tf=_bytes(ends, tf[met]))
                    if len(words) > 2 * _TERMS:
                        yield from counts()
                        words.forget()
        yield from counts()
        for part, hits in best.items():
            found = hits.batch()
            yield _rows(found.num_rows, kind=np.full(found.num_rows, _HIT), part=np.full(found.num_rows, part), query_id=found.column(0), doc_id=found.column(1), score=found.column(2))

    own = texts.select(F.col(by).cast("int").alias("part"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, _SCHEMA)


def vector_topk(stored: DataFrame, k: int) -> DataFrame:
    """``retrieval.vector_topk`` of the vectors that the texts were read for."""
    return top(stored.where(F.col("kind") == _HIT).select("query_id", "doc_id", "score"), k)


def bm25(stored: DataFrame, few: pd.DataFrame, by: str, names: list[str], k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """``retrieval.bm25`` for asked terms (query_id, by, term, qtf) among the names that the texts were read for."""
    counted = stored.where(F.col("kind") == _TERM).groupBy("part", "term").agg(F.sum("n").alias("df"), F.sum("doc_id").alias("n"))
    few = few.assign(part=few[by].astype("int64"))
    asked = weighed(few, index.weights_from(counted, few[["part", "term"]].drop_duplicates(), epsilon))
    number = {name: i for i, name in enumerate(names)}
    place = {}
    for part, (own, _) in asked.items():
        place[part] = np.full(len(names), -1)
        place[part][[number[name] for name in own.names.to_pylist()]] = np.arange(len(own.names))
    given = stored.sparkSession.sparkContext.broadcast((asked, place))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, place = given.value
        best = {part: _Best(own.ids, None, k) for part, (own, _) in asked.items()}
        for batch in batches:
            every = batch.column(0).to_numpy()
            for part in np.unique(every).tolist():
                if part not in best:
                    continue
                mine = batch if (every == part).all() else batch.filter(pa.array(every == part))
                (ends, at), (_, tf) = _numbers(mine.column(3)), _numbers(mine.column(4))
                ids, dl = mine.column(1).to_numpy(), mine.column(2).to_numpy()
                own, avgdl = asked[part]
                for first in range(0, len(ids), own.rows):
                    last = min(first + own.rows, len(ids))
                    term = place[part][at[ends[first] : ends[last]]]
                    row = np.repeat(np.arange(last - first), np.diff(ends[first : last + 1]))
                    known = term >= 0
                    best[part].offer(ids[first:last], worth(own, avgdl, dl[first:last], row[known], term[known], tf[ends[first] : ends[last]][known], k1, b))
        for found in best.values():
            yield found.batch()

    kept = stored.where(F.col("kind") == _TEXT).select("part", "doc_id", "n", "at", "tf")
    return top(kept.mapInArrow(run, _RANKED), k)
