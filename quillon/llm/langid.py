"""Language identification with a blended-spectrum string kernel.

Two texts are as similar as the share of character n-grams (lengths 1 to 4) that both contain, normalised:
k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|), where G is the set of n-grams, hashed to 2**15 places. A
Nystrom approximation over landmark texts gives each text a short vector; kernel ridge regression with one
output per language is solved on these vectors, and batches of texts are scored by two matrix products.

Fitting takes at most ``train`` labelled texts and ``landmarks`` of them, chosen evenly over the languages in
the order of a hash of their ids; these two bounds are parameters and everything else reads all rows.

Defined results: null texts and texts without a letter are ``und`` with score 0; texts of any length are read
whole; rows with a null language or id are never learned from; repeated rows get equal results and are learned from
once; of languages with equal scores the first by name is taken; without any labelled row every text is ``und``; an
empty table gives no rows; further columns, of whatever names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import crc_mod, least_hashed, small_batches

PLACES = 1 << 15
LENGTHS = (1, 2, 3, 4)
TRAIN, LANDMARKS, RIDGE = 3000, 96, 1e-2
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Texts in one matrix product.
ROWS = 64
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def spectrum(text: str, out: np.ndarray) -> None:
    """Marks the places of the n-grams of a text. White space counts as one blank, case does not count."""
    points = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    gram = np.zeros(len(points), np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        if n > len(points):
            break
        gram = (gram[: len(points) - n + 1] + points[n - 1 :] + np.uint64(n)) * _MIX
        gram ^= gram >> np.uint64(31)
        if n in LENGTHS:
            out[(gram * _MIX) >> np.uint64(64 - 15)] = 1


def presence(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), PLACES), np.float32)
    for row, text in zip(out, texts, strict=True):
        spectrum(text, row)
    return out


class Model:
    """weights: landmarks x languages, with the Nystrom map folded in."""

    def __init__(self, languages: list[str], marks: np.ndarray, weights: np.ndarray):
        self.languages, self.marks, self.weights = languages, marks, weights

    def kernel(self, grams: np.ndarray) -> np.ndarray:
        return (grams @ self.marks) / np.sqrt(np.maximum(grams.sum(1), 1))[:, None]

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        labels, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        some = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.languages else []
        for at in range(0, len(some), ROWS):
            rows = some[at : at + ROWS]
            out = self.kernel(presence([texts[i] for i in rows])) @ self.weights
            best = out.argmax(1)
            top = np.clip(out[np.arange(len(rows)), best], 0, 1)
            for i, b, s in zip(rows, best, top, strict=True):
                labels[i], scores[i] = self.languages[b], float(s)
        return labels, scores


def _unpack(rows: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(rows), np.uint8)).reshape(len(rows), PLACES).astype(np.float32)


def solve(rows: list[bytes], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fits on the packed presence rows of labelled texts. Landmarks are the first texts of each language in turn.

    Rows are unpacked a few at a time, so memory holds the packed rows and their kernels with the landmarks.
    """
    names = sorted(set(languages))
    turn: dict[str, int] = {}
    place = []
    for i, name in enumerate(languages):
        place.append((turn.get(name, 0), i))
        turn[name] = turn.get(name, 0) + 1
    order = [i for _, i in sorted(place)][:landmarks]
    chosen = _unpack([rows[i] for i in order])
    chosen /= np.sqrt(np.maximum(chosen.sum(1), 1))[:, None]
    model = Model(names, np.ascontiguousarray(chosen.T), np.zeros((len(order), len(names)), np.float32))
    k = np.concatenate([model.kernel(_unpack(rows[i : i + ROWS])) for i in range(0, len(rows), ROWS)]).astype(np.float64)
    values, vectors = np.linalg.eigh(k[order])
    usable = values > 1e-6 * values.max()
    whiten = vectors[:, usable] / np.sqrt(values[usable])
    x = k @ whiten
    target = np.array([[name == n for n in names] for name in languages], np.float64)
    weigh = (1 / np.maximum(target.sum(0), 1))[target.argmax(1)]
    weigh *= len(weigh) / weigh.sum()
    solved = np.linalg.solve(x.T @ (x * weigh[:, None]) + ridge * len(x) / 100 * np.eye(x.shape[1]), x.T @ (target * weigh[:, None]))
    model.weights = (whiten @ solved).astype(np.float32)
    return model


def fit(docs: DataFrame, held_out: Column, train: int = TRAIN, landmarks: int = LANDMARKS) -> Model:
    """Learns from rows with text and language that are not held out; of the rows of one id and language from one."""
    rows = docs.where(~F.coalesce(held_out, F.lit(False))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.dropna()
    ids = least_hashed(rows, "lang", "doc_id", train).orderBy("rank", F.xxhash64("lang")).limit(train).select("doc_id", "lang").collect()
    if not ids:
        return Model([], np.zeros((PLACES, 0), np.float32), np.zeros((0, 0), np.float32))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.packbits(presence([t])[0].astype(bool)).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["doc_id", "lang", "bits"])

    small_batches(docs.sparkSession)
    chosen = docs.sparkSession.createDataFrame(sorted((r.doc_id, r.lang) for r in ids), "doc_id long, lang string")
    picked = rows.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("doc_id", "lang", "text")
    got = picked.mapInArrow(bits, "doc_id long, lang string, bits binary").groupBy("doc_id", "lang").agg(F.min("bits").alias("bits"))
    got = sorted(got.collect())
    return solve([bytes(r.bits) for r in got], [r.lang for r in got], landmarks)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score per row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, scores = shared.value(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose text is in a learned language, with all their columns. Only ``und`` goes, whatever the score."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, _ = shared.value(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield batch.filter(pa.array([x != UNKNOWN for x in labels], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """Fits on all but one fold of the ids and predicts every row."""
    held_out = crc_mod("doc_id", folds) == fold
    model = fit(docs, held_out)
    return predict(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
