"""Repetition coverage: which share of a text's characters lies inside repeated n-grams and lines.

Words are hashed with a polynomial rolling hash over the text's bytes, n-grams with one over the word
hashes; both are computed in numpy, so no word is ever a Python object.

Defined results: a null text counts as an empty one (no words, ``base_failed``); texts of any length are
measured whole; equal rows give equal rows; an empty table gives no rows; further columns of the input are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.common import small_batches

#: Largest share of word characters inside repeated n-grams of each length, first occurrences included, and inside lines
#: that repeat an earlier one.
MAX_COVER = {5: 0.30, 6: 0.28, 8: 0.24, 10: 0.20}
MAX_LINE_COVER = 0.20
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"

_SPACE = np.zeros(256, np.int8)
_SPACE[[ord(c) for c in SPACES]] = 1
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCHEMA = (
    "doc_id long, "
    + ", ".join(f"{c} long" for c in COLUMNS)
    + ", "
    + ", ".join(f"cover_{n} double" for n in MAX_COVER)
    + ", line_cover double, base_failed boolean, kept boolean"
)


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if base not in _powers or len(_powers[base]) < n:
        out = np.full(max(n, 1 << 14), base, np.uint64)
        out[0] = 1
        _powers[base] = np.cumprod(out)
    return _powers[base][:n]


def hash_words(text: str, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and the code points of each word, in order. gaps: 1 for each byte that separates words."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    padded = np.ones(len(raw) + 2, np.int8)
    padded[1:-1] = gaps[raw]
    edges = np.flatnonzero(padded[1:] != padded[:-1])
    start, end = edges[::2], edges[1::2]
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(raw)), out=prefix[1:])
    hashes = (prefix[end] - prefix[start]) * _power(_INVERSE, len(raw) + 1)[start]
    hashes = (hashes ^ (hashes >> np.uint64(29))) * _STEP
    points = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
    return hashes ^ (hashes >> np.uint64(32)), points[end] - points[start]


def _repeated(grams: np.ndarray) -> np.ndarray:
    """Whether each n-gram occurs twice or more."""
    order = np.argsort(grams)
    same = grams[order[1:]] == grams[order[:-1]]
    out = np.zeros(len(grams), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def _covered(repeated: np.ndarray, n: int) -> np.ndarray:
    """Whether each word lies in a repeated window of n words."""
    words = len(repeated) + n - 1
    seen = np.zeros(words + n, np.int64)
    seen[n : n + len(repeated)] = repeated
    seen = np.cumsum(seen)
    return seen[n:] > seen[:words]


def measure(text: str | None) -> dict:
    """All figures of one text."""
    text = text or ""
    hashes, lengths = hash_words(text)
    words, chars = len(hashes), int(lengths.sum())
    out = {"n_words": words, "word_chars": chars, "n_symbols": sum(map(text.count, SYMBOLS)), "n_repeat_words": 0}
    seen: set[str] = set()
    duplicate = duplicate_chars = 0
    for line in text.split("\n"):
        if line in seen:
            if bare := len(line) - sum(map(line.count, SPACES)):
                duplicate += 1
                duplicate_chars += bare
        else:
            seen.add(line)
    out |= {"n_dup_lines": duplicate, "line_cover": duplicate_chars / max(chars, 1)}
    cover = dict.fromkeys(MAX_COVER, 0.0)
    grams = hashes
    for n in range(2, max(MAX_COVER) + 1):
        if words < n:
            break
        grams = grams[:-1] * _STEP + hashes[n - 1 :]
        if n == 3 or n in cover:
            repeated = _repeated(grams)
            if not repeated.any():
                break  # a longer n-gram repeats only if its parts do
            inside = _covered(repeated, n)
            if n == 3:
                out["n_repeat_words"] = int(inside.sum())
            else:
                cover[n] = float(lengths[inside].sum() / chars)
    failed = words < MIN_WORDS or 100 * out["n_repeat_words"] > 50 * words
    kept = not failed and out["line_cover"] <= MAX_LINE_COVER and all(cover[n] <= most for n, most in MAX_COVER.items())
    return out | {f"cover_{n}": x for n, x in cover.items()} | {"base_failed": failed, "kept": kept}


def repetition(docs: DataFrame) -> DataFrame:
    """doc_id, the base figures, the coverage of each n-gram length and of lines, and the verdict, per row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            rows = [measure(t) for t in texts.to_pylist()]
            if rows:
                names = [f.split()[0] for f in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[n] for r in rows]) for n in names[1:])], names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)


def keep_clean(docs: DataFrame) -> DataFrame:
    """The rows whose text passes, with all their columns."""
    small_batches(docs.sparkSession)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([measure(t)["kept"] for t in texts], pa.bool_()))

    return docs.mapInArrow(run, schema)
