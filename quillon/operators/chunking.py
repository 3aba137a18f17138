"""Chunkers: documents (doc_id, text) to chunks (doc_id, chunk_id, chunk_index, text).

The chunk id is the document id and a suffix, so documents of one title cannot clash. Empty texts give no chunk.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import providers
from quillon.functions import text as T

CHUNK_SCHEMA = "doc_id long, chunk_id string, chunk_index long, text string"


def _rows(docs: DataFrame, parts: Column, suffix: str) -> DataFrame:
    """parts: an array of structs (i, text)."""
    out = docs.select("doc_id", F.inline(parts).alias("i", "text"))
    return out.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(suffix), F.col("i").cast("string")).alias("chunk_id"), F.col("i").cast("long").alias("chunk_index"), "text")


def _windows(items: Column, size: int, step: int, last: Column) -> Column:
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(F.floor(s / step).alias("i"), F.slice(items, s + 1, size).alias("part")))


def fixed_tokens(docs: DataFrame, size: int = 64, overlap: int = 0) -> DataFrame:
    """Windows of ``size`` tokens every ``size - overlap``; windows of under half the size go, but keep their number."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    own = docs.select("doc_id", T.tokens(F.col("text"), lower=False).alias("items"))
    kept = F.filter(_windows(F.col("items"), size, size - overlap, F.size("items") - 1), lambda w: F.size(w.part) >= size // 2)
    return _rows(own, F.transform(kept, lambda w: F.struct(w.i.alias("i"), F.array_join(w.part, " ").alias("text"))), "_")


def paragraphs(docs: DataFrame, least_words: int = 10) -> DataFrame:
    """Parts between blank lines, else between line ends, else the whole text as one chunk without an id."""
    full = lambda sep: F.filter(F.transform(F.split(F.col("text"), sep), lambda s: F.trim(s)), lambda p: p != "")
    own = docs.select("doc_id", "text", full("\n\n").alias("blank"), full("\n").alias("line"))
    own = own.withColumn("parts", F.when(F.size("blank") > 1, F.col("blank")).when(F.size("line") > 1, F.col("line")))
    numbered = F.filter(F.transform("parts", lambda p, i: F.struct(i.alias("i"), p.alias("text"))), lambda p: F.size(T.words(p.text)) >= least_words)
    split = _rows(own.where("parts is not null").select("doc_id", numbered.alias("n")), F.col("n"), "_p")
    whole = own.where("parts is null and text is not null").select("doc_id", F.lit(None).cast("string").alias("chunk_id"), F.lit(0).cast("long").alias("chunk_index"), "text")
    return split.unionByName(whole)


def sentence_pack(docs: DataFrame, budget: int = 300, unit: str = "words") -> DataFrame:
    """Sentences in a row as long as they fit the budget of words or characters; a longer one stands alone."""
    size = (lambda s: F.size(T.words(s))) if unit == "words" else F.length
    own = docs.select("doc_id", T.sentences(F.col("text")).alias("s"))
    empty = F.struct(F.lit(0).alias("n"), F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"))

    def add(acc: Column, s: Column) -> Column:
        flush = (acc.n > 0) & (acc.n + size(s) > budget)
        done = F.when(flush, F.concat(acc.done, F.array(acc.open))).otherwise(acc.done)
        return F.struct(F.when(flush, size(s)).otherwise(acc.n + size(s)).alias("n"), done.alias("done"), F.when(flush, F.array(s)).otherwise(F.concat(acc.open, F.array(s))).alias("open"))

    packed = F.aggregate("s", empty, add, lambda acc: F.when(F.size(acc.open) > 0, F.concat(acc.done, F.array(acc.open))).otherwise(acc.done))
    return _rows(own, F.transform(packed, lambda p, i: F.struct(i.alias("i"), F.array_join(p, " ").alias("text"))), "_s")


def sliding_windows(docs: DataFrame, size: int = 200, stride: int = 100) -> DataFrame:
    """Word windows; the last one ends with the text even if it is out of step; short texts are one chunk."""
    own = docs.select("doc_id", "text", T.words(F.col("text")).alias("items")).where(F.size("items") > 0)
    n = F.size("items")
    regular = F.transform(_windows(F.col("items"), size, stride, n - size), lambda w: w.part)
    tail = F.when((n - size) % stride != 0, F.array(F.slice("items", -size, size))).otherwise(F.array().cast("array<array<string>>"))
    texts = F.when(n <= size, F.array(F.col("text"))).otherwise(F.transform(F.concat(regular, tail), lambda p: F.array_join(p, " ")))
    return _rows(own, F.transform(texts, lambda t, i: F.struct(i.alias("i"), t.alias("text"))), "_sw")


def _with_cosines(docs: DataFrame) -> DataFrame:
    """(doc_id, s, sim): the sentences and each one's hashed-term cosine to the next, null at the end. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = []
            for sentences in batch.column(1).to_pylist():
                v = providers.hash_embed(sentences or [])
                sims.append([*np.round((v[:-1] * v[1:]).sum(1), 6).tolist(), None] if sentences else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.list_(pa.float64()))], ["doc_id", "s", "sim"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), T.sentences(F.col("text")).alias("s"))
    return own.mapInArrow(run, "doc_id long, s array<string>, sim array<double>")


def sentence_cosines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, sentence, sim): each sentence with its hashed-term cosine to the next; null at the end."""
    rows = _with_cosines(docs).select("doc_id", F.posexplode(F.arrays_zip("s", "sim")).alias("pos", "z"))
    return rows.select("doc_id", "pos", F.col("z.s").alias("sentence"), F.col("z.sim").alias("sim"))


def semantic_segments(docs: DataFrame, target_sentences: int = 250, least_sentences: int = 10) -> DataFrame:
    """Breaks where the similarity of neighbouring sentences has a strict local minimum, at least so many sentences apart.

    Up to three sentences are one chunk; without a minimum a break comes every ``target_sentences``.
    """
    n = F.size("s")
    at = lambda i: F.get("sim", i)
    inner = F.when(n > 2, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    minima = F.transform(F.filter(inner, lambda i: (at(i - 1) > at(i)) & (at(i + 1) > at(i))), lambda i: i + 1)
    regular = F.when(n > target_sentences, F.sequence(F.lit(target_sentences), n - 1, F.lit(target_sentences))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("cuts"))
    apart = lambda breaks: F.aggregate(breaks, start, lambda acc, b: F.when(b - acc.at < least_sentences, acc).otherwise(F.struct(b.alias("at"), F.concat(acc.cuts, F.array(b)).alias("cuts"))), lambda acc: acc.cuts)
    rows = _with_cosines(docs).where(n > 0).withColumn("minima", minima)
    breaks = F.when(F.size("minima") > 0, F.col("minima")).otherwise(regular)
    own = rows.withColumn("cuts", F.when(n <= 3, F.array().cast("array<int>")).otherwise(apart(breaks)))
    edges = F.concat(F.array(F.lit(0)), F.col("cuts"))
    ends = F.concat(F.col("cuts"), F.array(n))
    parts = F.transform(F.arrays_zip(edges.alias("a"), ends.alias("b")), lambda e, i: F.struct(i.alias("i"), F.array_join(F.slice("s", e.a + 1, e.b - e.a), " ").alias("text")))
    return _rows(own, parts, "_semantic")


def _per_text(docs: DataFrame, split: Callable[[str], list[str]], suffix: str) -> DataFrame:
    """Chunkers whose state has no column form, on Arrow batches. A text that a chunker fails on gives no chunk; how many
    did is counted in ``failures`` of the session."""
    spark = docs.sparkSession
    if _failed.get(id(spark.sparkContext)) is None:
        _failed[id(spark.sparkContext)] = spark.sparkContext.accumulator(0)
    failed = _failed[id(spark.sparkContext)]

    def parts(text: str | None) -> list[str]:
        try:
            return split(text or "")
        except Exception:  # noqa: BLE001 - one text must not stop the others
            failed.add(1)
            return []

    def run(batches):
        for batch in batches:
            rows = [(d, f"{d}{suffix}{i}", i, part) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for i, part in enumerate(parts(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_id", "chunk_index", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, CHUNK_SCHEMA)


_failed: dict[int, Accumulator] = {}


def failures(spark: SparkSession) -> int:
    """Texts that chunkers failed on so far in this session; a task that runs again counts again."""
    found = _failed.get(id(spark.sparkContext))
    return found.value if found else 0


#: Separators of the recursive splitter, and of the one that prefers paragraphs.
SEPARATORS = ("\n\n", "\n", " ", "")
PARAGRAPH_SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> list[str]:
    """Splits at the first separator that occurs, the parts that are still too long at the next ones, and joins
    neighbours up to the size, each chunk beginning with at most ``overlap`` characters of the one before."""
    here = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    sep, deeper = separators[here], separators[here + 1 :]
    pieces = [p for p in (text.split(sep) if sep else list(text)) if p]
    out: list[str] = []
    window: deque[str] = deque()
    held = 0  # length of the window, joined

    def emit() -> None:
        if joined := sep.join(window).strip():
            out.append(joined)

    for piece in pieces:
        if len(piece) > size and deeper:
            emit()
            window.clear()
            held = 0
            out += split_recursively(piece, size, overlap, deeper)
            continue
        more = len(piece) + (len(sep) if window else 0)
        if window and held + more > size:
            emit()
            while window and (held > overlap or held + more > size):
                held -= len(window.popleft()) + (len(sep) if window else 0)
                more = len(piece) + (len(sep) if window else 0)
        held += more
        window.append(piece)
    emit()
    return out


def recursive_chars(docs: DataFrame, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    return _per_text(docs, lambda t: split_recursively(t, size, overlap, separators), "_r")


def chars(docs: DataFrame, size: int = 1000, overlap: int = 200, separator: str = "\n") -> DataFrame:
    """Parts between separators, joined up to the size; a longer part stays whole."""
    return _per_text(docs, lambda t: split_recursively(t, size, overlap, (separator,)), "_c")


def topic_segments(docs: DataFrame, topics: int = 5) -> DataFrame:
    """Breaks between paragraphs where their TF-IDF similarity lies half a standard deviation below the mean."""
    return _per_text(docs, lambda t: _topics(t, topics), "_topic")


def _topics(text: str, topics: int) -> list[str]:
    import math
    import re
    from collections import Counter

    parts = [p.strip() for p in text.split("\n\n") if p.strip()]
    if len(parts) <= 3:
        return [text] if text else []
    counts = [Counter(w for w in re.findall(r"\w\w+", p.lower()) if w not in providers.STOP_WORDS) for p in parts]
    df = Counter(w for c in counts for w in c)
    known = {w: math.log((1 + len(parts)) / (1 + n)) + 1 for w, n in df.items() if n >= 2 and n <= 0.9 * len(parts)}
    if not known:
        return parts
    vectors = [{w: n * known[w] for w, n in c.items() if w in known} for c in counts]
    norms = [math.sqrt(sum(x * x for x in v.values())) for v in vectors]
    sims = [sum(x * b.get(w, 0) for w, x in a.items()) / (m * n) if m * n else 0.0 for a, b, m, n in zip(vectors, vectors[1:], norms, norms[1:], strict=False)]
    mean = sum(sims) / len(sims)
    low = mean - 0.5 * math.sqrt(sum((s - mean) ** 2 for s in sims) / len(sims))
    cuts = sorted((s, i + 1) for i, s in enumerate(sims) if s < low)[: topics - 1]
    edges = [0, *sorted(i for _, i in cuts), len(parts)]
    return ["\n\n".join(parts[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def _spans_alike(words: list[str], starts: list[int], size: int, stride: int) -> Callable[[int, int, int, int], float]:
    """The cosine of two spans' offline vectors. These are sums over their words, so running sums at the places where
    windows begin and end give any span's vector by one difference, however long it is."""
    ends = [min(e, len(words)) for s in starts for e in (s + size, s + stride + size)]
    places = sorted({0, len(words), *starts, *ends, *(min(i * stride, len(words)) for i in range(len(starts) + 1))})
    row = {p: i for i, p in enumerate(places)}
    sums = np.zeros((len(places), providers.DIMENSIONS))
    for i, (a, b) in enumerate(zip(places, places[1:], strict=False)):
        sums[i + 1] = sums[i] + providers.hashed_counts(" ".join(words[a:b]))

    def alike(a: int, b: int, c: int, d: int) -> float:
        x, y = sums[row[b]] - sums[row[a]], sums[row[d]] - sums[row[c]]
        norm = math.sqrt((x @ x) * (y @ y))
        return float(x @ y) / norm if norm else 0.0

    return alike


def sliding_coherent(docs: DataFrame, size: int = 200, stride: int = 100, threshold: float = 0.7, embed: str = "hash", compat: bool = False) -> DataFrame:
    """Sliding windows, each merged into the one before while their vectors' cosine reaches the threshold.

    ``compat`` ends a merged span one stride further, as the original rule did.
    """
    load = providers.EMBEDDERS[embed]  # known here, not on the workers

    def split(text: str) -> list[str]:
        words = text.split()
        if len(words) <= size:
            return [text] if words else []
        starts = list(range(0, len(words) - size + 1, stride))
        if (len(words) - size) % stride:
            starts.append(len(words) - size)
        alike = _spans_alike(words, starts, size, stride) if embed == "hash" else None
        provider = providers.loaded("embedder", embed, load)
        spans: list[tuple[int, int]] = []
        begin, end = 0, size
        for i, s in enumerate(starts[1:], 1):
            if alike is None:
                a, b = provider([" ".join(words[begin:end]), " ".join(words[s : s + size])])
                near = float(a @ b)
            else:
                near = alike(begin, end, s, s + size)
            if near >= threshold:
                if compat:
                    begin, end = len(spans) * stride, min((i + 1) * stride + size, len(words))
                else:
                    end = s + size
            else:
                spans.append((begin, end))
                begin, end = s, s + size
        return [" ".join(words[a:b]) for a, b in [*spans, (begin, end)]]

    return _per_text(docs, split, "_coherent")


STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "fixed_tokens": fixed_tokens,
    "token": fixed_tokens,
    "paragraphs": paragraphs,
    "sentence_pack": sentence_pack,
    "sentence": lambda docs, size=1000, overlap=0: sentence_pack(docs, size, "chars"),
    "sliding_windows": sliding_windows,
    "semantic_seg": semantic_segments,
    "topic_seg": topic_segments,
    "sliding_coherent": sliding_coherent,
    "recursive_chars": recursive_chars,
    "paragraph_chars": lambda docs, size=1000, overlap=200: recursive_chars(docs, size, overlap, PARAGRAPH_SEPARATORS),
    "chars": chars,
}


def chunk(docs: DataFrame, strategy: str = "recursive_chars", **how) -> DataFrame:
    """By name; an unknown name means the recursive splitter."""
    return STRATEGIES.get(strategy, recursive_chars)(docs, **how)


def validate(chunks: DataFrame, strategy: str, size: int, overlap: int) -> DataFrame:
    """Drops rows without text and names those without an id by their place in the document."""
    made = F.concat_ws("_", F.lit(strategy), F.lit(size), F.lit(overlap), F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))
    return chunks.where(F.col("text").isNotNull()).withColumn("chunk_id", F.coalesce("chunk_id", made))


def estimated_chunks(length: Column, size: int, overlap: int) -> Column:
    """How many windows a text of a length gives."""
    return F.when(length > 0, F.greatest(F.lit(1), F.floor((length - overlap) / (size - overlap)) + 1)).otherwise(0)
