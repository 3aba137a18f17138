"""SimHash near-duplicates by pigeonring filtering.

A fingerprint's 64 bits form a ring of segments. If two fingerprints differ in at most ``distance`` bits then,
starting at some segment, every chain of l consecutive segments differs in at most l * distance / segments
bits. With five segments and distance 2 the first two segments of such a chain must agree, the third and
fourth may add one bit, the whole ring two. So fingerprints meet on two neighbouring segments (26 bits), the
chain's other budgets prune the pairs, and only then all bits are compared.

Only distinct fingerprints meet. A meeting key with more than ``crowd`` of them is never paired out: its
fingerprints emit all points within one bit of themselves instead. Two fingerprints are within two bits just
if these balls share a point, all that share a point are within two bits of each other, and at most 65 can,
so linking each to the smallest loses no link between components.

Defined results: null and empty texts have fingerprint zero and link like any other; texts of any length are read
whole; ties of a bit (exactly half of the shingles) give zero; rows with equal ids or null ids are kept as they are;
an empty table gives no rows; further columns, of whatever names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import few, fresh, materialize, small_batches
from quillon.llm.components import components

WIDTHS = (13, 13, 13, 13, 12)
DISTANCE = 2
SHINGLE = 3
CROWD = 24
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(words[i : i + shingle]), 42) for i in range(n)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def signed(fingerprint: int) -> int:
    return fingerprint - (1 << 64) if fingerprint >> 63 else fingerprint


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64 majority bits over the hashes of all shingles, repeats included; zero without any."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, mark (a hash of the text) and fp, the fingerprint's bits as a signed long, per row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "mark", "fp"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(cast(text as string)) mark", "cast(text as string) text")
    return rows.mapInArrow(run, "doc_id long, mark long, fp long")


def _mask(first: int, n: int) -> int:
    """The bits of n segments from one on, round the ring, as a signed long."""
    out = 0
    for s in range(first, first + n):
        s %= len(WIDTHS)
        out |= ((1 << WIDTHS[s]) - 1) << sum(WIDTHS[:s])
    return out - (1 << 64) if out >> 63 else out


def _differ(mask: Column | None = None) -> Column:
    x = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    return F.bit_count(x if mask is None else x.bitwiseAND(mask))


def links(fps: DataFrame, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all within the distance."""
    m = len(WIDTHS)
    if distance * 2 >= m:
        raise ValueError("the segments are laid out for a distance of 2 at most")
    keys = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_mask(i, 2))).alias("key")) for i in range(m)])).alias("k")).select("fp", "k.i", "k.key")
    sizes = keys.groupBy("i", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(keys.join(few(sizes), ["i", "key"]))
    rare = met.where(F.col("n") <= crowd)
    budget = F.lit(True)
    for i in range(m):
        chain = F.lit(True)
        for n in range(3, m):
            chain = chain & (_differ(F.lit(_mask(i, n))) <= n * distance // m)
        budget = F.when(F.col("l.i") == i, chain).otherwise(budget)
    pairs = rare.alias("l").join(rare.alias("r"), (F.col("l.i") == F.col("r.i")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.fp") < F.col("r.fp"))).where(budget).where(_differ() <= distance).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(64)])
    balls = met.where(F.col("n") > crowd).select("fp").distinct().select("fp", F.explode(flips).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("point"))
    least = balls.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    if distance < 2:
        return pairs.unionByName(_near(balls, least, distance))
    return pairs.unionByName(balls.join(least, "point").where("fp <> a").select("a", F.col("fp").alias("b"))).distinct()


def _near(balls: DataFrame, least: DataFrame, distance: int) -> DataFrame:
    """Of the fingerprints that share a point (65 at most), the pairs that are nearer still."""
    shared = balls.join(least.select("point"), "point")
    pair = shared.alias("l").join(shared.alias("r"), "point").where(F.col("l.fp") < F.col("r.fp")).where(_differ() <= distance)
    return pair.select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b")).distinct()


def grouped(prints: DataFrame, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """From rows with doc_id and fp: their columns and component_id, the smallest id of all documents each is linked to."""
    first = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")))
    roots = components(links(first.select("fp"), distance, crowd))
    linked = first.join(few(roots), first.fp == roots.node)
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = linked.join(few(least), "root").select("fp", "component_id")
    alone = first.where("copies > 1").join(found.select("fp"), "fp", "left_anti").select("fp", F.col("first_id").alias("component_id"))
    return prints.join(few(found.unionByName(alone)), "fp", "left").select(*prints.columns, F.coalesce("component_id", "doc_id").alias("component_id"))


def classes(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """doc_id, mark (a hash of the text), fp and component_id per row."""
    return grouped(materialize(fingerprints(docs, shingle)), distance, crowd)


def first_of(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Of each class in found (doc_id, mark, component_id) the row with the smallest id, with all its columns.

    Rows are told by id and text, so texts under one id are judged each for itself; of equal rows one stays. Rows with
    a null id have no identity to be linked by, and stay. Only ids are shuffled while few rows go.
    """
    id, mark = fresh(docs, "copy_id"), fresh(docs, "copy_mark")
    own = [F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))]
    named = found.select(F.col("doc_id").alias(id), F.col("mark").alias(mark), F.col("component_id").alias("least"))
    named = materialize(named.where(F.col(id).isNotNull()).groupBy(id, mark).agg(F.min("least").alias("least"), F.count("*").alias("n")))
    goes = few(named.where(F.col("least") != F.col(id)).select(id, mark))
    same = (own[0] == F.col(id)) & (own[1] == F.col(mark))
    rest = docs.join(goes, same, "left_anti")
    repeated = named.where((F.col("least") == F.col(id)) & (F.col("n") > 1)).select(id, mark)
    if repeated.isEmpty():
        return rest
    repeated = few(repeated)
    once = rest.join(repeated, same, "left_semi").withColumns({id: own[0], mark: own[1]}).dropDuplicates([id, mark]).drop(id, mark)
    return rest.join(repeated, same, "left_anti").unionByName(once)


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The first document of each class; see ``first_of``."""
    return first_of(docs, classes(docs, **how))
