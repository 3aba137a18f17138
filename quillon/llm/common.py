"""Helpers shared by the operators of this package."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows and bytes of one Arrow batch. Long texts come in small batches, so a worker's memory stays bounded.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that later Python operators of this session receive."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all machines share; see ``materialize``."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Writes the rows once to the shared checkpoint folder and cuts the lineage there.

    The folder comes from ``spark.checkpoint.dir``. Where that is unset, a temporary one is taken on a single
    machine; on a cluster, whose machines would not see it, that is an error.
    """
    shared_folder(df.sparkSession)
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("rows")).checkpoint(eager=True)
    out.known_rows = seen.get.get("rows")  # counted on the way, for ``few``
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver's table. One of fewer splits than half the session's cores, such as one small file, is dealt to all of them."""
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if 2 * rows.rdd.getNumPartitions() <= cores else rows


def crc_mod(column: str, n: int) -> Column:
    """The CRC-32 of the id written as text, modulo n (null ids: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


#: Rows of up to some 16 bytes that may be broadcast.
BROADCAST_ROWS = 100_000


def few(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Materialised rows, broadcast in joins if there are few enough of them."""
    most = BROADCAST_ROWS if rows is None else rows
    n = getattr(df, "known_rows", None)
    if n is None:
        df = materialize(df)
        n = df.count() if df.known_rows is None else df.known_rows
    out = F.broadcast(df) if n <= most else df
    out.known_rows = n
    return out


def fresh(df: DataFrame, name: str) -> str:
    """A column name like the given one that the rows do not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def least_hashed(rows: DataFrame, group: str, id: str, k: int) -> DataFrame:
    """(group, id, rank): of each group the k ids that come first by their hash, ranked from 1.

    Ids are counted first, so only as many as are surely needed, about 2 k of each group, reach the ranking task.
    """
    sizes = rows.groupBy(group).agg(F.approx_count_distinct(id).alias("n"))
    share = F.least(F.lit(1.0), F.lit(2.0 * k + 100) / F.greatest(F.col("n"), F.lit(1)))
    bound = sizes.select(group, (share * F.lit(2.0**64) - F.lit(2.0**63)).alias("bound"))
    low = rows.join(few(bound), group).where(F.xxhash64(id) <= F.col("bound")).groupBy(group, id).agg(F.first("bound").alias("bound"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64(id), id))
    return low.withColumn("rank", rank).where(F.col("rank") <= k).select(group, id, "rank")


#: Rows of one key from which it counts as hot.
HOT_ROWS = 20_000


def join_hot(rows: DataFrame, sums: DataFrame, key: str, n: str, how: str = "left") -> DataFrame:
    """rows with the columns of sums, which has one materialised row per key and in n how many rows have it.

    Null keys meet each other. Few sums are broadcast. Of more, those of hot keys, at most one in ``HOT_ROWS`` of the
    rows, meet theirs by a broadcast if they are few, and theirs are dealt over all tasks; only the rest is joined by key.
    """
    others = [c for c in sums.columns if c not in (key, n)]
    sums = few(sums)
    right = lambda s, tag: s.select(F.col(key).alias(tag), *[F.col(c) for c in others])
    if sums.known_rows <= BROADCAST_ROWS:
        tag = fresh(rows, "key_")
        return rows.join(F.broadcast(right(sums, tag)), F.col(key).eqNullSafe(F.col(tag)), how).drop(tag)
    hot = few(sums.where(F.col(n) > HOT_ROWS))
    tag = fresh(rows, "key_")
    heavy = rows.join(right(hot, tag), F.col(key).eqNullSafe(F.col(tag)), "left_semi")
    light = rows.join(right(hot, tag), F.col(key).eqNullSafe(F.col(tag)), "left_anti")
    return heavy.join(right(hot, tag), F.col(key).eqNullSafe(F.col(tag)), how).drop(tag).unionByName(light.join(right(sums.where(F.col(n) <= HOT_ROWS), tag), F.col(key).eqNullSafe(F.col(tag)), how).drop(tag))
