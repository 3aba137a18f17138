"""Analytics over experiment runs: one row per iteration, measures as columns."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def union_runs(frames: list[DataFrame]) -> DataFrame:
    """Runs of different schemas under each other; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def metric_columns(df: DataFrame, prefix: str = "metric_") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def group_mean(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.round(F.avg(m), 6).alias(m) for m in measures])


def summary(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Mean, sample deviation (null for one row) and count of each group."""
    parts = [f(m) for m in measures for f in (lambda m: F.round(F.avg(m), 6).alias(f"{m}_mean"), lambda m: F.round(F.stddev_samp(m), 6).alias(f"{m}_std"))]
    return df.groupBy(*keys).agg(*parts, F.count("*").alias("n"))


def group_first(df: DataFrame, keys: list[str], column: str, order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(column, order).alias(column))


#: Bins into which a bracket is cut in one pass of the search for a quantile.
BINS = 1000


def quantiles(df: DataFrame, measures: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles of each measure, null for one without values; infinities count as the ends they are.

    Every pass counts the rows in the bins of each wanted rank's bracket and goes on with the bin that holds the rank,
    so no task and no message ever holds more than some thousand bins, however many values there are.
    """
    measures = list(dict.fromkeys(measures))
    long = df.select(*[F.col(m).cast("double").alias(m) for m in measures]).unpivot([], measures, "measure", "value").where("value is not null and not isnan(value)")
    inf, finite = float("inf"), F.abs("value") < float("inf")
    least, largest = (F.min(F.when(finite, F.col("value"))), F.max(F.when(finite, F.col("value"))))
    sizes = {r.measure: r for r in long.groupBy("measure").agg(F.count("*").alias("n"), F.count_if(F.col("value") == -inf).alias("low"), F.count_if(F.col("value") == inf).alias("high"), least.alias("lo"), largest.alias("hi")).collect()}
    long = long.where(F.abs("value") < inf)  # infinities are known by their number
    ends = lambda n, p: (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))
    open_ = {}
    for m, s in sizes.items():
        for k in (k for p in shares for k in ends(s.n, p)):
            open_[m, k] = [0, -inf, -inf] if k < s.low else [0, inf, inf] if k >= s.n - s.high else [s.low, s.lo, s.hi]
    while active := [(m, k, *v) for (m, k), v in open_.items() if v[1] < v[2]]:
        brackets = F.broadcast(df.sparkSession.createDataFrame(active, "measure string, k long, below long, lo double, hi double"))
        bin = F.least(F.floor((F.col("value") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS), F.lit(BINS - 1))
        inside = long.join(brackets, "measure").where("value between lo and hi").groupBy("measure", "k", bin.alias("bin"))
        counts: dict[tuple, list] = {}
        for r in inside.agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect():
            counts.setdefault((r.measure, r.k), []).append((r.bin, r.n, r.lo, r.hi))
        for key, bins in counts.items():
            below = open_[key][0]
            for _, n, lo, hi in sorted(bins):
                if key[1] < below + n:
                    open_[key] = [below, lo, hi]
                    break
                below += n

    def value(m: str, p: float) -> float | None:
        if m not in sizes:
            return None
        low, high = ends(sizes[m].n, p)
        part = p * (sizes[m].n - 1) - low
        a, b = open_[m, low][1], open_[m, high][1]
        return a if part == 0 or a == b else a * (1 - part) + b * part

    return {m: [value(m, p) for p in shares] for m in measures}


def describe(df: DataFrame, measures: list[str]) -> DataFrame:
    """One row per measure: count, mean, std, min, quartiles (interpolated) and max."""
    long = df.unpivot([], measures, "measure", "value")
    found = quantiles(df, measures, [0.25, 0.5, 0.75])
    rows = df.sparkSession.createDataFrame([(m, *q) for m, q in found.items()], "measure string, p25 double, p50 double, p75 double")
    got = long.groupBy("measure").agg(F.count("value").alias("count"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return got.join(F.broadcast(rows), "measure").select("measure", "count", "mean", "std", "min", *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p75")], "max")


def pivot_mean(df: DataFrame, row: str, column: str, values: list, measure: str) -> DataFrame:
    """Values are named, so no extra job looks for them."""
    out = df.groupBy(row).pivot(column, values).agg(F.round(F.avg(measure), 6))
    return out.select(row, *[F.col(f"`{v}`").alias(str(v)) for v in values])


def melt(df: DataFrame, ids: list[str], measures: list[str]) -> DataFrame:
    """Wide to long, with readable labels."""
    out = df.unpivot(ids, measures, "metric", "score")
    return out.withColumn("metric", F.initcap(F.regexp_replace(F.regexp_replace("metric", "^metric_", ""), "_", " ")))


def best(df: DataFrame, measure: str, order: str, keys: list[str] | None = None, smallest: bool = False) -> DataFrame:
    """The row with the best measure, overall or per group; nulls never win, ties go to the first in order.

    Overall it is a top-1 sort, per group a pre-aggregation: no group's rows meet in a window.
    """
    known = df.where(F.col(measure).isNotNull())
    sort = F.asc(measure) if smallest else F.desc(measure)
    if not keys:
        return known.orderBy(sort, order).limit(1)
    value = F.col(measure).cast("double")
    rest = [c for c in df.columns if c not in keys]
    least = F.min(F.struct((value if smallest else -value).alias("_v"), F.col(order).alias("_o"), *rest)).alias("m")
    return known.groupBy(*keys).agg(least).select(*keys, *[F.col(f"m.{c}").alias(c) for c in rest])


def fallback_metric(df: DataFrame, prefer: str = "metric_mrr") -> str | None:
    """The preferred measure, else the first that is not all null."""
    names = metric_columns(df)
    counts = df.agg(*[F.count(c).alias(c) for c in names]).first() if names else {}
    usable = [c for c in names if counts[c]]
    return prefer if prefer in usable else usable[0] if usable else None


def plottable(df: DataFrame) -> list[str]:
    """Numeric columns that are not all null."""
    names = [f.name for f in df.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double")]
    counts = df.agg(*[F.count(c).alias(c) for c in names]).first() if names else {}
    return [c for c in names if counts[c]]


def min_max(column: str, low: str, high: str, invert: bool = False) -> Column:
    x = (F.col(column) - F.col(low)) / F.nullif(F.col(high) - F.col(low), F.lit(0.0))
    return 1 - x if invert else x


def balance(df: DataFrame, quality: str, cost: str) -> DataFrame:
    """Half normalised quality, half inverted normalised cost; null where a range is zero."""
    ends = df.agg(F.min(quality).alias("_ql"), F.max(quality).alias("_qh"), F.min(cost).alias("_cl"), F.max(cost).alias("_ch"))
    score = 0.5 * min_max(quality, "_ql", "_qh") + 0.5 * min_max(cost, "_cl", "_ch", invert=True)
    return df.crossJoin(F.broadcast(ends)).withColumn("balance", F.round(score, 6)).drop("_ql", "_qh", "_cl", "_ch")


def improvement(df: DataFrame, key: str, baseline: str, measure: str, seconds: str | None = None) -> DataFrame:
    """Means per group against the baseline group's: absolute, relative (null for a zero baseline), and per second."""
    mean = df.groupBy(key).agg(F.avg(measure).alias("mean"), *([F.avg(seconds).alias("seconds")] if seconds else []))
    base = df.agg(F.avg(F.when(F.col(key) == baseline, F.col(measure))).alias("base"))
    both = mean.crossJoin(F.broadcast(base))
    gain = F.col("mean") - F.col("base")
    out = [key, F.round("mean", 6).alias("mean"), F.round(gain, 6).alias("improvement"), F.round(gain / F.nullif(F.abs("base"), F.lit(0.0)), 6).alias("relative")]
    if seconds:
        out.append(F.round(gain / F.nullif(F.col("seconds"), F.lit(0.0)), 6).alias("per_second"))
    return both.select(*out)


#: Parts of which each finds its own frontier before the rest meets.
PARTS = 64


def pareto(df: DataFrame, cost: str, value: str, keys: list[str] | None = None, order: str | None = None, floor: float | None = 0.0) -> DataFrame:
    """Rows that beat every cheaper one: sorted by cost, the strict new maxima above the floor (none: -infinity).

    A row on the frontier is on that of any part of the rows, so parts dealt by a hash are thinned out first; only
    their frontiers meet in one window.
    """

    def thin(rows: DataFrame, *by: Column) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(cost, *([order] if order else [F.desc(value)])).rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.max(value).over(w), F.lit(float("-inf") if floor is None else floor))
        least = before if floor is None else F.greatest(before, F.lit(floor))
        return rows.withColumn("_before", least).where(F.col(value) > F.col("_before")).drop("_before")

    own = [F.col(k) for k in keys or ()]
    parts = thin(df, *own, F.pmod(F.xxhash64(*df.columns), F.lit(PARTS)))
    return thin(parts, *(own or [F.lit(1)]))


def confidence(df: DataFrame, key: str, measure: str) -> DataFrame:
    """Mean with its 95 % interval; no width for one row."""
    got = df.groupBy(key).agg(F.avg(measure).alias("m"), F.stddev_samp(measure).alias("s"), F.count(measure).alias("n"))
    half = F.coalesce(1.96 * F.col("s") / F.sqrt("n"), F.lit(0.0))
    return got.select(key, F.round("m", 6).alias("mean"), F.round(F.col("m") - half, 6).alias("low"), F.round(F.col("m") + half, 6).alias("high"), "n")


def correlation(df: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    return (df.groupBy(*keys) if keys else df.groupBy()).agg(F.round(F.corr(a, b), 6).alias("corr"))


def quadrants(df: DataFrame, cost: str, value: str) -> DataFrame:
    """Rows by the medians of both measures: fast or slow, good or poor."""
    middle = {m: F.lit(q[0]).cast("double") for m, q in quantiles(df, [cost, value], [0.5]).items()}
    name = F.concat_ws("_", F.when(F.col(cost) <= middle[cost], "fast").otherwise("slow"), F.when(F.col(value) >= middle[value], "good").otherwise("poor"))
    return df.withColumn("quadrant", name)


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the first in order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(F.col(order).alias("_o"), *rest)).alias("m")).select(*keys, *[F.col(f"m.{c}").alias(c) for c in rest])


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing): nulls per column."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "missing")


def config_grid(*options: DataFrame) -> DataFrame:
    """The product of all options, one row each. options: frames of one column, whose distinct values they are."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [o.distinct() for o in options])


def merged_settings(layers: DataFrame, key: str, name: str = "name", value: str = "value", layer: str = "layer") -> DataFrame:
    """(key, name, value): of each setting the value of its last layer. Layers of equal number: the larger value."""
    return layers.groupBy(key, name).agg(F.max(F.struct(layer, value)).alias("last")).select(key, name, F.col(f"last.{value}").alias(value))


def changed_settings(old: DataFrame, new: DataFrame, key: str, name: str = "name", value: str = "value") -> DataFrame:
    """(key, name, old, new) of settings that differ, null where one side lacks them."""
    both = old.select(key, name, F.col(value).alias("old")).join(new.select(key, name, F.col(value).alias("new")), [key, name], "full_outer")
    return both.where(~F.col("old").eqNullSafe(F.col("new")))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def ordered(column: Column, order: list[str]) -> Column:
    """Sort key of an ordered category; unknown ones come last."""
    at = F.array_position(F.array(*map(F.lit, order)), column)
    return F.when(at > 0, at).otherwise(len(order) + 1)


def lookup(column: Column, table: dict[str, float], default: float | None = None) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def timeline(runs: DataFrame, key: str, ts: str) -> DataFrame:
    """Each run's place between the first and the last of its type and of all, from 0 to 1."""
    own = runs.groupBy(key).agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    all_ = runs.agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    s = lambda c: F.unix_micros(F.col(c).cast("timestamp")).cast("double")
    place = lambda a, b: F.round((s(ts) - s(a)) / F.nullif(s(b) - s(a), F.lit(0.0)), 6)
    return runs.join(own, key).crossJoin(F.broadcast(all_)).withColumn("place", place("_a", "_b")).withColumn("place_in_type", place("first", "last")).drop("_a", "_b", "first", "last")


def sample(df: DataFrame, id: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all) without replacement, the same for the same seed."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string"))), id).limit(n)


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """Each assistant turn with the user turn right before it: (conv_id, turn, question, answer)."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.withColumn("before", F.lag("role").over(order)).withColumn("question", F.lag("text").over(order))
    return rows.where("role = 'assistant' and before = 'user'").select("conv_id", "turn", "question", F.col("text").alias("answer"))


def common_measures(df: DataFrame, measures: list[str], key: str = "experiment") -> list[str]:
    """The measures of which every experiment has a value."""
    counts = df.groupBy(key).agg(*[F.count(m).alias(m) for m in measures]).agg(*[F.min(m).alias(m) for m in measures]).first()
    return [m for m in measures if counts[m]]


def best_per_experiment(df: DataFrame, measures: list[str]) -> DataFrame:
    """Each experiment's best value of the measures that all experiments have."""
    return df.groupBy("experiment").agg(*[F.max(m).alias(m) for m in common_measures(df, measures)])


def recommendation(df: DataFrame, measure: str, order: str, keys: list[str]) -> DataFrame:
    """One row of JSON: the best configuration and its score."""
    row = best(df, measure, order)
    return row.select(F.to_json(F.struct(F.struct(*keys).alias("best_config"), F.round(measure, 6).alias("score"), F.lit(measure).alias("metric"))).alias("recommendation"))


def profile(questions: DataFrame) -> DataFrame:
    """One row: how many questions, which categories and difficulties."""
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",").alias(c)
    return questions.agg(F.count("*").alias("questions"), names("category"), names("difficulty"))


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def display(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values as text with four digits, N/A for null."""
    return df.select(*[c for c in df.columns if c not in columns], *[F.coalesce(F.format_number(c, 4), F.lit("N/A")).alias(c) for c in columns])


def head(df: DataFrame, order: list[str | Column], n: int) -> DataFrame:
    """The first n rows in an order of one or several keys."""
    return df.orderBy(*order).limit(n)


def has_rows(df: DataFrame) -> bool:
    return not df.isEmpty()


def grid_size(*options: DataFrame) -> DataFrame:
    """One row: how many configurations ``config_grid`` has."""
    sizes = [o.distinct().agg(F.count("*").alias(f"n{i}")) for i, o in enumerate(options)]
    product = reduce(lambda a, b: a * b, [F.col(f"n{i}") for i in range(len(options))])
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), sizes).select(product.alias("configurations"))


def best_value(df: DataFrame, key: str, measure: str) -> DataFrame:
    """The value of a setting with the best mean of a measure; of equal ones the smallest."""
    return best(group_mean(df, [key], [measure]), measure, key)
