import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import analytics as A

RUNS = [("e1", "a", 1, 2.0, 0.5), ("e1", "a", 2, 4.0, 0.9), ("e1", "b", 3, 1.0, 0.9), ("e2", "b", 4, 3.0, None), ("e2", "c", 5, 5.0, None)]


@pytest.fixture
def runs(spark):
    return spark.createDataFrame(RUNS, "experiment string, method string, seq long, seconds double, metric_mrr double")


def test_union_of_different_schemas(spark, runs):
    got = A.union_runs([runs.select("seq"), runs.select("seq", "method")])
    assert got.count() == 10 and got.where("method is null").count() == 5


def test_group_statistics(runs):
    got = {r.method: r for r in A.summary(runs, ["method"], ["seconds"]).collect()}
    assert (got["a"].seconds_mean, got["a"].seconds_std, got["a"].n) == (3.0, round(2**0.5, 6), 2)
    assert got["c"].seconds_std is None
    assert {r.method: r.seconds for r in A.group_first(runs, ["method"], "seconds", "seq").collect()} == {"a": 2.0, "b": 1.0, "c": 5.0}
    ci = {r.method: r for r in A.confidence(runs, "method", "seconds").collect()}
    assert ci["c"].low == ci["c"].high == 5.0 and ci["a"].high > 3.0


def test_describe_and_correlation(runs):
    got = {r.measure: r for r in A.describe(runs, ["seconds", "metric_mrr"]).collect()}
    assert (got["seconds"].p25, got["seconds"].p50, got["metric_mrr"]["count"]) == (2.0, 3.0, 3)
    assert A.correlation(runs, "seconds", "seconds").first()[0] == 1.0


def test_best_rows(runs):
    assert A.best(runs, "metric_mrr", "seq").first().seq == 2
    assert A.best(runs, "seconds", "seq", smallest=True).first().seq == 3
    assert {r.method: r.seq for r in A.best(runs, "metric_mrr", "seq", ["method"]).collect()} == {"a": 2, "b": 3}
    assert A.best(runs.where("metric_mrr is null"), "metric_mrr", "seq").count() == 0


def test_metric_choice(runs):
    more = runs.withColumn("metric_none", F.lit(None).cast("double"))
    assert A.fallback_metric(more, "metric_none") == "metric_mrr"
    assert A.fallback_metric(more) == "metric_mrr"
    assert A.fallback_metric(runs.drop("metric_mrr")) is None
    assert A.plottable(more) == ["seq", "seconds", "metric_mrr"]
    assert {r.column: r.missing for r in A.missing(more, ["metric_none", "seconds"]).collect()} == {"metric_none": 5, "seconds": 0}


def test_balance_and_improvement(runs):
    got = {r.seq: r.balance for r in A.balance(runs, "metric_mrr", "seconds").collect()}
    assert got[3] == 1.0 and got[1] == 0.375 and got[4] is None
    assert A.balance(runs.where("seq = 1"), "metric_mrr", "seconds").first().balance is None
    gain = {r.method: r for r in A.improvement(runs, "method", "a", "metric_mrr", "seconds").collect()}
    assert gain["b"].improvement == 0.2 and gain["b"].per_second == 0.1 and gain["a"].relative == 0
    zero = A.improvement(runs.withColumn("metric_mrr", F.lit(0.0)), "method", "a", "metric_mrr").first()
    assert zero.relative is None


def test_pareto(spark, runs):
    rows = spark.createDataFrame([(1, 1.0, 0.2), (2, 2.0, 0.1), (3, 3.0, 0.5), (4, 3.0, 0.6), (5, 4.0, 0.6), (6, 0.5, -1.0)], "seq long, cost double, value double")
    assert sorted(r.seq for r in A.pareto(rows, "cost", "value", order="seq").collect()) == [1, 3, 4]
    assert sorted(r.seq for r in A.pareto(rows, "cost", "value", order="seq", floor=None).collect()) == [1, 3, 4, 6]


def test_shapes(spark, runs):
    pivot = {r.experiment: r for r in A.pivot_mean(runs, "experiment", "method", ["a", "c"], "seconds").collect()}
    assert pivot["e1"].a == 3.0 and pivot["e1"].c is None
    long = A.melt(runs.select("seq", "metric_mrr"), ["seq"], ["metric_mrr"])
    assert long.count() == 5 and long.first().metric == "Mrr"
    options = [spark.createDataFrame([(v,) for v in values], f"{name} string") for name, values in (("x", "122"), ("y", "abc"))]
    assert sorted((r.x, r.y) for r in A.config_grid(*options).collect()) == [(x, y) for x in "12" for y in "abc"]
    assert A.grid_size(*options).first().configurations == 6
    layers = spark.createDataFrame([(1, "size", 5.0, 1), (1, "size", 7.0, 2), (1, "k", 3.0, 1), (2, "size", 5.0, 9)], "user long, name string, value double, layer long")
    merged = A.merged_settings(layers, "user")
    assert {(r.user, r.name): r.value for r in merged.collect()} == {(1, "size"): 7.0, (1, "k"): 3.0, (2, "size"): 5.0}
    changed = A.changed_settings(A.merged_settings(layers.where("layer = 1"), "user"), merged, "user")
    assert sorted((r.user, r.name, r.old, r.new) for r in changed.collect()) == [(1, "size", 5.0, 7.0), (2, "size", None, 5.0)]
    assert A.keep_first(runs, ["experiment"], "seq").count() == 2
    assert A.quadrants(runs, "seconds", "seconds").where("quadrant = 'fast_good'").count() == 1
    assert A.best_per_experiment(runs, ["seconds"]).where("experiment = 'e2'").first().seconds == 5.0
    assert A.drop_incomplete(runs, ["metric_mrr"]).count() == 3
    assert A.display(runs, ["metric_mrr"]).where("metric_mrr = 'N/A'").count() == 2


def test_sample_is_exact_and_repeatable(spark):
    frame = spark.range(100)
    one, two, other = (sorted(r.id for r in A.sample(frame, "id", 10, s).collect()) for s in (1, 1, 2))
    assert len(set(one)) == 10 and one == two and one != other


def test_small_helpers(spark, runs):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "name string, x long")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "name string, x long")
    assert {(r.name, r.x) for r in A.upsert(old, new, "name").collect()} == {("a", 1), ("b", 3), ("c", 4)}
    order = runs.select("method").distinct().orderBy(A.ordered(F.col("method"), ["c", "a"])).collect()
    assert [r.method for r in order] == ["c", "a", "b"]
    assert "best_config" in A.recommendation(runs, "metric_mrr", "seq", ["method"]).first()[0]
    times = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-01-03"), ("b", "2024-01-05")], "k string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.place, r.place_in_type) for r in A.timeline(times, "k", "ts").where("k = 'a'").collect()) == [(0.0, 0.0), (0.5, 1.0)]
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "assistant", "b")], "conv_id long, turn long, role string, text string")
    assert [(r.question, r.answer) for r in A.turn_pairs(turns).collect()] == [("q", "a")]
    questions = spark.createDataFrame([("x", "easy"), ("y", None)], "category string, difficulty string")
    assert tuple(A.profile(questions).first()) == (2, "x,y", "easy")


def test_quantiles_equal_numpy(spark):
    import numpy as np

    r = np.random.default_rng(1)
    columns = {"a": r.normal(size=3000), "b": np.exp(r.normal(size=3000) * 30), "c": r.integers(0, 3, 3000).astype(float), "d": np.full(3000, 7.0)}
    df = spark.createDataFrame([tuple(float(c[i]) for c in columns.values()) for i in range(3000)], "a double, b double, c double, d double").selectExpr("*", "cast(null as double) e")
    got = A.quantiles(df, [*columns, "e"], [0.0, 0.25, 0.5, 0.9, 1.0])
    for name, values in columns.items():
        assert np.allclose(got[name], np.quantile(values, [0, 0.25, 0.5, 0.9, 1]), rtol=1e-12, atol=0)
    assert got["e"] == [None] * 5 and A.quantiles(df.limit(0), ["a"], [0.5]) == {"a": [None]}


def test_frontier_without_keys_equals_one_pass(spark):
    import random

    r = random.Random(1)
    rows = [(i, r.randrange(50) / 10, r.randrange(100) / 10) for i in range(400)]
    got = sorted(x.id for x in A.pareto(spark.createDataFrame(rows, "id long, cost double, value double"), "cost", "value", order="id").collect())
    best, want = 0.0, []
    for i, _, v in sorted(rows, key=lambda x: (x[1], x[0])):
        if v > best:
            best = v
            want.append(i)
    assert got == sorted(want)


def test_quantiles_with_infinities(spark):
    inf = float("inf")
    for values in ([1.0, 2.0, inf], [-inf, 1.0, 5.0, 9.0], [-inf, -inf, 3.0, inf, inf], [inf], [inf, inf], [1.0, float("nan"), -inf]):
        got = A.quantiles(spark.createDataFrame([(v,) for v in values], "x double"), ["x"], [0.0, 0.25, 0.5, 0.75, 1.0])["x"]
        own = sorted(v for v in values if v == v)
        for p, g in zip([0.0, 0.25, 0.5, 0.75, 1.0], got, strict=True):
            low, high = (np.quantile(own, p, method=m) for m in ("lower", "higher"))
            exact = p * (len(own) - 1)
            want = low if exact == int(exact) or low == high else low * (1 - exact + int(exact)) + high * (exact - int(exact))
            assert g == want or np.isnan(g) and np.isnan(want), (values, p)
