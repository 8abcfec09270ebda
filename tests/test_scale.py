"""Ordered operators against brute force, with a group that holds most of the rows."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import scale
from granary.operators.operations import detect_drift
from granary.operators.windows import abc_classes


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [("hot", i, float(rng.randrange(200))) for i in range(4000)]
    rows += [(f"k{i % 50}", i, float(rng.randrange(10))) for i in range(1000)]
    rows.append((None, 1, 5.0))
    return rows, spark.createDataFrame(rows, "k string, i int, v double").repartition(8)


def test_running_totals_match_a_serial_walk(skewed):
    rows, df = skewed
    got = {(r.k, r.i): (r.t, r.t_all) for r in scale.running_totals(df, ["k"], [F.col("i")], {"t": F.col("v")}).collect()}
    want = {}
    for key, group in itertools.groupby(sorted(rows, key=lambda r: (str(r[0]), r[1])), key=lambda r: r[0]):
        group = list(group)
        total, whole = 0.0, sum(g[2] for g in group)
        for k, i, v in group:
            total += v
            want[(k, i)] = (total, whole)
    assert got == want


def test_global_order_is_split_over_slices(skewed):
    _, df = skewed
    numbered = scale.numbered(df, [F.desc("v"), F.col("k"), F.col("i")], "n")
    ordered = [r.n for r in numbered.orderBy(F.desc("v"), "k", "i").collect()]
    assert ordered == list(range(1, len(ordered) + 1))


def test_exact_quantiles_equal_numpy(skewed):
    rows, df = skewed
    probabilities = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r.k: r for r in scale.exact_quantiles(df, ["k"], ["v"], probabilities).collect()}
    for key in {r[0] for r in rows}:
        values = [r[2] for r in rows if r[0] == key]
        for name, p in probabilities.items():
            assert got[key][f"v_{name}"] == pytest.approx(np.quantile(values, p))


def test_no_stage_collects_the_hot_group(skewed):
    _, df = skewed
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        totals = scale.running_totals(df, ["k"], [F.col("i")], {"t": F.lit(1)})
        hot = totals.where("k = 'hot'").withColumn("p", F.spark_partition_id())
        sizes = [r["count"] for r in hot.groupBy("p").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) > 2 and max(sizes) < 3000


def test_abc_needs_a_positive_total(spark):
    zero = spark.createDataFrame([(1, 0.0), (2, 0.0)], "item_id int, revenue double")
    with pytest.raises(Exception, match="must be positive"):
        abc_classes(zero, "item_id", "revenue").collect()


def test_abc_thresholds(spark):
    df = spark.createDataFrame([(1, 80.0), (2, 15.0), (3, 5.0)], "item_id int, revenue double")
    assert {r.item_id: r.abc_class for r in abc_classes(df, "item_id", "revenue").collect()} == {1: "A", 2: "B", 3: "C"}


def test_drift_distance(spark):
    rng = np.random.default_rng(1)
    base, current = rng.normal(0, 1, 300).round(1), rng.normal(0.8, 1, 200).round(1)
    rows = [("x", float(v), False) for v in base] + [("x", float(v), True) for v in current] + [("y", 1.0, True)]
    df = spark.createDataFrame(rows, "item_id string, v double, cur boolean")
    got = {r.item_id: r for r in detect_drift(df, ["item_id"], "v", F.col("cur")).collect()}
    grid = np.unique(np.concatenate([base, current]))
    below = lambda s: np.searchsorted(np.sort(s), grid, side="right") / len(s)
    assert got["x"].test_statistic == pytest.approx(np.abs(below(base) - below(current)).max(), abs=1e-4)
    assert got["x"].p_value < 0.001
    assert got["y"].reason == "insufficient sample" and got["y"].p_value == 1.0 and not got["y"].drift_detected


@pytest.mark.parametrize("most, accuracy", [(200_000, 10_000), (2000, 100), (400, 20)])
def test_quantiles_of_a_table_by_brackets(spark, monkeypatch, most, accuracy):
    """Sketched brackets, narrowed where they hold too much, give the same as sorting everything."""
    monkeypatch.setattr(scale, "MOST", most)
    monkeypatch.setattr(scale, "ACCURACY", accuracy)
    rng = np.random.default_rng(7)
    n = 60_000
    a, b, c = rng.normal(size=n), rng.integers(0, 9, n).astype(float), np.where(rng.random(n) < 0.4, 5.0, rng.exponential(3, n))
    rows = [(float(x), None if i % 7 == 0 else float(y), float(z)) for i, (x, y, z) in enumerate(zip(a, b, c))]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(11)
    wanted = {"low": 0.0, "q1": 0.25, "mid": 0.5, "odd": 0.9137, "top": 1.0}
    got = scale.exact_quantiles(df, [], ["a", "b", "c"], wanted).first()
    for name, values in (("a", a), ("b", np.array([r[1] for r in rows if r[1] is not None])), ("c", c)):
        for q, p in wanted.items():
            assert got[f"{name}_{q}"] == pytest.approx(np.quantile(values, p), rel=1e-12), (name, q)


def test_quantiles_of_a_table_at_the_edges(spark):
    kind = "v double, w int"
    none = scale.exact_quantiles(spark.createDataFrame([], kind), [], ["v"], {"m": 0.5}).collect()
    assert [r.v_m for r in none] == [None]
    df = spark.createDataFrame([(None, 3), (2.0, None), (float("nan"), 1), (1.0, 2)], kind)
    got = scale.exact_quantiles(df, [], ["v", "w"], {"m": 0.5, "low": 0.0}).first()
    assert (got.v_m, got.v_low, got.w_m) == (2.0, 1.0, 2.0)
    one = scale.exact_quantiles(df.where("w = 3"), [], ["v", "w"], {"m": 0.5}).first()
    assert (one.v_m, one.w_m) == (None, 3.0)
