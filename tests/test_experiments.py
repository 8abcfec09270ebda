"""Distribution tails against tabulated values; assignment shares and stability; bootstrap sanity."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import experiments as X


def test_student_tail_against_tables():
    t = np.array([2.228, 12.706, 1.960, 2.576, 0.0, 63.657])
    df = np.array([10, 1, 1e6, 1e6, 5, 1])
    assert X.student_tail(t, df) == pytest.approx([0.05, 0.05, 0.05, 0.01, 1.0, 0.01], abs=1e-4)
    assert X.student_quantile(np.array([0.05, 0.05]), np.array([10.0, 30.0])) == pytest.approx([2.2281, 2.0423], abs=1e-3)


def test_assignment_is_stable_and_even(spark):
    users = spark.range(10_000).select(F.concat(F.lit("user_"), "id").alias("u"))
    one = users.withColumn("v", X.assign_uniform(F.col("u"), ["A", "B", "C"]))
    two = users.repartition(7).withColumn("w", X.assign_uniform(F.col("u"), ["A", "B", "C"]))
    assert one.join(two, "u").where("v != w").count() == 0
    shares = [r["count"] / 10_000 for r in one.groupBy("v").count().collect()]
    assert len(shares) == 3 and all(0.3 < s < 0.4 for s in shares)


def test_sticky_weights(spark):
    users = spark.range(20_000).withColumn("v", X.assign_sticky(F.col("id"), None, {"a": 0.1, "b": 0.6, "c": 0.3}))
    shares = {r.v: r["count"] / 20_000 for r in users.groupBy("v").count().collect()}
    assert shares == pytest.approx({"a": 0.1, "b": 0.6, "c": 0.3}, abs=0.02)


def test_stratified_digits(spark):
    df = spark.createDataFrame([("P12",), ("P13",), ("Px",), (None,)], "p string")
    rows = {r.p: r.v for r in df.withColumn("v", X.assign_stratified(F.col("p"), {"control": 0.5, "variant": 0.5})).collect()}
    assert rows["P12"] == "control" and rows["P13"] == "variant" and rows["Px"] == "control"
    assert rows[None] in ("control", "variant")


@pytest.fixture(scope="module")
def two_groups(spark):
    rng = np.random.default_rng(2)
    rows = [("a", "m", float(v)) for v in rng.normal(10, 2, 400)] + [("b", "m", float(v)) for v in rng.normal(11, 2, 300)]
    return rows, spark.createDataFrame(rows, "variant string, metric string, value double")


def test_welch_statistic(two_groups):
    rows, df = two_groups
    a, b = (np.array([v for g, _, v in rows if g == x]) for x in "ab")
    want = (a.mean() - b.mean()) / np.sqrt(a.var(ddof=1) / len(a) + b.var(ddof=1) / len(b))
    row = X.t_tests(df).first()
    assert row.t_statistic == pytest.approx(want) and row.p_value < 0.001 and row.significant
    assert row.ci_low_a < a.mean() < row.ci_high_a
    small = X.t_tests(df, min_sample=350).first()
    assert small.status == "insufficient_sample" and not small.significant


def test_bootstrap_covers_the_difference(two_groups):
    rows, df = two_groups
    row = X.bootstrap_test(df, replicates=500).first()
    again = X.bootstrap_test(df.repartition(5), replicates=500).first()
    assert row.ci_low < row.original_diff < row.ci_high
    assert row.p_value < 0.05 and row.p_value_ref > 0.5
    assert again.ci_low == pytest.approx(row.ci_low)
    spread = np.sqrt(sum(np.var([v for g, _, v in rows if g == x]) / sum(g == x for g, _, _ in rows) for x in "ab"))
    assert (row.ci_high - row.ci_low) / 2 == pytest.approx(1.96 * spread, rel=0.2)


def test_groups_without_spread_have_no_statistic(spark):
    rows = [("a", "m", 1.0), ("a", "m", 1.0), ("b", "m", 2.0)]
    df = spark.createDataFrame(rows, "variant string, metric string, value double")
    assert X.t_statistics(df).first().t_statistic is None
    assert X.t_statistics(df, pooled=True).first().cohens_d is None
