"""Permutation importance against what the data say, and over different partitionings."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from granary.operators.explanation import permutation_importance


def rows(spark, n):
    drawn = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) / 1000
    made = spark.range(n).select(drawn(1).alias("a"), drawn(2).alias("b"), drawn(3).alias("c"))
    return made.withColumn("y", 3 * F.col("a") + F.col("b"))


def importances(df, spark, parts, repeats=3):
    model = PipelineModel([SQLTransformer(statement="SELECT *, 3 * a + b AS yhat FROM __THIS__")])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = permutation_importance(model, df.repartition(parts), ["a", "b", "c"], "y", repeats)
        return {r.feature: (r.importance, r.importance_std) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_same_for_any_partitioning(spark):
    df = rows(spark, 2000)
    first = importances(df, spark, 3)
    for parts in (16, 40):
        again = importances(df, spark, parts)
        for feature, values in first.items():
            assert again[feature] == pytest.approx(values, abs=1e-9)


def test_a_shuffle_costs_twice_the_share_of_variance(spark):
    found = importances(rows(spark, 4000), spark, 4, repeats=10)
    assert found["a"][0] == pytest.approx(1.8, abs=0.1)
    assert found["b"][0] == pytest.approx(0.2, abs=0.05)
    assert found["c"][0] == 0


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    assert len(importances(rows(spark, n), spark, 2)) == (3 if n else 0)
