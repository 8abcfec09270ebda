"""Cleaning rules on small fixtures."""

import datetime

from pyspark.sql import functions as F

from granary.operators import cleaning as C
from granary.operators import joins as J


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


def test_gap_fill_leaves_keys_with_repeated_days_alone(spark):
    rows = [("a", day(0), 1.0), ("a", day(3), 2.0), ("b", day(0), 1.0), ("b", day(0), 5.0), ("b", day(4), 1.0)]
    filled = C.fill_calendar(spark.createDataFrame(rows, "k string, date date, q double"), ["k"])
    assert {r.k: r["count"] for r in filled.groupBy("k").count().collect()} == {"a": 4, "b": 3}


def test_mode_takes_the_smallest_of_equals(spark):
    df = spark.createDataFrame([("x",), ("b",), ("b",), ("x",), (None,)], "c string")
    assert C.impute_mode(df, ["c"]).where("c = 'b'").count() == 3


def test_json_text(spark):
    df = spark.createDataFrame([('[[1,2,3]]',), ('say "hi"',), (None,)], "price_breaks string")
    got = [r.price_breaks for r in C.conform_table(df, "suppliers").collect()]
    assert got == ['[[1,2,3]]', '"say \\"hi\\""', "null"]


def test_winsorize_keeps_nulls(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)] + [(None,)], "x double")
    got = sorted((r.x for r in C.winsorize_iqr(df, "x").collect()), key=lambda v: (v is None, v))
    assert got == [1.0, 2.0, 3.0, 4.0, 7.0, None]


def test_price_tiers_of_a_supplier(spark):
    text = "[[1,253,6.06],[254,973,5.57],[974,4999,4.75],[5000,null,4.3]]"
    suppliers = spark.createDataFrame([(1, text)], "supplier_id int, price_breaks string")
    orders = spark.createDataFrame([(1, q, 9.0) for q in (253, 254, 974, 5000, 0)] + [(2, 5, 9.0)], "supplier_id int, order_qty int, unit_price double")
    got = {(r.supplier_id, r.order_qty): (r.tier_chosen, r.tier_price) for r in J.assign_price_tier(orders, suppliers).collect()}
    assert got == {(1, 253): (1, 6.06), (1, 254): (2, 5.57), (1, 974): (3, 4.75), (1, 5000): (4, 4.3), (1, 0): (0, 9.0), (2, 5): (0, 9.0)}


def test_dense_grid_plan_has_no_cross_join(spark):
    df = spark.createDataFrame([("a", day(0), 1.0), ("b", day(1), 2.0)], "item string, date date, q double")
    grid = J.dense_grid(df, "item", "date", "q")
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert grid.count() == 4 and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).select(F.col("id").alias("item_id"), F.lit("x").alias("status"), F.current_date().alias("date")).write.parquet(path)
    out = C.for_product(spark.read.parquet(path), None, "date", status="X").select("item_id", "date")
    assert "PushedFilters: [" in out._jdf.queryExecution().executedPlan().toString()


def test_rolling_windows_need_every_value(spark):
    import numpy as np
    import pandas as pd

    from granary.operators.windows import rolling_features

    values = [3.0, 1.0, None, 4.0, 8.0, 2.0, 6.0, None, 5.0, 9.0, 7.0, 1.0]
    df = spark.createDataFrame([("a", day(i), v) for i, v in enumerate(values)], "k string, date date, q double")
    series = pd.Series(values, dtype=float)
    for statistics in (("mean", "median", "std", "min", "max"), ("mean", "std", "min", "max")):
        got = rolling_features(df, ["q"], (2, 3), statistics, ["k"], complete=False).orderBy("date").toPandas()
        for w in (2, 3):
            for s in statistics:
                want = series.rolling(w).agg(s)
                assert np.allclose(got[f"q_roll_{w}_{s}"].astype(float), want, equal_nan=True), (w, s)


def test_both_ways_of_filling_a_calendar_agree(spark):
    rows = [("a", day(0), 1.0), ("a", day(3), None), ("a", day(9), 2.0), ("b", day(4), 1.0)]
    df = spark.createDataFrame(rows, "k string, date date, q double")
    key = lambda r: (r.k, r.date)
    one = sorted(C.fill_calendar(df, ["k"]).collect(), key=key)
    two = sorted(C.fill_calendar(df, ["k"], unique=True).collect(), key=key)
    assert one == two and len(one) == 11
