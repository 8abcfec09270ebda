"""Feature vectors, intermittent models and policies against hand-computed values; invariants of the rest."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import scalars as S
from granary.models import intermittent as I
from granary.models import regression as R
from granary.models import selection as SEL
from granary.models import series as M
from granary.operators import aggregates as A

T1 = [10, 12, 8, 15, 20, 50, 18, 16, 14, 12, 10, 8, 12, 15, 18, 20, 16, 14, 12, 10]
INT = [0, 0, 0, 15, 0, 0, 0, 20, 0, 0, 0, 18, 0, 0, 0, 25]
ST = [10, 11, 9, 10, 11, 10, 9, 10, 11, 10, 9, 10]


def panel(spark, **series):
    start = datetime.date(2024, 1, 1)
    rows = [
        (name, "w", start + datetime.timedelta(days=i), float(v))
        for name, values in series.items()
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, "item_id string, location_id string, date date, demand_qty double")


@pytest.fixture(scope="module")
def three(spark):
    return panel(spark, T1=T1, INT=INT, ST=ST).cache()


def test_demand_features(three):
    got = {r.item_id: r for r in A.demand_features(three).withColumn("tag", S.model_tag()).collect()}
    want = {
        "T1": (15.5, 8.663140, 0.558912, 0, 0.05, 3.057360, 9.670010, 0.4635, "xgboost"),
        "INT": (4.875, 8.637672, 1.771830, 0.75, 0.25, 1.311163, -0.043349, 0.5848, "tbats"),
        "ST": (10, 0.707107, 0.070711, 0, 0, 0, -1.0, 0, "arima"),
    }
    for name, (mean, std, cv, zero, promo, skew, kurt, season, tag) in want.items():
        r = got[name]
        assert (r.mean_demand, r.std_demand, r.cv) == pytest.approx((mean, std, cv), abs=1e-5)
        assert (r.intermittency_index, r.promotion_flag) == pytest.approx((zero, promo))
        assert (r.skewness, r.kurtosis) == pytest.approx((skew, kurt), abs=1e-5)
        assert r.seasonality_strength == pytest.approx(season, abs=1e-4)
        assert r.tag == tag


@pytest.mark.parametrize(
    "method, item, want",
    [
        ("croston", "INT", (4.541890, 5.052587, 5.563285)),
        ("sba", "INT", (6.220911, 6.731609, 7.242307)),
        ("sba_m", "INT", (5.090853, 5.601551, 6.112248)),
        ("croston", "T1", (11.030756, 10.334355, 9.637954)),
    ],
)
def test_intermittent_forecasts(three, method, item, want):
    rows = I.forecast(I.fit(three.where(F.col("item_id") == item), method), 3).orderBy("step").collect()
    assert [r.yhat for r in rows] == pytest.approx(want, abs=1e-5)


def test_croston_state(three):
    r = I.fit(three.where("item_id = 'INT'")).first()
    assert (r.alpha, r.beta, r.level, r.interval, r.trend) == pytest.approx((0.137334, 0.07, 18.167559, 4, 0.510698), abs=1e-5)


def test_too_few_demands_give_the_mean(spark):
    df = panel(spark, one=[0, 0, 6, 0], none=[0, 0, 0])
    got = {r.item_id: r.yhat for r in I.forecast(I.fit(df), 1).collect()}
    assert got["one"] == pytest.approx(1.5, abs=1e-6) and got["none"] == 0.0


@pytest.mark.parametrize("method", I.METHODS)
def test_forecasts_are_not_negative(three, method):
    assert I.forecast(I.fit(three, method), 30).agg(F.min("yhat")).first()[0] >= 0


def test_policy_numbers(spark):
    row = spark.range(1).select(
        S.safety_stock(S.service_z(F.lit(0.95)), F.lit(50.0)).alias("ss"),
        S.reorder_point(F.lit(50.0), F.lit(10.0), F.lit(82.5)).alias("rop"),
        S.eoq(F.lit(18250.0), F.lit(100.0), F.lit(10.0)).alias("eoq"),
        S.total_cost(S.eoq(F.lit(18250.0), F.lit(100.0), F.lit(10.0)), F.lit(18250.0), F.lit(100.0), F.lit(10.0), F.lit(100.0)).alias("cost"),
        S.eoq(F.lit(7.0), F.lit(1.0), F.lit(0.0)).alias("no_holding"),
        S.normal_cdf(F.lit(1.0)).alias("phi"),
    ).first()
    assert (row.ss, row.rop) == (82.5, 582.5)
    assert row.eoq == pytest.approx(604.152299, abs=1e-5)
    assert row.cost == pytest.approx(1831041.522987, abs=1e-4)
    assert row.no_holding == 7.0
    assert row.phi == pytest.approx(0.841344746, abs=2e-7)


def test_dynamic_safety_stock(spark):
    mean, std = float(np.mean(T1)), float(np.std(T1))
    rows = [(mean, std, 20, 7.0, 0.0, "A"), (mean, std, 20, 7.0, 2.0, "A"), (mean, std, 5, 7.0, 0.0, "A")]
    df = spark.createDataFrame(rows, "demand_mean double, demand_std double, n_points int, lead_time double, lead_time_std double, abc_class string")
    assert [r.safety_stock for r in S.dynamic_safety_stock(df).collect()] == [42.83, 72.04, None]


def test_arima_recovers_its_coefficients():
    rng = np.random.default_rng(5)
    e, w = rng.normal(0, 1, 3000), np.zeros(3000)
    for i in range(1, 3000):
        w[i] = 0.6 * w[i - 1] + e[i] + 0.3 * e[i - 1]
    phi, theta, _ = M.fit_arima(np.cumsum(w))
    assert phi == pytest.approx(0.6, abs=0.06) and theta == pytest.approx(0.3, abs=0.06)


def test_failing_series_is_isolated(spark):
    rows = M.fit_candidates(panel(spark, short=[1, 2], long=list(range(30))), ["arima"], 4).collect()
    got = {r.item_id: r for r in rows}
    assert got["short"].error and got["short"].forecast == [0.0] * 4
    assert got["long"].error is None and got["long"].forecast == pytest.approx([30, 31, 32, 33], abs=1.5)


def test_short_hybrid_gives_zeros(spark):
    row = M.fit_candidates(panel(spark, a=[1, 2, 3, 4]), ["hybrid_arima_xgb"], 3).first()
    assert row.forecast == [0.0] * 3


def test_registered_model_and_choice(spark):
    def flat(df, steps, keys):
        return df.groupBy(*keys).agg(
            F.lit("flat").alias("model"), F.lit(0.0).alias("rmse"), F.array_repeat(F.lit(9.0), steps).alias("forecast"),
            F.lit(None).cast("string").alias("error"),
        )

    M.register_model("flat", flat)
    try:
        df = panel(spark, a=T1, b=INT)
        chosen = M.choose(M.fit_candidates(df, ["flat", "croston"], 2))
        assert {r.model for r in chosen.collect()} == {"flat"}
        only = chosen.select("item_id", "location_id").withColumn("models", F.array(F.lit("croston")))
        restricted = M.choose(M.fit_candidates(df, ["flat", "croston"], 2), only)
        assert {r.model for r in restricted.collect()} == {"croston"}
        none = only.withColumn("models", F.array(F.lit("prophet")))
        assert {r.model for r in M.choose(M.fit_candidates(df, ["flat"], 2), none).collect()} == {"linear_regression"}
        rows = M.forecast_chosen(df, chosen.withColumn("model", F.when(F.col("item_id") == "a", "flat").otherwise("zzz")), 2).collect()
        assert {(r.item_id, r.yhat, r.error) for r in rows} == {("a", 9.0, None), ("b", 0.0, "unknown model")}
    finally:
        M._REGISTRY.pop("flat")


def test_registered_metric(spark):
    SEL.measure_forecasts(spark.createDataFrame([(1, 1.0, 2.0)], "k int, actual double, yhat double"), ["k"], ["mae"])
    SEL.register_metric("worst", F.max(F.abs(F.col("actual") - F.col("yhat"))))
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 5.0, 2.0)], "k int, actual double, yhat double")
    assert SEL.measure_forecasts(df, ["k"], ["worst"]).first().worst == 3.0


def test_ensemble_weights_sum_to_one(spark):
    rows = [(k, d, m, float(d), float(d + o)) for k in "ab" for d in range(1, 9) for m, o in (("x", 1), ("y", d % 3))]
    df = spark.createDataFrame(rows, "k string, date int, model string, actual double, yhat double")
    weights = SEL.dynamic_weights(df, ["x", "y"], ["k"])
    for frame in (weights, SEL.add_model(weights, "z", ["k"]), SEL.add_model(weights, "z", ["k"], 0.5)):
        assert all(r.s == pytest.approx(1) for r in frame.groupBy("k").agg(F.sum("weight").alias("s")).collect())


def test_reconciled_items_add_up(spark):
    items = spark.createDataFrame(
        [(1, "c", 1, 2.0), (2, "c", 1, 6.0), (3, "z", 1, 0.0)], "item_id int, category string, step int, yhat double"
    )
    top = spark.createDataFrame([("c", 1, 4.0), ("z", 1, 9.0)], "category string, step int, category_yhat double")
    got = {r.item_id: r.yhat for r in SEL.reconcile(items, top).collect()}
    assert got == {1: 1.0, 2: 3.0, 3: 0.0}


def test_padding_repeats_the_last_forecast(spark):
    actual = spark.createDataFrame([("a", i, 1.0) for i in range(4)], "k string, date int, actual double")
    forecast = spark.createDataFrame([("a", 0, 5.0), ("a", 1, 6.0), ("a", 9, 7.0)], "k string, date int, yhat double")
    rows = SEL.pad_forecast(actual, forecast, ["k"]).orderBy("date").collect()
    assert [r.yhat for r in rows] == [5.0, 6.0, 6.0, 6.0]


def test_narrowed_range():
    assert R.narrowed(0, 10, None) == (0, 10)
    assert R.narrowed(0, 10, 1) == (0, 3.0)
    assert R.narrowed(0, 10, 5) == (3.0, 7.0)


def test_cross_validated_tuning(spark):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(b), float(2 * a + 3 * b)) for a, b in rng.random((80, 2))]
    df = spark.createDataFrame(rows, "x1 double, x2 double, demand_qty double")
    found = R.tune(df, "linear_regression", ["x1", "x2"], {"regParam": [0.0, 5.0]}, folds=3)
    assert found[0][0] == {"regParam": 0.0} and found[0][1] < found[1][1]


def test_codes_tell_series_apart(spark):
    rows = [(k, i, 100.0 * i + 10.0 * j) for i, k in enumerate(("x", "y", "z")) for j in range(30)]
    df = R.with_codes(spark.createDataFrame([*rows, (None, 9, 1.0)], "k string, n int, demand_qty double"), ["k", "n"])
    assert df.where("k is null").first().k_code == -1.0 and df.select("k_code").distinct().count() == 4
    known = df.where("k is not null")
    model = R.train(known, "random_forest", ["k_code"], numTrees=20)
    assert len({round(r.yhat) for r in R.predict(model, known).collect()}) == 3
