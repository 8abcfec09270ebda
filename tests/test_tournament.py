"""One-step paths, the tournament of candidates, dispatch by chosen model and the hybrid's residual model."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.models import intermittent as I
from granary.models import paths as P
from granary.models import selection as S
from granary.models import series as M
from granary.models import shared as H
from granary.models import tournament as T

SCHEMA = "item_id string, location_id string, date date, demand_qty double"


def month(i):
    return date(2015 + i // 12, i % 12 + 1, 1)


def monthly(spark, **series):
    rows = [(k, "x", month(i), None if v is None else float(v)) for k, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(9)
    n = 60
    return {
        "steady": 100 + rng.normal(0, 3, n),
        "trend": 20 + 2.5 * np.arange(n) + rng.normal(0, 2, n),
        "season": 100 + 40 * np.sin(np.arange(n) * 2 * np.pi / 12) + rng.normal(0, 3, n),
        "rare": np.where(rng.random(n) < 0.25, rng.integers(10, 60, n), 0),
        "wild": np.abs(rng.normal(60, 55, n)),
        "walk": 300 + np.cumsum(rng.normal(0, 8, n)),
    }


@pytest.fixture(scope="module")
def panel(spark, values):
    return monthly(spark, **values).cache()


def _at(rows, item, model=None):
    return [r for r in rows if r.item_id == item and (model is None or r.model == model)]


# --- paths ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("method", ["croston", "sba", "sba_m", "tsb", "tsb_simple"])
def test_croston_path_ends_in_the_fitted_state(panel, values, method):
    """One more position predicts what the fitted model forecasts for its first step, whatever its own value."""
    fitted = {r.item_id: r.yhat for r in I.forecast(I.fit(panel, method), 1).collect()}
    more = panel.unionByName(panel.select("item_id", "location_id").distinct().select("*", F.lit(month(60)).alias("date"), F.lit(0.0).alias("demand_qty")))
    last = {r.item_id: r.yhat for r in P.croston_path(more, method, train=panel).where(F.col("date") == month(60)).collect()}
    assert last == pytest.approx(fitted, rel=1e-9)


def test_paths_do_not_look_ahead(panel):
    """With weights from the same training rows, changing a later value leaves earlier predictions as they are."""
    train = panel.where(F.col("date") < month(30))
    late = panel.withColumn("demand_qty", F.when(F.col("date") >= month(45), F.col("demand_qty") * 7 + 1).otherwise(F.col("demand_qty")))
    read = lambda df: {(r.item_id, r.model, r.date): r.yhat for r in P.fitted_values(df, list(P.PATHS), train=train).collect() if r.date <= month(45)}
    before, after = read(panel), read(late)
    assert len(before) == 6 * 6 * 46 and before == pytest.approx(after)


def test_paths_of_short_series(spark):
    df = monthly(spark, one=[5], none=[0, 0, 0], two=[0, 4, 0], first=[3, 0, 0])
    rows = P.fitted_values(df, list(P.PATHS)).collect()
    assert len(rows) == 6 * 10 and all(np.isfinite(r.yhat) for r in rows)
    assert [r.yhat for r in sorted(_at(rows, "two", "croston"), key=lambda r: r.date)] == pytest.approx([0, 0, 2])


def test_holt_path_gives_the_grid_error(panel):
    path = P.holt_path(panel).where(F.col("date") > month(0))
    sse = {r.item_id: r.s for r in path.groupBy("item_id").agg(F.sum((F.col("actual") - F.col("yhat")) ** 2).alias("s")).collect()}
    assert sse == pytest.approx({r.item_id: r.sse for r in M.holt_fit(panel).collect()})


def test_arima_ends_where_no_neighbour_is_better():
    rng = np.random.default_rng(2)
    for _ in range(25):
        y = np.cumsum(rng.normal(0, 1, 60)) + rng.normal(0, rng.uniform(0, 3), 60)
        phi, theta, e = M.fit_arima(y)
        w, sse = np.diff(y), float(e @ e)
        around = [(phi + a, theta + b) for a in (-1e-3, 0, 1e-3) for b in (-1e-3, 0, 1e-3) if max(abs(phi + a), abs(theta + b)) < 0.989]
        near = M.arima_residuals(w, np.array([p for p, _ in around]), np.array([t for _, t in around]))
        assert (near**2).sum(axis=0).min() >= sse * (1 - 1e-6)
        grid = np.linspace(-0.98, 0.98, 40)
        p, t = (g.ravel() for g in np.meshgrid(grid, grid))
        assert sse <= (M.arima_residuals(w, p, t) ** 2).sum(axis=0).min() * 1.02


# --- dispatch -------------------------------------------------------------------------------------------------------


def test_series_models_equal_the_expressions(panel):
    wanted = panel.select("item_id", "location_id").distinct()
    for name in ("croston", "sba", "tsb", "holt_winters", "linear_regression", "ensemble"):
        chosen = wanted.withColumn("model", F.lit(name))
        here = {r.item_id: r.forecast for r in M.forecast_each(panel, chosen, 4).collect()}
        there = {r.item_id: r.forecast for r in M.fit_candidates(panel, [name], 4).collect()}
        assert all(here[k] == pytest.approx(there[k], rel=1e-6, abs=1e-6) for k in there), name


def test_a_broken_series_is_isolated(spark, panel):
    broken = monthly(spark, bad=[1, None, 3, 4, 5], short=[1, 2])
    both = panel.unionByName(broken)
    choice = {"bad": "arima", "short": "gradient_boosting", "steady": "arima", "trend": "random_forest", "rare": "croston", "wild": "zzz", "season": "hybrid_arima_xgb", "walk": "ensemble"}
    chosen = spark.createDataFrame([(k, "x", v) for k, v in choice.items()], "item_id string, location_id string, model string")
    rows = M.forecast_chosen(both, chosen, 5).collect()
    got = {k: [r.yhat for r in sorted(_at(rows, k), key=lambda r: r.step)] for k in choice}
    errors = {r.item_id for r in rows if r.error}
    assert len(rows) == 5 * len(choice) and errors == {"bad", "short", "wild"}
    assert got["bad"] == got["short"] == got["wild"] == [0.0] * 5
    assert all(80 < v < 120 for v in got["steady"]) and all(60 < v < 180 for v in got["season"])


def test_recursive_forecast_feeds_itself(spark):
    """y(t) = 0.5 y(t-1) + 10: three lags and a linear model over all series reproduce the recursion."""
    rng, series = np.random.default_rng(0), {}
    for k in "abcdef":
        y = [float(rng.integers(1, 200))]
        while len(y) < 9:
            y.append(0.5 * y[-1] + 10)
        series[k] = y
    got = {r.item_id: r.forecast for r in H.forecast_shared(monthly(spark, **series), "linear_regression", 4).collect()}
    for k, y in series.items():
        want = list(y)
        for _ in range(4):
            want.append(0.5 * want[-1] + 10)
        assert got[k] == pytest.approx(want[9:], abs=0.05)


# --- the hybrid -----------------------------------------------------------------------------------------------------


def test_hybrid_uses_external_features(spark):
    """A planted effect of a known feature: the hybrid follows it ahead, plain ARIMA can't."""
    rng = np.random.default_rng(1)
    rows = []
    for k in range(12):
        promo = rng.random(66) < 0.3
        rows += [(f"s{k}", "x", month(i), float(50 + 40.0 * promo[i] + rng.normal(0, 1)), float(promo[i])) for i in range(66)]
    whole = spark.createDataFrame(rows, SCHEMA + ", promo double").cache()
    past, ahead = whole.where(F.col("date") < month(60)), whole.where(F.col("date") >= month(60))
    future = ahead.select("item_id", "location_id", "date", "promo")
    actual = {r.item_id: r.y for r in ahead.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("date", "demand_qty")))["demand_qty"].alias("y")).collect()}
    error = lambda rows: np.mean([np.abs(np.array(r.forecast) - actual[r.item_id]).mean() for r in rows])
    plain = error(M.fit_candidates(past, ["arima"], 6).collect())
    hybrid = error(H.forecast_hybrid(past, 6, external=["promo"], future=future).collect())
    assert hybrid < 0.6 * plain
    carried = H.forecast_hybrid(past, 6, external=["promo"]).collect()
    assert len(carried) == 12 and all(len(r.forecast) == 6 and r.error is None for r in carried)


# --- the tournament -------------------------------------------------------------------------------------------------


def test_tournament(panel):
    keys = ["item_id", "location_id"]
    allowed = panel.select(*keys).distinct().withColumn("models", F.array(*[F.lit(m) for m in T.CANDIDATES])).cache()
    tested = T.backtests(panel, allowed).cache()
    held = S.time_folds(panel, keys, splits=3, test=0.2, min_train=0.4).where("role = 'test'")
    want = {(r.item_id, r.fold, r.date) for r in held.collect()}
    for m in T.CANDIDATES:
        rows = tested.where(F.col("model") == m).collect()
        assert len(rows) == len(want) and {(r.item_id, r.fold, r.date) for r in rows} == want, m
    scores = {(r.item_id, r.model): r.rmse for r in tested.groupBy(*keys, "model").agg(F.sqrt(F.avg((F.col("actual") - F.col("yhat")) ** 2)).alias("rmse")).collect()}
    chosen = {r.item_id: (r.model, r.rmse) for r in T.choose(tested, allowed).collect()}
    for item, (model, rmse) in chosen.items():
        assert rmse == pytest.approx(min(v for (i, _), v in scores.items() if i == item)) and scores[item, model] == pytest.approx(rmse)
    assert len({m for m, _ in chosen.values()}) >= 3
    assert scores["trend", "linear_regression"] < scores["trend", "croston"]


def test_only_allowed_candidates_run_and_unknown_ones_are_skipped(spark, panel):
    rows = [("steady", "x", ["prophet", "croston"]), ("trend", "x", ["svr"]), ("rare", "x", ["ensemble"])]
    allowed = spark.createDataFrame(rows, "item_id string, location_id string, models array<string>")
    tested = T.backtests(panel, allowed)
    assert {(r.item_id, r.model) for r in tested.select("item_id", "model").distinct().collect()} == {("steady", "croston"), ("rare", "ensemble")}
    assert {r.item_id: r.model for r in T.choose(tested, allowed).collect()} == {"steady": "croston", "trend": "linear_regression", "rare": "ensemble"}


def test_a_candidate_with_missing_rows_can_not_win(spark):
    rows = [("a", "x", d, m, 1.0, p) for d in range(3) for m, p in (("arima", 3.0), ("croston", 1.0 if d else float("nan")))]
    tested = spark.createDataFrame(rows, "item_id string, location_id string, date int, model string, actual double, yhat double")
    allowed = spark.createDataFrame([("a", "x", ["croston", "arima"])], "item_id string, location_id string, models array<string>")
    assert T.choose(tested, allowed).first().model == "arima"


def test_every_class_and_tag_occurs_and_reorders(spark, panel, values):
    rows = {r.item_id: r for r in T.allowed_models(panel).collect()}
    assert {r.abc_class for r in rows.values()} == {"A", "B", "C"}
    assert set(T.TAG_OF_LABEL.values()) == set(S.PREFERRED)
    assert rows["rare"].tag == "intermittent" and rows["rare"].pattern == "Intermittent"
    for tag, first in S.PREFERRED.items():
        moved = 0
        for listed in (S.A_STEADY, S.A_PROMOTIONAL, S.A_INTERMITTENT, S.B_ANY, S.C_ANY):
            df = spark.range(1).select(S.prioritised(F.array(*[F.lit(m) for m in listed]), F.lit(tag)).alias("m"))
            got = df.first().m
            assert sorted(got) == sorted(listed)
            front = [m for m in first if m in listed]
            assert got[: len(front)] == front
            moved += got != listed
        assert moved, tag


def test_fits_of_the_hybrid_take_as_few_tasks_as_their_rows_need(panel, monkeypatch):
    seen, train = [], H.regression.train

    def counted(rows, *args, **params):
        seen.append(rows.rdd.getNumPartitions())
        return train(rows, *args, **params)

    monkeypatch.setattr(H.regression, "train", counted)
    assert H.forecast_hybrid(panel, 2).count() == 6
    allowed = panel.select("item_id", "location_id").distinct().withColumn("models", F.array(F.lit("hybrid_arima_xgb")))
    assert T.backtests(panel, allowed, candidates=["hybrid_arima_xgb"]).count() > 0
    assert seen == [1] * 4
