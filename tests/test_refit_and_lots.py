"""Refits from mergeable summaries, sequential search, two-level forecasts and lot sizing."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.models import refit as U
from granary.models import regression as R
from granary.models import selection as S
from granary.models import series as M
from granary.plans import lots as LO
from granary.sources import stores as ST

SCHEMA = "item_id int, location_id string, date date, demand_qty double"


def month(i):
    return date(2018 + i // 12, i % 12 + 1, 1)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(6):
        y = 50.0
        for i in range(48):
            y = 0.6 * y + 20 + 8 * np.sin(i * np.pi / 6) + (25 if k == 5 and i >= 36 else 0) + float(rng.normal(0, 2))
            rows.append((k, "a", month(i), float(max(y, 0.0)) if k != 4 or rng.random() < 0.4 else 0.0))
    return spark.createDataFrame(rows, SCHEMA).cache()


# --- refit ----------------------------------------------------------------------------------------------------------


def _parts(panel, at):
    return panel.where(F.col("date") < month(at)), panel.where(F.col("date") >= month(at))


def _close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        for c in ("first_date", "last_date"):
            assert a[k][c] == b[k][c]
        for c in ("moments", "gaps", "products"):
            assert a[k][c] == pytest.approx(b[k][c], rel=1e-9, abs=1e-9)


def test_merged_summaries_equal_the_summary_of_the_union(panel):
    read = lambda df: {r.item_id: r.asDict() for r in df.collect()}
    whole = read(U.summarise(panel))
    for at in (1, 30, 47):
        old, new = _parts(panel, at)
        _close(read(U.merge(U.summarise(old), U.summarise(new))), whole)
    a, rest = _parts(panel, 10)
    b, c = rest.where(F.col("date") < month(25)), rest.where(F.col("date") >= month(25))
    _close(read(U.merge(U.merge(U.summarise(a), U.summarise(b)), U.summarise(c))), whole)
    one_sided = U.merge(U.summarise(a.where("item_id < 3")), U.summarise(panel.where("item_id >= 3")))
    assert {r.item_id: r.moments[0] for r in one_sided.collect()} == {0: 10, 1: 10, 2: 10, 3: 48, 4: 48, 5: 48}


def test_refit_equals_least_squares_on_the_union(panel):
    old, new = _parts(panel, 36)
    got = {r.item_id: r for r in U.refit(U.summarise(old), U.summarise(new)).collect()}
    for k, rows in panel.toPandas().sort_values("date").groupby("item_id"):
        y = rows["demand_qty"].to_numpy()
        days = np.array([(d - date(2000, 1, 1)).days for d in rows["date"]])
        turn = 2 * np.pi * np.array([d.month for d in rows["date"]]) / 12
        x = np.column_stack([np.ones(len(y) - 1), y[:-1], days[1:] / 3652.5, np.sin(turn[1:]), np.cos(turn[1:])])
        first, second = (np.linalg.lstsq(x[:n], y[1 : n + 1], rcond=None)[0] for n in (35, 47))
        assert got[k].old_weights == pytest.approx(first, rel=1e-6, abs=1e-6) and got[k].new_weights == pytest.approx(second, rel=1e-6, abs=1e-6)
        error = [np.sqrt(np.mean((y[36:] - x[35:] @ w) ** 2)) for w in (first, second)]
        assert (got[k].old_rmse, got[k].new_rmse) == pytest.approx(error, rel=1e-6)
        assert got[k].accepted == ((error[0] - error[1]) / error[0] > 0.05)
    assert got[5].accepted  # its level moved


def test_accepted_refits_become_versions(spark, panel):
    old, new = _parts(panel, 36)
    found = U.refit(U.summarise(old), U.summarise(new))
    rows = U.accepted_models(found, F.lit(7))
    registry = spark.createDataFrame([(5, 3, "m", "p", 1, False)], "item_id int, version int, model_name string, params string, saved_at int, is_deleted boolean")
    saved = {r.item_id: r for r in ST.next_versions(registry, rows).collect()}
    assert set(saved) == {r.item_id for r in found.collect() if r.accepted}
    assert saved[5].version == 4 and '"lag"' in saved[5].params and all(r.version == 1 for k, r in saved.items() if k != 5)


def test_first_fit_is_taken_and_old_rows_are_refused(panel):
    old, new = _parts(panel, 36)
    fresh = U.refit(U.summarise(old.where("item_id <> 2")), U.summarise(new)).where("item_id = 2").first()
    assert fresh.accepted and fresh.old_weights is None and fresh.new_rmse >= 0
    with pytest.raises(Exception, match="must follow"):
        U.refit(U.summarise(new), U.summarise(old)).collect()


def test_statistics(panel):
    old, new = _parts(panel, 20)
    got = {r.item_id: r for r in U.statistics(U.merge(U.summarise(old), U.summarise(new))).collect()}
    y = [r.demand_qty for r in panel.where("item_id = 4").orderBy("date").collect()]
    sold = [i for i, v in enumerate(y) if v > 0]
    assert got[4].n == 48 and got[4].n_demand == len(sold)
    assert (got[4].mean, got[4].std, got[4].demand_mean) == pytest.approx((np.mean(y), np.std(y), np.mean([y[i] for i in sold])))
    assert got[4].interval_days == pytest.approx((month(sold[-1]) - month(sold[0])).days / (len(sold) - 1))


# --- search ---------------------------------------------------------------------------------------------------------


def test_proposals_move_towards_the_best():
    rng, past = np.random.default_rng(0), []
    for _ in range(40):
        x = R.propose(past, 2, rng)
        assert ((0 <= x) & (x <= 1)).all()
        past.append((x, float(((x - [0.2, 0.7]) ** 2).sum())))
    late = np.array([x for x, _ in past[20:]])
    assert np.abs(np.median(late, axis=0) - [0.2, 0.7]).max() < 0.15
    assert min(s for _, s in past) < 0.02


def test_search_is_no_worse_than_a_grid(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), float(np.sin(6 * a) * 10 + 5 * b + rng.normal(0, 0.3))) for a, b in rng.random((400, 2))]
    df = spark.createDataFrame(rows, "x1 double, x2 double, demand_qty double")
    train, validation = df.randomSplit([0.7, 0.3], seed=1)
    space = {"maxDepth": (2, 8), "numTrees": (20, 60)}
    found = R.search(train, validation, "random_forest", ["x1", "x2"], trials=10, space=space)
    assert len(found) == 12 and sum(t.finalist for t in found) == 2
    assert all(2 <= t.params["maxDepth"] <= 8 and 20 <= t.params["numTrees"] <= 60 for t in found)
    grid = R.tune(train, "random_forest", ["x1", "x2"], {"maxDepth": [2, 5], "numTrees": [20]}, validation=validation)
    assert R.best_trial(found).rmse <= grid[0][1] * 1.02
    again = R.search(train, validation, "random_forest", ["x1", "x2"], trials=3, space=space, best={"maxDepth": 4, "numTrees": 40})
    assert all(2.8 <= t.params["maxDepth"] <= 6 and 32 <= t.params["numTrees"] <= 48 for t in again)


# --- two levels -----------------------------------------------------------------------------------------------------


def test_items_add_up_to_their_categories_forecast(panel):
    skus = panel.select(F.col("item_id").cast("string").alias("item_id"), F.when(F.col("item_id") < 3, "low").otherwise("high").alias("category"), "date", "demand_qty")
    found = S.reconciled_forecasts(skus, M.registered("holt_winters"), 4).collect()
    top = skus.groupBy("category", "date").agg(F.sum("demand_qty").alias("demand_qty"))
    want = {r.category: r.forecast for r in M.registered("holt_winters")(top, 4, ["category"]).collect()}
    for c, ahead in want.items():
        for step, value in enumerate(ahead, 1):
            assert sum(r.yhat for r in found if r.category == c and r.step == step) == pytest.approx(value)
    assert len({round(r.factor, 9) for r in found}) > 2


# --- lots -----------------------------------------------------------------------------------------------------------


def _lots(spark, needs, pack, least, most):
    items = spark.createDataFrame([(1, 0, pack, least, most)], "item_id int, lead_time int, pack_size int, min_order int, max_order int")
    given = spark.createDataFrame([(1, [float(x) for x in needs], False)], "item_id int, needs array<double>, late boolean")
    rows = {r.period: r for r in LO.size_lots(given, items).collect()}
    return [rows[p].order_qty if p in rows else 0.0 for p in range(1, len(needs) + 1)], rows


def test_surplus_is_carried_and_overflow_moves_ahead(spark):
    orders, rows = _lots(spark, [3, 3, 3, 3], 10, 0, 100)
    assert orders == [10, 0, 0, 10] and rows[1].carried == 7 and rows[4].carried == 8
    orders, rows = _lots(spark, [0, 0, 25], 10, 0, 10)
    assert orders == [10, 10, 10] and all(r.uncovered == 0 for r in rows.values())
    orders, rows = _lots(spark, [12, 0, 5], 10, 0, 10)
    assert orders == [10, 10, 0] and rows[1].uncovered == 2 and rows[2].uncovered == 0
    orders, _ = _lots(spark, [1, 1, 30], 5, 20, 20)
    assert orders == [20, 0, 15] or orders == [20, 0, 20]


def test_lots_hold_on_random_needs(spark):
    rng = np.random.default_rng(5)
    items, needs = [], []
    for k in range(200):
        items.append((k, 0, int(rng.integers(1, 9)), int(rng.integers(0, 12)), int(rng.integers(9, 40))))
        needs.append((k, [float(x) for x in rng.integers(0, 30, 10) * (rng.random(10) < 0.6)], False))
    df = spark.createDataFrame(items, "item_id int, lead_time int, pack_size int, min_order int, max_order int")
    found = LO.size_lots(spark.createDataFrame(needs, "item_id int, needs array<double>, late boolean"), df).collect()
    for (k, _, pack, least, most), (_, need, _) in zip(items, needs):
        mine = {r.period: r for r in found if r.item_id == k}
        cap = most // pack * pack
        orders = [mine[p].order_qty if p in mine else 0.0 for p in range(1, 11)]
        for p in range(1, 11):
            o = orders[p - 1]
            assert o <= cap and o % pack == 0 and (o == 0 or o >= min(least, cap))
            open_ = max(sum(need[:p]) - sum(orders[:p]), 0)
            if p in mine:
                assert mine[p].uncovered == pytest.approx(open_) and mine[p].requirement == need[p - 1]
            if open_ > 0:
                assert all(x == cap for x in orders[:p])
