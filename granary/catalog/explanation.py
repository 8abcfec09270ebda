"""Explanation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.catalog import query
from granary.catalog.aggregates import rounded
from granary.models import regression as R
from granary.operators import explanation as E
from granary.session import cut_lineage


def _linear(t):
    rows = cut_lineage(R.design(t.demand_monthly))
    return rows, R.train(rows, "linear_regression", R.FEATURES)


@query("e1_permutation_importance")
def e1(t):
    rows, model = _linear(t)
    return E.permutation_importance(model, rows, R.FEATURES, "demand_qty")


@query("e1_model_importance")
def e1_model(t):
    _, model = _linear(t)
    return E.model_importance(model, R.FEATURES, t.spark)


@query("e2_partial_dependence")
def e2(t):
    rows, model = _linear(t)
    top = [r["feature"] for r in E.model_importance(model, R.FEATURES, t.spark).limit(3).collect()]
    first, *others = [E.partial_dependence(model, rows, R.FEATURES, feature) for feature in top]
    for curve in others:
        first = first.unionByName(curve)
    return first


@query(
    "e2_partial_dependence_line",
    """WITH d AS (SELECT demand_qty AS y, lag(demand_qty) OVER w AS a, lag(demand_qty, 2) OVER w AS b, lag(demand_qty, 3) OVER w AS c
                 FROM demand_monthly WINDOW w AS (PARTITION BY item_id, location_id ORDER BY date)),
       s AS (SELECT covar_pop(y, a) AS ya, covar_pop(y, b) AS yb, covar_pop(a, b) AS ab, var_pop(a) AS aa, var_pop(b) AS bb,
                    avg(y) AS my, avg(a) AS ma, avg(b) AS mb, min(a) AS low, max(a) AS high FROM d WHERE c IS NOT NULL),
       w AS (SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS wa FROM s)
       SELECT 'demand_qty_lag_1' AS feature, CAST(p AS INTEGER) AS point, round(low + p * (high - low) / 19, 6) AS value,
              round(my + wa * (low + p * (high - low) / 19 - ma), 4) AS mean_prediction FROM w, (SELECT unnest(range(20)) AS p)""",
    ("demand_monthly",),
)
def e2_line(t):
    """The curve of a linear model on two lags is a line that sums of products give."""
    rows = cut_lineage(R.design(t.demand_monthly))
    lags = ["demand_qty_lag_1", "demand_qty_lag_2"]
    found = E.partial_dependence(R.train(rows, "linear_regression", lags), rows, lags, lags[0], points=20)
    return rounded(rounded(found, ["value"], 6), ["mean_prediction"])


_FEATURES = ["l_quantity", "l_discount"]
_ATTRIBUTED = """co AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b1, regr_slope(l_extendedprice, l_discount) AS b2,
        regr_intercept(l_extendedprice, l_quantity) AS b0, avg(l_quantity) AS m1, avg(l_discount) AS m2 FROM lineitem),
    ab AS (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, b1 * (l_quantity - m1) AS c1, b2 * (l_discount - m2) AS c2,
                  b0 + b1 * m1 + b2 * m2 AS base FROM lineitem, co)"""


def _attributed(t):
    lines = t.table("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", *_FEATURES)
    coefficients = lines.agg(
        F.regr_intercept("l_extendedprice", "l_quantity").alias("intercept"),
        *[F.regr_slope("l_extendedprice", c).alias(c) for c in _FEATURES],
    )
    return E.linear_attributions(lines.drop("l_extendedprice"), coefficients, _FEATURES)


@query(
    "e3_linear_attributions",
    f"""WITH {_ATTRIBUTED} SELECT l_orderkey, l_linenumber, l_quantity, l_discount, round(c1, 4) + 0.0 AS l_quantity_contribution,
               round(c2, 4) + 0.0 AS l_discount_contribution, round(base, 4) AS base_value, round(base + c1 + c2, 4) AS prediction
        FROM ab""",
)
def e3(t):
    return rounded(
        _attributed(t), ["l_quantity_contribution", "l_discount_contribution", "base_value", "prediction"]
    )


@query(
    "e3_attribution_summary",
    f"""WITH {_ATTRIBUTED}, s AS (SELECT 'l_quantity' AS feature, avg(c1) AS m, avg(abs(c1)) AS a FROM ab
               UNION ALL SELECT 'l_discount', avg(c2), avg(abs(c2)) FROM ab)
        SELECT feature, round(m, 4) + 0.0 AS mean_contribution, round(a, 4) AS mean_abs_contribution,
               CAST(row_number() OVER (ORDER BY a DESC) AS INTEGER) AS rank FROM s""",
)
def e3_summary(t):
    summary = E.attribution_summary(_attributed(t), _FEATURES)
    return rounded(summary, ["mean_contribution", "mean_abs_contribution"])


@query(
    "e4_prediction_summary",
    """SELECT model, count(yhat) AS n, round(min(yhat), 5) AS min, round(max(yhat), 5) AS max, round(avg(yhat), 5) AS mean,
              round(stddev_pop(yhat), 5) AS std FROM backtests GROUP BY ALL""",
    ("backtests",),
)
def e4(t):
    return rounded(E.prediction_summary(t.backtests, "yhat", ["model"]), ["min", "max", "mean", "std"], 5)


_DRIVERS = ["demand_lag_1", "demand_lag_7", "inventory_on_hand", "seasonal_factor", "unit_price"]
_IMPORTANCES = """pr AS (SELECT CAST(substr(p_brand, 7) AS BIGINT) AS item_id, avg(p_retailprice) AS unit_price FROM part GROUP BY ALL),
    dr AS (SELECT demand_qty AS y, lag(demand_qty) OVER w AS demand_lag_1, lag(demand_qty, 7) OVER w AS demand_lag_7,
                  lag(on_hand_qty) OVER w AS inventory_on_hand, seasonal_factor, unit_price
           FROM inventory_daily JOIN pr USING (item_id) WINDOW w AS (PARTITION BY item_id, location_id ORDER BY date)),
    sq AS (SELECT pow(corr(demand_lag_1, y), 2) AS demand_lag_1, pow(corr(demand_lag_7, y), 2) AS demand_lag_7,
                  pow(corr(inventory_on_hand, y), 2) AS inventory_on_hand, pow(corr(seasonal_factor, y), 2) AS seasonal_factor,
                  pow(corr(unit_price, y), 2) AS unit_price FROM dr WHERE demand_lag_7 IS NOT NULL),
    im AS (SELECT feature, s / sum(s) OVER () AS importance
           FROM (UNPIVOT sq ON demand_lag_1, demand_lag_7, inventory_on_hand, seasonal_factor, unit_price INTO NAME feature VALUE s)),
    ru AS (SELECT feature, CASE kind WHEN 'd' THEN 'demand_forecast' WHEN 'i' THEN 'inventory_management'
                  WHEN 'p' THEN 'pricing_impact' ELSE 'general' END AS rule_type,
                  concat('when ', feature, ' grows by one unit') AS condition,
                  CASE kind WHEN 'd' THEN CASE WHEN importance > 0.1 THEN 'high' ELSE 'medium' END
                       WHEN 'i' THEN CASE WHEN importance > 0.05 THEN 'medium' ELSE 'low' END
                       WHEN 'p' THEN 'medium' ELSE 'low' END AS priority,
                  least(0.99::DOUBLE, 0.7::DOUBLE + importance * 10) AS confidence, importance
           FROM (SELECT *, CASE WHEN contains(feature, 'demand') THEN 'd' WHEN contains(feature, 'inventory') THEN 'i'
                           WHEN contains(feature, 'price') OR contains(feature, 'cost') THEN 'p' END AS kind FROM im))"""


def _drivers(t):
    """Demand of the day before and the week before, stock, season and price, to explain the day's demand."""
    from pyspark.sql import Window

    line = Window.partitionBy("item_id", "location_id").orderBy("date")
    prices = t.table("part").join(t.brands, "p_partkey").groupBy(F.col("brand_id").alias("item_id")).agg(F.avg("p_retailprice").alias("unit_price"))
    return t.inventory_daily.join(prices, "item_id").select(
        "demand_qty", F.lag("demand_qty").over(line).alias("demand_lag_1"), F.lag("demand_qty", 7).over(line).alias("demand_lag_7"),
        F.lag("on_hand_qty").over(line).alias("inventory_on_hand"), "seasonal_factor", "unit_price",
    ).where("demand_lag_7 is not null")


def _rules(t):
    return E.business_rules(E.explained_shares(_drivers(t), _DRIVERS, "demand_qty"))


@query("e1_tree_gains")
def e1_gains(t):
    """Split gains of a forest over the drivers of demand."""
    rows = cut_lineage(_drivers(t))
    return E.model_importance(R.train(rows, "random_forest", _DRIVERS), _DRIVERS, t.spark)


@query("e5_rules_of_gains")
def e5_gains(t):
    return E.business_rules(e1_gains(t))


@query(
    "e5_business_rules",
    f"""WITH {_IMPORTANCES} SELECT feature, rule_type, condition, priority, round(confidence, 6) AS confidence,
               round(importance, 6) AS importance FROM ru""",
    ("inventory_daily",),
)
def e5(t):
    return rounded(_rules(t), ["confidence", "importance"], 6)


@query(
    "e5_rule_counts",
    f"""WITH {_IMPORTANCES} SELECT count(*) AS total_rules, count(*) FILTER (priority = 'high') AS high_rules,
               count(*) FILTER (priority = 'medium') AS medium_rules, count(*) FILTER (priority = 'low') AS low_rules FROM ru""",
    ("inventory_daily",),
)
def e5_counts(t):
    return E.rule_counts(_rules(t))
