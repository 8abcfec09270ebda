"""Model, evaluation and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.catalog import query
from granary.catalog.aggregates import DECOMPOSED, rounded
from granary.catalog.views import SERIES
from granary.models import intermittent as I
from granary.models import regression as R
from granary.models import paths as P
from granary.models import refit as U
from granary.models import selection as S
from granary.models import series as M
from granary.models import shared as H
from granary.models import tournament as T
from granary.operators import aggregates as A

LINE = "PARTITION BY item_id, location_id ORDER BY date"


def intermittent_sql(method: str, steps: int = 3, source: str = "demand_panel", effects: str = "") -> str:
    """The recurrence as a list fold over the non-zero demands of a series; `effects` are tables ending in `eff` (phase, effect)."""
    a = "greatest(0.05::DOUBLE, least(0.3::DOUBLE, 0.1::DOUBLE + 0.2::DOUBLE * dstd / (dmean + 1e-8::DOUBLE)))"
    b = "greatest(0.01::DOUBLE, least(0.2::DOUBLE, 0.1::DOUBLE * abs(CASE WHEN nd >= 3 THEN slope_all ELSE 0 END)))"
    g = a
    if method == "tsb":
        g = "greatest(0.05::DOUBLE, least(0.3::DOUBLE, 0.1::DOUBLE + 0.2::DOUBLE * gstd / (gmean + 1e-8::DOUBLE)))"
    if method == "tsb_simple":
        a, g, b = "0.1::DOUBLE", "0.1::DOUBLE", "0.05::DOUBLE"
    plain = "(w.g * x.gap + (1 - w.g) * acc.i)"
    fresh = plain
    start = "l[1].gap"
    if method == "sba_variance":
        fresh = f"({plain} * (1 + 0.5::DOUBLE * pow(x.gs / ({plain} + 1e-8::DOUBLE), 2)))"
        start = ("CASE WHEN nd > 2 THEN l[1].gap * (1 + 0.5::DOUBLE * pow(gstd / (l[1].gap + 1e-8::DOUBLE), 2)) "
                 "ELSE l[1].gap END")
    divisor = {"sba": "greatest(i - (2 - a) / (2 * (1 - a)), 0.5::DOUBLE)", "sba_m": "greatest(i - (1 - a) / 2, 0.5::DOUBLE)"}
    return f"""
    WITH p AS (SELECT *, CAST(row_number() OVER ({LINE}) - 1 AS DOUBLE) AS pos FROM {source}),
    d AS (SELECT *, lead(pos) OVER w - pos AS gap, row_number() OVER w AS rk
          FROM p WHERE demand_qty > 0 WINDOW w AS ({LINE})),
    e AS (SELECT *, stddev_pop(gap) OVER ({LINE} ROWS UNBOUNDED PRECEDING) AS gs FROM d),
    w AS (SELECT item_id, location_id, count(*) AS nd, avg(demand_qty) AS dmean, stddev_pop(demand_qty) AS dstd,
                 avg(gap) AS gmean, stddev_pop(gap) AS gstd, regr_slope(demand_qty, pos) AS slope_all,
                 regr_slope(demand_qty, pos) FILTER (rk <= 3) AS slope_first, max(pos) AS lp,
                 list({{'q': demand_qty, 'gap': gap, 'gs': gs}} ORDER BY pos) AS l FROM e GROUP BY ALL),
    p2 AS (SELECT *, {a} AS a, {b} AS b, {g} AS g, CASE WHEN nd >= 3 THEN slope_first ELSE 0 END AS t0 FROM w),
    f AS (SELECT w.item_id, w.location_id, w.a, w.lp,
                 list_reduce(w.l[2:], lambda acc, x: {{
                   'l': w.a * x.q + (1 - w.a) * (acc.l + acc.t),
                   'i': CASE WHEN x.gap IS NULL THEN acc.i ELSE {fresh} END,
                   't': w.b * (w.a * x.q + (1 - w.a) * (acc.l + acc.t) - acc.l) + (1 - w.b) * acc.t}},
                   {{'l': l[1].q, 'i': {start}, 't': t0}}) AS s
          FROM p2 w),
    s AS (SELECT item_id, location_id, a, lp, s.l AS lv, s.i AS i, s.t AS t FROM f){effects}
    SELECT s.item_id, s.location_id, CAST(h AS INTEGER) AS step,
           round(greatest(0, lv / ({divisor.get(method, "i")} + 1e-8::DOUBLE) + t * (h - 1) + {"coalesce(effect, 0)" if effects else "0"}), 5) AS yhat
    FROM s CROSS JOIN (SELECT unnest(range(1, {steps + 1})) AS h)
    {"LEFT JOIN eff ON eff.item_id = s.item_id AND eff.location_id = s.location_id AND eff.phase = (lp + h) % 12" if effects else ""}"""


def _intermittent(name: str, method: str) -> None:
    @query(name, intermittent_sql(method), ("demand_panel",))
    def build(t):
        return rounded(I.forecast(I.fit(t.demand_panel, method), 3), ["yhat"], 5)


for _name, _method in (
    ("m1_croston", "croston"), ("m2_sba", "sba"), ("m2_sba_m", "sba_m"), ("m3_sba_variance", "sba_variance"),
    ("m3_tsb", "tsb"), ("m3_tsb_simple", "tsb_simple"),
):
    _intermittent(_name, _method)


_EFFECTS = f""",
    sp AS (SELECT *, row_number() OVER w - 1 AS pos, CASE WHEN count(*) OVER f = 13 THEN
             (sum(demand_qty) OVER f - (lag(demand_qty, 6) OVER w + lead(demand_qty, 6) OVER w) / 2) / 12 END AS trend
           FROM demand_monthly WINDOW w AS ({LINE}), f AS ({LINE} ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
    sh AS (SELECT item_id, location_id, pos % 12 AS phase, avg(demand_qty - trend) AS m FROM sp GROUP BY ALL),
    ur AS (SELECT item_id, location_id, count(*) AS n, count(d) AS k, regr_slope(d, x) AS slope, regr_sxx(d, x) AS sxx,
                  regr_syy(d, x) AS syy, regr_sxy(d, x) AS sxy
           FROM (SELECT *, lag(demand_qty) OVER ({LINE}) AS x, demand_qty - lag(demand_qty) OVER ({LINE}) AS d FROM demand_monthly) GROUP BY ALL),
    eff AS (SELECT sh.item_id, sh.location_id, phase, m - avg(m) OVER (PARTITION BY sh.item_id, sh.location_id) AS effect
            FROM sh JOIN ur ON ur.item_id = sh.item_id AND ur.location_id = sh.location_id
            WHERE n >= 24 AND slope / sqrt((syy - slope * sxy) / (k - 2) / sxx) > -2.86)"""


@query("m1_croston_seasonal", intermittent_sql("croston", 12, "demand_monthly", _EFFECTS), ("demand_monthly",))
def m1_seasonal(t):
    effects = I.seasonal_effects(t.demand_monthly, 12)
    fitted = I.fit(t.demand_monthly)
    return rounded(I.forecast(fitted, 12, seasonal=effects, period=12), ["yhat"], 5)


@query(
    "m4_decompose",
    f"""WITH {DECOMPOSED} SELECT item_id, location_id, date, round(trend, 5) AS trend,
               round(seasonal, 5) + 0.0 AS seasonal, round(resid, 5) + 0.0 AS resid FROM dec""",
    ("demand_panel",),
)
def m4(t):
    parts = A.decompose(t.demand_panel, SERIES, "demand_qty", 7)
    return rounded(parts.select(*SERIES, "date", "trend", "seasonal", "resid"), ["trend", "seasonal", "resid"], 5)


@query(
    "m4_decompose_even_period",
    f"""WITH p AS (SELECT *, row_number() OVER w - 1 AS pos, CASE WHEN count(*) OVER f = 13 THEN
                     (sum(demand_qty) OVER f - (lag(demand_qty, 6) OVER w + lead(demand_qty, 6) OVER w) / 2) / 12 END AS trend
              FROM demand_monthly WINDOW w AS ({LINE}), f AS ({LINE} ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
        ph AS (SELECT item_id, location_id, pos % 12 AS phase, avg(demand_qty - trend) AS m FROM p GROUP BY ALL),
        c AS (SELECT item_id, location_id, avg(m) AS centre FROM ph GROUP BY ALL)
        SELECT item_id, location_id, date, round(trend, 8) AS trend, round(m - centre, 8) + 0.0 AS seasonal,
               round(demand_qty - trend - (m - centre), 8) + 0.0 AS resid
        FROM p JOIN ph USING (item_id, location_id) JOIN c USING (item_id, location_id) WHERE pos % 12 = phase""",
    ("demand_monthly",),
)
def m4_even(t):
    parts = A.decompose(t.demand_monthly, SERIES, "demand_qty", 12)
    return rounded(parts.select(*SERIES, "date", "trend", "seasonal", "resid"), ["trend", "seasonal", "resid"], 8)


@query(
    "m5_unit_root",
    f"""SELECT item_id, location_id, n, round(slope / sqrt((syy - slope * sxy) / (k - 2) / sxx), 4) AS t_statistic,
               slope / sqrt((syy - slope * sxy) / (k - 2) / sxx) > -2.86 AS non_stationary
        FROM (SELECT item_id, location_id, count(*) AS n, count(d) AS k, regr_slope(d, x) AS slope,
                     regr_sxx(d, x) AS sxx, regr_syy(d, x) AS syy, regr_sxy(d, x) AS sxy
              FROM (SELECT *, lag(demand_qty) OVER ({LINE}) AS x, demand_qty - lag(demand_qty) OVER ({LINE}) AS d
                    FROM demand_monthly) GROUP BY ALL)""",
    ("demand_monthly",),
)
def m5(t):
    return rounded(I.unit_root(t.demand_monthly), ["t_statistic"])


@query(
    "m6_demand_trend",
    f"""SELECT item_id, location_id, round(CASE WHEN count(*) >= 3 THEN regr_slope(demand_qty, pos) ELSE 0 END, 8) AS slope,
               count(*) AS n_demand
        FROM (SELECT *, row_number() OVER ({LINE}) - 1 AS pos FROM demand_panel) WHERE demand_qty > 0 GROUP BY ALL""",
    ("demand_panel",),
)
def m6(t):
    return rounded(I.demand_trend(t.demand_panel), ["slope"], 8)


@query("m7_arima")
def m7(t):
    fitted = M.fit_candidates(t.demand_monthly, ["arima"], 6)
    return fitted.select(*SERIES, "model", "rmse", F.posexplode("forecast").alias("step", "yhat"))


_GRID = ", ".join(str(g) for g in M.HOLT_GRID)


@query(
    "m8_holt",
    f"""WITH y AS (SELECT item_id, location_id, list(demand_qty ORDER BY date) AS v FROM demand_monthly GROUP BY ALL),
        g AS (SELECT a, b FROM (SELECT unnest([{_GRID}]::DOUBLE[]) AS a), (SELECT unnest([{_GRID}]::DOUBLE[]) AS b)),
        r AS (SELECT y.item_id, y.location_id, g.a, g.b,
                     list_reduce([{{'q': x, 'l': x, 't': x}} for x in y.v[2:]],
                       lambda acc, z: {{
                         'q': acc.q + (z.q - acc.l - acc.t) * (z.q - acc.l - acc.t),
                         'l': g.a * z.q + (1 - g.a) * (acc.l + acc.t),
                         't': g.b * (g.a * z.q + (1 - g.a) * (acc.l + acc.t) - acc.l) + (1 - g.b) * acc.t}},
                       {{'q': 0.0::DOUBLE, 'l': y.v[1], 't': coalesce(y.v[2] - y.v[1], 0)}}) AS s
              FROM y, g)
        SELECT item_id, location_id, a AS alpha, b AS beta, round(s.l, 5) AS level, round(s.t, 5) AS trend,
               round(s.l + s.t, 5) AS next_value
        FROM r QUALIFY row_number() OVER (PARTITION BY item_id, location_id ORDER BY s.q, a, b) = 1""",
    ("demand_monthly",),
)
def m8(t):
    fitted = M.holt_fit(t.demand_monthly).withColumn("next_value", F.col("level") + F.col("trend"))
    return rounded(
        fitted.select(*SERIES, "alpha", "beta", "level", "trend", "next_value"), ["level", "trend", "next_value"], 5
    )


@query("m9_hybrid")
def m9(t):
    """Orders per month and their mean price are the external features; ahead they are carried forward."""
    from granary.operators.joins import join_macro

    month = F.trunc("o_orderdate", "month").alias("date")
    macro = t.table("orders").groupBy(month).agg(F.count(F.lit(1)).cast("double").alias("ORDERS"), F.avg("o_totalprice").alias("PRICE"))
    long = macro.unpivot("date", ["ORDERS", "PRICE"], "indicator", "value")
    panel = join_macro(t.demand_monthly, long, ["ORDERS", "PRICE"])
    fitted = H.forecast_hybrid(panel, 6, SERIES, external=["orders", "price"])
    return fitted.select(*SERIES, "model", "rmse", F.posexplode("forecast").alias("step", "yhat"))


def holt_sql(name: str, source: str, keys: str, steps: int) -> str:
    """(keys, step, yhat) of smoothed trends over `source` (keys, date, demand_qty), as `name`."""
    return f"""
    {name}_y AS (SELECT {keys}, list(demand_qty ORDER BY date) AS v FROM {source} GROUP BY ALL),
    {name}_r AS (SELECT {name}_y.*, g.a, g.b, list_reduce({name}_y.v[2:], lambda acc, z: {{
          'q': acc.q + (z - acc.l - acc.t) * (z - acc.l - acc.t), 'l': g.a * z + (1 - g.a) * (acc.l + acc.t),
          't': g.b * (g.a * z + (1 - g.a) * (acc.l + acc.t) - acc.l) + (1 - g.b) * acc.t}},
          {{'q': 0.0::DOUBLE, 'l': {name}_y.v[1], 't': coalesce({name}_y.v[2] - {name}_y.v[1], 0)}}) AS s
        FROM {name}_y, (SELECT a, b FROM (SELECT unnest([{_GRID}]::DOUBLE[]) AS a), (SELECT unnest([{_GRID}]::DOUBLE[]) AS b)) g),
    {name} AS (SELECT {keys}, h AS step, s.l + s.t + s.t * (h - 1) AS yhat
        FROM (SELECT * FROM {name}_r QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY s.q, a, b) = 1),
             (SELECT unnest(range(1, {steps + 1})) AS h))"""


_SKUS = """sk AS (SELECT concat(item_id, '@', location_id) AS item_id, concat(item_id // 10, '@', location_id) AS category, date, demand_qty
           FROM demand_monthly),
    up AS (SELECT category, date, sum(demand_qty) AS demand_qty FROM sk GROUP BY ALL)"""


@query(
    "m10_reconcile",
    f"""WITH {_SKUS}, {holt_sql('fi', 'sk', 'item_id, category', 6)}, {holt_sql('fc', 'up', 'category', 6)},
        tot AS (SELECT category, step, sum(yhat) AS total FROM fi GROUP BY ALL)
        SELECT fi.item_id, fi.category, fi.step, round(fi.yhat * CASE WHEN total = 0 THEN 1 ELSE fc.yhat / total END, 5) AS yhat,
               round(CASE WHEN total = 0 THEN 1 ELSE fc.yhat / total END, 6) AS factor
        FROM fi JOIN tot ON tot.category = fi.category AND tot.step = fi.step JOIN fc ON fc.category = fi.category AND fc.step = fi.step""",
    ("demand_monthly",),
)
def m10(t):
    """Series of brands and of their makers are fitted apart; the makers' forecasts are the ones to add up to."""
    made = F.floor(F.col("item_id") / 10).cast("bigint")
    skus = t.demand_monthly.select(
        F.concat_ws("@", F.col("item_id").cast("string"), "location_id").alias("item_id"),
        F.concat_ws("@", made.cast("string"), "location_id").alias("category"), "date", "demand_qty",
    )
    found = rounded(S.reconciled_forecasts(skus, M.registered("holt_winters"), 6), ["factor"], 6)
    return rounded(found.withColumn("step", F.col("step").cast("bigint")), ["yhat"], 5)


_MODELS = ["last", "mean3", "year_ago"]

_PERFORMANCE = """
    pf AS (SELECT item_id, location_id, model, 1 / (sqrt(avg(pow(actual - yhat, 2))) + 1e-6::DOUBLE) AS inv
           FROM backtests GROUP BY ALL),
    dv AS (SELECT item_id, location_id, coalesce(avg(1 - c) FILTER (NOT isnan(c)), 0) AS div
           FROM (SELECT a.item_id, a.location_id, a.model AS m1, b.model AS m2, corr(a.yhat, b.yhat) AS c
                 FROM backtests a JOIN backtests b ON a.item_id = b.item_id AND a.location_id = b.location_id
                      AND a.date = b.date AND a.model < b.model GROUP BY ALL) GROUP BY ALL),
    adj AS (SELECT item_id, location_id, model, inv * 0.9::DOUBLE + div * 0.1::DOUBLE AS performance
            FROM pf JOIN dv USING (item_id, location_id)),
    wt AS (SELECT *, performance / sum(performance) OVER (PARTITION BY item_id, location_id) AS weight FROM adj)"""


@query(
    "m11_dynamic_weights",
    f"WITH {_PERFORMANCE} SELECT item_id, location_id, model, round(weight, 6) AS weight FROM wt",
    ("backtests",),
)
def m11(t):
    return rounded(S.dynamic_weights(t.backtests, _MODELS), ["weight"], 6)


@query(
    "m11_ensemble_forecast",
    f"""WITH {_PERFORMANCE} SELECT item_id, location_id, date, round(sum(yhat * weight), 5) AS yhat
        FROM backtests JOIN wt USING (item_id, location_id, model) GROUP BY ALL""",
    ("backtests",),
)
def m11_forecast(t):
    weights = S.dynamic_weights(t.backtests, _MODELS)
    return rounded(S.combine(t.backtests, weights, [*SERIES, "date"], SERIES), ["yhat"], 5)


@query(
    "m11_weights_after_updates",
    """WITH h AS (SELECT item_id, model, dense_rank() OVER (PARTITION BY item_id ORDER BY y) - 1 AS u, p
                  FROM (SELECT item_id, model, year(date) AS y, 1 / (sqrt(avg(pow(actual - yhat, 2))) + 1e-6::DOUBLE) AS p
                        FROM backtests GROUP BY ALL)),
       d AS (SELECT a.item_id, a.model, a.u, sum(b.p * pow(0.9::DOUBLE, a.u - b.u)) AS p
             FROM h a JOIN h b ON a.item_id = b.item_id AND a.model = b.model AND b.u <= a.u GROUP BY ALL),
       n AS (SELECT *, p / sum(p) OVER (PARTITION BY item_id, u) AS w, max(u) OVER (PARTITION BY item_id) AS last FROM d)
       SELECT item_id, model, round(sum(w * CASE WHEN u = 0 THEN pow(0.9::DOUBLE, last)
                                        ELSE 0.1::DOUBLE * pow(0.9::DOUBLE, last - u) END), 6) AS weight
       FROM n GROUP BY ALL""",
    ("backtests",),
)
def m11_updates(t):
    error = F.col("actual") - F.col("yhat")
    history = t.backtests.groupBy("item_id", "model", F.year("date").alias("update_no")).agg(  # any increasing number will do
        (1 / (F.sqrt(F.avg(error * error)) + 1e-6)).alias("performance")
    )
    return rounded(S.weights_after_updates(history, ["item_id"]), ["weight"], 6)


@query(
    "m11_add_model",
    f"""WITH {_PERFORMANCE} SELECT item_id, location_id, model, round(weight / 2, 6) AS weight FROM wt
        UNION ALL SELECT DISTINCT item_id, location_id, 'new', 0.5::DOUBLE FROM wt""",
    ("backtests",),
)
def m11_add(t):
    weights = S.add_model(S.dynamic_weights(t.backtests, _MODELS), "new", SERIES)
    return rounded(weights.select(*SERIES, "model", "weight"), ["weight"], 6)


@query(
    "m12_lag_regression",
    f"""SELECT item_id, location_id, round(slope, 6) AS slope, round(intercept, 5) AS intercept, round(r2, 6) AS r2,
               round(intercept + slope * last, 5) AS next_value
        FROM (SELECT item_id, location_id, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
                     regr_r2(y, x) AS r2, arg_max(y, date) AS last
              FROM (SELECT *, demand_qty AS y, lag(demand_qty) OVER ({LINE}) AS x FROM demand_monthly) GROUP BY ALL)""",
    ("demand_monthly",),
)
def m12_lag(t):
    return rounded(
        rounded(R.lag_regression(t.demand_monthly), ["slope", "r2"], 6), ["intercept", "next_value"], 5
    )


def _ml(name: str, model: str, **params) -> None:
    @query(name)
    def build(t):
        from granary.operators.windows import ordered_split
        from granary.session import cut_lineage

        design = R.design(t.demand_monthly).withColumn("category", F.floor(F.col("item_id") / 10))
        rows = cut_lineage(ordered_split(R.with_codes(design, ["item_id", "location_id", "category"])))
        codes = ["item_id_code", "location_id_code", "category_code"]
        fitted = R.train(rows.where("split = 'train'"), model, [*R.FEATURES, *codes], **params)
        scored = R.predict(fitted, rows.where("split != 'train'")).withColumn("model", F.lit(model))
        return S.measure_forecasts(scored, ["model", "split"], ["mae", "rmse", "mape"])


_ml("m12_linear", "linear_regression")
_ml("m12_random_forest", "random_forest")
_ml("m12_gradient_boosting", "gradient_boosting")


@query("m13_tune")
def m13(t):
    """Ten trials over the full ranges on a tenth of the trees, the best two again on all of them."""
    from granary.operators.windows import ordered_split
    from granary.session import cut_lineage

    rows = cut_lineage(ordered_split(R.design(t.demand_monthly)))
    found = R.search(rows.where("split = 'train'"), rows.where("split = 'validation'"), "random_forest", R.FEATURES, trials=10)
    return t.spark.createDataFrame(
        [(i + 1, x.share, str(sorted(x.params.items())), float(x.rmse), x.finalist) for i, x in enumerate(found)],
        "trial int, share double, params string, rmse double, finalist boolean",
    )


_PATTERN_SQL = f"""
    c AS (SELECT *, demand_qty - lag(demand_qty) OVER ({LINE}) AS ch,
                 demand_qty - avg(demand_qty) OVER (PARTITION BY item_id, location_id) AS dv FROM {{source}}),
    k AS (SELECT *, stddev_pop(ch) OVER (PARTITION BY item_id, location_id) AS cs, dv * lag(dv, 11) OVER ({LINE}) AS pr
          FROM c),
    mm AS (SELECT item_id, location_id, avg(CASE WHEN demand_qty = 0 THEN 1.0::DOUBLE ELSE 0 END) AS zero_share,
                  coalesce(avg(CASE WHEN abs(ch) > 2 * cs THEN 1.0::DOUBLE WHEN ch IS NOT NULL THEN 0 END), 0) AS jump_share,
                  CASE WHEN count(*) >= 12 AND var_pop(demand_qty) > 0
                       THEN sum(pr) / (var_pop(demand_qty) * (count(*) - 11)) END AS season_index
           FROM k GROUP BY ALL),
    pat AS (SELECT *, CASE WHEN zero_share > 0.3 THEN 'Intermittent' WHEN jump_share > 0.15 THEN 'Promotional'
                           WHEN season_index > 0.3 THEN 'Seasonal' ELSE 'Stable' END AS pattern FROM mm)"""


@query(
    "m14_demand_patterns",
    f"""WITH {_PATTERN_SQL.format(source='demand_monthly')} SELECT item_id, location_id, pattern,
        round(zero_share, 6) AS zero_share, round(jump_share, 6) AS jump_share, round(season_index, 5) AS season_index FROM pat""",
    ("demand_monthly",),
)
def m14(t):
    return rounded(rounded(S.demand_patterns(t.demand_monthly), ["zero_share", "jump_share"], 6), ["season_index"], 5)


@query(
    "m15_select_by_rmse",
    """SELECT item_id, location_id, model, round(rmse, 5) AS rmse
       FROM (SELECT item_id, location_id, model, sqrt(avg(pow(actual - yhat, 2))) AS rmse FROM backtests GROUP BY ALL)
       QUALIFY row_number() OVER (PARTITION BY item_id, location_id ORDER BY rmse, model) = 1""",
    ("backtests",),
)
def m15(t):
    return rounded(S.select_by_rmse(t.backtests), ["rmse"], 5)


_EACH = ["croston", "sba", "holt_winters", "linear_regression", "ensemble"]
_KEY = "item_id, location_id, fold"


def paths_sql(folds: str) -> str:
    """One-step paths of the fold models as `fitted`; `folds` has v and ds, the rows to learn from (cut) and to predict (upto)."""
    early = "greatest(0, s.tot / s.n / (1 + 1e-8::DOUBLE))"
    rate = lambda divisor: f"CASE WHEN s.n = 0 THEN z WHEN s.nd < 2 THEN {early} ELSE greatest(0, s.l / ({divisor} + 1e-8::DOUBLE)) END"
    level, sold = "(p.a * z + (1 - p.a) * (s.l + s.t))", "z > 0 AND s.nd"
    return f"""
    f AS ({folds}),
    r AS (SELECT {_KEY}, cut, upto, unnest(v) AS y, unnest(ds) AS date, CAST(generate_subscripts(v, 1) - 1 AS DOUBLE) AS x FROM f),
    ln AS (SELECT {_KEY}, coalesce(regr_slope(y, x), 0) AS s, coalesce(regr_intercept(y, x), avg(y)) AS i FROM r WHERE x < cut GROUP BY ALL),
    d AS (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY x) AS rk FROM r WHERE y > 0 AND x < cut),
    w AS (SELECT {_KEY}, count(*) AS nd, avg(y) AS dmean, stddev_pop(y) AS dstd, regr_slope(y, x) AS slope_all,
                 regr_slope(y, x) FILTER (rk <= 3) AS slope_first FROM d GROUP BY ALL),
    p AS (SELECT f.*, greatest(0.05::DOUBLE, least(0.3::DOUBLE, 0.1::DOUBLE + 0.2::DOUBLE * dstd / (dmean + 1e-8::DOUBLE))) AS a,
                 greatest(0.01::DOUBLE, least(0.2::DOUBLE, 0.1::DOUBLE * abs(CASE WHEN nd >= 3 THEN slope_all ELSE 0 END))) AS b,
                 CASE WHEN nd >= 3 THEN slope_first ELSE 0 END AS t0 FROM f JOIN w USING ({_KEY})),
    cr AS (SELECT {_KEY}, upto, cut, ds, list_reduce(p.v[1:upto], lambda s, z: {{
             'n': s.n + 1, 'tot': s.tot + z, 'nd': s.nd + CASE WHEN z > 0 THEN 1 ELSE 0 END,
             'l': CASE WHEN {sold} = 0 THEN z WHEN z > 0 THEN {level} ELSE s.l END,
             't': CASE WHEN {sold} > 0 THEN p.b * ({level} - s.l) + (1 - p.b) * s.t ELSE s.t END,
             'i': CASE WHEN {sold} = 1 THEN s.n - s.last WHEN {sold} > 1 THEN p.a * (s.n - s.last) + (1 - p.a) * s.i ELSE s.i END,
             'last': CASE WHEN z > 0 THEN s.n ELSE s.last END,
             'pc': list_append(s.pc, {rate("s.i")}),
             'ps': list_append(s.ps, {rate("greatest(s.i - (2 - p.a) / (2 * (1 - p.a)), 0.5::DOUBLE)")})}},
             {{'n': 0::DOUBLE, 'tot': 0::DOUBLE, 'nd': 0, 'l': 0::DOUBLE, 't': t0::DOUBLE, 'i': 1::DOUBLE, 'last': 0::DOUBLE,
               'pc': []::DOUBLE[], 'ps': []::DOUBLE[]}}) AS s FROM p),
    g AS (SELECT a, b FROM (SELECT unnest([{_GRID}]::DOUBLE[]) AS a), (SELECT unnest([{_GRID}]::DOUBLE[]) AS b)),
    hs AS (SELECT {_KEY}, g.a, g.b, f.v, f.ds, f.cut, f.upto, list_reduce(f.v[2:cut], lambda acc, z: {{
             'q': acc.q + (z - acc.l - acc.t) * (z - acc.l - acc.t), 'l': g.a * z + (1 - g.a) * (acc.l + acc.t),
             't': g.b * (g.a * z + (1 - g.a) * (acc.l + acc.t) - acc.l) + (1 - g.b) * acc.t}},
             {{'q': 0.0::DOUBLE, 'l': f.v[1], 't': coalesce(f.v[2] - f.v[1], 0)}}).q AS q FROM f, g),
    hb AS (SELECT * FROM hs QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY q, a, b) = 1),
    hp AS (SELECT {_KEY}, ds, cut, upto, list_reduce(hb.v[2:upto], lambda s, z: {{
             'l': hb.a * z + (1 - hb.a) * (s.l + s.t), 't': hb.b * (hb.a * z + (1 - hb.a) * (s.l + s.t) - s.l) + (1 - hb.b) * s.t,
             'p': list_append(s.p, s.l + s.t)}},
             {{'l': hb.v[1], 't': coalesce(hb.v[2] - hb.v[1], 0), 'p': [hb.v[1]]}}).p AS p FROM hb),
    lp AS (SELECT {_KEY}, 'croston' AS model, unnest(ds[1:upto]) AS date, unnest(s.pc) AS yhat FROM cr
           UNION ALL SELECT {_KEY}, 'sba', unnest(ds[1:upto]), unnest(s.ps) FROM cr
           UNION ALL SELECT {_KEY}, 'holt_winters', unnest(ds[1:upto]), unnest(p) FROM hp
           UNION ALL SELECT {_KEY}, 'linear_regression', date, i + s * x FROM r JOIN ln USING ({_KEY}) WHERE x < upto),
    fitted AS (SELECT {_KEY}, date, model, y AS actual, yhat, x >= cut AS held FROM lp JOIN r USING ({_KEY}, date))"""


_WHOLE = """SELECT item_id, location_id, 0 AS fold, list(demand_qty ORDER BY date) AS v, list(date ORDER BY date) AS ds,
                   count(*) AS cut, count(*) AS upto FROM demand_monthly GROUP BY ALL"""
_CUTS = """SELECT item_id, location_id, fold, v, ds, CAST(floor(n * (0.4::DOUBLE + 0.4::DOUBLE * (fold - 1) / 2) + 1e-9::DOUBLE) AS BIGINT) AS cut,
                  CAST(floor(n * (0.4::DOUBLE + 0.4::DOUBLE * (fold - 1) / 2) + 1e-9::DOUBLE) + floor(n * 0.2::DOUBLE + 1e-9::DOUBLE) AS BIGINT) AS upto
           FROM (SELECT item_id, location_id, list(demand_qty ORDER BY date) AS v, list(date ORDER BY date) AS ds, count(*) AS n
                 FROM demand_monthly GROUP BY ALL), (SELECT unnest([1, 2, 3]) AS fold)"""


@query(
    "m15_select_fitted",
    f"""WITH {paths_sql(_CUTS)},
        en AS (SELECT {_KEY}, date, 'ensemble' AS model, max(actual) AS actual, avg(yhat) AS yhat FROM fitted
               WHERE held AND model <> 'sba' GROUP BY ALL),
        sc AS (SELECT item_id, location_id, model, sqrt(avg(pow(actual - yhat, 2))) AS rmse
               FROM (SELECT {_KEY}, date, model, actual, yhat FROM fitted WHERE held UNION ALL
                     SELECT {_KEY}, date, model, actual, yhat FROM en) GROUP BY ALL)
        SELECT item_id, location_id, model, round(rmse, 5) AS rmse FROM sc
        QUALIFY row_number() OVER (PARTITION BY item_id, location_id ORDER BY rmse, list_position({_EACH}, model)) = 1""",
    ("demand_monthly",),
)
def m15_fitted(t):
    """The tournament among the candidates that SQL can fit, all of them allowed for every series."""
    panel = t.demand_monthly
    allowed = panel.select(*SERIES).distinct().withColumn("models", F.array(*[F.lit(m) for m in _EACH]))
    return rounded(T.choose(T.backtests(panel, allowed, SERIES, _EACH), allowed), ["rmse"], 5)


@query("m15_tournament")
def m15_tournament(t):
    return T.select_models(t.demand_monthly)


@query("m16_forecast_chosen")
def m16(t):
    from granary.session import cut_lineage

    panel = cut_lineage(t.demand_monthly)
    return M.forecast_chosen(panel, T.select_models(panel), 7)


_PATHS = ["croston", "sba", "holt_winters", "linear_regression"]
#: Added before rounding: smoothing by tenths gives values that end in 5, which the last bit rounds up or down.
_OFF_HALVES = 0.0000037


@query(
    "m17_fitted_values",
    f"""WITH {paths_sql(_WHOLE)} SELECT item_id, location_id, date, model, actual,
               round(yhat + {_OFF_HALVES}::DOUBLE, 5) AS yhat FROM fitted""",
    ("demand_monthly",),
)
def m17(t):
    found = P.fitted_values(t.demand_monthly, _PATHS)
    return rounded(found.withColumn("yhat", F.col("yhat") + _OFF_HALVES), ["yhat"], 5)


@query("m17_arima_fitted")
def m17_arima(t):
    return P.fitted_values(t.demand_monthly, ["arima"])


_EVALUATED = """
    st AS (SELECT *, lag(actual) OVER w AS pa, lag(yhat) OVER w AS pp
           FROM backtests WINDOW w AS (PARTITION BY item_id, location_id, model ORDER BY date)),
    ev AS (SELECT item_id, location_id, model, avg(abs(actual - yhat)) AS mae, avg(pow(actual - yhat, 2)) AS mse,
                  sqrt(avg(pow(actual - yhat, 2))) AS rmse,
                  CASE WHEN var_pop(actual) = 0 THEN CASE WHEN sum(pow(actual - yhat, 2)) = 0 THEN 1 ELSE 0 END
                       ELSE 1 - sum(pow(actual - yhat, 2)) / (var_pop(actual) * count(*)) END AS r2,
                  avg(abs(actual - yhat) / abs(actual)) FILTER (actual <> 0) * 100 AS mape,
                  2 * avg(abs(actual - yhat) / (abs(actual) + abs(yhat))) FILTER (abs(actual) + abs(yhat) <> 0) * 100 AS smape,
                  CASE WHEN coalesce(avg(abs(actual - pa)), 0) = 0 THEN 0
                       ELSE avg(abs(actual - yhat)) / avg(abs(actual - pa)) END AS mase,
                  avg(CASE WHEN abs((actual - yhat) / (actual + 1e-8::DOUBLE)) <= 0.1 THEN 1.0::DOUBLE ELSE 0 END) * 100
                      AS accuracy_10,
                  coalesce(avg(CASE WHEN (actual > pa) = (yhat > pp) THEN 1.0::DOUBLE ELSE 0 END) FILTER (pa IS NOT NULL), 0) * 100
                      AS direction_accuracy
           FROM st GROUP BY ALL)"""
_MEASURES = ["mae", "mse", "rmse", "r2", "mape", "smape", "mase", "accuracy_10", "direction_accuracy"]


@query(
    "m18_evaluate",
    f"WITH {_EVALUATED} SELECT item_id, location_id, model, "
    + ", ".join(f"round({m}, 5) AS {m}" for m in _MEASURES)
    + " FROM ev",
    ("backtests",),
)
def m18(t):
    return rounded(S.evaluate(t.backtests, [*SERIES, "model"]), _MEASURES, 5)


@query(
    "m18_evaluate_fitted",
    f"WITH {paths_sql(_WHOLE)}, {_EVALUATED.replace('backtests', 'fitted')} SELECT item_id, location_id, model, "
    + ", ".join(f"round({m}, 4) + 0.0 AS {m}" for m in _MEASURES)
    + " FROM ev",
    ("demand_monthly",),
)
def m18_fitted(t):
    return rounded(S.evaluate(P.fitted_values(t.demand_monthly, _PATHS), [*SERIES, "model"]), _MEASURES, 4)


@query(
    "m11_fitted_weights",
    f"WITH {paths_sql(_WHOLE)}, {_PERFORMANCE.replace('backtests', 'fitted')} SELECT item_id, location_id, model, round(weight, 6) AS weight FROM wt",
    ("demand_monthly",),
)
def m11_fitted(t):
    from granary.session import cut_lineage

    return rounded(S.dynamic_weights(cut_lineage(P.fitted_values(t.demand_monthly, _PATHS)), _PATHS), ["weight"], 6)


@query(
    "m19_weighted_score",
    f"""WITH {_EVALUATED} SELECT item_id, location_id, model, round(0.3::DOUBLE * rmse + 0.2::DOUBLE * mae +
        0.2::DOUBLE * mape + 0.15::DOUBLE * smape + 0.15::DOUBLE * mase, 5) AS score FROM ev""",
    ("backtests",),
)
def m19(t):
    scored = S.weighted_score(S.evaluate(t.backtests, [*SERIES, "model"]))
    return rounded(scored.select(*SERIES, "model", "score"), ["score"], 5)


@query(
    "m20_time_folds",
    f"""SELECT item_id, location_id, CAST(fold AS INTEGER) AS fold, role, count(*) AS n, min(date) AS first, max(date) AS last
        FROM (SELECT *, CASE WHEN rn <= floor(n * (0.3::DOUBLE + 0.5::DOUBLE * (fold - 1) / 4) + 1e-9::DOUBLE) THEN 'train'
                     WHEN rn <= floor(n * (0.3::DOUBLE + 0.5::DOUBLE * (fold - 1) / 4) + 1e-9::DOUBLE)
                                + floor(n * 0.2::DOUBLE + 1e-9::DOUBLE) THEN 'test' END AS role
              FROM (SELECT *, row_number() OVER ({LINE}) AS rn, count(*) OVER (PARTITION BY item_id, location_id) AS n
                    FROM demand_monthly), (SELECT unnest(range(1, 6)) AS fold))
        WHERE role IS NOT NULL GROUP BY ALL""",
    ("demand_monthly",),
)
def m20(t):
    folds = S.time_folds(t.demand_monthly)
    return folds.groupBy(*SERIES, "fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last")
    )


@query(
    "m21_accept_refit",
    """SELECT item_id, location_id, round(old_rmse, 5) AS old_rmse, round(new_rmse, 5) AS new_rmse,
              round((old_rmse - new_rmse) / old_rmse, 6) AS improvement, (old_rmse - new_rmse) / old_rmse > 0.05 AS accepted
       FROM (SELECT item_id, location_id, sqrt(avg(pow(actual - yhat, 2)) FILTER (model = 'last')) AS old_rmse,
                    sqrt(avg(pow(actual - yhat, 2)) FILTER (model = 'mean3')) AS new_rmse FROM backtests GROUP BY ALL)""",
    ("backtests",),
)
def m21(t):
    scored = S.measure_forecasts(t.backtests, [*SERIES, "model"], ["rmse"])
    at = lambda m: F.max(F.when(F.col("model") == m, F.col("rmse")))
    wide = scored.groupBy(*SERIES).agg(at("last").alias("old_rmse"), at("mean3").alias("new_rmse"))
    return rounded(rounded(S.accept_refit(wide), ["improvement"], 6), ["old_rmse", "new_rmse"], 5)


_SPLIT_AT = "floor(0.8::DOUBLE * n + 1e-9::DOUBLE)"


@query(
    "m21_refit",
    f"""WITH p AS (SELECT *, lag(demand_qty) OVER ({LINE}) AS x, row_number() OVER ({LINE}) AS rn,
                          count(*) OVER (PARTITION BY item_id, location_id) AS n FROM demand_monthly),
        c AS (SELECT item_id, location_id, regr_slope(demand_qty, x) FILTER (rn <= {_SPLIT_AT}) AS s0,
                     regr_intercept(demand_qty, x) FILTER (rn <= {_SPLIT_AT}) AS i0, regr_slope(demand_qty, x) AS s1,
                     regr_intercept(demand_qty, x) AS i1 FROM p WHERE x IS NOT NULL GROUP BY ALL),
        e AS (SELECT item_id, location_id, s0, i0, s1, i1, sqrt(avg(pow(demand_qty - i0 - s0 * x, 2))) AS o, sqrt(avg(pow(demand_qty - i1 - s1 * x, 2))) AS w
              FROM p JOIN c USING (item_id, location_id) WHERE rn > {_SPLIT_AT} GROUP BY ALL)
        SELECT item_id, location_id, round(i0, 5) AS old_level, round(s0, 7) AS old_slope, round(i1, 5) AS new_level, round(s1, 7) AS new_slope,
               round(o, 5) AS old_rmse, round(w, 5) AS new_rmse, round((o - w) / o, 6) AS improvement, (o - w) / o > 0.05 AS accepted FROM e""",
    ("demand_monthly",),
)
def m21_refit(t):
    """The first four fifths of a series are the stored history, the rest comes in anew: only summaries of both are used."""
    from pyspark.sql import Window

    n = F.count(F.lit(1)).over(Window.partitionBy(*SERIES))
    placed = t.demand_monthly.withColumn("_rn", F.row_number().over(Window.partitionBy(*SERIES).orderBy("date"))).withColumn("_old", F.col("_rn") <= F.floor(n * 0.8 + 1e-9))
    terms = ("one", "lag")
    history, fresh = (U.summarise(placed.where(old), SERIES, terms) for old in (F.col("_old"), ~F.col("_old")))
    found = U.refit(history, fresh, SERIES, terms)
    weights = {f"{age}_{name}": F.col(f"{age}_weights")[i] for age in ("old", "new") for i, name in enumerate(("level", "slope"))}
    out = found.withColumns(weights).drop("old_weights", "new_weights")
    return rounded(rounded(rounded(out, ["old_slope", "new_slope"], 7), ["improvement"], 6), ["old_level", "new_level", "old_rmse", "new_rmse"], 5)


@query(
    "m22_feedback",
    """SELECT item_id, location_id, model, round(avg(abs(actual - yhat)), 5) AS prediction_error,
              round(var_pop(actual - yhat), 4) AS error_variance, round(avg(actual - yhat), 5) + 0.0 AS bias, count(*) AS n
       FROM backtests GROUP BY ALL""",
    ("backtests",),
)
def m22(t):
    return rounded(
        rounded(S.feedback(t.backtests, [*SERIES, "model"]), ["prediction_error", "bias"], 5), ["error_variance"], 4
    )


@query(
    "m22_feedback_fitted",
    f"""WITH {paths_sql(_WHOLE)} SELECT item_id, location_id, model, round(avg(abs(actual - yhat)), 5) AS prediction_error,
              round(var_pop(actual - yhat), 3) AS error_variance, round(avg(actual - yhat), 5) + 0.0 AS bias, count(*) AS n
       FROM fitted GROUP BY ALL""",
    ("demand_monthly",),
)
def m22_fitted(t):
    found = S.feedback(P.fitted_values(t.demand_monthly, _PATHS), [*SERIES, "model"])
    return rounded(rounded(found, ["prediction_error", "bias"], 5), ["error_variance"], 3)


@query(
    "m23_f_scores",
    """SELECT feature, round(r * r / (1 - r * r) * (n - 2), 3) AS score
       FROM (SELECT count(*) AS n, corr(l_quantity, l_extendedprice) AS l_quantity, corr(l_discount, l_extendedprice) AS l_discount,
                    corr(l_tax, l_extendedprice) AS l_tax FROM lineitem)
       UNPIVOT (r FOR feature IN (l_quantity, l_discount, l_tax))""",
)
def m23_f(t):
    return rounded(R.f_scores(t.table("lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"), ["score"], 3)


_DECILES = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"


@query(
    "m23_mutual_information",
    f"""WITH q AS (SELECT quantile_cont(l_quantity, {_DECILES}) AS q1, quantile_cont(l_tax, {_DECILES}) AS q2,
                          quantile_cont(l_extendedprice, {_DECILES}) AS qy FROM lineitem),
        b AS (SELECT len(list_filter(q1, lambda c: l_quantity > c)) AS l_quantity, len(list_filter(q2, lambda c: l_tax > c)) AS l_tax,
                     len(list_filter(qy, lambda c: l_extendedprice > c)) AS y FROM lineitem, q),
        lg AS (SELECT 'l_quantity' AS feature, l_quantity AS x, y FROM b UNION ALL SELECT 'l_tax', l_tax, y FROM b),
        jt AS (SELECT feature, x, y, count(*) AS n FROM lg GROUP BY ALL),
        sh AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, x) AS nx,
                      sum(n) OVER (PARTITION BY feature, y) AS ny FROM jt)
        SELECT feature, round(sum(n / t * ln(CAST(n AS DOUBLE) * t / (CAST(nx AS DOUBLE) * ny))), 6) AS score FROM sh GROUP BY ALL""",
)
def m23_mi(t):
    return rounded(R.mutual_information(t.table("lineitem"), ["l_quantity", "l_tax"], "l_extendedprice"), ["score"], 6)
