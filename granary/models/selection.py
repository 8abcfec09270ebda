"""Demand patterns, candidate lists, evaluation and the choice of a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["item_id", "location_id"]

# Candidate models per value class and demand pattern.
A_STEADY = ["hybrid_arima_xgb", "prophet", "arima", "holt_winters", "xgb"]
A_PROMOTIONAL = ["ensemble", "xgb", "gradient_boosting", "random_forest", "hybrid_arima_xgb"]
A_INTERMITTENT = ["croston", "sba", "arima", "svr", "hybrid_arima_xgb"]
B_ANY = ["ensemble", "gradient_boosting", "random_forest", "linear_regression", "hybrid_arima_xgb"]
C_ANY = ["linear_regression", "svr", "croston", "sba", "arima", "hybrid_arima_xgb"]
# Models a selection tag moves to the front.
PREFERRED = {
    "high_variability": ["svr", "hybrid_arima_xgb"],
    "seasonal": ["holt_winters", "arima"],
    "intermittent": ["sarimax", "hybrid_arima_xgb"],
    "stable": ["linear_regression", "arima"],
    "trending": ["linear_regression", "gradient_boosting"],
}


def _names(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def recommended_models(abc_class: Column, pattern: Column) -> Column:
    in_a = (
        F.when(pattern.isin("Stable", "Seasonal"), _names(A_STEADY))
        .when(pattern == "Promotional", _names(A_PROMOTIONAL))
        .otherwise(_names(A_INTERMITTENT))
    )
    return F.when(abc_class == "A", in_a).when(abc_class == "B", _names(B_ANY)).otherwise(_names(C_ANY))


def prioritised(models: Column, tag: Column) -> Column:
    """The tag's models first, where recommended; the order is otherwise kept."""
    preferred = F.array().cast("array<string>")
    for name, first in PREFERRED.items():
        preferred = F.when(tag == name, _names(first)).otherwise(preferred)
    return F.concat(F.array_intersect(preferred, models), F.array_except(models, preferred))


def demand_patterns(
    df: DataFrame, keys: list[str] = SERIES, value: str = "demand_qty", date: str = "date",
    zero_share: float = 0.3, jump_share: float = 0.15, seasonal_correlation: float = 0.3,
) -> DataFrame:
    """Intermittent, Promotional, Seasonal or Stable, tested in that order, with the measured indices.

    The seasonal index is the autocorrelation at distance 11 of a series of at least twelve points.
    """
    line = Window.partitionBy(*keys).orderBy(date)
    series = Window.partitionBy(*keys)
    x = F.col(value)
    centred = df.select(
        *keys, date, x,
        (x - F.lag(x).over(line)).alias("_change"),
        (x - F.avg(x).over(series)).alias("_dev"),
    )
    paired = centred.select(
        "*",
        F.stddev_pop("_change").over(series).alias("_change_std"),
        (F.col("_dev") * F.lag("_dev", 11).over(line)).alias("_product"),
    )
    n = F.count(F.lit(1))
    jump = F.when(F.abs("_change") > 2 * F.col("_change_std"), 1.0).when(F.col("_change").isNotNull(), 0.0)
    measured = paired.groupBy(*keys).agg(
        F.avg(F.when(x == 0, 1.0).otherwise(0.0)).alias("zero_share"),
        F.coalesce(F.avg(jump), F.lit(0.0)).alias("jump_share"),
        F.when((n >= 12) & (F.var_pop(x) > 0), F.sum("_product") / (F.var_pop(x) * (n - 11))).alias("season_index"),
    )
    pattern = (
        F.when(F.col("zero_share") > zero_share, "Intermittent")
        .when(F.col("jump_share") > jump_share, "Promotional")
        .when(F.col("season_index") > seasonal_correlation, "Seasonal")
        .otherwise("Stable")
    )
    return measured.withColumn("pattern", pattern)


# Evaluation measures by name; each is an aggregate over (actual, yhat) rows of one group.
def _mean_if(condition: Column, value: Column) -> Column:
    return F.coalesce(F.avg(F.when(condition, value)), F.lit(0.0))


METRICS: dict[str, Column] = {}


def register_metric(name: str, measure: Column) -> None:
    """Make an aggregate expression over `actual` and `yhat` available to `measure_forecasts`."""
    METRICS[name] = measure


def _register_standard_metrics() -> None:
    """Fill in the standard measures; a name registered by the user keeps the user's measure."""
    if "mae" in METRICS and "smape" in METRICS:
        return
    mine = dict(METRICS)
    a, p = F.col("actual"), F.col("yhat")
    error = F.abs(a - p)
    register_metric("mae", F.avg(error))
    register_metric("mse", F.avg(error * error))
    register_metric("rmse", F.sqrt(F.avg(error * error)))
    register_metric("mape", _mean_if(a != 0, error / F.abs(a)) * 100)
    both = F.abs(a) + F.abs(p)
    register_metric("smape", 2 * _mean_if(both != 0, error / both) * 100)
    METRICS.update(mine)


def measure_forecasts(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """The named measures per group."""
    _register_standard_metrics()
    return df.groupBy(*keys).agg(*[METRICS[m].alias(m) for m in metrics])


def pad_forecast(actual: DataFrame, forecast: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """Every actual step with its forecast; steps past the forecast repeat its last value, extra steps fall away."""
    line = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    joined = actual.join(forecast, [*keys, date], "left")
    return joined.withColumn("yhat", F.last("yhat", ignorenulls=True).over(line))


def evaluate(df: DataFrame, keys: list[str], date: str = "date", tolerance: float = 0.1) -> DataFrame:
    """All evaluation measures per group (series and model) in one shuffle."""
    _register_standard_metrics()
    line = Window.partitionBy(*keys).orderBy(date)
    a, p = F.col("actual"), F.col("yhat")
    steps = df.select(
        "*",
        F.lag("actual").over(line).alias("_a"),
        F.lag("yhat").over(line).alias("_p"),
    )
    has_previous = F.col("_a").isNotNull()
    naive = F.avg(F.abs(a - F.col("_a")))
    mae = F.avg(F.abs(a - p))
    sse, sst = F.sum((a - p) * (a - p)), F.var_pop("actual") * F.count("actual")
    same_way = (a > F.col("_a")) == (p > F.col("_p"))
    hit = F.abs((a - p) / (a + 1e-8)) <= tolerance
    return steps.groupBy(*keys).agg(
        *[METRICS[m].alias(m) for m in ("mae", "mse", "rmse", "mape", "smape")],
        F.when(sst == 0, F.when(sse == 0, 1.0).otherwise(0.0)).otherwise(1 - sse / sst).alias("r2"),
        F.when(F.coalesce(naive, F.lit(0.0)) == 0, 0.0).otherwise(mae / naive).alias("mase"),
        (F.avg(F.when(hit, 1.0).otherwise(0.0)) * 100).alias("accuracy_10"),
        (_mean_if(has_previous, F.when(same_way, 1.0).otherwise(0.0)) * 100).alias("direction_accuracy"),
    )


# Weight of each measure in the selection score.
SCORE_WEIGHTS = {"rmse": 0.3, "mae": 0.2, "mape": 0.2, "smape": 0.15, "mase": 0.15}


def weighted_score(evaluated: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    terms = [F.col(m) * w for m, w in (weights or SCORE_WEIGHTS).items()]
    return evaluated.withColumn("score", sum(terms[1:], terms[0]))


def select_by_rmse(backtests: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Model with the least backtest rmse per series, ties by name."""
    scored = measure_forecasts(backtests, [*keys, "model"], ["rmse"])
    best = scored.groupBy(*keys).agg(F.min(F.struct("rmse", "model")).alias("_b"))
    return best.select(*keys, F.col("_b.model").alias("model"), F.col("_b.rmse").alias("rmse"))


def time_folds(
    df: DataFrame, keys: list[str] = SERIES, date: str = "date", splits: int = 5, test: float = 0.2, min_train: float = 0.3
) -> DataFrame:
    """Rows labelled train or test per fold; the cut moves evenly from `min_train` to the last full test part."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(date))
    placed = df.withColumn("_n", n).withColumn("_row", row)
    rows = placed.select("*", F.explode(F.sequence(F.lit(1), F.lit(splits))).alias("fold"))
    share = min_train + (1 - min_train - test) * (F.col("fold") - 1) / max(splits - 1, 1)
    cut, size = F.floor(F.col("_n") * share + 1e-9), F.floor(F.col("_n") * test + 1e-9)
    role = F.when(F.col("_row") <= cut, "train").when(F.col("_row") <= cut + size, "test")
    return rows.withColumn("role", role).where(F.col("role").isNotNull()).drop("_n", "_row")


# --- Ensembles -------------------------------------------------------------------------------------------------


def combine(forecasts: DataFrame, weights: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """Weighted sum of the models' forecasts per step; `weights` has (on, model, weight)."""
    joined = forecasts.join(weights.select(*on, "model", "weight"), [*on, "model"])
    return joined.groupBy(*keys).agg(F.sum(F.col("yhat") * F.col("weight")).alias("yhat"))


def adjusted_performance(
    backtests: DataFrame, models: list[str], keys: list[str] = SERIES, date: str = "date", diversity_weight: float = 0.1
) -> DataFrame:
    """Inverse rmse blended with the models' diversity: the mean of one minus their defined pairwise correlations.

    The models become columns first, so pairs are column pairs and rows are never multiplied.
    """
    at = lambda m: F.max(F.when(F.col("model") == m, F.col("yhat")))
    wide = backtests.groupBy(*keys, date).agg(F.max("actual").alias("actual"), *[at(m).alias(m) for m in models])
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1 :]]
    apart = [F.nanvl(1 - F.corr(a, b), F.lit(None).cast("double")) for a, b in pairs]
    defined = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in apart), F.lit(0))
    known = sum((F.coalesce(x, F.lit(0.0)) for x in apart), F.lit(0.0))
    diversity = F.coalesce(F.try_divide(known, defined), F.lit(0.0))
    inverse = lambda m: 1 / (F.sqrt(F.avg((F.col("actual") - F.col(m)) * (F.col("actual") - F.col(m)))) + 1e-6)
    blended = lambda m: inverse(m) * (1 - diversity_weight) + diversity * diversity_weight
    scores = F.array(*[F.struct(F.lit(m).alias("model"), blended(m).alias("performance")) for m in models])
    return wide.groupBy(*keys).agg(scores.alias("_s")).select(*keys, F.inline("_s"))


def normalised(performance: DataFrame, keys: list[str], value: str = "performance") -> DataFrame:
    total = F.sum(value).over(Window.partitionBy(*keys))
    return performance.withColumn("weight", F.col(value) / total)


def dynamic_weights(backtests: DataFrame, models: list[str], keys: list[str] = SERIES) -> DataFrame:
    """Weights of the first update: the blended performances scaled to sum 1."""
    return normalised(adjusted_performance(backtests, models, keys), keys).select(*keys, "model", "weight")


def weights_after_updates(
    history: DataFrame, keys: list[str], decay: float = 0.9, smoothing: float = 0.1
) -> DataFrame:
    """Weights after all updates in `history` (keys, model, update_no, performance).

    Update k uses performances decayed by age; from the second update on, weights move by `smoothing` towards it.
    The list per (key, model) holds one entry per update.
    """
    ordered = history.groupBy(*keys, "model").agg(
        F.sort_array(F.collect_list(F.struct("update_no", "performance"))).alias("_h")
    )
    decayed = F.aggregate(
        F.col("_h.performance"),
        F.array().cast("array<double>"),
        lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) > 0, F.get(acc, F.size(acc) - 1)).otherwise(0.0) * decay + x)),
    )
    per_update = ordered.select(*keys, "model", F.posexplode(decayed).alias("_u", "_p"))
    scaled = normalised(per_update, [*keys, "_u"], "_p")
    targets = scaled.groupBy(*keys, "model").agg(F.sort_array(F.collect_list(F.struct("_u", "weight"))).alias("_w"))
    first = F.get("_w", F.lit(0))["weight"]
    moved = F.aggregate(
        F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 1, F.lit(0))),
        first,
        lambda w, t: w * (1 - smoothing) + t["weight"] * smoothing,
    )
    return targets.select(*keys, "model", moved.alias("weight"))


def add_model(weights: DataFrame, model: str, keys: list[str], weight: float | None = None) -> DataFrame:
    """Weights with one more model, scaled to sum 1; without a weight it gets an average share."""
    share = F.sum("weight").over(Window.partitionBy(*keys))
    if weight is None:
        kept = weights.select(*keys, "model", (F.col("weight") / (share + 1)).alias("weight"))
        fresh = weights.groupBy(*keys).agg((1 / (F.sum("weight") + 1)).alias("weight"))
    else:
        kept = weights.select(*keys, "model", "weight")
        fresh = weights.select(*keys).distinct().withColumn("weight", F.lit(float(weight)))
    both = kept.unionByName(fresh.withColumn("model", F.lit(model)))
    return normalised(both, keys, "weight")


def reconcile(
    forecasts: DataFrame, category_forecasts: DataFrame, item: str = "item_id", step: str = "step"
) -> DataFrame:
    """Scale item forecasts so that they add up to their category's forecast.

    Categories can be huge, so their totals are a map-side combined aggregate joined back, not a window.
    Where the items of a category sum to zero, they stay as they are.
    """
    totals = forecasts.groupBy("category", step).agg(F.sum("yhat").alias("_total"))
    alive = totals.groupBy("category").agg(F.max(F.col("_total") != 0).alias("_alive"))
    factors = totals.join(category_forecasts, ["category", step]).join(alive, "category")
    still = ~F.col("_alive") | (F.col("_total") == 0)
    factor = F.when(still, 1.0).otherwise(F.col("category_yhat") / F.col("_total"))
    rows = forecasts.join(factors.select("category", step, factor.alias("factor")), ["category", step])
    return rows.select(item, "category", step, (F.col("yhat") * F.col("factor")).alias("yhat"), "factor")


def reconciled_forecasts(skus: DataFrame, forecaster, steps: int) -> DataFrame:
    """Items (item_id, category, date, demand_qty) and their categories' roll-up forecast apart, then made to add up.

    The categories' series are the sums of their items' per date; the factor of a category differs from step to step.
    """
    from granary.operators.aggregates import category_rollup

    def long(found: DataFrame, keys: list[str], name: str) -> DataFrame:
        return found.select(*keys, F.posexplode("forecast").alias("_i", name)).select(*keys, (F.col("_i") + 1).alias("step"), name)

    items = long(forecaster(skus, steps, ["item_id", "category"]), ["item_id", "category"], "yhat")
    rolled = category_rollup(skus).select("category", "date", "demand_qty")
    top = long(forecaster(rolled, steps, ["category"]), ["category"], "category_yhat")
    return reconcile(items, top)


# --- Refit and feedback ----------------------------------------------------------------------------------------


def accept_refit(scores: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Keep the refitted model only where its rmse is better by more than `threshold` (old_rmse, new_rmse columns)."""
    gain = F.when(F.col("old_rmse") > 0, (F.col("old_rmse") - F.col("new_rmse")) / F.col("old_rmse")).otherwise(0.0)
    return scores.withColumn("improvement", gain).withColumn("accepted", F.col("improvement") > threshold)


def feedback(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean absolute error, error variance and bias of forecasts against what happened."""
    error = F.col("actual") - F.col("yhat")
    return df.groupBy(*keys).agg(
        F.avg(F.abs(error)).alias("prediction_error"),
        F.var_pop(error).alias("error_variance"),
        F.avg(error).alias("bias"),
        F.count(F.lit(1)).alias("n"),
    )


def improvement_percent(old_rmse: Column, new_rmse: Column) -> Column:
    return F.when(old_rmse > 0, (old_rmse - new_rmse) / old_rmse * 100).otherwise(0.0)
