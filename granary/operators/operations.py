"""Model operations as table jobs: error metrics, drift, retraining, reports, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.scale import running_totals
from granary.operators.windows import recent_trend, rising_three


def error_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """mape, smape and rmse over the rows with a non-zero actual, to two digits; null where there is none."""
    error = F.abs(F.col("actual") - F.col("yhat"))
    used = lambda x: F.when(F.col("actual") != 0, x)
    return df.groupBy(*keys).agg(
        F.round(F.avg(used(error / F.abs("actual"))) * 100, 2).alias("mape"),
        F.round(F.avg(used(2 * error / (F.abs("actual") + F.abs("yhat")))) * 100, 2).alias("smape"),
        F.round(F.sqrt(F.avg(used(error * error))), 2).alias("rmse"),
        F.count(used(F.lit(1))).alias("n"),
    )


def compare_demand(df: DataFrame, keys: list[str]) -> DataFrame:
    """mae, mse, rmse and mape; a zero actual does not enter mape."""
    error = F.abs(F.col("actual") - F.col("yhat"))
    return df.groupBy(*keys).agg(
        F.avg(error).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(F.when(F.col("actual") != 0, error / F.abs("actual"))) * 100).alias("mape"),
    )


def kolmogorov_tail(statistic: Column) -> Column:
    """Asymptotic probability of a larger scaled distance; practically 1 below 0.2."""
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda total, k: total
        + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * statistic * statistic),
    )
    return F.when(statistic < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), terms)))


def detect_drift(
    samples: DataFrame, keys: list[str], value: str, is_current: Column,
    alpha: float = 0.1, min_distance: float = 0.3, min_size: int = 10,
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov test per group, baseline against current rows.

    Equal values collapse first and the two cumulative counts are distributed running sums, so a group may hold
    any share of the rows. The distance is exact; the p value is asymptotic.
    """
    counts = samples.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(
        F.sum(F.when(is_current, 0).otherwise(1)).alias("_nb"),
        F.sum(F.when(is_current, 1).otherwise(0)).alias("_nc"),
    )
    ranked = running_totals(counts, keys, [F.col("_v")], {"b": F.col("_nb"), "c": F.col("_nc")})
    # A group may lack one of the samples; its share is then null and the size test below decides.
    gap = F.abs(F.try_divide("b", "b_all") - F.try_divide("c", "c_all"))
    tested = ranked.groupBy(*keys).agg(
        F.max("b_all").alias("n_baseline"), F.max("c_all").alias("n_current"), F.max(gap).alias("_d")
    )
    enough = (F.col("n_baseline") >= min_size) & (F.col("n_current") >= min_size)
    both = F.col("n_baseline") + F.col("n_current")
    scaled = F.col("_d") * F.sqrt(F.try_divide(F.col("n_baseline") * F.col("n_current"), both))
    judged = tested.withColumn("_p", F.when(enough, kolmogorov_tail(scaled)).otherwise(1.0)).withColumn(
        "_d", F.when(enough, F.col("_d")).otherwise(0.0)
    )
    return judged.select(
        *keys,
        "n_baseline",
        "n_current",
        F.round("_d", 4).alias("test_statistic"),
        F.round("_p", 4).alias("p_value"),
        (enough & (F.col("_p") < alpha) & (F.col("_d") > min_distance)).alias("drift_detected"),
        F.when(~enough, "insufficient sample").alias("reason"),
    )


def halves(df: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """Mark the later half of each series as current."""
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(date))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("is_current", row > F.floor(n / 2))


def adaptive_parameters(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Normal quantile by demand variation, with the deviation and variation it came from."""
    std, mean = F.stddev_pop(value), F.avg(value)
    cv = F.when(mean != 0, std / mean).otherwise(0.0)
    z = F.when(cv < 0.2, 1.28).when(cv < 0.5, 1.65).otherwise(2.33)
    return df.groupBy(*keys).agg(z.alias("z_value"), std.alias("std_demand"), cv.alias("cv"))


def retrain_decisions(
    history: DataFrame, drift: DataFrame, as_of: Column, keys: list[str], mape_limit: float = 20.0, max_age_days: int = 30
) -> DataFrame:
    """Whether to retrain and why: drift, too little history, worsening error, age, in this order."""
    state = rising_three(history, "mape", keys).join(drift.select(*keys, "drift_detected"), keys, "left")
    old = F.datediff(as_of, F.col("last_date")) > max_age_days
    worse = F.col("rising") & (F.col("last_mape") > mape_limit)
    drifted = F.coalesce("drift_detected", F.lit(False))
    reason = (
        F.when(drifted, "data drift detected")
        .when(F.col("points") < 3, "too few metrics")
        .when(worse, "metrics keep worsening")
        .when(old, "maximum training age exceeded")
        .otherwise("no retraining needed")
    )
    retrain = drifted | ((F.col("points") >= 3) & (worse | old))
    return state.select(*keys, retrain.alias("should_retrain"), reason.alias("reason"))


def rollback_decisions(metrics: DataFrame, keys: list[str], factor: float = 1.2) -> DataFrame:
    """Roll back where the new mape exceeds the old one by more than the factor (old_mape, new_mape columns)."""
    worse = F.coalesce(F.col("new_mape") > factor * F.col("old_mape"), F.lit(False))
    return metrics.select(
        *keys, "old_mape", "new_mape", worse.alias("rolled_back"),
        F.when(worse, F.col("old_mape")).otherwise(F.col("new_mape")).alias("active_mape"),
    )


def performance_report(
    history: DataFrame, drift: DataFrame, as_of: Column, days: int | None, keys: list[str], date: str = "date"
) -> DataFrame:
    """Averages and error trend over the last `days` (all history when None), with the drift flag."""
    used = history.where(F.col(date) <= as_of)
    if days is not None:
        used = used.where(F.col(date) >= F.date_sub(as_of, days))
    stats = used.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("metrics_count"),
        *[F.round(F.avg(m), 2).alias(f"avg_{m}") for m in ("mape", "smape", "rmse")],
    )
    trend = recent_trend(used, "mape", keys, date).withColumn("mape_trend", F.round("mape_trend", 2))
    return (
        stats.join(trend, keys)
        .join(drift.select(*keys, "drift_detected"), keys, "left")
        .withColumn("time_range", F.lit("all" if days is None else f"{days}d"))
    )


def hash_fraction(text: Column) -> Column:
    """A stable number in [0, 1) from the first 60 bits of the md5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("double") / float(16**15)


def route_policies(
    items: DataFrame, enrolled: DataFrame, policies: DataFrame, split: float, enabled: bool = True, key: str = "item_id"
) -> DataFrame:
    """Policy version per item under a gradual release.

    Items outside the release use their current version; enrolled ones the current version for the `split` share
    of items, by a stable hash, and the previous version otherwise. `policies` has (key, version, policy).
    """
    ranked = policies.groupBy(key).agg(
        F.max(F.struct("version", "policy")).alias("_now"),
        F.sort_array(F.collect_set("version"), asc=False).alias("_versions"),
    )
    before = policies.join(ranked.select(key, F.get("_versions", F.lit(1)).alias("version")), [key, "version"])
    marked = items.select(key).join(enrolled.select(key).distinct().withColumn("_in", F.lit(True)), key, "left")
    new = F.lit(not enabled) | F.col("_in").isNull() | (hash_fraction(F.col(key).cast("string")) < split)
    joined = marked.join(ranked.select(key, "_now"), key, "left").join(
        before.select(key, F.col("version").alias("_v"), F.col("policy").alias("_p")), key, "left"
    )
    return joined.select(
        key,
        F.when(new, "current").otherwise("previous").alias("route"),
        F.when(new, F.col("_now.version")).otherwise(F.col("_v")).alias("version"),
        F.when(new, F.col("_now.policy")).otherwise(F.col("_p")).alias("policy"),
    )


def rollback_policies(policies: DataFrame, items: DataFrame, key: str = "item_id") -> DataFrame:
    """New version rows that restore the previous policy of the given items."""
    wanted = policies.join(items.select(key).distinct(), key, "left_semi")
    versions = wanted.groupBy(key).agg(F.sort_array(F.collect_set("version"), asc=False).alias("_v"))
    target = versions.where(F.size("_v") > 1).select(key, F.get("_v", F.lit(1)).alias("version"), F.get("_v", F.lit(0)).alias("_top"))
    return wanted.join(target, [key, "version"]).select(key, (F.col("_top") + 1).alias("version"), "policy")


def due_for_retraining(models: DataFrame, as_of: Column, every_days: int) -> DataFrame:
    age = F.datediff(as_of, F.col("last_trained"))
    return models.withColumn("age_days", age).where(F.col("age_days") >= every_days)


def system_status(models: DataFrame, drift: DataFrame, orders: DataFrame, key: str = "item_id") -> DataFrame:
    """Per model name: items that use it, how many of them drift, and the open orders of those items."""
    open_orders = orders.where(F.col("status") == "O").groupBy(key).agg(F.count(F.lit(1)).alias("_open"))
    joined = models.join(drift.select(key, "drift_detected"), key, "left").join(open_orders, key, "left")
    return joined.groupBy("model").agg(
        F.count(F.lit(1)).alias("models"),
        F.count(F.when(F.col("drift_detected"), 1)).alias("drifting"),
        F.coalesce(F.sum("_open"), F.lit(0)).alias("open_orders"),
    )
