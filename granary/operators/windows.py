"""Panels, lags, rolling statistics, cumulative classes, splits and ranked selections.

Series windows run over panels with one row per calendar step. Orders over whole tables go through
`granary.operators.scale`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.scale import numbered, running_totals, with_row

SERIES = ["item_id", "location_id"]
LAGS = (1, 3, 7, 14, 30)
WINDOWS = (7, 14, 30, 60)
STATISTICS = {"mean": F.avg, "median": None, "std": F.stddev_samp, "min": F.min, "max": F.max}


def _line(keys: list[str], date: str):
    return Window.partitionBy(*keys).orderBy(date)


def lag_features(
    df: DataFrame, columns: list[str], lags: tuple[int, ...] = LAGS, keys: list[str] = SERIES, date: str = "date"
) -> DataFrame:
    """`<column>_lag_<k>` in one projection, without the rows whose history is too short."""
    line = _line(keys, date)
    made = [F.lag(c, k).over(line).alias(f"{c}_lag_{k}") for c in columns for k in lags]
    out = df.select("*", *made, F.row_number().over(line).alias("_row"))
    return out.where(F.col("_row") > max(lags)).drop("_row")


def rolling_features(
    df: DataFrame,
    columns: list[str],
    windows: tuple[int, ...] = WINDOWS,
    statistics: tuple[str, ...] = tuple(STATISTICS),
    keys: list[str] = SERIES,
    date: str = "date",
    complete: bool = True,
) -> DataFrame:
    """`<column>_roll_<w>_<statistic>`, null until the window holds w values; `complete` drops those rows.

    Counts and sums of a window are differences of running totals, whatever its length. With medians wanted, one
    list of the longest window per row serves median, minimum and maximum of every window: its last w values,
    sorted. Deviations then come from running sums of squares around the series mean, and are exactly 0 where the
    window's extremes agree.
    """
    line, series = _line(keys, date), Window.partitionBy(*keys)
    frame = lambda w: line.rowsBetween(1 - w, 0)
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    from_list = {"median", "min", "max"} & set(statistics) if "median" in statistics else set()
    from_sums = {"mean", "std"} & set(statistics) if from_list else {"mean"} & set(statistics)
    from_frames = [s for s in statistics if s not in from_list | from_sums]

    centred = df.select("*", *[F.avg(c).over(series).alias(f"_mid_{c}") for c in columns]).withColumns(
        {f"_dev_{c}": F.coalesce(F.col(c) - F.col(f"_mid_{c}"), F.lit(0.0)) for c in columns}
    )
    running = centred.select(
        "*",
        F.row_number().over(line).alias("_row"),
        *[F.count(c).over(so_far).alias(f"_upto_{c}") for c in columns],
        *[F.sum(f"_dev_{c}").over(so_far).alias(f"_sum_{c}") for c in columns],
        *[F.sum(F.col(f"_dev_{c}") * F.col(f"_dev_{c}")).over(so_far).alias(f"_sq_{c}") for c in columns],
        *[F.collect_list(F.col(c)).over(frame(max(windows))).alias(f"_last_{c}") for c in columns if from_list],
        *[STATISTICS[s](F.col(c)).over(frame(w)).alias(f"_{s}_{c}_{w}") for c in columns for w in windows for s in from_frames],
    )
    within = lambda total, w: F.col(total) - F.coalesce(F.lag(total, w).over(line), F.lit(0))
    parts = {"n": "_upto", "s": "_sum", "q": "_sq"}
    windowed = running.select(
        "*",
        *[within(f"{total}_{c}", w).alias(f"_{p}_{c}_{w}") for p, total in parts.items() for c in columns for w in windows],
    )
    kept = windowed.where(F.col("_row") >= max(windows)) if complete else windowed
    if from_list:
        kept = kept.select(
            "*", *[F.sort_array(F.slice(f"_last_{c}", -w, w)).alias(f"_l_{c}_{w}") for c in columns for w in windows]
        )

    def statistic(s: str, c: str, w: int) -> Column:
        at = lambda i: F.get(F.col(f"_l_{c}_{w}"), F.lit(i))
        total, squares = F.col(f"_s_{c}_{w}"), F.col(f"_q_{c}_{w}")
        if s in from_frames:
            return F.col(f"_{s}_{c}_{w}")
        if s == "mean":
            return F.col(f"_mid_{c}") + total / w
        if s == "std":
            spread = F.sqrt(F.greatest(F.lit(0.0), squares - total * total / w) / max(w - 1, 1))
            return F.when(at(0) == at(w - 1), F.lit(0.0) if w > 1 else F.lit(None)).otherwise(spread)
        return {"min": at(0), "max": at(w - 1), "median": (at((w - 1) // 2) + at(w // 2)) / 2}[s]

    made = [
        F.when(F.col(f"_n_{c}_{w}") == w, statistic(s, c, w)).alias(f"{c}_roll_{w}_{s}")
        for c in columns for w in windows for s in statistics
    ]
    return kept.select(*df.columns, *made)


def rolling_trend(
    df: DataFrame, windows: tuple[int, ...] = (7, 14, 30), value: Column | None = None,
    keys: list[str] = SERIES, date: str = "date",
) -> DataFrame:
    """Least-squares slope over each window; the value defaults to the day of the year."""
    line = _line(keys, date)
    y = (F.dayofyear(date) if value is None else value).cast("double")
    placed = df.select("*", y.alias("_y"), F.row_number().over(line).cast("double").alias("_x"))
    made = [
        F.when(F.col("_x") >= w, F.regr_slope("_y", "_x").over(line.rowsBetween(1 - w, 0))).alias(f"trend_{w}d")
        for w in windows
    ]
    return placed.select("*", *made).drop("_y", "_x")


def time_decay(df: DataFrame, keys: list[str] = SERIES, date: str = "date", rate: float = 0.01) -> DataFrame:
    since = F.datediff(F.col(date), F.min(date).over(Window.partitionBy(*keys)))
    return df.withColumn("days_since_start", since).withColumn("time_decay", F.exp(-rate * F.col("days_since_start")))


def abc_classes(df: DataFrame, item: str, value: str, a_share: float = 0.8, b_share: float = 0.95) -> DataFrame:
    """Class by cumulative share of value, highest value first, ties by item. Any number of products."""
    ranked = running_totals(df, [], [F.desc(value), F.col(item)], {"_run": F.col(value)})
    total = F.when(F.col("_run_all") > 0, F.col("_run_all")).otherwise(
        F.raise_error(F.lit("the total of the classified value must be positive")).cast("double")
    )
    share = F.col("_run") / total
    label = F.when(F.col("share") <= a_share, "A").when(F.col("share") <= b_share, "B").otherwise("C")
    return ranked.withColumn("share", share).withColumn("abc_class", label).drop("_run", "_run_all")


def _recent(df: DataFrame, keys: list[str], date: str, n: int) -> DataFrame:
    """The last `n` rows per key, `_back` = 1 for the newest; Spark limits each group before the shuffle."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(date)))
    return df.withColumn("_back", back).where(F.col("_back") <= n)


def recent_trend(df: DataFrame, metric: str, keys: list[str], date: str = "date", k: int = 7) -> DataFrame:
    """Mean of the last k minus mean of the k before; 0 with fewer than 2k points."""
    recent = F.avg(F.when(F.col("_back") <= k, F.col(metric)))
    before = F.avg(F.when(F.col("_back") > k, F.col(metric)))
    trend = F.when(F.count(F.lit(1)) == 2 * k, recent - before).otherwise(0.0)
    return _recent(df, keys, date, 2 * k).groupBy(*keys).agg(trend.alias(f"{metric}_trend"))


def rising_three(df: DataFrame, metric: str, keys: list[str], date: str = "date") -> DataFrame:
    """Whether the last three values rise strictly, with the last value, its date and how many there are (at most 3)."""
    at = lambda k: F.max(F.when(F.col("_back") == k, F.col(metric)))
    return (
        _recent(df, keys, date, 3)
        .groupBy(*keys)
        .agg(
            F.coalesce((at(1) > at(2)) & (at(2) > at(3)), F.lit(False)).alias("rising"),
            at(1).alias(f"last_{metric}"),
            F.max(date).alias("last_date"),
            F.count(F.lit(1)).alias("points"),
        )
    )


def jump_share(df: DataFrame, value: str, keys: list[str] = SERIES, date: str = "date", sigmas: float = 2.0) -> DataFrame:
    """Share of step changes larger than `sigmas` population deviations of the changes."""
    changes = df.select(*keys, (F.col(value) - F.lag(value).over(_line(keys, date))).alias("_change"))
    spread = F.stddev_pop("_change").over(Window.partitionBy(*keys))
    marked = changes.select(*keys, "_change", spread.alias("_std"))
    is_jump = F.when(F.abs("_change") > sigmas * F.col("_std"), 1.0).when(F.col("_change").isNotNull(), 0.0)
    return marked.groupBy(*keys).agg(F.coalesce(F.avg(is_jump), F.lit(0.0)).alias("jump_share"))


def direction_flags(df: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """Whether actual and forecast went up since the previous step; null at a series' first step."""
    line = _line(keys, date)
    up = lambda c: (F.col(c) > F.lag(c).over(line)).cast("int")
    return df.withColumns({"actual_up": up("actual"), "yhat_up": up("yhat")})


def ordered_split(
    df: DataFrame, keys: list[str] = SERIES, date: str = "date", test: float = 0.2, validation: float = 0.1
) -> DataFrame:
    """Label rows train / validation / test in date order; both part sizes round up."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    row = F.row_number().over(_line(keys, date))
    n_test = F.ceil(n * F.lit(test))
    n_validation = F.ceil((n - n_test) * F.lit(validation))
    label = (
        F.when(row > n - n_test, "test").when(row > n - n_test - n_validation, "validation").otherwise("train")
    )
    return df.withColumn("split", label)


def scale_on_train(df: DataFrame, columns: list[str]) -> DataFrame:
    """Standardise with the mean and population deviation of the train rows; a zero deviation counts as 1."""
    train = lambda c: F.when(F.col("split") == "train", F.col(c))
    stats = df.agg(
        *[F.avg(train(c)).alias(f"{c}_mean") for c in columns],
        *[F.stddev_pop(train(c)).alias(f"{c}_std") for c in columns],
    )
    scaled = {}
    for c in columns:
        std = F.col(f"_stats.{c}_std")
        scaled[f"{c}_scaled"] = (F.col(c) - F.col(f"_stats.{c}_mean")) / F.when(std == 0, 1.0).otherwise(std)
    return with_row(df, stats).withColumns(scaled).drop("_stats")


def latest_rows(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """First k rows per group with their `rank`; groups are cut to k rows per task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def top_features(scores: DataFrame, k: int = 20, at_least: float = 0.0) -> DataFrame:
    return scores.where(F.col("score") >= at_least).orderBy(F.desc("score"), "feature").limit(k)


def series_tail(df: DataFrame, n: int, keys: list[str] = SERIES, date: str = "date") -> DataFrame:
    return _recent(df, keys, date, n).drop("_back")


def top_rules(rules: DataFrame, n: int = 5) -> DataFrame:
    """High priority first, then confidence, then importance."""
    return rules.orderBy(
        F.when(F.col("priority") == "high", 0).otherwise(1), F.desc("confidence"), F.desc("importance"), "feature"
    ).limit(n)


def clip_horizon(forecast: DataFrame, days: int, keys: list[str] = SERIES, date: str = "date") -> DataFrame:
    """First `days` steps per series with their step number."""
    step = F.row_number().over(_line(keys, date))
    return forecast.withColumn("step", step).where(F.col("step") <= days)


def append(*parts: DataFrame) -> DataFrame:
    """Rows of all parts by column name; a column some part lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def extend_history(history: DataFrame, fresh: DataFrame, keys: list[str] = SERIES, date: str = "date") -> DataFrame:
    """History and new observations; on the same day the newer value wins."""
    both = append(history.withColumn("_age", F.lit(1)), fresh.withColumn("_age", F.lit(0)))
    rest = [c for c in history.columns if c not in (*keys, date)]
    kept = F.min_by(F.struct(*rest), "_age")
    return both.groupBy(*keys, date).agg(kept.alias("_row")).select(*keys, date, *[F.col(f"_row.{c}").alias(c) for c in rest])


def with_row_ids(df: DataFrame, order: list[Column], name: str = "row_id") -> DataFrame:
    return numbered(df, order, name)
