"""Variant assignment, observation errors, and statistical comparison of variants."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.scalars import normal_cdf
from granary.operators.aggregates import variant_stats
from granary.operators.joins import variant_pairs
from granary.operators.operations import hash_fraction
from granary.operators.scale import spread, value_counts


def assign_uniform(unit: Column, variants: list[str]) -> Column:
    """Stable equal-share variant of a unit."""
    index = F.conv(F.substring(F.md5(unit.cast("string")), 1, 15), 16, 10).cast("bigint") % len(variants)
    return F.get(F.array(*[F.lit(v) for v in variants]), index.cast("int"))


def _by_weight(fraction: Column, weights: dict[str, float]) -> Column:
    names = list(weights)
    out, reached, steps = F.lit(names[-1]), 0.0, []
    for name in names:
        reached += weights[name]
        steps.append((name, reached))
    for name, limit in reversed(steps):
        out = F.when(fraction <= limit, name).otherwise(out)
    return out


def assign_sticky(unit: Column, product: Column | None, weights: dict[str, float]) -> Column:
    """Stable weighted variant of a unit, or of a (unit, product) pair where a product is given."""
    key = unit.cast("string")
    if product is not None:
        key = F.when(product.isNull(), key).otherwise(F.concat_ws("_", key, product.cast("string")))
    return _by_weight(hash_fraction(key), weights)


def assign_random(weights: dict[str, float], seed: int, key: Column | None = None) -> Column:
    """Weighted variant drawn anew for every row; with a row `key` the draw is a hash of it, the same on every run."""
    draw = F.rand(seed) if key is None else hash_fraction(F.concat_ws("_", key.cast("string"), F.lit(str(seed))))
    return _by_weight(draw, weights)


def assign_stratified(product: Column, weights: dict[str, float], seed: int = 0, key: Column | None = None) -> Column:
    """Even last digit (or no digit) is control, odd is variant; without a product the choice is random.

    With a row `key` that draw is a hash of it, the same on every run and for any partitioning.
    """
    last = F.substring(product.cast("string"), -1, 1)
    odd = last.rlike("^[0-9]$") & (last.cast("string").try_cast("int") % 2 == 1)
    by_digit = F.when(odd, "variant").otherwise("control")
    return F.when(product.isNull() | (product.cast("string") == ""), assign_random(weights, seed, key)).otherwise(by_digit)


def observation_errors(df: DataFrame) -> DataFrame:
    gap = F.col("actual") - F.col("predicted")
    share = F.when(F.col("actual") != 0, F.abs(gap / F.col("actual"))).otherwise(0.0)
    return df.withColumns(
        {"error": F.abs(gap), "squared_error": gap * gap, "absolute_percentage_error": share}
    )


def group_summary(observed: DataFrame, keys: list[str], control: str = "control", variant: str = "variant") -> DataFrame:
    """rmse, mae and mape of both groups with their difference and improvement, one row per measure."""
    measures = {
        "rmse": F.sqrt(F.avg("squared_error")),
        "mae": F.avg("error"),
        "mape": F.avg("absolute_percentage_error") * 100,
    }
    per_group = observed.groupBy(*keys, "group").agg(*[m.alias(n) for n, m in measures.items()])
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in measures]))
    long = per_group.select(*keys, "group", cells.alias("c")).select(*keys, "group", "c.metric", "c.value")
    of = lambda g: F.coalesce(F.max(F.when(F.col("group") == g, F.col("value"))), F.lit(0.0))
    wide = long.groupBy(*keys, "metric").agg(of(control).alias("control"), of(variant).alias("variant"))
    gain = F.when(F.col("control") != 0, (F.col("control") - F.col("variant")) / F.col("control") * 100).otherwise(0.0)
    return wide.withColumn("difference", F.col("variant") - F.col("control")).withColumn("improvement", gain)


# --- Student's t tail, the one function neither Spark nor SQL offers; runs on the few pair rows only -------------


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz evaluation)."""
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(x)
    d = 1 / guard(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, 300):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / guard(1 + even * d)
        c = guard(1 + even / c)
        out = out * c * d
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / guard(1 + odd * d)
        c = guard(1 + odd / c)
        step = c * d
        out = out * step
        if np.all(np.abs(step - 1) < 1e-13):
            break
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling series after shifting the argument above 10."""
    x = np.asarray(x, dtype=float)
    shift = np.zeros_like(x)
    for _ in range(10):
        low = x < 10
        shift = shift - np.where(low, np.log(np.where(low, x, 1.0)), 0.0)
        x = np.where(low, x + 1, x)
    inv = 1 / (x * x)
    series = (1 / 12 - inv * (1 / 360 - inv * (1 / 1260 - inv / 1680))) / x
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series


def student_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p value of a t statistic."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    x = df / (df + t * t)
    a, b = df / 2, np.full_like(df, 0.5)
    front = np.exp(
        _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b)
        + a * np.log(np.clip(x, 1e-300, 1)) + b * np.log(np.clip(1 - x, 1e-300, 1))
    )
    direct = front * _beta_fraction(a, b, x) / a
    mirrored = 1 - front * _beta_fraction(b, a, 1 - x) / b
    return np.clip(np.where(x < (a + 1) / (a + b + 2), direct, mirrored), 0, 1)


def student_quantile(p: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Half width of a two-sided interval: the t with tail probability `p`, by bisection."""
    low, high = np.zeros_like(df, dtype=float), np.full_like(df, 1e4, dtype=float)
    for _ in range(80):
        middle = (low + high) / 2
        above = student_tail(middle, df) > p
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return (low + high) / 2


@F.pandas_udf(T.DoubleType())
def _tail_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(student_tail(t.to_numpy(), df.to_numpy()))


@F.pandas_udf(T.DoubleType())
def _quantile_udf(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(student_quantile(p.to_numpy(), df.to_numpy()))


def t_statistics(observations: DataFrame, keys: tuple[str, ...] = ("metric",), pooled: bool = False) -> DataFrame:
    """t, degrees of freedom and effect size for every pair of variants per metric.

    Welch with population variances in the effect size; with `pooled` the equal-variance test with sample variances.
    The rows shrink to one per (variant, metric) before pairs are formed.
    """
    stats = variant_stats(observations, ("variant", *keys)).select("variant", *keys, "n", "mean", "std", "var_pop")
    pairs = variant_pairs(stats, list(keys))
    na, nb = F.col("n_a"), F.col("n_b")
    va, vb = F.col("std_a") * F.col("std_a"), F.col("std_b") * F.col("std_b")
    gap = F.col("mean_a") - F.col("mean_b")
    # Groups of one row or without any spread have no statistic: null instead of a division error.
    free = na + nb - 2
    common = F.sqrt(F.try_divide((na - 1) * va + (nb - 1) * vb, free))
    if pooled:
        t = F.try_divide(gap, common * F.sqrt(1 / na + 1 / nb))
        df, d = free.cast("double"), F.try_divide(gap, common)
    else:
        sa, sb = va / na, vb / nb
        t = F.try_divide(gap, F.sqrt(sa + sb))
        inner = F.try_divide(sa * sa, na - 1) + F.try_divide(sb * sb, nb - 1)
        df = F.try_divide((sa + sb) * (sa + sb), inner)
        within = (na - 1) * F.col("var_pop_a") + (nb - 1) * F.col("var_pop_b")
        d = F.try_divide(gap, F.sqrt(F.try_divide(within, free)))
    return pairs.select(
        "variant_a", "variant_b", *keys, "n_a", "n_b", "mean_a", "mean_b", "std_a", "std_b",
        t.alias("t_statistic"), df.alias("degrees"), d.alias("cohens_d"),
    )


def t_tests(
    observations: DataFrame, alpha: float = 0.05, min_sample: int = 0, pooled: bool = False, keys: tuple[str, ...] = ("metric",)
) -> DataFrame:
    """`t_statistics` with p value, both groups' confidence intervals and the verdict; small groups are not tested."""
    tested = t_statistics(observations, keys, pooled).withColumn("p_value", _tail_udf("t_statistic", "degrees"))
    enough = (F.col("n_a") >= min_sample) & (F.col("n_b") >= min_sample)

    def half(side: str) -> Column:
        quantile = _quantile_udf(F.lit(alpha), (F.col(f"n_{side}") - 1).cast("double"))
        return quantile * F.col(f"std_{side}") / F.sqrt(f"n_{side}")

    with_ci = tested.withColumns({"_half_a": half("a"), "_half_b": half("b")})
    bounds = {
        f"ci_{end}_{s}": F.col(f"mean_{s}") + sign * F.col(f"_half_{s}")
        for s in "ab"
        for end, sign in (("low", -1), ("high", 1))
    }
    return with_ci.withColumns(bounds).withColumns(
        {
            "status": F.when(enough, "completed").otherwise("insufficient_sample"),
            "significant": F.when(enough, F.col("p_value") < alpha).otherwise(F.lit(False)),
        }
    ).drop("_half_a", "_half_b")


def chi_square(successes: DataFrame, keys: list[str]) -> DataFrame:
    """Yates-corrected chi-square of two proportions for every pair of variants (variant, successes, total)."""
    pairs = variant_pairs(successes.select("variant", *keys, "successes", "total"), keys)
    sa, sb, ta, tb = (F.col(c).cast("double") for c in ("successes_a", "successes_b", "total_a", "total_b"))
    rate = F.try_divide(sa + sb, ta + tb)
    expected = {"expected_success_a": ta * rate, "expected_success_b": tb * rate}
    cells = [(sa, ta * rate), (sb, tb * rate), (ta - sa, ta * (1 - rate)), (tb - sb, tb * (1 - rate))]

    def term(observed: Column, wanted: Column) -> Column:
        gap = F.abs(observed - wanted)
        reduced = gap - F.least(F.lit(0.5), gap)
        return F.try_divide(reduced * reduced, wanted)

    statistic = sum((term(o, e) for o, e in cells[1:]), term(*cells[0]))
    tested = pairs.withColumns(expected).withColumn("chi2_statistic", statistic)
    p = 2 * (1 - normal_cdf(F.sqrt("chi2_statistic")))
    return tested.withColumn("p_value", p).withColumn("significant", F.col("p_value") < 0.05)


_STREAMS = 1024


def bootstrap_means(
    observations: DataFrame, replicates: int = 10_000, seed: int = 42, keys: tuple[str, ...] = ("variant", "metric")
) -> DataFrame:
    """Means of Poisson bootstrap replicates per group: (keys, replicate, mean).

    Equal values collapse to counts. The values of a group are dealt by hash to `_STREAMS` generators, each seeded by
    its own number and drawing in the order of its values, so nothing depends on how rows are spread. A task holds the
    sums of one group at a time and emits one partial sum per (group, replicate).
    """
    counts = value_counts(observations, list(keys), ["value"]).select(
        *keys, F.pmod(F.xxhash64("value"), F.lit(_STREAMS)).alias("stream"), "value", "n"
    )
    counts = counts.withColumn("seed", F.xxhash64(*keys, "stream", F.lit(seed)))
    types = dict(observations.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", replicate int, total double, weight double"

    def sums_of(group: tuple, acc: np.ndarray) -> pd.DataFrame:
        out = pd.DataFrame({"replicate": np.arange(replicates, dtype="int32"), "total": acc[0], "weight": acc[1]})
        for k, v in zip(keys, group):
            out[k] = v
        return out[[*keys, "replicate", "total", "weight"]]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, acc, at, rng = None, np.zeros((2, replicates)), None, None
        for pdf in batches:
            for (*here, s), part in pdf.groupby([*keys, "seed"], sort=False, dropna=False):
                if tuple(here) != group:
                    if group is not None:
                        yield sums_of(group, acc)
                    group, acc = tuple(here), np.zeros((2, replicates))
                if (group, s) != at:
                    at, rng = (group, s), np.random.default_rng(int(s) & 0xFFFFFFFFFFFFFFFF)
                for i in range(0, len(part), 64):
                    values, n = (part[c].to_numpy(float)[i : i + 64] for c in ("value", "n"))
                    weights = rng.poisson(n[:, None], (len(n), replicates)).astype(float)
                    acc += np.stack([values, np.ones(len(n))]) @ weights
        if group is not None:
            yield sums_of(group, acc)

    # Every task emits one row per (group, replicate), so one task per core keeps the partial sums few.
    cores = observations.sparkSession.sparkContext.defaultParallelism
    dealt = spread(counts, *keys, "stream", parts=cores).sortWithinPartitions(*keys, "stream", "value")
    partial = dealt.mapInPandas(draw, schema)
    return partial.groupBy(*keys, "replicate").agg(F.try_divide(F.sum("total"), F.sum("weight")).alias("mean"))


def bootstrap_test(
    observations: DataFrame, replicates: int = 10_000, alpha: float = 0.05, seed: int = 42
) -> DataFrame:
    """Bootstrap interval and p value of the mean difference for every pair of variants per metric.

    `p_value` tests a difference of zero; `p_value_ref` compares the replicates with the observed difference.
    """
    means = bootstrap_means(observations, replicates, seed)
    observed = variant_pairs(variant_stats(observations).select("variant", "metric", "mean"), ["metric"]).select(
        "variant_a", "variant_b", "metric", (F.col("mean_a") - F.col("mean_b")).alias("original_diff")
    )
    pairs = variant_pairs(means, ["metric", "replicate"]).select(
        "variant_a", "variant_b", "metric", (F.col("mean_a") - F.col("mean_b")).alias("diff")
    )
    joined = pairs.join(observed, ["variant_a", "variant_b", "metric"])
    share = lambda condition: F.avg(F.when(condition, 1.0).otherwise(0.0))
    two_sided = lambda at: F.least(2 * F.least(share(F.col("diff") <= at), share(F.col("diff") >= at)), F.lit(1.0))
    return joined.groupBy("variant_a", "variant_b", "metric", "original_diff").agg(
        F.percentile("diff", alpha / 2).alias("ci_low"),
        F.percentile("diff", 1 - alpha / 2).alias("ci_high"),
        two_sided(F.lit(0.0)).alias("p_value"),
        two_sided(F.col("original_diff")).alias("p_value_ref"),
        F.count(F.lit(1)).alias("replicates"),
    )


def experiment_summary(experiments: DataFrame, observations: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """Per experiment: state, days, variants, observations, comparisons and how many are significant."""
    seen = observations.groupBy("experiment_id").agg(
        F.countDistinct("variant").alias("variants"), F.count(F.lit(1)).alias("observations")
    )
    judged = results.groupBy("experiment_id").agg(
        F.count(F.lit(1)).alias("comparisons"), F.count(F.when(F.col("significant"), 1)).alias("significant")
    )
    end = F.coalesce("end_date", as_of)
    return (
        experiments.join(seen, "experiment_id", "left")
        .join(judged, "experiment_id", "left")
        .select(
            "experiment_id",
            F.when(F.col("end_date").isNull() | (F.col("end_date") > as_of), "active").otherwise("ended").alias("state"),
            F.datediff(end, F.col("start_date")).alias("duration_days"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("variants", "observations", "comparisons", "significant")],
        )
    )


def end_experiment(experiments: DataFrame, experiment: str, on: Column) -> DataFrame:
    ended = F.when(F.col("experiment_id") == experiment, on).otherwise(F.col("end_date"))
    return experiments.withColumn("end_date", ended)


def chart_data(observations: DataFrame) -> DataFrame:
    """Mean with one deviation to either side and with the 95 % normal interval, per variant and metric."""
    stats = variant_stats(observations).select("variant", "metric", "n", "mean", "std")
    reach = 1.96 * F.col("std") / F.sqrt("n")
    return stats.withColumns(
        {
            "bar_low": F.col("mean") - F.col("std"), "bar_high": F.col("mean") + F.col("std"),
            "ci_low": F.col("mean") - reach, "ci_high": F.col("mean") + reach,
        }
    )


def significance_matrix(tested: DataFrame, variants: list[str]) -> DataFrame:
    """p value of every pair as a square matrix per metric; 1 on the diagonal."""
    both = tested.select("metric", "variant_a", "variant_b", "p_value").unionByName(
        tested.select("metric", F.col("variant_b").alias("variant_a"), F.col("variant_a").alias("variant_b"), "p_value")
    )
    cell = lambda v: F.coalesce(
        F.max(F.when(F.col("variant_b") == v, F.col("p_value"))), F.lit(1.0)
    ).alias(f"vs_{v}")
    return both.groupBy("metric", F.col("variant_a").alias("variant")).agg(*[cell(v) for v in variants])
