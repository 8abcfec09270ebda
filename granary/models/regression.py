"""Models shared by all series (pyspark.ml), their tuning, and feature scores."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.scalars import calendar_parts
from granary.operators.scale import exact_quantiles, with_row
from granary.operators.windows import lag_features

SERIES = ["item_id", "location_id"]
FEATURES = ["demand_qty_lag_1", "demand_qty_lag_2", "demand_qty_lag_3", "month", "quarter"]

ESTIMATORS = {
    "linear_regression": (LinearRegression, {}),
    "random_forest": (RandomForestRegressor, {"numTrees": 100, "seed": 42}),
    "gradient_boosting": (GBTRegressor, {"maxIter": 100, "seed": 42}),
}

# Search range per parameter.
SEARCH_SPACE = {
    "random_forest": {"numTrees": (50, 500), "maxDepth": (3, 15), "minInstancesPerNode": (1, 10)},
    "gradient_boosting": {"maxIter": (50, 500), "maxDepth": (3, 10), "stepSize": (0.01, 0.3)},
}


def design(panel: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Lag and calendar features with the target `demand_qty`."""
    parts = calendar_parts()
    return lag_features(panel, ["demand_qty"], (1, 2, 3), keys).withColumns({c: parts[c] for c in ("month", "quarter")})


def with_codes(rows: DataFrame, columns: list[str]) -> DataFrame:
    """`<column>_code` for key columns, so that a model of all series can tell items, places and categories apart.

    Numbers stand for themselves; text becomes a number by its checksum, the same in every run and without a pass over the rows.
    """
    types = dict(rows.dtypes)
    text = lambda c: F.pmod(F.crc32(F.col(c).cast("binary")), F.lit(10_007))
    return rows.withColumns({f"{c}_code": F.coalesce((text(c) if types[c] == "string" else F.col(c)).cast("double"), F.lit(-1.0)) for c in columns})


def train(rows: DataFrame, model: str, features: list[str], target: str = "demand_qty", **params) -> PipelineModel:
    kind, defaults = ESTIMATORS[model]
    estimator = kind(featuresCol="features", labelCol=target, predictionCol="yhat", **{**defaults, **params})
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), estimator]).fit(rows)


def predict(model: PipelineModel, rows: DataFrame, target: str = "demand_qty") -> DataFrame:
    return model.transform(rows).withColumnRenamed(target, "actual").drop("features")


def narrowed(low: float, high: float, best: float | None, share: float = 0.2) -> tuple[float, float]:
    """Search range around the previous best value, at most `share` of the full range to either side."""
    if best is None:
        return low, high
    reach = (high - low) * share
    return max(low, best - reach), min(high, best + reach)


def tune(
    rows: DataFrame, model: str, features: list[str], grid: dict[str, list], target: str = "demand_qty",
    validation: DataFrame | None = None, folds: int = 5, parallelism: int = 4,
) -> list[tuple[dict, float]]:
    """(parameters, rmse) of every grid point, best first; by the validation rows if given, else by k folds.

    Each fit is a distributed job; only the grid itself lives on the driver.
    """
    scorer = RegressionEvaluator(labelCol=target, predictionCol="yhat", metricName="rmse")
    if validation is not None:
        scored = []
        for values in product(*grid.values()):
            params = dict(zip(grid, values))
            fitted = train(rows, model, features, target, **params)
            scored.append((params, scorer.evaluate(fitted.transform(validation))))
        return sorted(scored, key=lambda s: s[1])
    kind, defaults = ESTIMATORS[model]
    estimator = kind(featuresCol="features", labelCol=target, predictionCol="yhat", **defaults)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(getattr(estimator, name), values)
    points = builder.build()
    search = CrossValidator(
        estimator=estimator, estimatorParamMaps=points, evaluator=scorer, numFolds=folds, parallelism=parallelism, seed=42
    )
    assembled = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    found = search.fit(assembled).avgMetrics
    named = [{p.name: v for p, v in point.items()} for point in points]
    return sorted(zip(named, found), key=lambda s: s[1])


@dataclass(frozen=True)
class Trial:
    params: dict[str, float]
    share: float
    rmse: float
    finalist: bool = False


def _density(x: np.ndarray, centres: np.ndarray, width: float) -> float:
    return float(np.exp(-0.5 * ((x - centres) / width) ** 2).prod(axis=1).mean()) + 1e-12


def propose(past: list[tuple[np.ndarray, float]], dims: int, rng: np.random.Generator, first: int = 4, tries: int = 64) -> np.ndarray:
    """The next point of the unit cube: spread out at first, then where good trials are dense and the others are not."""
    if len(past) < first:
        shift = np.modf(np.sqrt(np.array([2, 3, 5, 7, 11, 13][:dims])) * (len(past) + 1))[0]
        return (0.5 + shift) % 1
    ranked = [x for x, _ in sorted(past, key=lambda p: p[1])]
    cut = max(2, len(ranked) // 4)
    good, rest = np.array(ranked[:cut]), np.array(ranked[cut:])
    width = max(0.08, 0.3 / np.sqrt(len(ranked)))
    drawn = np.clip(good[rng.integers(len(good), size=tries)] + rng.normal(0, width, (tries, dims)), 0, 1)
    return max(drawn, key=lambda x: _density(x, good, width) / _density(x, rest, 2 * width))


def search(
    rows: DataFrame, validation: DataFrame, model: str, features: list[str], target: str = "demand_qty", trials: int = 10,
    best: dict[str, float] | None = None, space: dict[str, tuple[float, float]] | None = None, share: float = 0.1, finalists: int = 2, seed: int = 42,
) -> list[Trial]:
    """Sequential search: every trial is proposed from the ones before it, over the full ranges or those around `best`.

    Trials run with a `share` of the trees (numTrees, maxIter), where the model has such a parameter; the best `finalists` run
    again in full. One entry per run, in order, for the history; `best_trial` picks the winner. Fits are distributed jobs, only the trials' parameters
    live on the driver.
    """
    ranges = {n: narrowed(*r, None if best is None else best.get(n)) for n, r in (space or SEARCH_SPACE[model]).items()}
    whole = {n for n, r in (space or SEARCH_SPACE[model]).items() if all(isinstance(v, int) for v in r)}
    scorer = RegressionEvaluator(labelCol=target, predictionCol="yhat", metricName="rmse")
    rng, past, out = np.random.default_rng(seed), [], []

    def run(params: dict[str, float], part: float) -> float:
        used = {n: max(int(v * part), 5) if n in ("numTrees", "maxIter") and part < 1 else v for n, v in params.items()}
        return scorer.evaluate(train(rows, model, features, target, **used).transform(validation))

    sized = any(n in ranges for n in ("numTrees", "maxIter"))
    for _ in range(trials):
        x = propose(past, len(ranges), rng)
        point = {n: low + float(v) * (high - low) for v, (n, (low, high)) in zip(x, ranges.items(), strict=True)}
        params = {n: int(round(v)) if n in whole else v for n, v in point.items()}
        out.append(Trial(params, share if sized else 1.0, run(params, share if sized else 1.0)))
        past.append((x, out[-1].rmse))
    if not sized:
        return out
    for t in sorted(out, key=lambda t: t.rmse)[:finalists]:
        out.append(Trial(t.params, 1.0, run(t.params, 1.0), True))
    return out


def best_trial(history: list[Trial]) -> Trial:
    """The best full run."""
    return min((t for t in history if t.share == 1.0), key=lambda t: t.rmse)


def lag_regression(df: DataFrame, keys: list[str] = SERIES, value: str = "demand_qty", date: str = "date") -> DataFrame:
    """Least squares of a value on its predecessor per series, with fit quality and the next value."""
    line = Window.partitionBy(*keys).orderBy(date)
    pairs = df.select(*keys, date, F.col(value).alias("y"), F.lag(value).over(line).alias("x"))
    y, x = F.col("y"), F.col("x")
    slope, intercept = F.regr_slope(y, x), F.regr_intercept(y, x)
    return (
        pairs.groupBy(*keys)
        .agg(
            slope.alias("slope"), intercept.alias("intercept"), F.regr_r2(y, x).alias("r2"),
            F.max_by("y", date).alias("last"),
        )
        .withColumn("next_value", F.col("intercept") + F.col("slope") * F.col("last"))
        .drop("last")
    )


def f_scores(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """F statistic of the simple regression of the target on each feature, one pass over the rows."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in features]
    )
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in features]))
    rows = row.select("n", cells.alias("c")).select("n", "c.feature", "c.r")
    r2 = F.col("r") * F.col("r")
    return rows.select("feature", F.when(r2 < 1, r2 / (1 - r2) * (F.col("n") - 2)).alias("score"))


def mutual_information(df: DataFrame, features: list[str], target: str, bins: int = 10) -> DataFrame:
    """Mutual information of each feature with the target over equal-frequency bins, in nats.

    Bin limits are exact quantiles; after binning, one row per (feature, bin, bin) is left.
    """
    columns = [*features, target]
    cuts = {f"b{i}": i / bins for i in range(1, bins)}
    limited = with_row(df.select(*columns), exact_quantiles(df, [], columns, cuts))
    place = lambda c: sum((F.when(F.col(c) > F.col(f"_stats.{c}_{b}"), 1).otherwise(0) for b in cuts), F.lit(0))
    binned = limited.select(*[place(c).alias(f"_{c}") for c in columns])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_{c}").alias("x")) for c in features]))
    joint = (
        binned.select(F.col(f"_{target}").alias("y"), cells.alias("c"))
        .groupBy("c.feature", "c.x", "y")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    of = lambda *by: F.sum("n").over(Window.partitionBy("feature", *by))
    shares = joint.select("feature", "n", of().alias("all"), of("x").alias("nx"), of("y").alias("ny"))
    term = F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("nx") * F.col("ny")))
    return shares.groupBy("feature").agg(F.sum(term).alias("score"))
