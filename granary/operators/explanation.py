"""Model explanations as table jobs."""

from __future__ import annotations

import math
import random

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.scale import numbered, with_row
from granary.session import cut_lineage


def model_importance(model: PipelineModel, features: list[str], spark) -> DataFrame:
    """Coefficients of a linear model or split gains of a tree model, one row per feature."""
    fitted = model.stages[-1]
    scores = fitted.coefficients if hasattr(fitted, "coefficients") else fitted.featureImportances
    rows = [(f, float(s)) for f, s in zip(features, scores.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc(F.abs("importance")), "feature")


def permutation_importance(
    model: PipelineModel, rows: DataFrame, features: list[str], target: str, repeats: int = 30, seed: int = 42
) -> DataFrame:
    """Mean drop of the fit quality (r2) when one feature is shuffled.

    Rows are numbered once in the order of a seeded hash of their content. In every repeat, row i takes the
    feature of row (a * i + b) mod n, with a step a that has no divisor in common with n: a rearrangement of all rows by
    an equi-join on the number, the same for any partitioning. The features of a repeat share its rearrangement, one feature being
    replaced at a time. All of them go through the model in one distributed pass.
    """
    columns = [*features, target]
    numbers = rows.select(*[F.col(c).cast("double").alias(c) for c in columns])
    placed = cut_lineage(numbered(numbers, [F.xxhash64(*columns, F.lit(seed)), *map(F.col, columns)], "_i"))
    count = placed.count()
    draws, most = random.Random(seed), max(1, min(count, 2**62 // max(count, 1)))

    def step() -> int:
        while math.gcd(a := draws.randint(1, most), max(count, 1)) > 1:
            pass
        return a

    plans = [(r, step(), draws.randrange(max(count, 1))) for r in range(repeats)]
    plan = F.explode(F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(c) for c, v in zip("rab", p)]) for p in plans]))
    wide = placed.select("*", plan.alias("_p")).withColumn("_j", F.pmod(F.col("_p.a") * F.col("_i") + F.col("_p.b"), F.lit(count)) + 1)
    given = placed.select(F.col("_i").alias("_j"), F.array(*features).alias("_given"))
    versions = F.array(*[
        F.struct(*[(F.get("_given", F.lit(k)) if k == f else F.col(c)).alias(c) for k, c in enumerate(features)], F.lit(name).alias("feature"))
        for f, name in enumerate(features)
    ])  # made after the join: a row is shuffled once per repeat, whatever the number of features
    shuffled = wide.join(given, "_j").select(target, F.col("_p.r").cast("int").alias("repeat"), F.inline(versions)).select(*columns, "feature", "repeat")
    plain = placed.select(*columns, F.lit("").alias("feature"), F.lit(0).alias("repeat"))
    scored = model.transform(plain.unionByName(shuffled))
    gap = F.col(target) - F.col("yhat")
    quality = 1 - F.try_divide(F.sum(gap * gap), F.var_pop(target) * F.count(F.lit(1)))
    per_shuffle = scored.groupBy("feature", "repeat").agg(quality.alias("r2"))
    known = with_row(per_shuffle.where("feature != ''"), per_shuffle.where("feature = ''").select("r2"), "_plain")
    drop = F.col("_plain.r2") - F.col("r2")
    return (
        known.groupBy("feature")
        .agg(F.avg(drop).alias("importance"), F.stddev_pop(drop).alias("importance_std"))
        .orderBy(F.desc(F.abs("importance")), "feature")
    )


def explained_shares(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, importance): each feature's squared correlation with the target, as a share of all of them; one pass."""
    found = rows.agg(*[F.coalesce(F.corr(F.col(c).cast("double"), F.col(target).cast("double")), F.lit(0.0)).alias(c) for c in features])
    square = lambda c: F.col(c) * F.col(c)
    total = sum((square(c) for c in features), F.lit(0.0))
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.when(total > 0, square(c) / total).otherwise(0.0).alias("importance")) for c in features])
    return found.select(F.inline(cells))


def partial_dependence(
    model: PipelineModel, rows: DataFrame, features: list[str], feature: str, points: int = 100
) -> DataFrame:
    """Mean prediction with one feature set to each of `points` values between its extremes."""
    bounds = rows.agg(F.min(feature).cast("double").alias("low"), F.max(feature).cast("double").alias("high"))
    step = (F.col("_b.high") - F.col("_b.low")) / max(points - 1, 1)
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("_b.low") + i * step)
    others = [c for c in features if c != feature]
    gridded = with_row(rows.select(*others), bounds, "_b").select(*others, F.posexplode(grid).alias("point", feature))
    scored = model.transform(gridded)
    return scored.groupBy(F.lit(feature).alias("feature"), "point", F.col(feature).alias("value")).agg(
        F.avg("yhat").alias("mean_prediction")
    )


def linear_attributions(rows: DataFrame, coefficients: DataFrame, features: list[str]) -> DataFrame:
    """Contribution of each feature of a linear model per row: coefficient times distance from the mean.

    `coefficients` is one row with `intercept` and one column per feature. `base_value` plus the contributions is
    the prediction.
    """
    means = rows.agg(*[F.avg(c).alias(c) for c in features])
    known = with_row(with_row(rows, means, "_mean"), coefficients, "_coef")
    made = {f"{c}_contribution": F.col(f"_coef.{c}") * (F.col(c) - F.col(f"_mean.{c}")) for c in features}
    base = sum((F.col(f"_coef.{c}") * F.col(f"_mean.{c}") for c in features), F.col("_coef.intercept"))
    out = known.withColumns(made).withColumn("base_value", base)
    total = sum((F.col(c) for c in made), F.col("base_value"))
    return out.withColumn("prediction", total).drop("_mean", "_coef")


def attribution_summary(attributed: DataFrame, features: list[str]) -> DataFrame:
    """Mean and mean absolute contribution per feature, largest first, with the rank."""
    row = attributed.agg(
        *[F.avg(f"{c}_contribution").alias(f"m_{c}") for c in features],
        *[F.avg(F.abs(f"{c}_contribution")).alias(f"a_{c}") for c in features],
    )
    cells = F.array(
        *[
            F.struct(
                (-F.col(f"a_{c}")).alias("_order"), F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean_contribution"),
                F.col(f"a_{c}").alias("mean_abs_contribution"),
            )
            for c in features
        ]
    )
    ranked = row.select(F.posexplode(F.array_sort(cells)).alias("_i", "c"))
    return ranked.select("c.feature", "c.mean_contribution", "c.mean_abs_contribution", (F.col("_i") + 1).alias("rank"))


def prediction_summary(df: DataFrame, column: str = "yhat", keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or [])).agg(
        F.count(column).alias("n"), F.min(column).alias("min"), F.max(column).alias("max"),
        F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"),
    )


def business_rules(importances: DataFrame, top: int = 10) -> DataFrame:
    """One readable rule per important feature (feature, importance); the name decides type and priority."""
    name, weight = F.lower("feature"), F.col("importance")

    def by_type(demand: object, inventory: object, price: object, other: object) -> Column:
        as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
        return (
            F.when(name.contains("demand"), as_column(demand))
            .when(name.contains("inventory"), as_column(inventory))
            .when(name.contains("price") | name.contains("cost"), as_column(price))
            .otherwise(as_column(other))
        )

    return importances.orderBy(F.desc("importance"), "feature").limit(top).select(
        "feature",
        by_type("demand_forecast", "inventory_management", "pricing_impact", "general").alias("rule_type"),
        F.concat(F.lit("when "), F.col("feature"), F.lit(" grows by one unit")).alias("condition"),
        by_type(
            F.when(weight > 0.1, "high").otherwise("medium"),
            F.when(weight > 0.05, "medium").otherwise("low"),
            "medium",
            "low",
        ).alias("priority"),
        F.least(F.lit(0.99), 0.7 + weight * 10).alias("confidence"),
        weight.alias("importance"),
    )


def rule_counts(rules: DataFrame) -> DataFrame:
    """All rules and the number per priority, one row."""
    return rules.agg(
        F.count(F.lit(1)).alias("total_rules"),
        *[F.count(F.when(F.col("priority") == p, 1)).alias(f"{p}_rules") for p in ("high", "medium", "low")],
    )
