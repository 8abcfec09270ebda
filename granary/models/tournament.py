"""Choosing a model by a tournament: every allowed candidate predicts the same held-out rows, one step ahead.

`selection.time_folds` cuts each series three times; a fold's held-out rows are the fifth after its cut, and together they are the
last three fifths. In each fold a candidate learns from the rows before the cut only: per-series models their weights,
regressors over all series their trees. The hybrid fits its ARIMA anew before each held-out row. Paths, folds and
scores are tables; a candidate runs on the series it is allowed for and on no other.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.scalars import lookup
from granary.models import paths, regression, selection, shared
from granary.operators.scale import packed
from granary.session import cut_lineage

SERIES = ["item_id", "location_id"]
SPLITS, TEST, LEAST = 3, 0.2, 0.4
MEMBERS = ("linear_regression", "holt_winters", "croston")
SHARED = ("random_forest", "gradient_boosting")
CANDIDATES = [*paths.PATHS, "ensemble", *SHARED, "hybrid_arima_xgb"]
FALLBACK = "linear_regression"

# The preference tag that each variability label stands for.
TAG_OF_LABEL = {
    "intermittent": "intermittent",
    "high_seasonal_high_variability": "high_variability",
    "non_seasonal_high_variability": "high_variability",
    "medium_seasonal_medium_variability": "seasonal",
    "non_seasonal_medium_variability": "high_variability",
    "high_seasonal_low_variability": "seasonal",
    "trending_low_variability": "trending",
    "stable_low_variability": "stable",
}


def allowed_models(panel: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """(keys, abc_class, pattern, tag, models): the candidates of each series in order of preference.

    Classes come from cumulative shares of the demand, so A, B and C occur whatever the number of series.
    """
    from granary.functions.scalars import service_tag
    from granary.operators.aggregates import service_features
    from granary.operators.windows import abc_classes

    value = panel.groupBy(*keys).agg(F.sum("demand_qty").alias("value")).withColumn("_key", F.to_json(F.struct(*keys)))
    classes = abc_classes(value, "_key", "value").select(*keys, "abc_class")
    tags = service_features(panel, keys).select(*keys, lookup(service_tag(), TAG_OF_LABEL, None).alias("tag"))
    models = selection.prioritised(selection.recommended_models(F.col("abc_class"), F.col("pattern")), F.col("tag"))
    joined = selection.demand_patterns(panel, keys).join(classes, keys).join(tags, keys)
    return joined.select(*keys, "abc_class", "pattern", "tag", models.alias("models"))


def _shared_path(folds: DataFrame, design: DataFrame, model: str, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """A regressor per fold, fitted to the fold's training rows of all series; the folds are fitted side by side."""
    rows = cut_lineage(folds.select(*keys, "date", "fold", "role").join(design, [*keys, "date"]))

    def one(fold: int) -> DataFrame | None:
        here = rows.where(F.col("fold") == fold)
        train = here.where("role = 'train'")
        if train.isEmpty():
            return None
        test = here.where("role = 'test'").join(wanted, keys, "left_semi")
        scored = regression.predict(regression.train(train, model, regression.FEATURES), test)
        return scored.select(*keys, "fold", "date", F.lit(model).alias("model"), "actual", "yhat")

    with ThreadPoolExecutor(SPLITS) as pool:
        found = [p for p in pool.map(one, range(1, SPLITS + 1)) if p is not None]
    return reduce(DataFrame.unionByName, found) if found else _none(folds, keys)


def _hybrid_path(folds: DataFrame, keys: list[str]) -> DataFrame:
    """ARIMA refitted before each held-out row, plus the residual model of the fold's training rows of all series."""
    per_fold = [*keys, "fold"]
    table = packed(cut_lineage(shared.residual_table(folds.select(*per_fold, "date", "demand_qty", "role"), 0, per_fold)))

    def one(fold: int) -> DataFrame:
        here = table.where(F.col("fold") == fold)
        test, fitted = here.where("kind = 'test'"), shared.residual_model(here, [])
        test = test.withColumn("yhat", F.lit(0.0)) if fitted is None else fitted.transform(test)
        value = F.col("base") + F.col("yhat") * F.col("unit")
        return test.select(*per_fold, "date", F.lit("hybrid_arima_xgb").alias("model"), "actual", value.alias("yhat"))

    with ThreadPoolExecutor(SPLITS) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, range(1, SPLITS + 1)))


def _none(folds: DataFrame, keys: list[str]) -> DataFrame:
    return folds.where("false").select(*keys, "fold", "date", F.lit("").alias("model"), F.lit(0.0).alias("actual"), F.lit(0.0).alias("yhat"))


def backtests(panel: DataFrame, allowed: DataFrame, keys: list[str] = SERIES, candidates: list[str] | None = None) -> DataFrame:
    """(keys, fold, date, model, actual, yhat) of every held-out row and allowed candidate.

    `allowed` has (keys, models). A candidate that fails on a series has no rows there.
    """
    candidates = CANDIDATES if candidates is None else candidates
    per_fold = [*keys, "fold"]
    folds = cut_lineage(selection.time_folds(panel.select(*keys, "date", "demand_qty"), keys, splits=SPLITS, test=TEST, min_train=LEAST))
    asked = cut_lineage(allowed.select(*keys, F.explode("models").alias("model")).distinct())
    seen = {r.model for r in asked.select("model").distinct().collect()}  # at most as many as there are names in the lists
    for_model = lambda m: asked.where(F.col("model") == m).select(*keys).distinct()

    def along_paths() -> DataFrame:
        parts = []
        for m in [c for c in candidates if c in paths.PATHS]:
            names = [m, "ensemble"] if m in MEMBERS and "ensemble" in candidates else [m]
            if not seen & set(names):
                continue
            mine = folds.join(asked.where(F.col("model").isin(names)).select(*keys).distinct(), keys, "left_semi")
            found = paths.PATHS[m](mine.drop("role"), per_fold, mine.where("role = 'train'"))
            held = mine.where("role = 'test'").select(*per_fold, "date")
            parts.append(found.join(held, [*per_fold, "date"], "left_semi"))
        each = cut_lineage(reduce(DataFrame.unionByName, parts)) if parts else _none(folds, keys)
        own = each.join(asked, [*keys, "model"], "left_semi").select(columns)
        if "ensemble" not in candidates or "ensemble" not in seen:
            return own
        return own.unionByName(paths.ensemble_path(each.join(for_model("ensemble"), keys, "left_semi"), per_fold, MEMBERS).select(columns))

    def of_shared(model: str) -> DataFrame:
        return _shared_path(folds, design, model, for_model(model), keys).select(columns)

    def of_hybrid() -> DataFrame:
        return _hybrid_path(folds.join(for_model("hybrid_arima_xgb"), keys, "left_semi"), keys).select(columns)

    columns = [*per_fold, "date", "model", "actual", "yhat"]
    wanted = [m for m in (*SHARED, "hybrid_arima_xgb") if m in candidates and m in seen]
    if set(wanted) & set(SHARED):
        design = cut_lineage(shared.sound_rows(regression.design(panel.select(*keys, "date", "demand_qty"), keys)))
    with ThreadPoolExecutor(1 + len(wanted)) as pool:  # many small jobs: the candidates run side by side
        todo = [pool.submit(along_paths)]
        todo += [pool.submit(of_hybrid) if m == "hybrid_arima_xgb" else pool.submit(of_shared, m) for m in wanted]
        return reduce(DataFrame.unionByName, [t.result() for t in todo])


def choose(tested: DataFrame, allowed: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """(keys, model, rmse): least rmse over the held-out rows, ties by the order of preference.

    Only candidates that predicted all rows that any candidate of the series predicted can win; a series that none of its
    candidates could predict falls back to the line.
    """
    error = F.col("actual") - F.col("yhat")
    sound = tested.where(F.col("yhat").isNotNull() & ~F.isnan("yhat") & (F.abs("yhat") < float("inf")))
    scored = sound.groupBy(*keys, "model").agg(F.sqrt(F.avg(error * error)).alias("rmse"), F.count(F.lit(1)).alias("rows"))
    whole = scored.withColumn("most", F.max("rows").over(Window.partitionBy(*keys))).where("rows = most")
    ranked = whole.join(allowed.select(*keys, "models"), keys).withColumn("place", F.expr("array_position(models, model)"))
    best = ranked.where("place > 0").groupBy(*keys).agg(F.min(F.struct("rmse", "place", "model")).alias("_b"))
    return allowed.select(*keys).join(best, keys, "left").select(*keys, F.coalesce("_b.model", F.lit(FALLBACK)).alias("model"), F.col("_b.rmse").alias("rmse"))


def select_models(panel: DataFrame, keys: list[str] = SERIES, candidates: list[str] | None = None) -> DataFrame:
    """The whole choice: classes, patterns and tags give the candidates, the tournament the winner."""
    panel = cut_lineage(panel.select(*keys, "date", "demand_qty"))
    allowed = cut_lineage(allowed_models(panel, keys))
    return choose(backtests(panel, allowed, keys, candidates), allowed, keys)
