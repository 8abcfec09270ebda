"""Ordered computations over groups of any size.

A window without a bounded partition sends a whole group to one task. The operators here are used wherever a
group may hold an arbitrary share of the rows: they range-partition on (group, order), compute inside each
slice, and combine the slices through one small row per slice.

Windows elsewhere in this library are partitioned by a series key over panels that hold one row per calendar
day (or month), so such a partition is bounded by the length of the calendar and not by the data volume.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.session import cut_lineage

_SLICE = "_slice"


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    totals: dict[str, Column],
) -> DataFrame:
    """Add, for each name in `totals`, the inclusive running sum in `order` and `<name>_all`, the group sum.

    `order` must be a total order inside a group. Work is spread over range slices, whatever the group sizes.
    """
    values = {name: f"_v_{name}" for name in totals}
    prepared = df.select("*", *[expr.alias(values[name]) for name, expr in totals.items()])
    sliced = cut_lineage(
        prepared.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn(_SLICE, F.spark_partition_id())
    )

    # One row per (group, slice); a group has at most as many of them as there are partitions.
    before = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    per_slice = sliced.groupBy(*keys, _SLICE).agg(*[F.sum(v).alias(f"_s_{n}") for n, v in values.items()])
    offsets = per_slice.select(
        *keys,
        _SLICE,
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values],
        *[F.sum(f"_s_{n}").over(whole).alias(f"{n}_all") for n in values],
    )

    inside = Window.partitionBy(*keys, _SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.select("*", *[F.sum(v).over(inside).alias(f"_r_{n}") for n, v in values.items()])
    joined = local.join(offsets, _null_safe(local, offsets, [*keys, _SLICE]))
    return joined.select(
        *[local[c] for c in df.columns],
        *[(local[f"_r_{n}"] + offsets[f"_o_{n}"]).alias(n) for n in values],
        *[offsets[f"{n}_all"] for n in values],
    )


def numbered(df: DataFrame, order: list[Column], name: str, keys: list[str] | None = None) -> DataFrame:
    """Add consecutive numbers from 1 in `order`, inside `keys` when given."""
    return running_totals(df, keys or [], order, {name: F.lit(1)}).drop(f"{name}_all")


def spread(df: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """Hash-partition by `keys` over all cores, or into `parts`.

    For steps whose work per row is large against the row's size (series models, bootstrap draws): adaptive execution
    would otherwise merge their few bytes into a handful of tasks. A grouping or window by the same keys that
    follows reuses this partitioning.
    """
    spark = df.sparkSession
    parts = parts or max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    )
    return df.repartition(parts, *[F.col(k) for k in keys])



def packed(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """A stored table in as many partitions as its rows need, for iterative fits, whose every step is a task per partition."""
    return df.coalesce(max(1, -(-df.count() // rows)))


def value_counts(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Long form (keys, column, value, n) with one row per distinct non-null value."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    )
    return (
        df.select(*keys, cells.alias("_cell"))
        .select(*keys, "_cell.column", "_cell.value")
        .where(F.col("value").isNotNull())
        .groupBy(*keys, "column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


ACCURACY, MOST = 10_000, 200_000


def _bracketed(df: DataFrame, columns: list[str], probabilities: dict[str, float]) -> DataFrame | None:
    """Quantiles of a table in two passes without a shuffle of its values; None if a column holds NaN.

    A sketch of known error gives each quantile a bracket of values that must hold it. The next pass counts the values below
    the bracket and the equal ones inside, map-side, and only these counts are sorted. A bracket that may hold more than `MOST` different
    values is narrowed by a sketch of what is inside it first; up to `MOST` rows the bracket is the whole column.
    """
    number = {c: F.col(c).cast("double") for c in columns}
    sizes = [F.count(number[c]).alias(f"n_{c}") for c in columns] + [F.coalesce(F.count_if(F.isnan(number[c])), F.lit(0)).alias(f"nan_{c}") for c in columns]
    places = {(c, name): (float("-inf"), float("inf")) for c in columns for name in probabilities}

    def sketched(c: str, inside: tuple[float, float], shares: list[float]) -> Column:
        held = F.when(number[c].between(F.lit(inside[0]), F.lit(inside[1])), number[c])
        return F.percentile_approx(held, [min(max(q, 0.0), 1.0) for q in shares], ACCURACY)

    margin = 3 / ACCURACY
    around = lambda p: [p - margin, p + margin]
    row = df.agg(*sizes, *[sketched(c, places[c, k], around(p)).alias(f"s_{c}_{k}") for c in columns for k, p in probabilities.items()]).first()
    if any(row[f"nan_{c}"] for c in columns):
        return None
    n = {c: row[f"n_{c}"] for c in columns}
    wide = {}
    for (c, k) in places:
        if n[c] > MOST:
            places[c, k] = tuple(row[f"s_{c}_{k}"])
            wide[c, k] = 4 * margin * n[c]  # values strictly inside, at most
    while any(w > MOST for w in wide.values()):
        todo = [key for key, w in wide.items() if w > MOST]
        below = [F.count_if(number[c] < places[c, k][0]).alias(f"b_{c}_{k}") for c, k in todo]
        held = [F.count_if(number[c].between(*map(F.lit, places[c, k]))).alias(f"h_{c}_{k}") for c, k in todo]
        counted = df.agg(*below, *held).first()
        few = [(c, k) for c, k in todo if counted[f"h_{c}_{k}"] <= MOST]
        wide |= dict.fromkeys(few, 0)
        todo = [key for key in todo if key not in few]
        if not todo:
            break
        shares = {(c, k): (probabilities[k] * (n[c] - 1) - counted[f"b_{c}_{k}"]) / counted[f"h_{c}_{k}"] for c, k in todo}
        row = df.agg(*[sketched(c, places[c, k], around(shares[c, k])).alias(f"s_{c}_{k}") for c, k in todo]).first()
        for c, k in todo:
            inside = tuple(row[f"s_{c}_{k}"])
            done = inside == places[c, k]  # one value fills it
            places[c, k], wide[c, k] = inside, 0 if done else 4 * margin * counted[f"h_{c}_{k}"]

    def cell(c: str, k: str) -> Column:
        low, high = map(F.lit, places[c, k])
        value = F.when(number[c] < low, None).otherwise(number[c])
        return F.when(number[c] <= high, F.struct(F.lit(f"{c}_{k}").alias("quantile"), value.alias("value")))

    cells = F.filter(F.array(*[cell(c, k) for c, k in places]), lambda x: x.isNotNull())
    counts = df.select(F.explode(cells).alias("_c")).groupBy("_c.quantile", "_c.value").agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(Window.partitionBy("quantile").orderBy(F.col("value").asc_nulls_first()))  # at most the values of a bracket
    ranked = counts.withColumn("upto", upto)

    def at(name: str, rank: int) -> Column:
        here = (F.col("quantile") == name) & F.col("value").isNotNull() & (F.col("upto") - F.col("m") <= rank) & (F.col("upto") > rank)
        return F.max(F.when(here, F.col("value")))

    measures, out = [], []
    for c, k in places:
        place = probabilities[k] * (n[c] - 1)
        low, high, name = math.floor(place), math.ceil(place), f"{c}_{k}"
        measures += [at(name, low).alias(f"lo_{name}"), at(name, high).alias(f"hi_{name}")]
        out.append((F.col(f"lo_{name}") + (F.col(f"hi_{name}") - F.col(f"lo_{name}")) * F.lit(float(place - low))).alias(name))
    return ranked.agg(*measures).select(*out)


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    columns: list[str],
    probabilities: dict[str, float],
) -> DataFrame:
    """Exact linear-interpolation quantiles as columns `<column>_<name>`, one row per group.

    Of a whole table, only the values around each quantile are sorted (`_bracketed`). Of groups, equal values collapse
    before the shuffle and ranks come from `running_totals`. Either way no task holds a group.
    """
    if not keys:
        found = _bracketed(df, columns, probabilities)
        if found is not None:
            return found
    ranked = running_totals(value_counts(df, keys, columns), [*keys, "column"], [F.col("value")], {"upto": F.col("n")})
    n = F.col("upto_all")
    first = F.col("upto") - F.col("n")

    def at(column: str, rank: Column) -> Column:
        hit = (F.col("column") == column) & (first <= rank) & (rank < F.col("upto"))
        return F.max(F.when(hit, F.col("value")))

    measures = []
    for column in columns:
        for name, p in probabilities.items():
            position = F.lit(float(p)) * (n - 1)
            measures += [
                at(column, F.floor(position)).alias(f"_lo_{column}_{name}"),
                at(column, F.ceil(position)).alias(f"_hi_{column}_{name}"),
                F.max(F.when(F.col("column") == column, position - F.floor(position))).alias(f"_f_{column}_{name}"),
            ]
    picked = ranked.groupBy(*keys).agg(*measures) if keys else ranked.agg(*measures)
    return picked.select(
        *keys,
        *[
            (
                F.col(f"_lo_{c}_{name}")
                + (F.col(f"_hi_{c}_{name}") - F.col(f"_lo_{c}_{name}")) * F.col(f"_f_{c}_{name}")
            ).alias(f"{c}_{name}")
            for c in columns
            for name in probabilities
        ],
    )


def one_row(df: DataFrame, *columns: str) -> Column:
    """The only row of an aggregate as a scalar subquery, a struct of `columns` (all when none are named)."""
    return df.select(F.struct(*(columns or df.columns)).alias("row")).scalar()


def with_row(df: DataFrame, stats: DataFrame, name: str = "_stats") -> DataFrame:
    """`df` with the only row of `stats` as a struct column: one subquery, however many fields are read later."""
    return df.withColumn(name, one_row(stats))
