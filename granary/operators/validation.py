"""Table checks. Every check yields rows (table, rule, column, violations, is_valid)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary import schemas

Check = tuple[str, str, Column]


def _count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("bigint")


def _report(df: DataFrame, table: str, checks: list[Check]) -> DataFrame:
    """All checks in one pass over `df`, one output row per check."""
    row = df.agg(*[measure.alias(f"c{i}") for i, (_, _, measure) in enumerate(checks)])
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(rule).alias("rule"), F.lit(column).alias("column"), F.col(f"c{i}").alias("violations"))
                for i, (rule, column, _) in enumerate(checks)
            ]
        )
    )
    return row.select(cells.alias("c")).select(
        F.lit(table).alias("table"),
        "c.rule",
        "c.column",
        "c.violations",
        (F.col("c.violations") == 0).alias("is_valid"),
    )


def _presence(df: DataFrame, required: list[str]) -> list[Check]:
    return [("present", c, F.lit(0 if c in df.columns else 1).cast("bigint")) for c in required]


def _nulls(df: DataFrame, columns: list[str]) -> list[Check]:
    return [("not_null", c, _count_if(F.col(c).isNull())) for c in columns if c in df.columns]


def _whole(df: DataFrame, table: str) -> list[Check]:
    columns = [c for c in schemas.WHOLE_NUMBERS.get(table, []) if c in df.columns]
    return [("whole_number", c, _count_if(F.col(c).cast("double") % 1 != 0)) for c in columns]


def check_required(df: DataFrame, table: str) -> DataFrame:
    """Required columns are present and hold no null."""
    required = schemas.REQUIRED[table]
    return _report(df, table, _presence(df, required) + _nulls(df, required))


def check_whole_numbers(df: DataFrame, table: str) -> DataFrame:
    """Quantity columns hold whole numbers, whatever their type; a table without such columns has one valid row."""
    return _report(df, table, _whole(df, table) or [("whole_number", "*", F.lit(0).cast("bigint"))])


def check_all(tables: dict[str, DataFrame]) -> DataFrame:
    """Failing checks over all tables, each table read once."""
    required = schemas.REQUIRED
    reports = [
        _report(df, name, _presence(df, required[name]) + _nulls(df, required[name]) + _whole(df, name))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, reports).where(~F.col("is_valid"))


# Required columns and the measure that must not be negative, per feed.
FEED_RULES = {
    "sales": (["date", "sku", "sales"], "sales"),
    "inventory": (["date", "sku", "inventory_level"], "inventory_level"),
    "demand": (["date", "sku", "demand"], "demand"),
}


def check_feed(df: DataFrame, feed: str) -> DataFrame:
    """Presence, nulls, negative measure and emptiness of a dated feed."""
    required, measure = FEED_RULES[feed]
    checks = _presence(df, required) + _nulls(df, required)
    if measure in df.columns:
        checks.append(("not_negative", measure, _count_if(F.col(measure) < 0)))
    checks.append(("not_empty", "*", F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("bigint")))
    return _report(df, feed, checks)


def check_products(df: DataFrame) -> DataFrame:
    """Presence, nulls, repeated sku, and positive cost and price."""
    required = ["sku", "cost", "price"]
    checks = _presence(df, required) + _nulls(df, required)
    checks += [("positive", c, _count_if(F.col(c) <= 0)) for c in ("cost", "price") if c in df.columns]
    checks.append(("not_empty", "*", F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("bigint")))
    report = _report(df, "product", checks)
    if "sku" in df.columns:
        per_sku = df.groupBy("sku").agg((F.count(F.lit(1)) - 1).alias("extra"))
        unique = [("unique", "sku", F.coalesce(F.sum("extra"), F.lit(0)).cast("bigint"))]
        report = report.unionByName(_report(per_sku, "product", unique))
    return report


def quality_metrics(df: DataFrame, table: str) -> DataFrame:
    """Rows, columns, missing cells, repeated rows, and the missing share of each column, one row per column."""
    columns = df.columns
    per_row = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    stats = per_row.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"),
        *[F.coalesce(F.sum(F.when(F.col(c).isNull(), F.col("_copies"))), F.lit(0)).alias(f"m_{c}") for c in columns],
    )
    missing = reduce(lambda a, b: a + b, [F.col(f"m_{c}") for c in columns])
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("missing")) for c in columns])
    )
    return stats.select(
        F.lit(table).alias("table_name"),
        "total_rows",
        F.lit(len(columns)).cast("bigint").alias("total_columns"),
        missing.alias("missing_values"),
        "duplicate_rows",
        cells.alias("c"),
    ).select(
        "table_name",
        "total_rows",
        "total_columns",
        "missing_values",
        "duplicate_rows",
        "c.column",
        F.try_divide("c.missing", "total_rows").alias("missing_ratio"),
    )
