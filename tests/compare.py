"""Run a registered query and its DuckDB twin, and describe any difference."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
}


def open_tables(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def cell(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return str(v)


def difference(df, con, sql: str) -> str | None:
    names = sorted(df.columns)
    spark_rows = sorted(tuple(cell(r[c]) for c in names) for r in df.collect())
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} vs {sorted(rel.columns)}"
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    bad = [(c, t, duck_types[c]) for c, t in df.dtypes if TYPES.get(t, t) != duck_types[c]]
    order = [rel.columns.index(c) for c in names]
    duck_rows = sorted(tuple(cell(r[i]) for i in order) for r in rel.fetchall())
    if len(spark_rows) != len(duck_rows):
        return f"rows {len(spark_rows)} vs {len(duck_rows)}; types {bad}; {spark_rows[:2]} vs {duck_rows[:2]}"
    wrong = [(a, b) for a, b in zip(spark_rows, duck_rows) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(spark_rows)} rows differ, columns {names}; first {wrong[:3]}; types {bad}"
    if bad:
        return f"types {bad}"
    if not spark_rows:
        return "empty result"
    return None
