"""Table readers: CSV, JDBC, JSON landings, paged REST endpoints, and priority-ordered fallback between them."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from granary import schemas

Reader = Callable[[str], DataFrame]


def csv_reader(spark: SparkSession, folder: str, files: dict[str, str] | None = None) -> Reader:
    """Tables from CSV files (or folders of them) with a header and the fixed schema; JSON cells are quoted."""
    known = files if files is not None else {t: f"{t}.csv" for t in schemas.tables()}

    def read(table: str) -> DataFrame:
        if table not in known:
            raise KeyError(f"no CSV file for table {table!r}")
        options = {"header": True, "quote": '"', "escape": '"', "mode": "FAILFAST"}  # a malformed row is an error, not nulls
        return spark.read.schema(schemas.schema(table)).options(**options).csv(f"{folder}/{known[table]}")

    return read


def write_csv(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(f"{folder}/{name}.csv")


def jdbc_options(
    url: str, query: str, partition_column: str | None = None, lower: int | str | None = None,
    upper: int | str | None = None, partitions: int = 1, fetch_size: int = 10_000, **properties: str,
) -> dict[str, str]:
    """Options of a JDBC scan; with a partition column the scan is split into ranges read in parallel."""
    options = {"url": url, "fetchsize": str(fetch_size), **properties}
    if partition_column is None:
        return {**options, "query": query}
    if lower is None or upper is None:
        raise ValueError("a partition column needs its lower and upper bound")
    return {
        **options, "dbtable": f"({query}) AS source", "partitionColumn": partition_column,
        "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions),
    }


def jdbc_reader(spark: SparkSession, url: str, queries: dict[str, str], **options) -> Reader:
    """All domain tables from a database, `SELECT * FROM <table>` unless a query is given."""

    def read(table: str) -> DataFrame:
        query = queries.get(table, f"SELECT * FROM {table}")
        return spark.read.format("jdbc").options(**jdbc_options(url, query, **options)).load()

    return read


def json_reader(spark: SparkSession, folder: str, endpoints: dict[str, str] | None = None) -> Reader:
    """Tables from landed JSON responses, one folder per endpoint, with the fixed schema."""

    def read(table: str) -> DataFrame:
        return spark.read.schema(schemas.schema(table)).option("mode", "FAILFAST").json(f"{folder}/{(endpoints or {}).get(table, table)}")

    return read


class _Stride(InputPartition):
    """Every `step`-th page from `first` on, up to `last` if that is known."""

    def __init__(self, first: int, step: int, last: int | None):
        self.first, self.step, self.last = first, step, last


class PagedEndpointReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.names = schema.names
        self.url, self.token = options["url"], options.get("token")
        number = lambda name: int(options[name]) if options.get(name) else None
        self.pages, self.size, self.readers = number("pages"), number("page_size"), number("readers") or 4
        if "{page}" not in self.url:
            self.pages = 1

    def partitions(self) -> list[InputPartition]:
        strides = self.readers if self.pages is None else min(self.readers, max(self.pages, 1))
        return [_Stride(i, strides, self.pages) for i in range(1, strides + 1)]

    def _fetch(self, page: int) -> list[dict] | None:
        """The records of a page; None where there is no such page."""
        request = urllib.request.Request(self.url.replace("{page}", str(page)))
        if self.token:
            request.add_header("Authorization", f"Bearer {self.token}")
        try:
            with urllib.request.urlopen(request, timeout=60) as response:
                return json.load(response)
        except urllib.error.HTTPError as failed:
            if failed.code != 404:
                raise
        except urllib.error.URLError as failed:
            if not isinstance(failed.reason, FileNotFoundError):
                raise
        return None

    def read(self, partition: _Stride) -> Iterator[tuple]:
        page = partition.first
        while partition.last is None or page <= partition.last:
            records = self._fetch(page)
            if records is None and partition.last is not None:
                raise ValueError(f"page {page} of {partition.last} is missing")
            for record in records or ():
                yield tuple(record.get(n) for n in self.names)
            if partition.last is None and (not records or (self.size is not None and len(records) < self.size)):
                return  # past the end: the pages after a short one are empty
            if page == partition.last and self.size is not None and len(records) >= self.size:
                raise ValueError(f"page {page} is the last one listed but full, so there are more")
            page += partition.step


class PagedEndpoint(DataSource):
    """A JSON endpoint whose URL contains `{page}`, read by strides of pages, each in its own task.

    Options: url; pages (the number of them; without it, strides go on until a page is short, empty or missing); page_size
    (records of a full page; without it only an empty or missing page ends a stride); readers (number of strides, 4); token
    (sent as a bearer header). With pages and page_size, a full last page raises an error instead of leaving rows
    out. The schema must be given.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_endpoint"

    def schema(self) -> str:
        raise ValueError("give the schema of a paged endpoint")

    def reader(self, schema: T.StructType) -> PagedEndpointReader:
        return PagedEndpointReader(schema, self.options)


def endpoint_reader(
    spark: SparkSession, base_url: str, endpoints: dict[str, str], pages: int | None = None, token: str | None = None, page_size: int | None = None, readers: int = 4
) -> Reader:
    spark.dataSource.register(PagedEndpoint)

    def read(table: str) -> DataFrame:
        options = {"url": f"{base_url}/{endpoints.get(table, table)}", "readers": str(readers)}
        given = {"pages": pages, "page_size": page_size, "token": token}
        options |= {name: str(value) for name, value in given.items() if value is not None}
        return spark.read.format("paged_endpoint").schema(schemas.schema(table)).options(**options).load()

    return read


_KINDS: dict[str, Callable[..., Reader]] = {
    "csv": csv_reader, "database": jdbc_reader, "json": json_reader, "api": endpoint_reader,
}


def register_kind(kind: str, build: Callable[..., Reader]) -> None:
    """Make a further kind of source available to `open_source`."""
    _KINDS[kind] = build


def open_source(spark: SparkSession, kind: str, **config) -> Reader:
    if kind not in _KINDS:
        raise ValueError(f"unknown source kind {kind!r}; known: {', '.join(sorted(_KINDS))}")
    return _KINDS[kind](spark, **config)


class SourceRegistry:
    """Readers by priority. A table comes from the first source that can open it; a lower number goes first."""

    def __init__(self) -> None:
        self._sources: list[tuple[int, str, Reader]] = []

    def register(self, name: str, reader: Reader, priority: int = 0) -> None:
        self._sources = sorted([*self._sources, (priority, name, reader)], key=lambda s: (s[0], s[1]))

    def load(self, table: str) -> DataFrame:
        """The table with the name of the source it came from in `source_used`."""
        problems = []
        for _, name, reader in self._sources:
            try:
                df = reader(table)
                df.schema  # resolves paths and columns, reads no rows
                return df.withColumn("source_used", F.lit(name))
            except Exception as e:
                problems.append(f"{name}: {type(e).__name__}: {str(e).splitlines()[0]}")
        raise LookupError(f"no source has table {table!r}: " + "; ".join(problems))


def external_feed(feed: DataFrame, key: str | None, value: object, start: str, end: str, date: str = "date") -> DataFrame:
    """Rows of one key between two days, both included; both filters reach the scan."""
    rows = feed.where(F.col(date).between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    return rows if key is None else rows.where(F.col(key) == value)
