"""Tables kept in a folder: warehouse tables, keyed feature store, histories, model registry, lineage."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.session import cut_lineage, entries


GENERATION, BUCKET = "generation", "bucket"


def _found(spark: SparkSession, folder: str) -> DataFrame | None:
    """The Parquet table in `folder`, None where there is none yet; any other failure is raised."""
    try:
        return spark.read.option("mergeSchema", True).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND" or not entries(spark, folder):
            return None
        raise


LINEAGE_SCHEMA = "table string, operation string, source string, at timestamp, rows bigint, detail string"


class Warehouse:
    """Named tables with append and replace, and a lineage row for every operation: its `rows` are those the operation wrote."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _folder(self, table: str) -> str:
        return f"{self.folder}/tables/{table}"

    def _generations(self, table: str) -> list[int]:
        """One folder per replacement, also those that are not complete."""
        return sorted(int(n.split("=")[1]) for n in entries(self.spark, self._folder(table)) if n.startswith(f"{GENERATION}="))

    def _newest(self, table: str) -> int:
        """The last complete replacement, 0 before the first."""
        whole = [n for n in self._generations(table) if "_SUCCESS" in entries(self.spark, f"{self._folder(table)}/{GENERATION}={n}")]
        return max(whole, default=0)

    def record(self, table: str, operation: str, source: str, rows: int | None = None, detail: str | None = None) -> None:
        values = self.spark.createDataFrame(
            [(table, operation, source, rows, detail)], "table string, operation string, source string, rows bigint, detail string"
        ).withColumn("at", F.current_timestamp())
        values.write.mode("append").parquet(f"{self.folder}/lineage")

    def load(self, table: str) -> DataFrame:
        number = self._newest(table)
        if not number:
            raise KeyError(f"no table {table!r} in the warehouse")
        return self.spark.read.option("mergeSchema", True).parquet(f"{self._folder(table)}/{GENERATION}={number}")

    def update(self, table: str, df: DataFrame, how: str = "append", source: str = "user") -> None:
        """Append to the table by column name, or replace it.

        An append adds Parquet files to the current generation, a replacement writes a generation of its own, which
        readers see when it is complete. Of two replacements at the same time the second fails.
        """
        if how not in ("append", "replace"):
            raise ValueError(f"unknown update {how!r}; use append or replace")
        rows = cut_lineage(df)  # counted and written once, also when it reads this very table
        number = self._newest(table)
        if how == "replace" or number == 0:
            number = max(self._generations(table), default=0) + 1
            rows.write.mode("errorifexists").parquet(f"{self._folder(table)}/{GENERATION}={number}")
        else:
            rows.write.mode("append").parquet(f"{self._folder(table)}/{GENERATION}={number}")
        self.record(table, f"update_{how}", source, rows.count(), f"generation {number}")

    def refresh(self, table: str, reader, source: str) -> DataFrame:
        self.update(table, reader(table), "replace", source)
        return self.load(table)

    def lineage(self, table: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        """Operations grouped per table, oldest first, filtered by table and time."""
        rows = self.spark.read.schema(LINEAGE_SCHEMA).parquet(f"{self.folder}/lineage")
        return lineage_log(rows, table, start, end)


def lineage_log(rows: DataFrame, table: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Lineage rows as one row per table with its ordered operations."""
    if table is not None:
        rows = rows.where(F.col("table") == table)
    if start is not None:
        rows = rows.where(F.col("at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.where(F.col("at") <= F.lit(end).cast("timestamp"))
    entry = F.struct("at", "operation", "source", "rows", "detail")
    return rows.groupBy("table").agg(F.sort_array(F.collect_list(entry)).alias("operations"))


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int")


class FeatureStore:
    """Feature vectors and model tags per key, in folders by a hash of the key.

    An update rewrites the folders of the keys it brings and no other.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: tuple[str, ...] = ("item_id", "location_id"), buckets: int = 64):
        self.spark, self.folder, self.keys, self.buckets = spark, folder, list(keys), buckets

    def update(self, features: DataFrame) -> None:
        """Rows of `features` replace rows of the same key; a column one side lacks is null there."""
        fresh = cut_lineage(features.withColumn(BUCKET, _bucket(self.keys, self.buckets)))
        stored = _found(self.spark, self.folder)
        if stored is not None:
            touched = [r[BUCKET] for r in fresh.select(BUCKET).distinct().collect()]  # at most as many as there are buckets
            kept = stored.where(F.col(BUCKET).isin(touched)).join(fresh.select(*self.keys), self.keys, "left_anti")
            fresh = cut_lineage(kept.unionByName(fresh, allowMissingColumns=True))
        writer = fresh.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(BUCKET).parquet(self.folder)

    def all(self) -> DataFrame | None:
        found = _found(self.spark, self.folder)
        return None if found is None else found.drop(BUCKET)

    def get(self, **key: object) -> DataFrame | None:
        """The rows with these values; a whole key reads its folder only."""
        rows = _found(self.spark, self.folder)
        if rows is None:
            return None
        if set(self.keys) <= set(key):
            types = dict(rows.dtypes)
            own = self.spark.range(1).select(*[F.lit(key[k]).cast(types[k]).alias(k) for k in self.keys]).select(_bucket(self.keys, self.buckets)).first()[0]
            rows = rows.where(F.col(BUCKET) == own)
        for name, value in key.items():
            rows = rows.where(F.col(name) == value)
        return rows.drop(BUCKET)

    def tags(self, wanted: DataFrame, default: str = "default") -> DataFrame:
        """The model tag of each wanted key, `default` for unknown keys."""
        rows = self.all()
        if rows is None:
            return wanted.select(*self.keys).withColumn("model_tag", F.lit(default))
        joined = wanted.select(*self.keys).join(rows.select(*self.keys, "model_tag"), self.keys, "left")
        return joined.withColumn("model_tag", F.coalesce("model_tag", F.lit(default)))


class History:
    """Append-only rows per item with the time they were recorded, partitioned by item bucket."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def append(self, df: DataFrame, recorded_at: str = "recorded_at") -> None:
        rows = df if recorded_at in df.columns else df.withColumn(recorded_at, F.current_timestamp())
        bucket = F.pmod(F.xxhash64(F.col("item_id").cast("bigint")), F.lit(self.buckets)).cast("int")
        rows.withColumn("bucket", bucket).write.mode("append").partitionBy("bucket").parquet(self.folder)

    def read(self, item_id: int | None = None) -> DataFrame:
        """All rows, or one item's; the item's bucket is computed, so only its folder is scanned."""
        rows = self.spark.read.parquet(self.folder)
        if item_id is not None:
            bucket = F.pmod(F.xxhash64(F.lit(item_id).cast("bigint")), F.lit(self.buckets)).cast("int")
            rows = rows.where((F.col("bucket") == bucket) & (F.col("item_id") == item_id))
        return rows.drop("bucket")

    def import_json(self, pattern: str, schema: str, name_pattern: str = r"(\d+)\.json$") -> None:
        """Append JSON array files named after their item."""
        rows = self.spark.read.schema(schema).option("multiLine", True).json(pattern)
        item = F.regexp_extract(F.col("_metadata.file_name"), name_pattern, 1).cast("bigint")
        self.append(rows.withColumn("item_id", item))


# --- Model registry: rows (item_id, version, model_name, params, saved_at, is_deleted, is_rollback) ---------------


def next_versions(registry: DataFrame, saved: DataFrame) -> DataFrame:
    """New rows with the version after the item's highest one (as a number, so 10 follows 9)."""
    top = registry.groupBy("item_id").agg(F.max("version").alias("_top"))
    rows = saved.join(top, "item_id", "left")
    return rows.withColumn("version", (F.coalesce("_top", F.lit(0)) + 1).cast("int")).drop("_top")


def live_versions(registry: DataFrame) -> DataFrame:
    """Versions not deleted; a deletion is a later row of the same version."""
    states = registry.groupBy("item_id", "version").agg(
        F.max("is_deleted").alias("_gone"), F.min_by(F.struct("model_name", "params", "saved_at"), "saved_at").alias("_m")
    )
    return states.where(~F.col("_gone")).select("item_id", "version", "_m.model_name", "_m.params", "_m.saved_at")


def load_models(registry: DataFrame, version: int | None = None) -> DataFrame:
    """The given version, or the latest live one, of every item."""
    live = live_versions(registry)
    if version is not None:
        return live.where(F.col("version") == version)
    rest = F.struct("version", "model_name", "params", "saved_at")
    return live.groupBy("item_id").agg(F.max(rest).alias("_m")).select("item_id", "_m.*")


def rollback_rows(registry: DataFrame, targets: DataFrame, saved_at) -> DataFrame:
    """New latest versions that repeat the target version (item_id, target_version) of each item."""
    live = live_versions(registry)
    chosen = live.join(
        targets.select("item_id", F.col("target_version").alias("version")), ["item_id", "version"]
    ).drop("version", "saved_at")
    return next_versions(registry, chosen).withColumn("saved_at", saved_at).withColumn("is_deleted", F.lit(False))


def deletion_rows(registry: DataFrame, targets: DataFrame, saved_at) -> DataFrame:
    """Rows that mark versions (item_id, version) as deleted."""
    hit = live_versions(registry).join(targets.select("item_id", "version"), ["item_id", "version"])
    return hit.withColumn("saved_at", saved_at).withColumn("is_deleted", F.lit(True))
