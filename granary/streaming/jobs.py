"""Incremental jobs over file streams.

Every sink writes one folder per micro-batch (`batch_id=<n>`) in overwrite mode, so a batch replayed after a failure
replaces its own output and nothing else. Keyed state lives in Spark's state store; what else a batch builds on is read
from the batch before only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from granary.operators.cleaning import latest_per_key
from granary.operators.experiments import observation_errors
from granary.operators.scale import numbered
from granary.session import scratch_path

SERIES = ["item_id", "location_id"]
BatchJob = Callable[[DataFrame, int], DataFrame]


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, name_glob: str = "*", fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", name_glob).format(fmt).load(folder)


def run_available(stream: DataFrame, target: str, job: BatchJob, checkpoint: str | None = None) -> None:
    """Process everything that has arrived, batch by batch, into `target`, and stop."""
    place = checkpoint or scratch_path(stream.sparkSession, "stream")

    def write(batch: DataFrame, batch_id: int) -> None:
        job(batch, batch_id).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    running = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", place).trigger(availableNow=True).start()
    )
    running.awaitTermination()


def read_target(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.option("basePath", target).parquet(target).drop("batch_id")


def read_newest(spark: SparkSession, target: str, keys: list[str] | None = None) -> DataFrame:
    """The rows of the last batch, or with `keys` each key's row of the last batch that has one."""
    rows = spark.read.option("basePath", target).parquet(target)
    if keys is None:
        last = rows.agg(F.max("batch_id")).first()[0]
        return rows.where(F.col("batch_id").eqNullSafe(F.lit(last))).drop("batch_id")
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_row"))
    return newest.select(*keys, "_row.*")


def _state(target: str, batch_id: int) -> str:
    """The folder beside the target that holds what the next batch needs to know of all batches up to this one."""
    return f"{target}_state/batch_id={batch_id}"


class StreamRegistry:
    """Named streams, each appended to its own table; one failing stream does not stop the others."""

    def __init__(self) -> None:
        self._streams: dict[str, tuple[Callable[[], DataFrame], str, str | None]] = {}

    def add(self, name: str, open_stream: Callable[[], DataFrame], target: str, checkpoint: str | None = None) -> None:
        self._streams[name] = (open_stream, target, checkpoint)

    def process(self, name: str | None = None) -> dict[str, str | None]:
        """Run the named stream, or all; returns the error text per stream, None where it went well."""
        outcome: dict[str, str | None] = {}
        for key, (open_stream, target, checkpoint) in self._streams.items():
            if name is not None and key != name:
                continue
            try:
                run_available(open_stream(), target, lambda batch, _: batch, checkpoint)
                outcome[key] = None
            except Exception as e:
                outcome[key] = f"{type(e).__name__}: {e}"
        return outcome


def _stored(running, target: str, checkpoint: str | None, mode: str, spark: SparkSession) -> None:
    """Run a stateful stream to its end; each batch writes the rows it changed, the state stays in Spark's store."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # what keyed state needs
    try:
        query = (
            running.writeStream.outputMode(mode)
            .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{target}/batch_id={n}"))
            .option("checkpointLocation", checkpoint or scratch_path(spark, "stream"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(name, before)


class _Stock(StatefulProcessor):
    """One key's date and stock in the state store; a micro-batch that touches the key moves both."""

    def __init__(self, names: list[str], qty: str):
        self.names, self.qty = names, qty

    def init(self, handle) -> None:
        self.stock = handle.getValueState("stock", "date date, qty bigint")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.stock.update((row["date"], int(row[self.qty])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        moved = sum(int(part["delta"].sum()) for part in rows)
        if not self.stock.exists():
            return  # a key without stock is not rolled forward
        date, qty = self.stock.get()
        date, qty = date + timedelta(days=1), max(0, qty + moved)
        self.stock.update((date, qty))
        yield pd.DataFrame([[*key, date, qty]], columns=[*self.names, "date", self.qty])

    def close(self) -> None:
        pass


def roll_forward(changes: DataFrame, base: DataFrame, target: str, checkpoint: str | None = None, qty: str = "on_hand_qty", keys: list[str] = SERIES) -> None:
    """Next-day stock of the keys that each micro-batch of deltas (keys, delta) touches: latest stock plus delta, not below zero.

    A micro-batch stands for a day: each one that touches a key moves it by one date. The latest rows of `base` are the
    initial state of Spark's keyed state store; from then on a batch reads and writes the state of its own keys only. A
    key's rows of a batch are added up in chunks. `target` gets one row per touched key and batch; keys `base` lacks are left out.
    """
    first = latest_per_key(base.select(*keys, "date", F.col(qty).cast("bigint").alias(qty)), keys, ["date"])
    sound = changes.select(*keys, F.coalesce(F.col("delta"), F.lit(0)).cast("bigint").alias("delta"))
    types = dict(first.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in (*keys, "date", qty))
    running = sound.groupBy(*keys).transformWithStateInPandas(
        _Stock(list(keys), qty), schema, "Update", "None", initialState=first.groupBy(*keys)
    )
    _stored(running, target, checkpoint, "update", changes.sparkSession)


def ingest_orders(existing: DataFrame, target: str, order_by: str, id_column: str = "po_id") -> BatchJob:
    """New orders numbered on from the highest id so far, in the order of a unique column.

    The highest id is looked up in `existing` for the first batch only; later ones read the state of the batch before.
    """

    def job(batch: DataFrame, batch_id: int) -> DataFrame:
        spark = batch.sparkSession
        if batch_id == 0:
            known = existing.agg(F.coalesce(F.max(id_column), F.lit(0)).cast("bigint").alias("top"))
        else:
            known = spark.read.parquet(_state(target, batch_id - 1))
        top = known.first()["top"]
        after = batch.agg((F.count(F.lit(1)) + F.lit(top)).cast("bigint").alias("top"))
        after.write.mode("overwrite").parquet(_state(target, batch_id))
        return numbered(batch, [F.col(order_by)], "_n").withColumn(id_column, F.col("_n") + F.lit(top)).drop("_n")

    return job


def refresh_forecasts(
    history: DataFrame, forecaster: Callable[[DataFrame, int, list[str]], DataFrame], steps: int = 1,
    min_rows: int = 30, keys: list[str] = SERIES,
) -> BatchJob:
    """New forecasts with an error band for the keys a batch touches, where the history is long enough."""

    def job(batch: DataFrame, batch_id: int) -> DataFrame:
        touched = history.join(batch.select(*keys).distinct(), keys, "left_semi")
        long_enough = touched.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows)
        rows = forecaster(touched.join(long_enough.select(*keys), keys, "left_semi"), steps, keys)
        last = F.get("forecast", F.lit(steps - 1))
        return rows.select(
            *keys, "model", last.alias("yhat"),
            F.greatest(F.lit(0.0), last - 1.96 * F.col("rmse")).alias("lower_bound"),
            (last + 1.96 * F.col("rmse")).alias("upper_bound"),
        )

    return job


def running_group_metrics(stream: DataFrame, target: str, checkpoint: str | None = None) -> None:
    """Running error measures per experiment group: a batch writes the groups it touches; `read_newest` by group has the last."""
    measured = observation_errors(stream).groupBy("group").agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg("squared_error")).alias("rmse"),
        F.avg("error").alias("mae"),
        (F.avg("absolute_percentage_error") * 100).alias("mape"),
    )
    _stored(measured, target, checkpoint, "update", stream.sparkSession)
