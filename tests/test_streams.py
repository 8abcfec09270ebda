"""Stream jobs over three files, one per micro-batch, and table stores under failures and two writers."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from granary.sources.stores import FeatureStore, Warehouse
from granary.streaming import jobs as D


def three_files(spark, folder, rows, schema):
    """A stream that reads one file per batch, in the order they were written."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/{i}")
    kind = spark.read.parquet(f"{folder}/0").schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def test_roll_forward_keeps_keyed_state(spark, tmp_path):
    base = spark.createDataFrame([(1, "a", "2024-01-01", 5), (1, "a", "2024-01-02", 10), (2, "a", "2024-01-02", 1)],
                                 "item_id long, location_id string, date string, on_hand_qty long")
    base = base.withColumn("date", F.to_date("date"))
    parts = [[(1, "a", -3)], [(1, "a", -9), (2, "a", 4)], [(1, "a", 6), (9, "a", 5)]]
    stream = three_files(spark, f"{tmp_path}/in", parts, "item_id long, location_id string, delta long")
    target = f"{tmp_path}/out"
    D.roll_forward(stream, base, target, f"{tmp_path}/check")
    batches = spark.read.option("basePath", target).parquet(target)
    assert sorted((r.batch_id, r.item_id) for r in batches.collect()) == [(0, 1), (1, 1), (1, 2), (2, 1)]  # touched keys only
    last = {(r.item_id, str(r.date), r.on_hand_qty) for r in D.read_newest(spark, target, D.SERIES).collect()}
    assert last == {(1, "2024-01-05", 6), (2, "2024-01-03", 5)}


def test_order_ids_go_on_over_batches(spark, tmp_path):
    known = spark.createDataFrame([(7,), (41,)], "po_id long")
    stream = three_files(spark, f"{tmp_path}/in", [[(3,), (1,)], [(2,)], [(9,), (8,)]], "event_id long")
    target = f"{tmp_path}/out"
    D.run_available(stream, target, D.ingest_orders(known, target, "event_id"), f"{tmp_path}/check")
    found = {r.event_id: r.po_id for r in D.read_target(spark, target).collect()}
    assert sorted(found.values()) == [42, 43, 44, 45, 46]
    assert found[1] < found[3] and found[8] < found[9]


def test_forecasts_keep_the_newest_row_per_key(spark, tmp_path):
    history = spark.range(40).select(F.lit(1).cast("long").alias("item_id"), F.lit("a").alias("location_id"), "id")
    calls = []

    def forecaster(rows, steps, keys):
        calls.append(1)
        return rows.groupBy(*keys).agg(F.lit("m").alias("model"), F.array(F.lit(float(len(calls)))).alias("forecast"), F.lit(0.5).alias("rmse"))

    stream = three_files(spark, f"{tmp_path}/in", [[(1, "a")], [(1, "a")], [(2, "a")]], "item_id long, location_id string")
    target = f"{tmp_path}/out"
    D.run_available(stream, target, D.refresh_forecasts(history, forecaster), f"{tmp_path}/check")
    assert [(r.item_id, r.yhat) for r in D.read_newest(spark, target, D.SERIES).collect()] == [(1, 2.0)]


def test_running_metrics_equal_one_batch(spark, tmp_path):
    parts = [[("a", 1.0, 2.0)], [("a", 4.0, 2.0), ("b", 0.0, 1.0)], [("b", 2.0, 1.0)]]
    kind = "group string, actual double, predicted double"
    stream = three_files(spark, f"{tmp_path}/in", parts, kind)
    D.running_group_metrics(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    D.running_group_metrics(three_files(spark, f"{tmp_path}/one", [sum(parts, [])], kind), f"{tmp_path}/whole", f"{tmp_path}/check1")
    rows = lambda p: sorted(map(tuple, D.read_newest(spark, p, ["group"]).select("group", "n", "rmse", "mae", "mape").collect()))
    assert rows(f"{tmp_path}/out") == rows(f"{tmp_path}/whole") and len(rows(f"{tmp_path}/out")) == 2


def test_an_incomplete_replacement_is_not_read(spark, tmp_path):
    store = Warehouse(spark, f"{tmp_path}/w")
    store.update("t", spark.range(3), "replace")
    (tmp_path / "w/tables/t/generation=2/_temporary").mkdir(parents=True)  # what a job that died leaves
    assert store.load("t").count() == 3
    store.update("t", spark.range(4), "replace")
    assert store.load("t").count() == 4 and sorted(p.name for p in (tmp_path / "w/tables/t").iterdir()) == [f"generation={n}" for n in (1, 2, 3)]


def test_two_writers_keep_each_others_rows(spark, tmp_path):
    one, two = (Warehouse(spark, f"{tmp_path}/w") for _ in range(2))
    one.update("t", spark.range(3), "replace")
    two._newest, two._generations = lambda table: 1, lambda table: [1]  # it looked before the other wrote
    one.update("t", spark.range(10, 12))
    two.update("t", spark.range(20, 21))
    assert sorted(r.id for r in one.load("t").collect()) == [0, 1, 2, 10, 11, 20]
    one.update("t", spark.range(5), "replace")
    with pytest.raises(AnalysisException):
        two.update("t", spark.range(7), "replace")  # the generation is taken
    assert one.load("t").count() == 5


def test_a_table_may_be_replaced_by_what_is_read_from_it(spark, tmp_path):
    store = Warehouse(spark, f"{tmp_path}/w")
    store.update("t", spark.range(6), "replace")
    store.update("t", store.load("t").where("id > 3"), "replace")
    assert sorted(r.id for r in store.load("t").collect()) == [4, 5]
    store.update("t", store.load("t").where("id > 9"), "replace")
    assert store.load("t").count() == 0


def test_feature_updates_rewrite_touched_buckets_only(spark, tmp_path):
    store = FeatureStore(spark, f"{tmp_path}/f", ("k",), buckets=8)
    store.update(spark.range(100).select(F.col("id").alias("k"), F.lit("old").alias("model_tag")))
    files = lambda: {p for p in (tmp_path / "f").rglob("*.parquet")}
    before = files()
    store.update(spark.range(3, 4).select(F.col("id").alias("k"), F.lit("new").alias("model_tag"), F.lit(1).alias("extra")))
    assert len(before - files()) == 1 and len(files() - before) == 1
    assert {r.k: r.model_tag for r in store.all().collect()} == {k: "new" if k == 3 else "old" for k in range(100)}
    assert store.get(k=3).first().extra == 1 and store.get(k=4).first().extra is None and store.get(k=500).count() == 0


def test_lineage_counts_new_rows_only(spark, tmp_path):
    store = Warehouse(spark, f"{tmp_path}/w")
    store.update("t", spark.range(5), "replace")
    store.update("t", spark.range(2), "append")
    entries = store.lineage("t").first()["operations"]
    assert [e["rows"] for e in entries] == [5, 2] and store.load("t").count() == 7
