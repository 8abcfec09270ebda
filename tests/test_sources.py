"""Readers, stores and streams on small folders."""

import json

import pytest
from pyspark.sql import functions as F

from granary import schemas
from granary.sources import readers as R
from granary.sources import stores as T
from granary.streaming import jobs as D


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def locations(spark, *names):
    return spark.createDataFrame([(n, 10, 1.0, "r") for n in names], schemas.schema("locations"))


def test_csv_keeps_quoted_json(spark, folder):
    text = '[[1,253,6.06],[254,null,5.57]]'
    df = spark.createDataFrame([(1, 3, text, "A", "t, \"q\"")], schemas.schema("suppliers"))
    R.write_csv({"suppliers": df}, folder)
    row = R.csv_reader(spark, folder)("suppliers").first()
    assert row.price_breaks == text and row.type == 't, "q"'
    with pytest.raises(KeyError):
        R.csv_reader(spark, folder)("nonsense")


def test_jdbc_options():
    assert R.jdbc_options("jdbc:x", "SELECT 1", user="u") == {"url": "jdbc:x", "fetchsize": "10000", "user": "u", "query": "SELECT 1"}
    split = R.jdbc_options("jdbc:x", "SELECT * FROM t", "id", 0, 100, 8)
    assert split["partitionColumn"] == "id" and split["numPartitions"] == "8" and "query" not in split
    with pytest.raises(ValueError):
        R.jdbc_options("jdbc:x", "SELECT 1", "id")


@pytest.mark.parametrize("pages", [1, 3, 4, 9, 10])
def test_open_ended_paging(spark, folder, pages):
    """Strides read on until a page is short or missing, however many there are."""
    for page in range(1, pages + 1):
        rows = 3 if page < pages else 1 + page % 3
        with open(f"{folder}/loc-{page}.json", "w") as f:
            json.dump([{"location_id": f"{page}-{i}", "capacity_limit": page, "region": None} for i in range(rows)], f)
    want = 3 * (pages - 1) + 1 + pages % 3
    for more in ({"page_size": 3}, {}, {"page_size": 3, "readers": 1}):
        read = R.open_source(spark, "api", base_url=f"file://{folder}", endpoints={"locations": "loc-{page}.json"}, **more)
        assert read("locations").count() == want
    listed = lambda n: R.open_source(spark, "api", base_url=f"file://{folder}", endpoints={"locations": "loc-{page}.json"}, pages=n, page_size=3)("locations")
    if pages > 1:
        with pytest.raises(Exception, match="there are more"):
            listed(pages - 1).collect()
    with pytest.raises(Exception, match="is missing"):
        listed(pages + 1).collect()


def test_paged_endpoint_reads_every_page(spark, folder):
    for page, name in ((1, "a"), (2, "b")):
        with open(f"{folder}/loc-{page}.json", "w") as f:
            json.dump([{"location_id": name, "capacity_limit": page, "region": None}], f)
    read = R.open_source(spark, "api", base_url=f"file://{folder}", endpoints={"locations": "loc-{page}.json"}, pages=2)
    rows = {r.location_id: r.capacity_limit for r in read("locations").collect()}
    assert rows == {"a": 1, "b": 2}


def test_fallback_order_and_failure(spark, folder):
    sources = R.SourceRegistry()
    sources.register("late", lambda t: locations(spark, "x"), priority=5)
    sources.register("early", lambda t: locations(spark, "y"), priority=1)
    assert sources.load("locations").first().source_used == "early"
    broken = R.SourceRegistry()
    broken.register("csv", R.csv_reader(spark, folder), 1)
    with pytest.raises(LookupError, match="csv"):
        broken.load("locations")
    with pytest.raises(ValueError):
        R.open_source(spark, "carrier pigeon")


def test_registered_kind(spark):
    R.register_kind("memory", lambda s, rows: lambda table: locations(s, *rows))
    assert R.open_source(spark, "memory", rows=["q"])("locations").first().location_id == "q"


def test_warehouse_append_replace_lineage(spark, folder):
    store = T.Warehouse(spark, folder)
    store.update("t", locations(spark, "a", "b"), "replace", "files")
    store.update("t", locations(spark, "c").withColumn("extra", F.lit(1)))
    assert store.load("t").count() == 3 and store.load("t").where("extra is null").count() == 2
    store.update("t", locations(spark, "z"), "replace")
    assert [r.location_id for r in store.load("t").collect()] == ["z"]
    log = store.lineage("t").first()
    assert [o.operation for o in log.operations] == ["update_replace", "update_append", "update_replace"]
    assert [o.rows for o in log.operations] == [2, 1, 1]
    with pytest.raises(ValueError):
        store.update("t", locations(spark, "z"), "merge")
    with pytest.raises(KeyError):
        store.load("missing")


def test_feature_store_upsert(spark, folder):
    store = T.FeatureStore(spark, folder)
    rows = lambda *r: spark.createDataFrame(list(r), "item_id int, location_id string, model_tag string")
    store.update(rows((1, "a", "x"), (2, "a", "y")))
    store.update(rows((2, "a", "z"), (3, "a", "w")))
    assert {(r.item_id, r.model_tag) for r in store.all().collect()} == {(1, "x"), (2, "z"), (3, "w")}
    wanted = spark.createDataFrame([(1, "a"), (9, "a")], "item_id int, location_id string")
    assert {r.item_id: r.model_tag for r in store.tags(wanted).collect()} == {1: "x", 9: "default"}
    assert store.get(item_id=2).first().model_tag == "z"


def test_history_imports_json_by_file_name(spark, folder):
    with open(f"{folder}/safety_stock_params_12.json", "w") as f:
        json.dump([{"z_value": 1.65, "cv": 0.3, "recorded_at": "2024-01-01"}, {"z_value": 2.33, "cv": 0.7, "recorded_at": "2024-01-02"}], f)
    history = T.History(spark, f"{folder}/h", buckets=4)
    history.import_json(f"{folder}/*.json", "z_value double, cv double, recorded_at string")
    assert history.read(12).count() == 2 and history.read(13).count() == 0


def test_versions_are_numbers(spark):
    registry = spark.createDataFrame(
        [(1, v, "m", "p", v, False) for v in range(1, 11)], "item_id int, version int, model_name string, params string, saved_at int, is_deleted boolean"
    )
    saved = spark.createDataFrame([(1, "n", "q"), (2, "n", "q")], "item_id int, model_name string, params string")
    assert {r.item_id: r.version for r in T.next_versions(registry, saved).collect()} == {1: 11, 2: 1}
    assert T.load_models(registry).first().version == 10
    assert T.load_models(registry, 3).first().version == 3


def test_one_broken_stream_does_not_stop_the_others(spark, folder):
    for n, name in enumerate("ab"):
        locations(spark, name).coalesce(1).write.parquet(f"{folder}/in/{n}")
    stream = lambda: spark.readStream.schema(schemas.schema("locations")).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    registry = D.StreamRegistry()
    registry.add("bad", lambda: stream().select("nope"), f"{folder}/bad")
    registry.add("good", stream, f"{folder}/good", f"{folder}/ck")
    outcome = registry.process()
    assert outcome["good"] is None and "nope" in outcome["bad"]
    assert D.read_target(spark, f"{folder}/good").count() == 2
    locations(spark, "c").coalesce(1).write.parquet(f"{folder}/in/9")
    assert registry.process("good") == {"good": None}
    assert D.read_target(spark, f"{folder}/good").count() == 3


def test_order_ids_continue_over_batches_and_replays(spark, folder):
    existing = spark.createDataFrame([(7,)], "po_id bigint")
    target = f"{folder}/po"
    job = D.ingest_orders(existing, target, "k")
    batch = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k int")
    for batch_id, rows in ((0, batch(5, 3)), (1, batch(9)), (1, batch(9))):
        job(rows, batch_id).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
    assert {r.k: r.po_id for r in D.read_target(spark, target).collect()} == {3: 8, 5: 9, 9: 10}


def test_stock_rolls_forward_over_restarts(spark, folder):
    """The state is found again by the next run from the same checkpoint."""
    base = spark.createDataFrame([(1, "a", 10), (2, "a", 4)], "item_id int, location_id string, on_hand_qty bigint").withColumn(
        "date", F.lit("2024-01-01").cast("date")
    )
    target = f"{folder}/stock"
    kind = "item_id int, location_id string, delta bigint"
    for n, delta in enumerate((-3, -20, 5)):
        spark.createDataFrame([(1, "a", delta)], kind).coalesce(1).write.parquet(f"{folder}/in/{n}")
        stream = spark.readStream.schema(kind).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        D.roll_forward(stream, base, target, f"{folder}/check")
    got = sorted((str(r.date), r.on_hand_qty) for r in D.read_target(spark, target).collect())
    assert got == [("2024-01-02", 7), ("2024-01-03", 0), ("2024-01-04", 5)]
