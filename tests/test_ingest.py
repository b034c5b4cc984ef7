import os
from datetime import datetime, timedelta

import pytest
from helpers import DAY, LATER, order, orders
from pyspark.sql import functions as F

from sluice.operators import ingest
from sluice.plans.ingest_run import Ingest
from sluice.schemas import ENTITIES
from sluice.sources.layers import (
    EPOCH,
    RUN_LOG_DDL,
    LayerStore,
    PartitionedTable,
    RunLog,
    calendar,
    key_range,
)
from sluice.sources.readers import (
    drift_by_file,
    read_all_names,
    read_entity,
    resolve_by_file,
    resolve_column,
    with_arrival,
)

ORDERS, CUSTOMERS = ENTITIES["orders"], ENTITIES["customers"]


def ids(df):
    return sorted(r.order_id for r in df.select("order_id").collect())


def test_three_arms(spark):
    df = orders(
        spark,
        [
            order(10, ordered_at="2024-01-01 00:00:00"),
            order(3000, ordered_at="2023-01-01 00:00:00"),
            order(4001, ordered_at="2023-01-01 00:00:00"),
            order(20, ordered_at="2024-02-03 00:00:00"),
        ],
    )
    prior = ("2024-02-10 00:00:00", 4000)
    assert ids(ingest.incremental_window(df, ORDERS, *prior)) == [20, 3000, 4001]
    counts = ingest.arm_counts(df, ORDERS, *prior).first().asDict()
    assert counts == {"recent_time": 1, "new_key": 1, "recent_key": 2}
    assert list(ingest.window_arms(CUSTOMERS, *prior)) == ["recent_time"]


def test_window_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "orders")
    orders(spark, [order(i) for i in range(5)]).select(*ORDERS.column_names).write.parquet(path)
    df = read_entity(spark, ORDERS, path)
    plan = ingest.incremental_window(df, ORDERS, "2024-02-10 00:00:00", 4)._jdf.queryExecution().toString()
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "GreaterThan(order_id,4)" in pushed and "Or(" in pushed


def test_high_watermark_never_falls_back(spark):
    df = orders(spark, [order(5, ordered_at="2024-01-01 00:00:00"), order(6, ordered_at=None)])
    row = ingest.high_watermark(df, ORDERS, "2024-03-01 00:00:00", 2).first()
    assert (str(row.high_ts), row.high_id) == ("2024-03-01 00:00:00", 6)
    empty = ingest.high_watermark(df.where("false"), ORDERS, EPOCH, 7).first()
    assert (str(empty.high_ts), empty.high_id) == (EPOCH, 7)


def test_drift_resolution(spark):
    df = spark.createDataFrame([(1, 2)], "order_id BIGINT, user_id BIGINT")
    fixed, drift = resolve_column(df, ["customer_id", "user_id"], "customer_id")
    assert fixed.columns == ["order_id", "customer_id"] and drift is True
    same, drift = resolve_column(fixed, ["customer_id", "user_id"], "customer_id")
    assert same.columns == fixed.columns and drift is False
    none, drift = resolve_column(df.select("order_id"), ["customer_id", "user_id"], "customer_id")
    assert none.columns == ["order_id"] and drift is False


def test_upsert_is_idempotent(spark):
    target = orders(spark, [order(1), order(2)])
    batch = orders(spark, [order(2, quantity=9), order(3)])
    once = ingest.upsert(target, batch, "order_id")
    twice = ingest.upsert(once, batch, "order_id")
    rows = lambda df: sorted((r.order_id, r.quantity) for r in df.collect())
    assert rows(once) == rows(twice) == [(1, 2), (2, 9), (3, 2)]


def test_purges(spark):
    df = orders(spark, [order(1), order(2), order(3)])
    keys = spark.createDataFrame([(2,), (None,)], "order_id BIGINT")
    assert ids(ingest.purge_keys(df, keys, "order_id")) == [1, 3]
    assert ids(ingest.purge_orphans(df, keys, "order_id")) == [2]


def test_sample_and_latest(spark):
    df = orders(spark, [order(i) for i in range(50)])
    assert ingest.sample_rows(df, df.columns[0], 7, seed=3).count() == 7
    assert ids(ingest.latest_rows(df, "order_id", 3)) == [47, 48, 49]


def files(path, part):
    return {p.name for p in (path / f"_part={part}").glob("*.parquet")}


def test_an_upsert_rewrites_only_touched_partitions(spark, tmp_path):
    path = tmp_path / "t"
    table = PartitionedTable(spark, str(path), key_range("order_id", 10))
    assert table.rows() is None
    table.upsert(orders(spark, [order(1), order(2), order(25)]), "order_id", str(tmp_path / "s0"))
    before = {part: files(path, part) for part in (0, 2)}
    table.upsert(orders(spark, [order(25, quantity=9), order(26)]), "order_id", str(tmp_path / "s1"))
    assert {r.order_id: r.quantity for r in table.rows().collect()} == {1: 2, 2: 2, 25: 9, 26: 2}
    assert files(path, 0) == before[0] and not files(path, 2) & before[2]
    plan = table.rows([2])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_part" in plan and "_part#" in plan.split("PartitionFilters")[1]


def test_a_part_that_lost_all_rows_is_gone(spark, tmp_path):
    table = PartitionedTable(spark, str(tmp_path / "t"), calendar("ordered_at"))
    rows = orders(spark, [order(1), order(2, ordered_at="2024-02-01 00:00:00"), order(3, ordered_at=None)])
    parts = table.parts(rows)
    assert parts == [0, 20240102, 20240201]
    table.replace(rows, parts, str(tmp_path / "s0"))
    moved = rows.where("order_id = 2").withColumn("ordered_at", F.lit(DAY).cast("timestamp"))
    table.replace(rows.where("order_id = 1").unionByName(moved), [20240102, 20240201], str(tmp_path / "s1"))
    assert {r.order_id: str(r.ordered_at) for r in table.rows().collect()} == {1: DAY, 2: DAY, 3: "None"}
    assert calendar("t", "month")._jc.toString().count("yyyyMM")


def test_a_crash_while_overwriting_heals_with_the_replay(spark, tmp_path):
    table = PartitionedTable(spark, str(tmp_path / "t"), key_range("order_id", 10))
    table.upsert(orders(spark, [order(1), order(2), order(3)]), "order_id", str(tmp_path / "s0"))
    batch = orders(spark, [order(1, quantity=9)])
    # The stage is complete, but the overwrite has lost the old rows of the part.
    ingest.upsert(table.rows([0]), batch, "order_id").write.parquet(str(tmp_path / "s1"))
    for file in files(tmp_path / "t", 0):
        (tmp_path / "t" / "_part=0" / file).unlink()
    spark.catalog.clearCache()
    table.upsert(batch, "order_id", str(tmp_path / "s1"))
    assert {r.order_id: r.quantity for r in table.rows().collect()} == {1: 9, 2: 2, 3: 2}


def test_files_with_either_name_of_the_customer(spark, tmp_path):
    path = str(tmp_path / "orders")
    names = ["customer_id", "user_id"]

    def drop(rows, name="customer_id"):
        frame = orders(spark, rows).select(*ORDERS.column_names).withColumnRenamed("customer_id", name)
        frame.coalesce(1).write.mode("append").parquet(path)

    drop([order(1, customer_id=7), order(2, customer_id=None)])
    drop([order(3, customer_id=8), order(4, customer_id=None)], "user_id")
    drop([order(5, customer_id=None)])
    rows = read_all_names(spark, ORDERS, path, names, "customer_id")
    found = drift_by_file(rows, names, "customer_id")
    assert sorted((r.rows, r.live, r._schema_drift) for r in found.collect()) == [
        (1, "customer_id", False),
        (2, "customer_id", False),
        (2, "user_id", True),
    ]
    resolved = resolve_by_file(rows, found, names, "customer_id")
    got = {r.order_id: (r.customer_id, r._schema_drift) for r in resolved.collect()}
    assert got == {1: (7, False), 2: (None, False), 3: (8, True), 4: (None, True), 5: (None, False)}

    runs = Ingest(spark, str(tmp_path / "lake"), width=10)
    log = runs.run({"orders": path}, "2024-02-01 00:00:00", ["orders"], mode="full").first()
    assert log.schema_drift and log.rows_read == 5
    table = {r.order_id: (r.customer_id, r._schema_drift) for r in runs.raw("orders").rows().collect()}
    assert table == got


def test_of_two_versions_in_a_window_the_later_file_or_row_wins(spark, tmp_path):
    path = tmp_path / "customers"
    ddl = CUSTOMERS.ddl
    at = datetime(2024, 1, 1)

    def drop(*rows):
        frame = spark.createDataFrame([(k, n, "e", "c", "t", "s", at) for k, n in rows], ddl)
        frame.coalesce(1).write.mode("append").parquet(str(path))

    drop((1, "zz first"), (2, "a"), (2, "zz"), (2, "b"))
    drop((1, "m second"))
    drop((1, "a third"))
    stamps = sorted(path.glob("*.parquet"), key=lambda f: f.stat().st_mtime)
    for i, file in enumerate(stamps):
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
    rows = with_arrival(spark.read.schema(ddl).parquet(str(path)))
    latest = ingest.latest_per_key(rows, "customer_id")
    assert latest.columns == CUSTOMERS.column_names
    assert {r.customer_id: r.full_name for r in latest.collect()} == {1: "a third", 2: "b"}
    runs = Ingest(spark, str(tmp_path / "lake"), width=10)
    runs.run({"customers": str(path)}, "2024-02-01 00:00:00", ["customers"], mode="full")
    assert {r.customer_id: r.full_name for r in runs.raw("customers").rows().collect()} == {1: "a third", 2: "b"}


def test_run_log_cold_start_and_unreadable_state(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"))
    assert log.priors() == {}
    at = datetime(2024, 1, 1)
    bad = (at, "orders", 1, 1, 1, True, False, "garbage", "x")
    good = (at, "payments", 1, 1, 1, True, False, "2024-01-01 05:00:00", "12")
    newer = (at + timedelta(days=1), "payments", 1, 1, 1, False, False, "2024-01-02 05:00:00", "9")
    log.append(spark.createDataFrame([bad, good, newer], RUN_LOG_DDL))
    assert log.priors() == {"orders": (EPOCH, 0), "payments": ("2024-01-02 05:00:00", 9)}


def test_run_full_then_incremental(spark, tmp_path):
    runs = Ingest(spark, str(tmp_path), width=10)
    first = orders(spark, [order(i, ordered_at="2024-01-01 00:00:00") for i in range(1, 25)])
    source = first.select(*ORDERS.column_names)
    full = runs.run({"orders": source}, "2024-02-01 00:00:00", ["orders"], mode="full").first()
    assert (full.rows_read, full.table_total, full.full_load) == (24, 24, True)
    assert (full.high_watermark_ts, full.high_watermark_id) == ("2024-01-01 00:00:00", "24")

    late = orders(spark, [order(30, ordered_at="2020-01-01 00:00:00")]).select(*ORDERS.column_names)
    drifted = source.unionByName(late).withColumnRenamed("customer_id", "user_id")
    second = runs.run({"orders": drifted}, "2024-02-02 00:00:00", ["orders"]).first()
    assert second.full_load is False and second.schema_drift is True
    table = runs.raw("orders").rows()
    assert table.count() == 25 and table.select("order_id").distinct().count() == 25
    stamps = {r.order_id: r for r in table.collect()}
    assert str(stamps[30]._ingested_at) == "2024-02-02 00:00:00" and stamps[30]._schema_drift
    with pytest.raises(ValueError):
        runs.run({"orders": source}, LATER, ["orders"], mode="sometimes")


def test_layer_store_shows_only_committed_runs(spark, tmp_path):
    store = LayerStore(spark, str(tmp_path))
    assert store.version() == 0
    store.overwrite("gold", "t", spark.range(3), 1)
    store.commit(1)
    store.overwrite("gold", "t", spark.range(5), 2)
    assert store.read("gold", "t").count() == 3
    store.commit(2)
    assert store.read("gold", "t").count() == 5
    store.append("silver", "t", spark.range(2))
    store.append("silver", "t", spark.range(2))
    assert store.read("silver", "t").count() == 4
    store.view("bronze", "t", spark.range(4))
    assert spark.table("bronze_t").count() == 4


def test_a_batch_with_two_versions_of_a_key_keeps_the_later_one(spark):
    target = spark.createDataFrame([(1, "old", "2024-01-01"), (2, "old", "2024-01-01")], "k int, v string, _ingested_at string")
    batch = spark.createDataFrame(
        [(1, "first", "2024-01-02"), (1, "last", "2024-01-03"), (3, "new", "2024-01-02"), (3, "new", "2024-01-02")],
        "k int, v string, _ingested_at string",
    )
    rows = sorted((r.k, r.v) for r in ingest.upsert(target, batch, "k").collect())
    assert rows == [(1, "last"), (2, "old"), (3, "new")]
