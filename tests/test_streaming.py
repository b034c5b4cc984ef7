from datetime import datetime, timedelta

from helpers import order, orders, rules

from sluice.operators.classify import classify_orders
from sluice.operators.ingest import upsert
from sluice.plans.incremental import OrderTables
from sluice.streaming import jobs

T = datetime(2024, 1, 1)


def test_two_drops_equal_one_rebuild_and_replay_changes_nothing(spark, tmp_path):
    drops = tmp_path / "drops"
    tables = OrderTables(spark, str(tmp_path / "tables"), width=10)
    first = orders(spark, [order(1), order(2), order(3, quantity=5), order(25, quantity=6)])
    # Order 1 changes, so order 2 is no duplicate any more; order 25 is corrupted.
    second = orders(
        spark,
        [
            order(1, quantity=8, ingested="2024-02-01 00:00:00"),
            order(25, quantity=6, total_amount="0.00", ingested="2024-02-01 00:00:00"),
            order(26, quantity=5, ingested="2024-02-01 00:00:00"),
        ],
    )

    def drain():
        source = spark.readStream.schema(first.schema).parquet(str(drops))
        jobs.stream_ingest(source, tables, str(tmp_path / "checkpoint")).awaitTermination()

    first.coalesce(1).write.mode("append").parquet(str(drops))
    drain()
    assert rules(tables.verdicts.rows(), "order_id")[2] == "duplicate_order"
    second.coalesce(1).write.mode("append").parquet(str(drops))
    drain()
    expected = rules(classify_orders(upsert(first, second, "order_id")), "order_id")
    assert rules(tables.verdicts.rows(), "order_id") == expected
    assert expected[2] is None and expected[25] == "destructive_fix" and expected[26] == "duplicate_order"

    tables.apply(second, 99)
    assert rules(tables.verdicts.rows(), "order_id") == expected
    assert tables.silver().count() == 3 and tables.rejects("2024-03-01 00:00:00").count() == 2


def test_minute_counts_update_across_drops(spark, tmp_path):
    src = str(tmp_path / "src")

    def drop(seconds):
        rows = [(T + timedelta(seconds=s),) for s in seconds]
        spark.createDataFrame(rows, "ts TIMESTAMP").coalesce(1).write.mode("append").parquet(src)

    def drain():
        stream = spark.readStream.schema("ts TIMESTAMP").parquet(src)
        counts = jobs.stream_minute_counts(stream, "ts")
        jobs.upsert_windows(counts, str(tmp_path / "t"), "minute", str(tmp_path / "c")).awaitTermination()
        return {r.minute: r["rows"] for r in jobs.read_windows(spark, str(tmp_path / "t"), "minute").collect()}

    drop([1, 5, 61])
    assert drain() == {T: 2, T + timedelta(minutes=1): 1}
    drop([62, 130])
    assert drain() == {T: 2, T + timedelta(minutes=1): 2, T + timedelta(minutes=2): 1}


def test_routes_drop_incidents_past_the_watermark(spark, tmp_path):
    src = str(tmp_path / "src")
    ddl = "incident_id BIGINT, failure_key STRING, injected_at TIMESTAMP"

    def drop(rows):
        frame = spark.createDataFrame([(i, k, T + timedelta(minutes=m)) for i, k, m in rows], ddl)
        frame.coalesce(1).write.mode("append").parquet(src)

    def drain():
        routes = jobs.stream_routes(spark.readStream.schema(ddl).parquet(src))
        jobs.upsert_windows(routes, str(tmp_path / "t"), "window_start", str(tmp_path / "c")).awaitTermination()
        rows = jobs.read_windows(spark, str(tmp_path / "t"), "window_start").collect()
        return {(r.window_start - T).seconds // 60: (r.route, r.incidents) for r in rows}

    drop([(1, "late_arrival", 1), (2, "late_arrival", 2), (3, "schema_drift", 300)])
    assert drain() == {0: ("base", 2), 300: ("base", 1)}
    # The watermark is at minute 240: minute 3 is too late, minute 305 joins its window.
    drop([(4, "schema_drift", 3), (5, "volume_spike", 305)])
    assert drain() == {0: ("base", 2), 300: ("cascade", 2)}
