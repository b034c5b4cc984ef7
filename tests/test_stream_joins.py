from datetime import datetime, timedelta

from helpers import order, orders, payment, payments, rules
from pyspark.sql import functions as F

from sluice.operators.classify import accepted, classify_orders, classify_payments
from sluice.operators.detect import spike_test
from sluice.sources.layers import PartitionedTable, key_range
from sluice.streaming import jobs, volumes
from sluice.streaming.payments import keep_verdicts, stream_payment_verdicts

T = datetime(2024, 1, 1)


def day(n):
    return str(T + timedelta(days=n))


class Payments:
    """Two folders of drops and the table of final verdicts."""

    def __init__(self, spark, root, ahead="1 day"):
        self.spark, self.root, self.ahead = spark, root, ahead
        self.table = PartitionedTable(spark, f"{root}/verdicts", key_range("payment_id", 10))

    def drop(self, paid=(), known=()):
        if paid:
            payments(self.spark, list(paid)).coalesce(1).write.mode("append").parquet(f"{self.root}/payments")
        if known:
            rows = orders(self.spark, list(known)).select("order_id", "ordered_at")
            rows.coalesce(1).write.mode("append").parquet(f"{self.root}/orders")

    def drain(self):
        read = lambda name, like: self.spark.readStream.schema(like.schema).parquet(f"{self.root}/{name}")
        paid = read("payments", payments(self.spark, []))
        known = read("orders", orders(self.spark, []).select("order_id", "ordered_at"))
        verdicts = stream_payment_verdicts(paid, known, delay="3 days", reach="30 days", ahead=self.ahead)
        keep_verdicts(verdicts, self.table, f"{self.root}/checkpoint").awaitTermination()
        found = self.table.rows()
        return {} if found is None else rules(found, "payment_id")


def test_a_payment_waits_for_its_order_and_an_orphan_for_the_delay(spark, tmp_path):
    shop = Payments(spark, str(tmp_path))
    shop.drop([payment(1, 7, paid_at=day(10)), payment(2, 8, paid_at=day(10)), payment(3, 9, amount="-1.00", paid_at=day(10))], [order(9, ordered_at=day(9))])
    # Order 9 is there; 7 may still come, and 8 never will.
    assert shop.drain() == {3: "negative_price"}
    shop.drop([payment(4, 9, status="odd", paid_at=day(12))], [order(7, ordered_at=day(8)), order(7, ordered_at=day(8))])
    assert shop.drain() == {3: "negative_price", 1: None, 4: "malformed_data"}
    shop.drop([payment(5, 50, paid_at=day(30))], [order(50, ordered_at=day(30))])
    shop.drain()
    # Both watermarks have passed day 11 only now: the orphan is final.
    shop.drop([payment(6, 51, paid_at=day(31))], [order(51, ordered_at=day(31))])
    found = shop.drain()
    assert found == {3: "negative_price", 1: None, 4: "malformed_data", 5: None, 6: None, 2: "orphan_payment"}
    # Too late for its payment: the verdict stays.
    shop.drop((), [order(8, ordered_at=day(9))])
    assert shop.drain()[2] == "orphan_payment"


def test_stream_verdicts_equal_the_batch_ones_once_closed(spark, tmp_path):
    known = [order(i, ordered_at=day(i % 5), quantity=i + 1, total_amount="0.00" if i % 7 == 0 else "20.00") for i in range(30)]
    paid = [payment(i, i % 40, paid_at=day(i % 6) if i % 11 else None, ingested=day(3), amount="-1.00" if i % 9 == 0 else "2.00") for i in range(60)]
    shop = Payments(spark, str(tmp_path), ahead="10 days")
    silver = accepted(classify_orders(orders(spark, known)), "orders")
    ids = {r.order_id for r in silver.collect()}
    good = [o for o in known if o[0] in ids]
    shop.drop(paid[:30], good[15:])
    shop.drop(paid[30:], good[:15])
    for n in (1000, 1001):
        shop.drop([payment(n, n, paid_at=day(n))], [order(n, ordered_at=day(n))])
        found = shop.drain()
    want = rules(classify_payments(payments(spark, paid), silver), "payment_id")
    assert {k: v for k, v in found.items() if k < 1000} == want


def test_new_verdicts_are_added_and_only_repeated_keys_rewrite(spark, tmp_path):
    files = lambda: {str(f) for f in (tmp_path / "verdicts").glob("_part=*/*.parquet")}
    shop = Payments(spark, str(tmp_path))
    shop.drop([payment(1, 7, paid_at=day(10)), payment(11, 7, paid_at=day(10))], [order(7, ordered_at=day(9))])
    assert shop.drain() == {1: None, 11: None}
    first = files()
    shop.drop([payment(2, 7, paid_at=day(10)), payment(25, 7, paid_at=day(10))])
    assert shop.drain() == {1: None, 11: None, 2: None, 25: None}
    assert first < files()
    # Payment 1 comes again, with an amount that is refused: one row of it, the other part as it was.
    shop.drop([payment(1, 7, amount="-1.00", paid_at=day(11)), payment(12, 7, paid_at=day(11))])
    before = files()
    assert shop.drain() == {1: "negative_price", 11: None, 2: None, 25: None, 12: None}
    assert shop.table.rows().count() == 5
    assert {f for f in before if "_part=0" not in f} < files()
    assert not {f for f in before if "_part=0" in f} & files()


def test_a_repeated_call_mends_rows_half_added(spark, tmp_path):
    table = PartitionedTable(spark, f"{tmp_path}/table", key_range("k", 10))
    batch = lambda *rows: spark.createDataFrame(list(rows), "k long, v string")
    found = lambda: sorted(tuple(r) for r in table.rows().collect())
    table.upsert(batch((1, "a"), (11, "b")), "k", f"{tmp_path}/stage", add=True)
    more = batch((2, "c"), (12, "d"), (13, "e"), (21, "f"))
    # A crash has left one of the two rows of part 1.
    torn = batch((12, "d")).select("*", table.part)
    torn.write.mode("append").partitionBy("_part").parquet(table.path)
    want = [(1, "a"), (2, "c"), (11, "b"), (12, "d"), (13, "e"), (21, "f")]
    for n in range(2):
        table.upsert(more, "k", f"{tmp_path}/stage-{n}", add=True)
        assert found() == want


def test_the_state_settings_are_those_of_the_query_only(spark, tmp_path):
    key = "spark.sql.streaming.maxBatchesToRetainInMemory"
    before = spark.conf.get(key)
    shop = Payments(spark, str(tmp_path))
    shop.drop([payment(1, 7, paid_at=day(10))], [order(7, ordered_at=day(9))])
    shop.drain()
    assert spark.conf.get(key) == before != "1"


def test_the_histogram_gives_the_spike_test_after_each_drop(spark, tmp_path):
    source = str(tmp_path / "source")
    live = volumes.MinuteVolumes(spark, str(tmp_path / "live"))
    seen = []

    def drain():
        stream = spark.readStream.schema("ts TIMESTAMP").parquet(source)
        counts = jobs.stream_minute_counts(stream, "ts", delay="2 days")
        volumes.stream_volumes(counts, live, str(tmp_path / "checkpoint")).awaitTermination()

    for drop in ([1, 5, 61, 130], [2, 62, 63, 700, 86_400], [86_401 + i % 50 for i in range(400)], [3, 64]):
        seen += drop
        rows = [(T + timedelta(seconds=s),) for s in drop]
        spark.createDataFrame(rows, "ts TIMESTAMP").coalesce(1).write.mode("append").parquet(source)
        drain()
        frame = spark.createDataFrame([(T + timedelta(seconds=s),) for s in seen], "ts TIMESTAMP")
        minutes = frame.groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("rows"))
        assert live.spike().collect() == spike_test(minutes).collect()
    assert live.spike().first().found


def test_replayed_minutes_move_no_unit_twice(spark, tmp_path):
    live = volumes.MinuteVolumes(spark, str(tmp_path))
    batch = lambda *rows: spark.createDataFrame([(T + timedelta(minutes=m), n) for m, n in rows], "minute timestamp, rows long")
    live.apply(batch((0, 3), (1, 3), (2, 5)), 0)
    live.apply(batch((1, 4), (2, 9)), 1)
    live.apply(batch((1, 4), (2, 9)), 1)
    assert {r.rows: r.minutes for r in live.histogram.rows().collect()} == {3: 1, 4: 1, 9: 1}
    assert live.spike().first().median_minute_rows == 4.0
    live.apply(batch(), 2)
    assert live.spike().first().latest_minute_rows == 9
