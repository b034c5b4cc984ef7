"""Verdicts and gold kept current by batches, against a rebuild from all raw rows."""

import random

import pytest
from helpers import order, orders, payment, payments, rules
from pyspark.sql import functions as F
from test_publish import dimensions

from sluice.operators import deltas, gold
from sluice.operators.classify import accepted, classify_orders, classify_payments
from sluice.operators.ingest import upsert
from sluice.plans.incremental import GoldTables, OrderTables

DAYS = [f"2024-01-0{d} 10:00:00" for d in range(1, 8)]


class Shop:
    """Live tables, and the same from scratch."""

    def __init__(self, spark, root):
        self.spark = spark
        self.customers, self.products = dimensions(spark)
        self.payments = payments(spark, [])
        made = GoldTables(spark, root, lambda: self.customers, lambda: self.products, lambda: self.payments)
        self.tables = OrderTables(spark, root, width=10, gold_tables=made)
        self.raw = None

    def take(self, batch, batch_id):
        self.raw = batch if self.raw is None else upsert(self.raw, batch, "order_id")
        self.tables.apply(batch, batch_id)

    def check(self):
        classified = classify_orders(self.raw)
        assert rules(self.tables.verdicts.rows(), "order_id") == rules(classified, "order_id")
        silver = accepted(classified, "orders")
        paid = accepted(classify_payments(self.payments, silver), "payments")
        obt = gold.orders_obt(silver, self.customers, self.products, paid)
        rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
        assert rows(self.tables.gold.obt.rows().select(*obt.columns)) == rows(obt)
        assert rows(self.tables.gold.daily()) == rows(gold.revenue_daily(obt))


def some_orders(rng, ids):
    return [
        order(
            i,
            customer_id=rng.choice([1, 2, 3, None]),
            product_id=rng.choice([1, 2, 9]),
            quantity=rng.choice([1, 2, 2, -1]),
            total_amount=rng.choice(["20.00", "10.50", "0.00", None]),
            status=rng.choice(["placed", "shipped", "cancelled", "odd"]),
            ordered_at=rng.choice([*DAYS, None]),
            ingested=f"2024-01-{rng.randrange(10, 20)} 00:00:00",
        )
        for i in ids
    ]


def test_batches_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(4)
    shop = Shop(spark, str(tmp_path))
    shop.payments = payments(spark, [payment(i, rng.randrange(40), amount=f"{i}.00") for i in range(60)])
    shop.take(orders(spark, some_orders(rng, range(30))), 0)
    shop.check()
    # Changes, moves to other days, evictions and inserts at once.
    shop.take(orders(spark, some_orders(rng, [*range(0, 30, 4), *range(30, 40)])), 1)
    shop.check()
    new = payments(spark, [payment(100 + i, i, amount="3.00", paid_at="2024-03-01 00:00:00") for i in range(0, 20, 3)])
    shop.payments = shop.payments.unionByName(new)
    shop.tables.payments_changed(new, 0)
    shop.check()


def test_a_replayed_batch_adds_nothing_twice(spark, tmp_path, monkeypatch):
    shop = Shop(spark, str(tmp_path))
    first = orders(spark, [order(1), order(2, quantity=3), order(3, ordered_at=DAYS[4])])
    shop.take(first, 0)
    second = orders(spark, [order(1, quantity=5), order(3, total_amount="0.00"), order(4, quantity=7)])

    def stop(*_):
        raise OSError("stopped")

    # The first call dies after the daily groups were changed, before the order table was.
    replace = type(shop.tables.gold.obt).replace
    with monkeypatch.context() as crash:
        crash.setattr(shop.tables.gold.obt, "replace", stop)
        with pytest.raises(OSError):
            shop.take(second, 1)
    assert replace is type(shop.tables.gold.obt).replace
    shop.tables.apply(second, 1)
    shop.tables.apply(second, 1)
    shop.check()


def test_one_day_reads_and_rewrites_its_own_partition_only(spark, tmp_path):
    shop = Shop(spark, str(tmp_path))
    shop.take(orders(spark, [order(i, quantity=i, ordered_at=d) for i, d in enumerate(DAYS, 1)]), 0)
    names = ("classified_orders", "gold_orders_obt", "gold_revenue_groups")

    def listed(name):
        return {p.parent.name: p.name for p in (tmp_path / name).glob("_part=*/*.parquet")}

    before = {n: listed(n) for n in names}
    shop.take(orders(spark, [order(3, quantity=30, ordered_at=DAYS[2]), order(50, ordered_at=DAYS[2])]), 1)
    shop.check()
    for n in names:
        after = listed(n)
        assert {p for p in after if after[p] != before[n].get(p)} == {"_part=20240103"}, n
    plan = shop.tables.verdicts.rows([20240103])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_part" in plan and "20240103" in plan


def test_signed_changes(spark):
    ddl = "k int, v string"
    before = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], ddl)
    after = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], ddl)
    found = deltas.row_changes(before, after, "k").select("sign", "row.*").collect()
    assert sorted(tuple(r) for r in found if r.v) == [(-1, 3, "c"), (1, 2, "b"), (1, 4, "d")]
    assert [(r.sign, r.k) for r in found if r.v is None] == [(-1, 2)]


def test_groups_vanish_and_sums_without_values_are_null(spark):
    rows = spark.createDataFrame(
        [(1, "2024-01-01", "a", 2, None, "placed"), (2, "2024-01-01", "a", 3, "5.00", "placed")],
        "order_id int, d string, product_category string, quantity int, amount string, status string",
    ).select(
        "order_id",
        F.col("d").cast("timestamp").alias("ordered_at"),
        "product_category",
        "quantity",
        F.col("amount").cast("decimal(12,2)").alias("total_amount"),
        "status",
    )
    groups = gold.revenue_groups(rows)
    one = deltas.merge_revenue(groups, deltas.revenue_deltas(deltas.row_changes(rows.where("order_id = 2"), rows.limit(0), "order_id")))
    assert [(r.order_count, r.units_sold, r.gross_revenue) for r in one.collect()] == [(1, 2, None)]
    none = deltas.merge_revenue(groups, deltas.revenue_deltas(deltas.row_changes(rows, rows.limit(0), "order_id")))
    assert none.count() == 0
