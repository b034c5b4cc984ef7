from helpers import order, orders, payment, payments
from pyspark.sql import functions as F

from sluice.operators.ingest import upsert
from sluice.plans.medallion import Medallion, publish
from sluice.sources.layers import LayerStore

LATER = "2024-03-01 00:00:00"


def dimensions(spark):
    stamp = F.lit("2024-01-01").cast("timestamp")
    customers = spark.range(1, 3).select(
        F.col("id").alias("customer_id"),
        F.lit("n").alias("full_name"),
        F.lit("e").alias("email"),
        F.lit("BR").alias("country"),
        F.lit("X").alias("city"),
        F.lit("s").alias("segment"),
        stamp.alias("created_at"),
        stamp.alias("_ingested_at"),
        stamp.alias("_source_watermark"),
    )
    money = F.lit("5.00").cast("decimal(10,2)")
    products = spark.range(1, 3).select(
        F.col("id").alias("product_id"),
        F.lit("sku").alias("sku"),
        F.lit("p").alias("name"),
        F.lit("toys").alias("category"),
        money.alias("unit_price"),
        money.alias("cost"),
        stamp.alias("created_at"),
        stamp.alias("_ingested_at"),
        stamp.alias("_source_watermark"),
    )
    return customers, products


def test_incremental_publish_in_both_modes(spark, tmp_path):
    customers, products = dimensions(spark)
    first = orders(spark, [order(1), order(2, quantity=3), order(3, customer_id=None)])
    pays = payments(spark, [payment(1, 1), payment(2, 2), payment(3, 3)])
    raw = {"customers": customers, "products": products, "orders": first, "payments": pays}

    def counts(written):
        return {k: written[k].count() for k in ("silver_orders", "silver_payments", "gold_orders_obt")}

    corrupted = orders(spark, [order(1, total_amount="0.00", ingested=LATER)])
    second = {**raw, "orders": upsert(first, corrupted, "order_id")}
    for mode, kept_payments in (("strict", 1), ("reference", 2)):
        store = LayerStore(spark, str(tmp_path / mode))
        written = publish(Medallion(raw.__getitem__), store)
        assert counts(written) == {"silver_orders": 2, "silver_payments": 2, "gold_orders_obt": 2}
        written = publish(Medallion(second.__getitem__), store, mode)
        assert store.version() == 2
        assert counts(written) == {
            "silver_orders": 1,
            "silver_payments": kept_payments,
            "gold_orders_obt": 1,
        }
        rejected = written["silver_orders_rejects"].collect()
        assert {r.order_id: r.reject_rule for r in rejected} == {
            1: "destructive_fix",
            3: "missing_customer",
        }
        assert spark.table("bronze_orders").count() == 3
