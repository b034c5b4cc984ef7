"""Builders of small hand-made frames."""

from __future__ import annotations

from pyspark.sql import functions as F

ORDER_DDL = (
    "order_id BIGINT, customer_id BIGINT, product_id BIGINT, quantity INT, unit_price STRING, "
    "total_amount STRING, status STRING, ordered_at STRING, _ingested_at STRING"
)
PAYMENT_DDL = (
    "payment_id BIGINT, order_id BIGINT, method STRING, amount STRING, status STRING, "
    "paid_at STRING, _ingested_at STRING"
)
DAY = "2024-01-02 10:00:00"
LATER = "2024-01-05 10:00:00"


def order(
    order_id,
    customer_id=1,
    product_id=1,
    quantity=2,
    unit_price="10.00",
    total_amount="20.00",
    status="placed",
    ordered_at=DAY,
    ingested=LATER,
):
    return (
        order_id, customer_id, product_id, quantity, unit_price, total_amount, status, ordered_at,
        ingested,
    )


def orders(spark, rows):
    df = spark.createDataFrame(rows, ORDER_DDL)
    return df.select(
        "order_id",
        "customer_id",
        "product_id",
        "quantity",
        F.col("unit_price").cast("decimal(10,2)"),
        F.col("total_amount").cast("decimal(12,2)"),
        "status",
        F.col("ordered_at").cast("timestamp"),
        F.col("_ingested_at").cast("timestamp"),
        F.col("_ingested_at").cast("timestamp").alias("_source_watermark"),
        F.lit(False).alias("_schema_drift"),
    )


def payment(
    payment_id, order_id, amount="5.00", status="captured", paid_at=LATER, ingested=LATER, method="paypal"
):
    return (payment_id, order_id, method, amount, status, paid_at, ingested)


def payments(spark, rows):
    df = spark.createDataFrame(rows, PAYMENT_DDL)
    return df.select(
        "payment_id",
        "order_id",
        "method",
        F.col("amount").cast("decimal(12,2)"),
        "status",
        F.col("paid_at").cast("timestamp"),
        F.col("_ingested_at").cast("timestamp"),
        F.col("_ingested_at").cast("timestamp").alias("_source_watermark"),
    )


def rules(classified, key):
    return {r[key]: r["reject_rule"] for r in classified.select(key, "reject_rule").collect()}
