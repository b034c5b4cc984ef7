"""Gold tables: one row per accepted order, and a date by category rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.expressions import realised


def payment_rollup(payments: DataFrame) -> DataFrame:
    """The latest payment of each order, the higher payment id on equal times.

    A maximum over a struct combines before the shuffle, so an order with very many
    payments is no hot spot. A NULL time sorts below all others.
    """
    latest = payments.groupBy("order_id").agg(
        F.max(F.struct("paid_at", "payment_id", "method", "status", "amount")).alias("p")
    )
    return latest.select(
        "order_id",
        F.col("p.method").alias("payment_method"),
        F.col("p.status").alias("payment_status"),
        F.col("p.amount").alias("payment_amount"),
        F.col("p.paid_at").alias("paid_at"),
    )


def orders_obt(
    orders: DataFrame, customers: DataFrame, products: DataFrame, payments: DataFrame
) -> DataFrame:
    """One row per accepted order with customer, product and payment attributes.

    The rollup is joined first: orders arrive partitioned by order id from the
    duplicate check, so that join needs no further exchange of the wide side.
    """
    c = customers.select(
        "customer_id",
        F.col("country").alias("customer_country"),
        F.col("city").alias("customer_city"),
        F.col("segment").alias("customer_segment"),
    )
    p = products.select(
        "product_id",
        F.col("sku").alias("product_sku"),
        F.col("name").alias("product_name"),
        F.col("category").alias("product_category"),
    )
    return (
        orders.join(payment_rollup(payments), "order_id", "left")
        .join(c, "customer_id", "left")
        .join(p, "product_id", "left")
        .select(
            "order_id",
            "customer_id",
            "customer_country",
            "customer_city",
            "customer_segment",
            "product_id",
            "product_sku",
            "product_name",
            "product_category",
            "quantity",
            "unit_price",
            "total_amount",
            "status",
            "ordered_at",
            "payment_method",
            "payment_status",
            "payment_amount",
            "paid_at",
            "is_late",
        )
    )


def revenue_groups(obt: DataFrame) -> DataFrame:
    """What adds up per date and category: orders, units, realised value, and rows with a value.

    Cancelled and returned orders count as orders of value zero.
    """
    return (
        obt.select(
            F.to_date("ordered_at").alias("order_date"),
            "product_category",
            "quantity",
            realised().alias("value"),
        )
        .groupBy("order_date", "product_category")
        .agg(
            F.count("*").alias("order_count"),
            F.sum("quantity").alias("units_sold"),
            F.sum("value").alias("gross_revenue"),
            F.count("value").alias("_valued"),
        )
    )


def finish_daily(groups: DataFrame) -> DataFrame:
    """The daily table from its groups.

    The average is rounded half up once, in whole cents: Spark's decimal average would round
    twice.
    """
    cents = (F.col("gross_revenue") * 100).cast("bigint")
    rounded = F.expr("(2 * _cents + _valued) div (2 * _valued)")
    average = F.when(
        F.col("_valued") > 0,
        (rounded.cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(12,2)"),
    )
    return groups.withColumn("_cents", cents).select(
        "order_date",
        "product_category",
        "order_count",
        "units_sold",
        "gross_revenue",
        average.alias("avg_order_value"),
    )


def revenue_daily(obt: DataFrame) -> DataFrame:
    """Orders, units, realised revenue and average order value by date and category."""
    return finish_daily(revenue_groups(obt))
