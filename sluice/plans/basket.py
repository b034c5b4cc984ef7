"""The query basket over gold and over the source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.expressions import sort_columns, ts


def full_scan(obt: DataFrame) -> DataFrame:
    return obt.agg(F.count("*").alias("orders"), F.sum("total_amount").alias("revenue"))


def _revenue_by(obt: DataFrame, key: str) -> DataFrame:
    grouped = obt.groupBy(key).agg(
        F.count("*").alias("orders"), F.sum("total_amount").alias("revenue")
    )
    return grouped.orderBy(*sort_columns([("revenue", True), (key, False)]))


def revenue_by_category(obt: DataFrame) -> DataFrame:
    """All accepted orders, cancelled and returned ones included."""
    return _revenue_by(obt, "product_category")


def revenue_by_country(obt: DataFrame) -> DataFrame:
    return _revenue_by(obt, "customer_country")


def top_products(obt: DataFrame, n: int = 10) -> DataFrame:
    grouped = obt.groupBy("product_id", "product_name").agg(F.sum("total_amount").alias("revenue"))
    order = [("revenue", True), ("product_id", False), ("product_name", False)]
    return grouped.orderBy(*sort_columns(order)).limit(n)


def status_breakdown(obt: DataFrame) -> DataFrame:
    grouped = obt.groupBy("status").agg(F.count("*").alias("orders"))
    return grouped.orderBy(*sort_columns([("orders", True), ("status", False)]))


def running_revenue(daily: DataFrame, n: int = 100) -> DataFrame:
    """Running revenue per category, newest rows first.

    The rollup holds one row per calendar day and category, so a window partition is
    bounded by the number of days.
    """
    by_date = Window.partitionBy("product_category").orderBy("order_date")
    running = daily.select(
        "order_date",
        "product_category",
        "gross_revenue",
        F.sum("gross_revenue").over(by_date).alias("running"),
    )
    order = [("order_date", True), ("product_category", False)]
    return running.orderBy(*sort_columns(order)).limit(n)


def daily_with_orders(daily: DataFrame, obt: DataFrame, n: int = 50) -> DataFrame:
    """Rollup rows with the number of orders behind them, newest first.

    Orders are counted per (date, category) before the join, so a busy day never fans
    out. A NULL category matches nothing and counts zero.
    """
    counted = obt.groupBy(
        F.to_date("ordered_at").alias("order_date"), "product_category"
    ).agg(F.count("order_id").alias("orders"))
    joined = daily.join(counted, ["order_date", "product_category"], "left").select(
        "order_date", "product_category", "gross_revenue", F.coalesce("orders", F.lit(0)).alias("orders")
    )
    order = [("order_date", True), ("product_category", False)]
    return joined.orderBy(*sort_columns(order)).limit(n)


def daily_totals(orders: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Orders and amounts per day over the last days before ``as_of``."""
    recent = orders.where(F.col("ordered_at") >= ts(as_of) - F.expr(f"INTERVAL {days} DAYS"))
    grouped = recent.groupBy(F.date_trunc("day", "ordered_at").alias("day")).agg(
        F.count("*").alias("orders"), F.sum("total_amount").alias("amount")
    )
    return grouped.orderBy(F.desc_nulls_last("day"))


def category_revenue(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Summed per product first, so the join moves one row per product."""
    per_product = orders.groupBy("product_id").agg(
        F.count("*").alias("n"), F.sum("total_amount").alias("amount")
    )
    joined = per_product.join(products.select("product_id", "category"), "product_id")
    grouped = joined.groupBy("category").agg(
        F.sum("n").alias("orders"), F.sum("amount").alias("revenue")
    )
    return grouped.orderBy(*sort_columns([("revenue", True), ("category", False)]))


def segment_average(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders and average order value per customer segment."""
    per_customer = orders.groupBy("customer_id").agg(
        F.count("*").alias("n"),
        F.count("total_amount").alias("valued"),
        F.sum("total_amount").alias("amount"),
    )
    joined = per_customer.join(customers.select("customer_id", "segment"), "customer_id")
    grouped = joined.groupBy("segment").agg(
        F.sum("n").alias("orders"),
        (F.sum("amount").cast("double") / F.sum("valued")).alias("average_value"),
    )
    return grouped.orderBy(*sort_columns([("orders", True), ("segment", False)]))


def status_totals(orders: DataFrame) -> DataFrame:
    grouped = orders.groupBy("status").agg(
        F.count("*").alias("orders"), F.sum("total_amount").alias("amount")
    )
    return grouped.orderBy(*sort_columns([("orders", True), ("status", False)]))
