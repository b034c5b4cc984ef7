from helpers import DAY, order, orders, payment, payments, rules

from sluice.operators.classify import (
    accepted,
    classify_customers,
    classify_orders,
    classify_payments,
    classify_products,
    rejects,
)

CUSTOMER_DDL = "customer_id BIGINT, full_name STRING, email STRING, country STRING, segment STRING"


def test_first_matching_rule_wins(spark):
    df = orders(
        spark,
        [
            order(1),
            order(2, customer_id=None, quantity=-5, unit_price="-1.00"),
            order(3, quantity=-5, unit_price="-1.00"),
            order(4, quantity=None),
            order(5, unit_price="-1.00", status="nope"),
            order(6, total_amount="0.00", status="nope"),
            order(7, status="nope"),
            order(8, status=None),
        ],
    )
    assert rules(classify_orders(df), "order_id") == {
        1: None,
        2: "missing_customer",
        3: "invalid_quantity",
        4: "invalid_quantity",
        5: "negative_price",
        6: "destructive_fix",
        7: "malformed_data",
        8: "malformed_data",
    }


def test_null_money_is_accepted_on_orders_only(spark):
    df = orders(spark, [order(1, unit_price=None), order(2, total_amount=None)])
    assert rules(classify_orders(df), "order_id") == {1: None, 2: None}
    products = spark.createDataFrame(
        [(1, "a", "c", None, "1"), (2, "a", "c", "1", None), (3, "a", "c", "1", "1")],
        "product_id BIGINT, sku STRING, category STRING, unit_price STRING, cost STRING",
    ).selectExpr(
        "product_id", "sku", "category", "cast(unit_price as decimal(10,2)) unit_price",
        "cast(cost as decimal(10,2)) cost",
    )
    got = rules(classify_products(products), "product_id")
    assert got == {1: "negative_price", 2: "negative_price", 3: None}


def test_reason_survives_a_null_amount(spark):
    df = classify_orders(orders(spark, [order(1, unit_price="-2.00", total_amount=None)]))
    reason = df.first().reject_reason
    assert reason == "negative money: unit_price=-2.00 total_amount=null"


def test_duplicates_keep_the_lowest_key_and_nulls_group(spark):
    df = orders(
        spark,
        [
            order(11),
            order(10),
            order(12, quantity=3),
            order(20, unit_price=None, product_id=None),
            order(21, unit_price=None, product_id=None),
        ],
    )
    got = rules(classify_orders(df), "order_id")
    assert got == {10: None, 11: "duplicate_order", 12: None, 20: None, 21: "duplicate_order"}


def test_only_spaces_are_blank_not_tabs(spark):
    df = spark.createDataFrame(
        [(1, "  ", "e", "c", "s"), (2, "\t", "e", "c", "s"), (3, "n", "e", None, "s"), (None, "n", "e", "c", "s")],
        CUSTOMER_DDL,
    )
    out = {r.customer_id: r.reject_reason for r in classify_customers(df).collect()}
    assert out == {
        1: "full_name is null/blank",
        2: None,
        3: "country is null/blank",
        None: "customer_id is null",
    }


def test_payment_rules(spark):
    accepted_orders = orders(spark, [order(1)])
    df = payments(
        spark,
        [
            payment(1, 1),
            payment(2, 999999999, amount="-1"),
            payment(3, None),
            payment(4, 1, amount="-1", status="x"),
            payment(5, 1, amount=None),
            payment(6, 1, status="x"),
        ],
    )
    assert rules(classify_payments(df, accepted_orders), "payment_id") == {
        1: None,
        2: "orphan_payment",
        3: "orphan_payment",
        4: "negative_price",
        5: "negative_price",
        6: "malformed_data",
    }


def test_late_counts_day_boundaries(spark):
    df = orders(
        spark,
        [
            order(1, ordered_at="2024-01-01 23:00:00", ingested="2024-01-09 01:00:00"),
            order(2, ordered_at="2024-01-01 01:00:00", ingested="2024-01-08 23:00:00", quantity=3),
        ],
    )
    silver = accepted(classify_orders(df), "orders")
    assert {r.order_id: r.is_late for r in silver.collect()} == {1: True, 2: False}
    assert "_source_watermark" not in silver.columns


def test_rejects_keep_all_columns_and_the_time(spark):
    df = orders(spark, [order(1), order(2, customer_id=None)])
    out = rejects(classify_orders(df), DAY)
    assert out.columns[-3:] == ["reject_reason", "reject_rule", "rejected_at"]
    row = out.first()
    assert (row.order_id, str(row.rejected_at)) == (2, DAY)
    assert set(df.columns) <= set(out.columns)
