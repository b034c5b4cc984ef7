from decimal import Decimal

import pytest
from helpers import order, orders, payment, payments

from sluice.functions.expressions import portable
from sluice.operators import audit, gold
from sluice.operators.classify import accepted, classify_orders, rejects
from sluice.plans import basket, intents


def silver_orders(spark, rows):
    return accepted(classify_orders(orders(spark, rows)), "orders")


def customers(spark):
    return spark.createDataFrame(
        [(1, "BR", "X", "seg")], "customer_id BIGINT, country STRING, city STRING, segment STRING"
    )


def products(spark):
    return spark.createDataFrame(
        [(1, "sku1", "p1", "toys")], "product_id BIGINT, sku STRING, name STRING, category STRING"
    )


@pytest.fixture(scope="module")
def obt(spark):
    o = silver_orders(
        spark,
        [
            order(1, total_amount="1.01"),
            order(2, quantity=3, total_amount="1.00"),
            order(3, quantity=4, status="cancelled", total_amount="50.00"),
            order(4, product_id=77, customer_id=88, total_amount="9.00"),
            order(5, ordered_at="2024-01-03 10:00:00", status="returned", total_amount="7.00"),
        ],
    )
    pays = payments(
        spark,
        [
            payment(1, 1, amount="3", paid_at="2024-01-04 00:00:00"),
            payment(2, 1, amount="4", paid_at="2024-01-05 00:00:00"),
            payment(3, 1, amount="5", paid_at="2024-01-05 00:00:00"),
            payment(4, 1, amount="6", paid_at=None),
        ],
    )
    return gold.orders_obt(o, customers(spark), products(spark), pays).cache()


def test_latest_payment_wins_ties_on_id_and_null_time_loses(obt):
    row = obt.where("order_id = 1").first()
    assert row.payment_amount == Decimal("5.00")
    assert len(obt.columns) == 19 and obt.count() == 5


def test_rejected_dimensions_leave_nulls(obt):
    row = obt.where("order_id = 4").first()
    assert row.product_category is None and row.customer_country is None


def test_daily_rollup(obt):
    rows = {(str(r.order_date), r.product_category): r for r in gold.revenue_daily(obt).collect()}
    toys = rows["2024-01-02", "toys"]
    assert (toys.order_count, toys.units_sold) == (3, 9)
    assert toys.gross_revenue == Decimal("2.01")
    assert toys.avg_order_value == Decimal("0.67")
    assert rows["2024-01-03", "toys"].gross_revenue == 0
    assert rows["2024-01-02", None].gross_revenue == Decimal("9.00")


def test_average_rounds_half_up_once(spark):
    o = silver_orders(spark, [order(1, total_amount="1.01"), order(2, quantity=3, total_amount="1.00")])
    out = gold.orders_obt(o, customers(spark), products(spark), payments(spark, [payment(1, 1)]))
    assert gold.revenue_daily(out).first().avg_order_value == Decimal("1.01")


def test_integrity_leaks_and_reconciliation(spark, obt):
    daily = gold.revenue_daily(obt)
    row = audit.gold_integrity(obt, daily, obt.select("order_id")).first()
    assert row.ok and row.obt_rows == 5 and row.daily_orders == 5
    assert not audit.gold_integrity(obt, daily, obt.select("order_id").where("order_id > 1")).first().ok
    assert {r.failure_key: r.leaked for r in audit.leak_checks(obt).collect()} == {
        k: 0
        for k in (
            "negative_price", "missing_customer", "invalid_quantity", "destructive_fix",
            "malformed_data", "orphan_payment", "duplicate_order",
        )
    }
    tables = {"gold_orders_obt": obt, "gold_revenue_daily": daily}
    named = intents.run_intent(tables, "revenue_by_category", limit=1000)
    bad = named.withColumn("order_count", named.order_count + 1)
    both = audit.reconcile(named, bad, ["product_category"], ["order_count"])
    assert both.count() == 2 and not any(r.agrees for r in both.collect())


def test_split_invariant_notices_loss_and_overlap(spark):
    bronze = orders(spark, [order(1), order(2, customer_id=None), order(3, quantity=9)])
    verdicts = classify_orders(bronze)
    good, bad = accepted(verdicts, "orders"), rejects(verdicts, "2024-01-01 00:00:00")
    row = audit.split_invariant(bronze, good, bad, "order_id").first()
    assert (row.bronze_rows, row.accepted_rows, row.rejected_rows, row.overlap, row.holds) == (3, 2, 1, 0, True)
    lost = audit.split_invariant(bronze, good.where("order_id <> 1"), bad, "order_id").first()
    assert not lost.holds
    overlap = audit.split_invariant(bronze, good, bronze, "order_id").first()
    assert overlap.overlap == 2 and not overlap.holds


def test_intent_filters_order_and_limit(obt):
    tables = {"gold_orders_obt": obt, "gold_revenue_daily": gold.revenue_daily(obt)}
    days = intents.run_intent(tables, "revenue_by_period", {"start_date": "2024-01-03", "end_date": None})
    assert [str(r.order_date) for r in days.collect()] == ["2024-01-03"]
    by = intents.run_intent(tables, "revenue_by_category", order_by="product_category desc").collect()
    assert [r.product_category for r in by] == ["toys", None]
    top = intents.run_intent(tables, "top_products", {"category": "toys"}, limit=1).collect()
    assert len(top) == 1 and top[0].gross_revenue == Decimal("2.01")
    late = intents.run_intent(tables, "order_status_breakdown").collect()
    assert late[0].status == "placed" and late[0].order_count == 3


@pytest.mark.parametrize(
    "call",
    [
        lambda t: intents.run_intent(t, "nope"),
        lambda t: intents.run_intent(t, "top_products", {"start_date": "2024-01-01"}),
        lambda t: intents.run_intent(t, "revenue_by_period", {"start_date": "yesterday"}),
        lambda t: intents.run_intent(t, "top_products", order_by="product_sku"),
        lambda t: intents.run_intent(t, "top_products", order_by="units_sold sideways"),
        lambda t: intents.run_intent(t, "top_products", limit=0),
        lambda t: intents.run_intent(t, "top_products", limit="many"),
        lambda t: intents.run_report(t, "nope"),
        lambda t: intents.schema_info(t, "raw_orders"),
        lambda t: intents.table_counts(t, ("raw_orders",)),
    ],
)
def test_bad_requests_are_refused(obt, call):
    with pytest.raises(intents.IntentError):
        call({"gold_orders_obt": obt, "gold_revenue_daily": obt})


def test_limit_clamp():
    assert intents.clamp_limit(None) == 100
    assert intents.clamp_limit(5000) == 1000
    assert intents.clamp_limit("7") == 7


def test_reports(obt):
    tables = {"gold_orders_obt": obt, "gold_revenue_daily": gold.revenue_daily(obt)}
    window = {"start_date": "2024-01-03"}
    sections = intents.run_report(tables, "executive_summary", window)
    assert list(sections) == ["by_category", "by_country", "top_products", "status_mix"]
    assert sections["by_category"].count() == 1 and sections["top_products"].count() == 2
    rows = intents.report_rows(tables, "daily_revenue").collect()
    assert [(r.section, r.rank) for r in rows if r.section == "trend"] == [("trend", 1), ("trend", 2)]
    names = {r.name for r in intents.intent_info(obt).collect()}
    assert names == {*intents.INTENTS, *intents.REPORTS}
    info = intents.schema_info(tables, "gold_orders_obt")
    assert info.count() == 19 and info.first().row_count == 5


def test_basket_join_counts_null_category_as_zero(obt):
    rows = basket.daily_with_orders(gold.revenue_daily(obt), obt).collect()
    assert {(str(r.order_date), r.product_category): r.orders for r in rows} == {
        ("2024-01-03", "toys"): 1,
        ("2024-01-02", "toys"): 3,
        ("2024-01-02", None): 0,
    }
    running = basket.running_revenue(gold.revenue_daily(obt)).collect()
    assert running[0].running == Decimal("2.01")


def test_portable_values(obt):
    row = portable(gold.revenue_daily(obt)).where("product_category = 'toys'").orderBy("order_date").first()
    assert (row.order_date, row.gross_revenue, row.avg_order_value) == ("2024-01-02", "2.01", "0.67")
    assert portable(obt).where("order_id = 1").first().ordered_at == "2024-01-02T10:00:00"


@pytest.mark.parametrize("limit", [2.7, True, "2.7", "x", [1]])
def test_a_limit_that_is_no_whole_number_is_refused(limit):
    with pytest.raises(intents.IntentError):
        intents.clamp_limit(limit)
