import random

import pytest
from helpers import order, orders, payment, payments, rules

from sluice.operators.classify import accepted, classify_orders, classify_payments
from sluice.operators.ingest import upsert
from sluice.operators.refresh import (
    affected_orders,
    append_only_new,
    evict_reprocessed,
    refresh,
    transition_report,
)

T0, T1 = "2024-01-05 10:00:00", "2024-01-06 10:00:00"


def rows(df):
    return sorted(tuple(r) for r in df.select("order_id", "total_amount", "_ingested_at").collect())


def test_evict_and_append(spark):
    before = accepted(classify_orders(orders(spark, [order(1), order(2, quantity=3), order(3, quantity=4)])), "orders")
    now = orders(
        spark,
        [
            order(1),
            order(2, quantity=3, total_amount="0.00", ingested=T1),
            order(3, quantity=4, ingested=T1),
            order(4, quantity=5, ingested=T1),
        ],
    )
    kept = evict_reprocessed(before, now, "order_id")
    assert [r.order_id for r in kept.collect()] == [1]
    candidates = accepted(classify_orders(now), "orders")
    added = append_only_new(candidates, kept, "order_id")
    assert sorted(r.order_id for r in added.collect()) == [3, 4]


def test_reference_mode_keeps_payments_of_a_rejected_order(spark):
    pays = payments(spark, [payment(1, 1), payment(2, 2)])
    first = orders(spark, [order(1), order(2, quantity=3)])
    second = orders(spark, [order(1, total_amount="0.00", ingested=T1), order(2, quantity=3)])
    before = accepted(classify_payments(pays, accepted(classify_orders(first), "orders")), "payments")
    verdicts = classify_payments(pays, accepted(classify_orders(second), "orders"))
    reference = refresh(before, verdicts, "payments", "payment_id", "reference")
    strict = refresh(before, verdicts, "payments", "payment_id", "strict")
    assert sorted(r.payment_id for r in reference.collect()) == [1, 2]
    assert sorted(r.payment_id for r in strict.collect()) == [2]


def test_first_run_is_a_full_build_and_modes_are_checked(spark):
    verdicts = classify_orders(orders(spark, [order(1), order(2, customer_id=None)]))
    assert refresh(None, verdicts, "orders", "order_id").count() == 1
    with pytest.raises(ValueError):
        refresh(None, verdicts, "orders", "order_id", "loose")


def random_order(rng, order_id, stamp):
    return order(
        order_id,
        customer_id=rng.choice([1, 1, None]),
        quantity=rng.choice([1, 2, -5]),
        total_amount=rng.choice(["20.00", "0.00"]),
        status=rng.choice(["placed", "placed", "junk"]),
        ingested=stamp,
    )


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_strict_refresh_equals_full_rebuild(spark, seed):
    rng = random.Random(seed)
    raw = orders(spark, [random_order(rng, i, T0) for i in range(1, 30)])
    silver = accepted(classify_orders(raw), "orders")
    for step in (6, 7):
        stamp = f"2024-01-{step:02d} 10:00:00"
        ids = rng.sample(range(1, 40), 12)
        batch = orders(spark, [random_order(rng, i, stamp) for i in ids])
        raw = upsert(raw, batch, "order_id")
        silver = refresh(silver, classify_orders(raw), "orders", "order_id", "strict")
    assert rows(silver) == rows(accepted(classify_orders(raw), "orders"))


@pytest.mark.parametrize("seed", [4, 5])
def test_reclassifying_only_affected_rows_equals_reclassifying_all(spark, seed):
    rng = random.Random(seed)
    before = orders(spark, [random_order(rng, i, T0) for i in range(1, 40)])
    batch = orders(spark, [random_order(rng, i, T1) for i in rng.sample(range(1, 50), 8)])
    raw = upsert(before, batch, "order_id")
    old = rules(classify_orders(before), "order_id")
    partial = rules(classify_orders(affected_orders(raw, before, batch)), "order_id")
    assert {**old, **partial} == rules(classify_orders(raw), "order_id")


def test_transitions(spark):
    before = classify_orders(orders(spark, [order(1), order(2, customer_id=None), order(3, quantity=7)]))
    after = classify_orders(
        orders(spark, [order(1, quantity=-5), order(2, quantity=6), order(3, quantity=7), order(4, quantity=8)])
    )
    got = {r.order_id: r.transition for r in transition_report(before, after, "order_id").collect()}
    assert got == {1: "accepted_to_rejected", 2: "rejected_to_accepted", 3: "unchanged", 4: "new"}


def test_a_group_of_many_copies_adds_only_its_first_rows(spark):
    before = orders(spark, [order(i) for i in range(10, 60)])
    batch = orders(spark, [order(10, quantity=9, ingested=T1), order(99, ingested=T1)])
    raw = upsert(before, batch, "order_id")
    affected = affected_orders(raw, before, batch)
    assert sorted(r.order_id for r in affected.collect()) == [10, 11, 99]
    assert rules(classify_orders(affected), "order_id") == {10: None, 11: None, 99: "duplicate_order"}
