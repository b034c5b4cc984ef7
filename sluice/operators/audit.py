"""Checks over the layers: split invariant, rule counts, baseline rules, gold integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.schemas import BUSINESS_KEY, ORDER_STATUSES, ORPHAN_ORDER_ID


def stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def split_invariant(bronze: DataFrame, accepted: DataFrame, rejects: DataFrame, key: str) -> DataFrame:
    """Accepted plus rejected is bronze, and no key is both."""

    def tagged(df: DataFrame, side: str) -> DataFrame:
        marks = [F.lit(1 if side == s else 0).alias(s) for s in ("b", "a", "r")]
        return df.select(key, *marks)

    sides = stack([tagged(bronze, "b"), tagged(accepted, "a"), tagged(rejects, "r")])
    per_key = sides.groupBy(key).agg(*[F.sum(s).alias(s) for s in ("b", "a", "r")])
    totals = per_key.agg(
        F.sum("b").alias("bronze_rows"),
        F.sum("a").alias("accepted_rows"),
        F.sum("r").alias("rejected_rows"),
        F.count_if((F.col("a") > 0) & (F.col("r") > 0)).alias("overlap"),
        F.count_if(F.col("b") != F.col("a") + F.col("r")).alias("unbalanced"),
    )
    return totals.select(
        "bronze_rows",
        "accepted_rows",
        "rejected_rows",
        "overlap",
        ((F.col("overlap") == 0) & (F.col("unbalanced") == 0)).alias("holds"),
    )


def reject_histogram(rejects: DataFrame) -> DataFrame:
    """Rows per rule, and how many of them lack a reason."""
    blank = F.col("reject_reason").isNull() | (F.trim("reject_reason") == "")
    return rejects.groupBy("reject_rule").agg(
        F.count("*").alias("rows"), F.count_if(blank).alias("blank_reasons")
    )


def _rule(df: DataFrame, name: str, scope: Column, broken: Column) -> list[Column]:
    return [
        F.count_if(scope).alias(f"{name}|checked"),
        F.count_if(scope & F.coalesce(broken, F.lit(False))).alias(f"{name}|violations"),
    ]


def _as_rows(one_row: DataFrame, names: list[str]) -> DataFrame:
    items = [
        F.struct(
            F.lit(n).alias("rule"),
            F.col(f"`{n}|checked`").alias("checked"),
            F.col(f"`{n}|violations`").alias("violations"),
        )
        for n in names
    ]
    return one_row.select(F.explode(F.array(*items)).alias("r")).select("r.*")


def _repeated(df: DataFrame, col: str, name: str) -> DataFrame:
    groups = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    return groups.select(
        F.lit(name).alias("rule"), "n"
    ).groupBy("rule").agg(F.sum("n").alias("checked"), F.count_if(F.col("n") > 1).alias("violations"))


def baseline_audit(
    customers: DataFrame, products: DataFrame, orders: DataFrame, payments: DataFrame
) -> DataFrame:
    """The rules a clean baseline keeps, as (rule, checked, violations).

    One pass per table; for the uniqueness rules a violation is a repeated value.
    """
    cost, price = F.col("cost"), F.col("unit_price")
    in_band = (cost * 100 >= price * 45) & (cost * 100 <= price * 80)
    product_rules = _as_rows(
        products.agg(
            *_rule(products, "cost_45_to_80_percent", cost.isNotNull() & price.isNotNull(), ~in_band)
        ),
        ["cost_45_to_80_percent"],
    )

    signup = customers.select("customer_id", F.col("created_at").alias("_signup"))
    dated = orders.join(signup, "customer_id", "left")
    order_rules = _as_rows(
        dated.agg(
            *_rule(
                dated,
                "signup_before_order",
                F.col("_signup").isNotNull(),
                F.col("_signup") > F.col("ordered_at"),
            ),
            *_rule(
                dated,
                "total_is_price_times_quantity",
                F.col("total_amount").isNotNull() & price.isNotNull() & F.col("quantity").isNotNull(),
                F.col("total_amount") != price * F.col("quantity"),
            ),
        ),
        ["signup_before_order", "total_is_price_times_quantity"],
    )

    placed = orders.select(
        "order_id", F.col("ordered_at").alias("_ordered"), F.col("status").alias("_order_status")
    )
    paid = payments.join(placed, "order_id", "left")
    payment_rules = _as_rows(
        paid.agg(
            *_rule(
                paid,
                "order_before_payment",
                F.col("_ordered").isNotNull(),
                F.col("_ordered") > F.col("paid_at"),
            ),
            *_rule(
                paid,
                "returned_is_refunded",
                F.col("_order_status") == "returned",
                F.col("status") != "refunded",
            ),
        ),
        ["order_before_payment", "returned_is_refunded"],
    )
    return stack(
        [
            product_rules,
            order_rules,
            payment_rules,
            _repeated(customers, "email", "email_is_unique"),
            _repeated(products, "sku", "sku_is_unique"),
        ]
    )


def gold_integrity(obt: DataFrame, daily: DataFrame, silver_orders: DataFrame) -> DataFrame:
    """Grain, row counts and sign checks of the gold tables in one row."""
    sides = stack(
        [
            obt.select("order_id", F.lit(1).alias("g"), F.lit(0).alias("s")),
            silver_orders.select("order_id", F.lit(0).alias("g"), F.lit(1).alias("s")),
        ]
    )
    per_order = sides.groupBy("order_id").agg(F.sum("g").alias("g"), F.sum("s").alias("s"))
    grain = per_order.agg(
        F.sum("g").alias("obt_rows"),
        F.sum("s").alias("silver_rows"),
        F.count_if(F.col("g") > 1).alias("repeated_orders"),
        F.count_if((F.col("g") > 0) != (F.col("s") > 0)).alias("unmatched_orders"),
    )
    days = daily.agg(
        F.count("*").alias("daily_rows"),
        F.coalesce(F.sum("order_count"), F.lit(0)).alias("daily_orders"),
        F.count_if(F.col("gross_revenue") < 0).alias("negative_days"),
    )
    joined = grain.withColumn("_one", F.lit(1)).join(days.withColumn("_one", F.lit(1)), "_one")
    return joined.drop("_one").withColumn(
        "ok",
        (F.col("obt_rows") == F.col("silver_rows"))
        & (F.col("obt_rows") == F.col("daily_orders"))
        & (F.col("repeated_orders") == 0)
        & (F.col("unmatched_orders") == 0)
        & (F.col("negative_days") == 0),
    )


def duplicate_keys(obt: DataFrame) -> DataFrame:
    """Business keys that occur more than once in gold."""
    groups = obt.groupBy(*BUSINESS_KEY).agg(F.count("*").alias("rows"))
    return groups.where(F.col("rows") > 1)


def leak_checks(obt: DataFrame) -> DataFrame:
    """Rows in gold that a defect rule should have kept out, per failure key."""
    worth = F.col("quantity") * F.col("unit_price")
    predicates = {
        "negative_price": (F.col("unit_price") < 0) | (F.col("total_amount") < 0),
        "missing_customer": F.col("customer_id").isNull(),
        "invalid_quantity": F.col("quantity") <= 0,
        "destructive_fix": (F.col("total_amount") == 0) & (worth > 0),
        "malformed_data": ~F.col("status").isin(*ORDER_STATUSES),
        "orphan_payment": F.col("order_id") == ORPHAN_ORDER_ID,
    }
    counts = obt.agg(*[F.count_if(p).alias(k) for k, p in predicates.items()])
    pairs = [F.struct(F.lit(k).alias("failure_key"), F.col(k).alias("leaked")) for k in predicates]
    by_row = counts.select(F.explode(F.array(*pairs)).alias("r")).select("r.*")
    doubled = duplicate_keys(obt).agg(
        F.lit("duplicate_order").alias("failure_key"), F.count("*").alias("leaked")
    )
    return by_row.unionByName(doubled)


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Compare two aggregates key by key; NULL keys match each other."""
    named = left.select(*keys, *[F.col(m).alias(f"{m}_named") for m in measures])
    direct = right.select(
        *[F.col(k).alias(f"_{k}") for k in keys], *[F.col(m).alias(f"{m}_direct") for m in measures]
    )
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    same = reduce(
        lambda a, b: a & b,
        [F.col(f"{m}_named").eqNullSafe(F.col(f"{m}_direct")) for m in measures],
    )
    values = [f"{m}_{side}" for m in measures for side in ("named", "direct")]
    return named.join(direct, match, "full_outer").select(
        *[F.coalesce(k, f"_{k}").alias(k) for k in keys], *values, same.alias("agrees")
    )
