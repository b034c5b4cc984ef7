"""One verdict per row: the first matching rule, or none for an accepted row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.expressions import days_between, null_or_blank, outside, quoted, shown, ts
from sluice.schemas import BUSINESS_KEY, ENTITIES, LATE_DAYS, ORDER_STATUSES, PAYMENT_STATUSES

# A rule is (name, condition, reason). Their order decides which one is reported.
Rule = tuple[str, Column, Column]


def bronze(raw: DataFrame, entity: str) -> DataFrame:
    """The raw table, column by column."""
    spec = ENTITIES[entity]
    return raw.select(*spec.column_names, *spec.lineage)


def _apply(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    verdict = reason = None
    for name, condition, text in rules:
        verdict = F.when(condition, name) if verdict is None else verdict.when(condition, name)
        reason = F.when(condition, text) if reason is None else reason.when(condition, text)
    return df.withColumns({"reject_rule": verdict, "reject_reason": reason})


def _required(pk: str, text_columns: Sequence[str]) -> list[Rule]:
    rules = [("malformed_data", F.col(pk).isNull(), F.lit(f"{pk} is null"))]
    for col in text_columns:
        rules.append(("malformed_data", null_or_blank(col), F.lit(f"{col} is null/blank")))
    return rules


def _money(col: str) -> Rule:
    bad = F.col(col).isNull() | (F.col(col) < 0)
    return ("negative_price", bad, F.lit(f"{col} < 0 or null"))


def classify_customers(df: DataFrame) -> DataFrame:
    return _apply(df, _required("customer_id", ["full_name", "email", "country", "segment"]))


def classify_products(df: DataFrame) -> DataFrame:
    required = _required("product_id", ["sku", "category"])
    return _apply(df, [*required, _money("unit_price"), _money("cost")])


def mark_duplicates(df: DataFrame, pk: str = "order_id", flag: str = "_duplicate") -> DataFrame:
    """True on every row but the lowest key of its business-key group.

    A window over the group would sort it in one task, and one group may hold a third
    of the table (NULLs group together). The minimum combines before the shuffle, and
    the join back is on the unique key. A row without a key is no duplicate.
    """
    first = df.groupBy(*BUSINESS_KEY).agg(F.min(pk).alias(pk))
    marked = df.join(first.select(pk, F.lit(True).alias("_first")), pk, "left")
    return marked.withColumn(flag, F.col("_first").isNull() & F.col(pk).isNotNull()).drop("_first")


def classify_orders(df: DataFrame) -> DataFrame:
    """Six rules in order. NULL money is no defect here, unlike for products."""
    worth = F.col("quantity") * F.col("unit_price")
    money = F.concat(
        F.lit("negative money: unit_price="),
        shown(F.col("unit_price")),
        F.lit(" total_amount="),
        shown(F.col("total_amount")),
    )
    rules: list[Rule] = [
        (
            "missing_customer",
            F.col("customer_id").isNull(),
            F.lit("customer_id is null (orphaned order)"),
        ),
        (
            "invalid_quantity",
            F.col("quantity").isNull() | (F.col("quantity") <= 0),
            F.concat(
                F.lit("quantity "), shown(F.col("quantity")), F.lit(" violates quantity > 0")
            ),
        ),
        ("negative_price", (F.col("unit_price") < 0) | (F.col("total_amount") < 0), money),
        (
            "destructive_fix",
            (F.col("total_amount") == 0) & (worth > 0),
            F.concat(F.lit("total_amount=0 while quantity*unit_price="), worth.cast("string")),
        ),
        (
            "malformed_data",
            outside("status", ORDER_STATUSES),
            F.concat(F.lit("status "), quoted("status"), F.lit(" not in known ORDER_STATUSES")),
        ),
        (
            "duplicate_order",
            F.col("_duplicate"),
            F.lit("duplicate of an earlier order on the full business key"),
        ),
    ]
    return _apply(mark_duplicates(df), rules).drop("_duplicate")


def payment_rules(known: Column) -> list[Rule]:
    """Three rules in order; the first asks for ``known``, whether the order was accepted."""
    return [
        (
            "orphan_payment",
            ~known,
            F.concat(
                F.lit("order_id "),
                shown(F.col("order_id")),
                F.lit(" has no accepted silver_orders match"),
            ),
        ),
        (
            "negative_price",
            F.col("amount").isNull() | (F.col("amount") < 0),
            F.concat(F.lit("amount "), shown(F.col("amount")), F.lit(" < 0")),
        ),
        (
            "malformed_data",
            outside("status", PAYMENT_STATUSES),
            F.concat(F.lit("status "), quoted("status"), F.lit(" not in known PAYMENT_STATUSES")),
        ),
    ]


def classify_payments(df: DataFrame, accepted_orders: DataFrame) -> DataFrame:
    """Orphan test first; it needs the accepted orders.

    Orphans may all name one order id. Both sides are plain shuffles, so AQE splits it.
    """
    known = accepted_orders.select("order_id", F.lit(True).alias("_known"))
    marked = df.join(known, "order_id", "left")
    out = _apply(marked, payment_rules(F.col("_known").isNotNull())).drop("_known")
    return out.select(*df.columns, "reject_rule", "reject_reason")


def judged_payments(marked: DataFrame, known: str) -> DataFrame:
    """Verdicts of payments on which a join has left ``known``, NULL without an order."""
    return _apply(marked, payment_rules(F.col(known).isNotNull()))


def late_flag() -> Column:
    """More than seven calendar-day boundaries between the event and its ingest."""
    return days_between("_ingested_at", "ordered_at") > LATE_DAYS


def accepted(classified: DataFrame, entity: str) -> DataFrame:
    """Silver: rows without a verdict."""
    return classified.where(F.col("reject_rule").isNull()).select(*silver_columns(entity))


def silver_columns(entity: str) -> list[Column]:
    """Columns of an accepted row, made from a classified one."""
    columns = [F.col(c) for c in (*ENTITIES[entity].column_names, "_ingested_at")]
    if entity == "orders":
        columns += [F.col("_schema_drift"), late_flag().alias("is_late")]
    return columns


def rejects(classified: DataFrame, run_ts: str) -> DataFrame:
    """Quarantine: rows with a verdict, all their columns, and the rejection time."""
    source = [c for c in classified.columns if c not in ("reject_rule", "reject_reason")]
    return classified.where(F.col("reject_rule").isNotNull()).select(
        *source, "reject_reason", "reject_rule", ts(run_ts).alias("rejected_at")
    )
