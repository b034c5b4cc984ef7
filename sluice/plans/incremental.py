"""Order verdicts and gold tables kept current batch by batch.

Raw orders are partitioned by ranges of their key, so that an upsert knows which rows it replaces.
Everything after that is partitioned by the order's day or month, which is part of the business
key: duplicates never cross a partition, and a batch reads and rewrites only the partitions its
old and new rows lie in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import gold
from sluice.operators.classify import accepted, classify_orders, classify_payments, rejects
from sluice.operators.deltas import merge_revenue, revenue_deltas, row_changes
from sluice.operators.ingest import latest_per_key
from sluice.operators.refresh import affected_orders
from sluice.session import remove
from sluice.sources.layers import PartitionedTable, calendar, exists, key_range

RANGE_WIDTH = 10_000_000


def _without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select(F.col("order_id").alias("_gone")).distinct()
    return rows.join(gone, F.col("order_id") == F.col("_gone"), "left_anti")


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    here = ids.select(F.col("order_id").alias("_here")).distinct()
    return rows.join(here, F.col("order_id") == F.col("_here"), "left_semi")


class GoldTables:
    """The order table and the groups of the daily table, changed by the orders of a batch.

    The three sources give accepted customers, accepted products and raw payments as they are when
    a batch is applied.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        customers: Callable[[], DataFrame],
        products: Callable[[], DataFrame],
        payments: Callable[[], DataFrame],
        grain: str = "day",
    ):
        self.spark = spark
        self.customers, self.products, self.payments = customers, products, payments
        self.obt = PartitionedTable(spark, f"{root}/gold_orders_obt", calendar("ordered_at", grain))
        self.groups = PartitionedTable(spark, f"{root}/gold_revenue_groups", calendar("order_date", grain))

    def daily(self) -> DataFrame:
        return gold.finish_daily(self.groups.rows())

    def apply(self, before: DataFrame, after: DataFrame, stage: str) -> None:
        """Replace the rows of some orders: accepted before, and accepted now.

        The daily groups get signed deltas, and a delta must not be applied twice: a complete
        stage of a step is used again when the batch is repeated.
        """
        ids = before.select("order_id").unionByName(after.select("order_id"))
        parts = self.obt.parts(before, after)
        near = self.obt.rows(parts)
        own = _only(self.payments(), ids)
        paid = accepted(classify_payments(own, after), "payments")
        now = gold.orders_obt(after, self.customers(), self.products(), paid)
        now = self._keep(now, f"{stage}/obt-after")
        was = now.limit(0) if near is None else _only(near, ids)
        was = self._keep(was, f"{stage}/obt-before")

        deltas = revenue_deltas(row_changes(was, now, "order_id"))
        groups = self.groups.rows(parts)
        groups = gold.revenue_groups(now.limit(0)) if groups is None else groups
        self.groups.replace(merge_revenue(groups, deltas), parts, f"{stage}/groups")
        if near is None:
            # What was kept is already the stage.
            self.obt.replace(now, parts, f"{stage}/obt-after")
        else:
            self.obt.replace(self.obt.with_new(_without(near, ids), now), parts, f"{stage}/obt")

    def _keep(self, df: DataFrame, path: str) -> DataFrame:
        if not exists(self.spark, f"{path}/_SUCCESS"):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


class OrderTables:
    """Raw orders, their verdicts, and gold if it is given.

    Accepted and rejected rows are filters on verdicts. A verdict row never leaves the table, it
    changes, so refreshing is a replacement too.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        width: int = RANGE_WIDTH,
        grain: str = "day",
        gold_tables: GoldTables | None = None,
    ):
        self.spark = spark
        self.root = root.rstrip("/")
        self.gold = gold_tables
        self.raw = PartitionedTable(spark, f"{self.root}/raw_orders", key_range("order_id", width))
        self.verdicts = PartitionedTable(
            spark, f"{self.root}/classified_orders", calendar("ordered_at", grain)
        )

    def silver(self) -> DataFrame:
        return accepted(self.verdicts.rows(), "orders")

    def rejects(self, run_ts: str) -> DataFrame:
        return rejects(self.verdicts.rows(), run_ts)

    def _keep(self, df: DataFrame, path: str) -> DataFrame:
        if not exists(self.spark, f"{path}/_SUCCESS"):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Take one batch of raw orders in. Replaying a batch changes nothing.

        Every step is staged below the batch's folder before it changes a table, and a replay uses
        what is complete there; the folder goes when the next batch comes.
        """
        stage = f"{self.root}/stage/batch={batch_id}"
        remove(self.spark, f"{self.root}/stage/batch={batch_id - 1}")
        rows = self._keep(latest_per_key(batch, "order_id"), f"{stage}/rows")
        known = self.raw.rows(self.raw.parts(rows))
        old = self._keep(rows.limit(0) if known is None else _only(known, rows), f"{stage}/old")
        self.raw.upsert(rows, "order_id", f"{stage}/raw", unique=True)

        parts = self.verdicts.parts(rows, old)
        near = self.verdicts.rows(parts)
        raw_now = rows if near is None else _without(near.select(*rows.columns), rows).unionByName(rows)
        affected = affected_orders(raw_now, near, rows)
        verdicts = self._keep(classify_orders(affected), f"{stage}/verdicts")
        was = verdicts.limit(0) if near is None else _only(near, verdicts)
        was = self._keep(was.select(*verdicts.columns), f"{stage}/before")
        if near is None:
            # What was kept is already the stage.
            self.verdicts.replace(verdicts, parts, f"{stage}/verdicts")
        else:
            others = _without(near, verdicts).select(*verdicts.columns)
            merged = self.verdicts.with_new(others, verdicts)
            self.verdicts.replace(merged, parts, f"{stage}/merged")
        if self.gold is not None:
            self.gold.apply(accepted(was, "orders"), accepted(verdicts, "orders"), f"{stage}/gold")

    def payments_changed(self, payments: DataFrame, batch_id: int) -> None:
        """Bring gold up to date after payments of some orders came or changed.

        The orders' days are found in the key ranges of the raw table, so that only their
        partitions are read.
        """
        stage = f"{self.root}/stage/payments={batch_id}"
        remove(self.spark, f"{self.root}/stage/payments={batch_id - 1}")
        ids = payments.select("order_id").where(F.col("order_id").isNotNull()).distinct()
        raw = self.raw.rows(self.raw.parts(ids))
        if raw is None or self.gold is None:
            return
        found = self._keep(_only(raw, ids).select("order_id", "ordered_at"), f"{stage}/orders")
        rows = accepted(_only(self.verdicts.rows(self.verdicts.parts(found)), found), "orders")
        self.gold.apply(rows, rows, f"{stage}/gold")
