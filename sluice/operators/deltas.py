"""Signed changes of rows, and a daily rollup maintained by them.

An aggregate of counts and sums does not need its rows again when some of them change: what a
changed row was is taken off its group, what it is now is added to its group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.expressions import realised


def row_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``sign`` and ``row``: -1 with what a changed row was, +1 with what it is.

    Inserts have only the second, evictions only the first, and unchanged rows neither. Keys
    are unique on both sides, so the join is one row each.
    """
    columns = [F.col(c) for c in after.columns]
    was = before.select(F.col(key).alias("_was_key"), F.struct(*columns).alias("was"))
    now = after.select(F.col(key).alias("_now_key"), F.struct(*columns).alias("now"))
    both = was.join(now, F.col("_was_key") == F.col("_now_key"), "full_outer")
    signed = lambda sign, row: F.when(
        F.col(row).isNotNull(), F.struct(F.lit(sign).alias("sign"), F.col(row).alias("row"))
    )
    pair = F.array_compact(F.array(signed(-1, "was"), signed(1, "now")))
    changed = both.where(~F.col("was").eqNullSafe(F.col("now")))
    return changed.select(F.explode(pair).alias("x")).select("x.sign", "x.row")


def revenue_deltas(changes: DataFrame) -> DataFrame:
    """What signed order rows add to the groups of ``gold.revenue_groups``."""
    rows = changes.select("sign", "row.*")
    value = realised()
    signed = rows.select(
        F.to_date("ordered_at").alias("order_date"),
        "product_category",
        "sign",
        (F.col("sign") * F.col("quantity")).alias("units"),
        F.when(F.col("sign") < 0, -value).otherwise(value).alias("value"),
        F.when(value.isNotNull(), F.col("sign")).otherwise(0).alias("valued"),
    )
    return signed.groupBy("order_date", "product_category").agg(
        F.sum("sign").alias("order_count"),
        F.sum("units").alias("units_sold"),
        F.sum("value").alias("gross_revenue"),
        F.sum("valued").alias("_valued"),
    )


def merge_revenue(groups: DataFrame, deltas: DataFrame) -> DataFrame:
    """The groups with the deltas in them. A group without orders is gone."""
    kinds = dict(groups.dtypes)
    merged = (
        groups.unionByName(deltas.select(*[F.col(c).cast(kinds[c]).alias(c) for c in groups.columns]))
        .groupBy("order_date", "product_category")
        .agg(
            F.sum("order_count").alias("order_count"),
            F.sum("units_sold").alias("units_sold"),
            # A sum over no values is NULL, not zero.
            F.when(F.sum("_valued") > 0, F.sum("gross_revenue")).alias("gross_revenue"),
            F.sum("_valued").alias("_valued"),
        )
        .where("order_count > 0")
    )
    return merged.select(*[F.col(c).cast(kinds[c]).alias(c) for c in groups.columns])
