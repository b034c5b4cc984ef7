"""Running totals, ranks and exact percentiles that never pull a group into one task.

A window over a group sorts the whole group in one task, and an exact percentile
aggregate keeps all distinct values of the group in one buffer. Both break when one
group holds a third of the rows. Here rows are range-partitioned on group and order
together, so a hot group spreads over many partitions; only one total per
(group, partition) is then summed up in order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.expressions import round_to
from sluice.session import ensure_checkpointing


def running_total(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], weight: Column
) -> DataFrame:
    """Add ``running`` (inclusive running sum in the group) and ``group_total``.

    ``order`` must be total within a group, so that no tie has to stay together.
    """
    ensure_checkpointing(df.sparkSession)
    weighted = df.withColumn("_weight", weight.cast("bigint"))
    placed = weighted.repartitionByRange(*[F.col(c) for c in by], *order)
    # Both uses below must see one and the same placement, also after a lost
    # executor; a reliable checkpoint fixes it.
    placed = placed.withColumn("_chunk", F.spark_partition_id()).checkpoint()

    chunks = placed.groupBy(*by, "_chunk").agg(F.sum("_weight").alias("_chunk_weight"))
    across = Window.partitionBy(*by)
    earlier = across.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.col("_chunk").alias("_chunk_id"),
        F.coalesce(F.sum("_chunk_weight").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_chunk_weight").over(across).alias("group_total"),
    )
    match = reduce(
        lambda a, b: a & b,
        [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by],
        F.col("_chunk") == F.col("_chunk_id"),
    )
    inside = (
        Window.partitionBy(*by, "_chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        placed.join(chunks, match)
        .withColumn("running", F.sum("_weight").over(inside) + F.col("_before"))
        .drop("_weight", "_chunk", "_chunk_id", "_before", *[f"_by_{c}" for c in by])
    )


def ordinal(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """1-based position of each row in its group, for a total order."""
    ranked = running_total(df, by, order, F.lit(1))
    return ranked.withColumnRenamed("running", name).drop("group_total")


def _picked(position: Column, value: str) -> Column:
    """Value standing at a 0-based position of the sorted group."""
    start = F.col("running") - F.col("_n")
    return F.max(F.when((start <= position) & (position < F.col("running")), F.col(value)))


def _counts_in_order(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    return running_total(counted, by, [F.asc(value)], F.col("_n"))


def percentiles(
    df: DataFrame, by: Sequence[str], value: str, points: dict[str, float]
) -> DataFrame:
    """Exact percentiles with linear interpolation between neighbours.

    One row per group: the group columns, ``n``, and one column per point.
    """
    ranked = _counts_in_order(df, by, value)
    last = F.col("group_total") - 1
    aggs = []
    for name, p in points.items():
        target = last * F.lit(float(p))
        low = F.floor(target)
        aggs += [
            _picked(low, value).alias(f"_lo_{name}"),
            _picked(F.least(low + 1, last), value).alias(f"_hi_{name}"),
            F.max(target - low).alias(f"_part_{name}"),
        ]
    found = ranked.groupBy(*by).agg(F.max("group_total").alias("n"), *aggs)
    return found.select(
        *by,
        "n",
        *[
            (
                F.col(f"_lo_{name}")
                + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_part_{name}")
            ).alias(name)
            for name in points
        ],
    )


def nearest_rank(
    df: DataFrame, by: Sequence[str], value: str, points: dict[str, float], digits: int = 2
) -> DataFrame:
    """Nearest-rank percentiles; the rank is rounded half to even."""
    ranked = _counts_in_order(df, by, value)
    last = F.col("group_total") - 1
    aggs = []
    for name, p in points.items():
        rank = F.bround(F.lit(p / 100.0) * F.col("group_total") + F.lit(0.5), 0).cast("bigint")
        spot = F.greatest(F.lit(0).cast("bigint"), F.least(last, rank - 1))
        aggs.append(round_to(_picked(spot, value), digits).alias(name))
    return ranked.groupBy(*by).agg(F.max("group_total").alias("n"), *aggs)
