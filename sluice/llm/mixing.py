"""Mixing sources to target weights by weighted fair queueing.

Every document of a source, in hash-shuffled order and over as many passes as the cap
allows, gets a virtual finish time: the source's tokens up to and including it, divided by
the source's target. All entries are sorted by that time over all sources, and the mix is
what fits into the total budget. Both running sums are distributed: rows are range-placed
on (source, shuffle) and on time, so a source that holds a third of the rows spreads over
many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.ranking import running_total
from sluice.llm.common import SPACE, keep

WEIGHTS = (5, 2, 1)
SHARE = 1.5
PASSES = 2


def n_words(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}|{SPACE}\z", "")
    return F.when(F.length(trimmed) == 0, 0).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = PASSES
) -> DataFrame:
    """Add ``weight`` and ``target`` to one row per source (``source``, ``source_size``).

    Weights repeat along the sources in code-point order, null last. The targets share
    ``share`` times all sizes by weight; none passes ``cap`` times its source's size, and
    what is over is shared anew by weight among the rest. That is the water level L with
    sum(min(cap * size, L * weight)) = total: with sources in order of cap over weight,
    the first whose own level is not below the level that the rest would get fixes it.
    """
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("_n") % len(weights) + 1)
    everything = Window.partitionBy()
    in_order = everything.orderBy(F.asc_nulls_last("source"))
    ranked = sizes.withColumn("_n", F.row_number().over(in_order) - 1).select(
        "source", "source_size", pick.alias("weight")
    )
    full = F.col("source_size") * cap
    by_level = everything.orderBy(full / F.col("weight"), F.asc_nulls_last("source"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(share)
    spent = F.coalesce(F.sum(full).over(before), F.lit(0))
    level = (total - spent) / F.sum("weight").over(rest)
    levelled = ranked.withColumn("_level", level)
    fits = F.when(full >= F.col("_level") * F.col("weight"), F.col("_level"))
    levelled = levelled.withColumn("_level", F.max(fits).over(everything))
    target = F.least(full.cast("double"), F.coalesce(F.col("_level") * F.col("weight"), full.cast("double")))
    return levelled.select("source", "source_size", "weight", target.alias("target"))


def mix(
    docs: DataFrame,
    source: str = "source",
    text: str = "text",
    key: str = "doc_id",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    passes: int = PASSES,
    carry_text: bool = False,
) -> DataFrame:
    """How many words the mix takes of every document; one output row per input row.

    Returns ``row`` (the input columns, the text only if ``carry_text``), ``size``, ``source_size``,
    ``target`` and ``taken`` (a multiple of the size, up to ``passes`` times). The shuffle
    is a hash of key and text, so reruns agree; equal rows are interchangeable. A null
    source is a source of its own. A document without words is never taken; a source
    without any has the target 0.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if carry_text or c != text])
    digest = F.md5(
        F.concat_ws("|", F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit("")))
    )
    full = docs.select(
        rest.alias("row"),
        F.col(f"`{source}`").alias("source"),
        n_words(F.col(f"`{text}`")).alias("size"),
        digest.alias("shuffle"),
    )
    # With the texts the table is read once more at the end rather than staged.
    sized = keep(full.drop("row") if carry_text else full, "mix-sizes")
    share_of = targets(
        sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, passes
    )
    share_of = keep(share_of, "mix-targets").withColumnRenamed("source", "_source")

    # One running sum per source over its first pass; later passes add whole source sizes.
    # Equal rows (same key and text) are summed up first, so that the order is total.
    groups = sized.where(F.col("size") > 0).groupBy("source", "shuffle", "size").agg(F.count("*").alias("copies"))
    first = running_total(
        groups, ["source"], [F.asc("shuffle"), F.asc("size")], F.col("size") * F.col("copies")
    )
    first = first.join(share_of, F.col("source").eqNullSafe(F.col("_source")))
    entries = first.select(
        "source",
        "shuffle",
        "size",
        "copies",
        F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("lap"),
        "running",
        "source_size",
        "target",
    ).withColumn(
        "finish", (F.col("running") + F.col("lap") * F.col("source_size")) / F.col("target")
    )
    queue = keep(entries.select("source", "shuffle", "size", "copies", "lap", "finish"), "mix-queue")
    budget = share_of.agg(F.sum("target").alias("b")).scalar()
    order = [F.asc("finish"), F.asc_nulls_last("source"), F.asc("shuffle"), F.asc("size"), F.asc("lap")]
    served = running_total(queue, [], order, F.col("size") * F.col("copies"))
    # The entry that crosses the budget still counts: a source ends within one entry of its target.
    taken = served.where(F.col("running") - F.col("size") * F.col("copies") < budget)
    laps = taken.groupBy("source", "shuffle", "size").agg(F.count("*").alias("laps"))

    laps = laps.select(
        F.col("source").alias("_s"), F.col("shuffle").alias("_h"), F.col("size").alias("_z"), "laps"
    )
    out = (full if carry_text else sized).join(
        laps,
        F.col("source").eqNullSafe(F.col("_s"))
        & (F.col("shuffle") == F.col("_h"))
        & (F.col("size") == F.col("_z")),
        "left",
    ).join(share_of, F.col("source").eqNullSafe(F.col("_source")))
    return out.select(
        "row",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.coalesce("laps", F.lit(0))).cast("long").alias("taken"),
    )
