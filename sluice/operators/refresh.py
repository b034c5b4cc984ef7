"""Incremental refresh of the accepted tables: evict re-extracted keys, append, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.classify import accepted as accepted_rows
from sluice.operators.classify import silver_columns
from sluice.schemas import BUSINESS_KEY


def evict_reprocessed(accepted: DataFrame, bronze: DataFrame, key: str) -> DataFrame:
    """Drop accepted rows whose bronze copy was ingested later, whatever its verdict."""
    newer = bronze.select(F.col(key).alias("_key"), F.col("_ingested_at").alias("_newer"))
    match = (F.col(key) == F.col("_key")) & (F.col("_newer") > F.col("_ingested_at"))
    return accepted.join(newer, match, "left_anti")


def append_only_new(candidates: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    """Candidates not yet present on (key, ingest time)."""
    present = accepted.select(key, "_ingested_at")
    return candidates.join(present, [key, "_ingested_at"], "left_anti").select(*candidates.columns)


def refresh(
    accepted: DataFrame | None,
    classified: DataFrame,
    entity: str,
    key: str,
    mode: str = "strict",
) -> DataFrame:
    """The accepted table after a run; the first run is a full build.

    A verdict may change because of ANOTHER row: the first of two duplicates is
    repaired, or an order is rejected under its payments. ``mode="reference"`` evicts
    only rows that were themselves re-extracted and so keeps such rows.
    ``mode="strict"`` also evicts keys whose current verdict is a reject, which makes
    the result equal to a full rebuild.
    """
    if mode not in ("strict", "reference"):
        raise ValueError(f"mode must be strict or reference, not {mode!r}")
    if accepted is None:
        return accepted_rows(classified, entity)
    # Keys are unique on both sides, so one join shows each key's old row and its verdict.
    fresh = classified.select("reject_rule", F.struct(*silver_columns(entity)).alias("new"))
    fresh = fresh.withColumn("_new_key", F.col(f"new.{key}"))
    columns = fresh.select("new.*").columns
    old = accepted.select(F.struct(*columns).alias("old"), F.col(key).alias("_old_key"))
    both = old.join(fresh, F.col("_old_key") == F.col("_new_key"), "full_outer")
    rejected = F.col("reject_rule").isNotNull()
    evicted = F.coalesce(F.col("new._ingested_at") > F.col("old._ingested_at"), F.lit(False))
    if mode == "strict":
        evicted = evicted | rejected
    keep = F.col("old").isNotNull() & ~evicted
    present = keep & F.coalesce(F.col("new._ingested_at") == F.col("old._ingested_at"), F.lit(False))
    append = F.col("new").isNotNull() & ~rejected & ~present
    rows = F.array(F.when(keep, F.col("old")), F.when(append, F.col("new")))
    return both.select(F.explode(F.array_compact(rows)).alias("row")).select("row.*")


def affected_orders(raw: DataFrame, before: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The raw orders whose verdict a batch may change.

    ``raw`` is the table with the batch in it, ``before`` the one without. Apart from
    the batch itself a verdict can change only for the first row of a business key the
    batch touches, as it was before or as it is now: other copies stay duplicates. So a
    key with very many copies adds two rows, not its whole group.

    The result holds the first row of every business key in it and can therefore be
    classified on its own. Touched keys are matched by hash, first rows are found on the
    full key; a hash collision only adds rows.
    """
    if before is None and raw is batch:
        # Every row is the batch's own; one without a key has never been matched.
        return raw.where(F.col("order_id").isNotNull())
    key_hash = F.xxhash64(*BUSINESS_KEY)
    touched = batch.select(key_hash.alias("_bk"))
    if before is not None:
        replaced = before.join(batch.select("order_id"), "order_id", "left_semi")
        touched = touched.unionByName(replaced.select(key_hash.alias("_bk")))
    touched = touched.distinct()

    def first_rows(df: DataFrame) -> DataFrame:
        # Few touched keys are broadcast by AQE; of many, a hot one is split.
        keyed = df.select(*BUSINESS_KEY, "order_id", key_hash.alias("_bk"))
        near = keyed.join(touched, "_bk", "left_semi")
        return near.groupBy(*BUSINESS_KEY).agg(F.min("order_id").alias("order_id")).select("order_id")

    ids = batch.select("order_id").unionByName(first_rows(raw))
    if before is not None:
        ids = ids.unionByName(first_rows(before))
    return raw.join(ids.distinct(), "order_id", "left_semi")


def transition_report(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """What happened to each key between two classified snapshots."""

    def verdict(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.coalesce("reject_rule", F.lit("accepted")).alias(name))

    both = verdict(before, "before").join(verdict(after, "after"), key, "full_outer")
    was, now = F.col("before"), F.col("after")
    return both.withColumn(
        "transition",
        F.when(was.isNull(), "new")
        .when(now.isNull(), "gone")
        .when((was == "accepted") & (now != "accepted"), "accepted_to_rejected")
        .when((was != "accepted") & (now == "accepted"), "rejected_to_accepted")
        .when(was == now, "unchanged")
        .otherwise("other_rule"),
    )
