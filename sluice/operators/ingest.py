"""Incremental, watermark-driven ingest: window, stamps, watermark, upsert, purge."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.expressions import ts
from sluice.schemas import LOOKBACK, PK_BAND, EntitySpec


def window_arms(
    spec: EntitySpec,
    prior_ts: str,
    prior_id: int,
    lookback: str = LOOKBACK,
    pk_band: int = PK_BAND,
) -> dict[str, Column]:
    """The named arms of the incremental window.

    ``recent_time`` re-reads rows near the frontier, ``new_key`` finds late inserts
    whatever their event time, ``recent_key`` re-reads the newest keys so that updates
    in place are seen. Dimensions have the time arm only.
    """
    arms = {"recent_time": F.col(spec.watermark) >= ts(prior_ts) - F.expr(f"INTERVAL {lookback}")}
    if spec.pk_arms:
        arms["new_key"] = F.col(spec.pk) > F.lit(prior_id)
        arms["recent_key"] = F.col(spec.pk) >= F.lit(prior_id - pk_band)
    return arms


def incremental_window(
    df: DataFrame,
    spec: EntitySpec,
    prior_ts: str,
    prior_id: int,
    lookback: str = LOOKBACK,
    pk_band: int = PK_BAND,
) -> DataFrame:
    """Rows any arm selects: one disjunction, which the scan can push down."""
    return df.where(reduce(or_, window_arms(spec, prior_ts, prior_id, lookback, pk_band).values()))


def arm_counts(df: DataFrame, spec: EntitySpec, prior_ts: str, prior_id: int) -> DataFrame:
    """How many rows each arm selects, in one pass."""
    arms = window_arms(spec, prior_ts, prior_id)
    return df.agg(*[F.count_if(cond).alias(name) for name, cond in arms.items()])


def stamp_lineage(
    df: DataFrame, run_ts: str, high_ts: str | Column, drift: bool | None = None
) -> DataFrame:
    """Ingest time and source watermark on every row; the drift flag where it applies."""
    high = ts(high_ts) if isinstance(high_ts, str) else high_ts
    stamps = {"_ingested_at": ts(run_ts), "_source_watermark": high}
    if drift is not None:
        stamps["_schema_drift"] = F.lit(drift)
    return df.withColumns(stamps)


def high_watermark(df: DataFrame, spec: EntitySpec, prior_ts: str, prior_id: int) -> DataFrame:
    """One row: highest time and key of the batch, never below the prior ones."""
    floor_ts, floor_id = ts(prior_ts), F.lit(prior_id).cast("bigint")
    return df.agg(
        F.greatest(F.coalesce(F.max(spec.watermark), floor_ts), floor_ts).alias("high_ts"),
        F.greatest(F.coalesce(F.max(spec.pk), floor_id), floor_id).alias("high_id"),
    )


def latest_per_key(batch: DataFrame, pk: str) -> DataFrame:
    """One row per key: the one written last.

    That is the highest ingest time, then the source's update time, then the place of arrival
    (``_arrived``, see ``with_arrival``), then the source watermark, as far as the batch has
    them. Versions that tie in all are told apart by a hash of the row, so reruns agree. The
    maximum combines before the shuffle. ``_arrived`` is dropped.
    """
    order = ("_ingested_at", "updated_at", "_arrived", "_source_watermark")
    own = [c for c in batch.columns if c != "_arrived"]
    newest = F.struct(*[c for c in order if c in batch.columns], F.xxhash64(*own).alias("_tie"))
    last = batch.groupBy(F.col(pk).alias("_pk")).agg(F.max_by(F.struct(*own), newest).alias("_row"))
    return last.select("_row.*")


def upsert(target: DataFrame, batch: DataFrame, pk: str) -> DataFrame:
    """The last row of each key of the batch replaces the target's row, or is added."""
    batch = latest_per_key(batch, pk)
    present = batch.select(F.col(pk).alias("_pk"))
    return target.join(present, F.col(pk) == F.col("_pk"), "left_anti").unionByName(batch)


def load_stats(
    spec: EntitySpec, target: DataFrame, batch: DataFrame, full_load: bool, drift: bool = False
) -> DataFrame:
    """One row: rows read, rows written, rows in the table afterwards, and two flags."""
    marked = target.select(F.col(spec.pk), F.lit(0).alias("_read")).unionByName(
        batch.select(F.col(spec.pk), F.lit(1).alias("_read"))
    )
    per_key = marked.groupBy(spec.pk).agg(F.sum("_read").alias("_read"))
    return per_key.agg(
        F.coalesce(F.sum("_read"), F.lit(0)).alias("rows_read"),
        F.coalesce(F.sum("_read"), F.lit(0)).alias("rows_upserted"),
        F.count("*").alias("table_total"),
    ).select(
        F.lit(spec.name).alias("entity"),
        "*",
        F.lit(full_load).alias("full_load"),
        F.lit(drift).alias("schema_drift"),
    )


def purge_keys(df: DataFrame, keys: DataFrame, pk: str) -> DataFrame:
    """Delete rows whose key is in the key set."""
    return df.join(keys.select(pk), pk, "left_anti")


def purge_orphans(df: DataFrame, source_keys: DataFrame, key: str) -> DataFrame:
    """Delete rows whose key left the source. A NULL in the key set harms nothing."""
    return df.join(source_keys.select(key), key, "left_semi")


def sample_rows(df: DataFrame, pk: str, k: int, seed: int) -> DataFrame:
    """``k`` rows in the order of a seeded digest of the key, by a partial top-k in every task."""
    digest = F.md5(F.concat_ws("|", F.col(pk).cast("string"), F.lit(str(seed))))
    return df.orderBy(digest, pk).limit(k)


def latest_rows(df: DataFrame, pk: str, n: int) -> DataFrame:
    """The ``n`` rows with the highest keys."""
    return df.orderBy(F.desc_nulls_last(pk)).limit(n)
