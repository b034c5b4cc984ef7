"""The polled jobs as Structured Streaming: ingest, incident routing, minute volumes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluice.operators.ledger import route
from sluice.plans.incremental import OrderTables
from sluice.session import remove
from sluice.sources.layers import PartitionedTable, calendar

def stream_ingest(
    source: DataFrame,
    tables: OrderTables,
    checkpoint: str,
    to_orders: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> StreamingQuery:
    """Upsert and re-classify each micro-batch. The stream checkpoint is the watermark.

    ``foreachBatch`` may repeat a batch after a failure; the upserts make that safe.
    """
    return (
        source.writeStream.foreachBatch(lambda df, i: tables.apply(to_orders(df), i))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_routes(ledger: DataFrame, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Route of each event-time window; incidents later than the delay are dropped.

    State is one row per open window: a set of at most fourteen keys and a maximum.
    """
    grouped = (
        ledger.withWatermark("injected_at", delay)
        .groupBy(F.window("injected_at", window).alias("w"))
        .agg(
            F.array_sort(F.collect_set("failure_key")).alias("failure_keys"),
            F.max_by("failure_key", F.struct("injected_at", "incident_id")).alias("_last"),
            F.count("*").alias("incidents"),
        )
    )
    chosen = route(F.col("failure_keys"), F.col("incidents"))
    return grouped.select(
        F.col("w.start").alias("window_start"),
        chosen.alias("route"),
        "failure_keys",
        "incidents",
        F.when(chosen == "base", F.col("_last")).alias("dispatch_key"),
    )


def stream_ledger_once(polls: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each incident of overlapping polls once.

    A poll from a time cursor reads the last incidents again. State is one row per
    incident of the last ``delay`` before the watermark, which must be longer than the
    overlap; an incident later than that is dropped.
    """
    return polls.withWatermark("injected_at", delay).dropDuplicatesWithinWatermark(["incident_id"])


def append_rows(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Rows of a stream in files, exactly once: the sink logs the files of every batch."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_minute_counts(stream: DataFrame, ts_col: str, delay: str = "10 minutes") -> DataFrame:
    """Rows per minute of event time."""
    grouped = (
        stream.withWatermark(ts_col, delay)
        .groupBy(F.window(ts_col, "1 minute").alias("w"))
        .agg(F.count("*").alias("rows"))
    )
    return grouped.select(F.col("w.start").alias("minute"), "rows")


def windows_table(spark: SparkSession, path: str, start_col: str) -> PartitionedTable:
    """Results of windows by the day they start on."""
    return PartitionedTable(spark, path, calendar(start_col))


def upsert_windows(df: DataFrame, path: str, start_col: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest result of every window in a table, day by day.

    Update mode writes a window again whenever it changed, so open windows are not
    missing from the table; only the days a batch touches are rewritten.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stage = f"{path}-stage/batch={batch_id}"
        batch.write.mode("overwrite").parquet(f"{stage}/rows")
        rows = spark.read.schema(batch.schema).parquet(f"{stage}/rows")
        windows_table(spark, path, start_col).upsert(rows, start_col, f"{stage}/merged")
        remove(spark, stage)

    return (
        df.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_windows(spark: SparkSession, path: str, start_col: str) -> DataFrame:
    return windows_table(spark, path, start_col).rows()
