"""Minute volumes of a stream, their histogram, and the spike test on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluice.operators.deltas import row_changes
from sluice.operators.detect import spike_from_histogram
from sluice.session import remove
from sluice.sources.layers import PartitionedTable, calendar, exists


class MinuteVolumes:
    """Rows per minute, how many minutes have each count, and the latest minute.

    A minute that changes moves one unit of the histogram from its old count to its new one, so
    that the exact median never needs a pass over all minutes. The histogram has one row per
    distinct count.
    """

    def __init__(self, spark: SparkSession, root: str, grain: str = "day"):
        self.spark = spark
        self.root = root.rstrip("/")
        self.minutes = PartitionedTable(spark, f"{self.root}/minutes", calendar("minute", grain))
        self.histogram = PartitionedTable(spark, f"{self.root}/histogram", F.lit(0))
        self.latest = PartitionedTable(spark, f"{self.root}/latest", F.lit(0))

    def _keep(self, df: DataFrame, path: str) -> DataFrame:
        if not exists(self.spark, f"{path}/_SUCCESS"):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Take in the current counts of some minutes. Replaying a batch changes nothing.

        A replay uses what an earlier call has staged; a stage goes when the next batch comes.
        """
        stage = f"{self.root}/stage/batch={batch_id}"
        remove(self.spark, f"{self.root}/stage/batch={batch_id - 1}")
        rows = self._keep(batch.select("minute", "rows"), f"{stage}/rows")
        near = self.minutes.rows(self.minutes.parts(rows))
        at = rows.select(F.col("minute").alias("_at"))
        old = rows.limit(0) if near is None else near.join(at, F.col("minute") == F.col("_at"), "left_semi")
        old = self._keep(old.select("minute", "rows"), f"{stage}/old")
        self.minutes.upsert(rows, "minute", f"{stage}/minutes")

        moved = row_changes(old, rows, "minute").groupBy(F.col("row.rows").alias("rows"))
        moved = moved.agg(F.sum("sign").alias("minutes"))
        known = self.histogram.rows()
        merged = moved if known is None else known.unionByName(moved)
        merged = merged.groupBy("rows").agg(F.sum("minutes").alias("minutes")).where("minutes > 0")
        self.histogram.replace(merged, [0], f"{stage}/histogram")
        last = self.latest.rows()
        # On equal minutes the batch has the newer count.
        ranked = rows.withColumn("age", F.lit(1))
        if last is not None:
            ranked = ranked.unionByName(last.withColumn("age", F.lit(0)))
        newest = ranked.agg(F.max(F.struct("minute", "age", "rows")).alias("m"))
        newest = newest.where("m IS NOT NULL").select("m.minute", "m.rows")
        self.latest.replace(newest, [0], f"{stage}/latest")

    def spike(self) -> DataFrame:
        """The finding after the last batch that had rows."""
        return spike_from_histogram(self.histogram.rows(), self.latest.rows())


def stream_volumes(counts: DataFrame, volumes: MinuteVolumes, checkpoint: str) -> StreamingQuery:
    """Keep the tables current with a stream of minute counts (``stream_minute_counts``)."""
    return (
        counts.writeStream.outputMode("update")
        .foreachBatch(volumes.apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
