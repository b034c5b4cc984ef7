"""Layered tables on plain Parquet, and the run log.

Parquet has no MERGE. Tables that are rebuilt get a new folder per run, and one commit
row makes the whole run visible at once; readers keep the version they opened. Tables that
are changed in place are partitioned by a derived column, and Spark's dynamic partition
overwrite replaces the partitions a batch touches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.ingest import latest_per_key
from sluice.session import remove

EPOCH = "1970-01-01 00:00:00"
# Parts a staged file may hold on average before its rows are shuffled by part.
FEW_PARTS = 4
COMMIT_DDL = "version BIGINT, committed_at TIMESTAMP"
RUN_LOG_DDL = (
    "run_ts TIMESTAMP, entity STRING, rows_read BIGINT, rows_upserted BIGINT, "
    "table_total BIGINT, full_load BOOLEAN, schema_drift BOOLEAN, "
    "high_watermark_ts STRING, high_watermark_id STRING"
)


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    files, jvm_path = _file_system(spark, path)
    return files.exists(jvm_path)


class LayerStore:
    """Tables named ``<layer>_<entity>`` below one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _home(self, layer: str, entity: str) -> str:
        return f"{self.root}/{layer}/{layer}_{entity}"

    def version(self) -> int:
        """The newest committed run, 0 before the first."""
        path = f"{self.root}/_commits"
        if not exists(self.spark, path):
            return 0
        commits = self.spark.read.schema(COMMIT_DDL).parquet(path)
        return commits.agg(F.max("version")).first()[0] or 0

    def overwrite(self, layer: str, entity: str, df: DataFrame, version: int) -> DataFrame:
        """Write a table of one run. Repeating an uncommitted run replaces its files."""
        path = f"{self._home(layer, entity)}/v={version}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def append(self, layer: str, entity: str, df: DataFrame) -> DataFrame:
        path = f"{self._home(layer, entity)}/rows"
        df.write.mode("append").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def view(self, layer: str, entity: str, df: DataFrame) -> str:
        """A lazy layer: a temporary view, nothing is written."""
        name = f"{layer}_{entity}"
        df.createOrReplaceTempView(name)
        return name

    def commit(self, version: int) -> None:
        """Make every table of the run visible at once."""
        row = self.spark.range(1).select(
            F.lit(version).cast("bigint").alias("version"),
            F.current_timestamp().alias("committed_at"),
        )
        row.write.mode("append").parquet(f"{self.root}/_commits")

    def read(self, layer: str, entity: str) -> DataFrame:
        """The committed table; an appended table if it has no versions."""
        home = self._home(layer, entity)
        rows = f"{home}/rows"
        if exists(self.spark, rows):
            return self.spark.read.parquet(rows)
        return self.spark.read.parquet(f"{home}/v={self.version()}")


def key_range(key: str, width: int = 10_000_000) -> Column:
    """Partition of a key: ``width`` keys each, as keys are unique no partition runs hot."""
    return F.coalesce(F.floor(F.col(key) / width), F.lit(-1)).cast("int")


def calendar(time: str, grain: str = "day") -> Column:
    """Partition of a time: its day as yyyyMMdd or its month as yyyyMM, 0 for NULL."""
    pattern = {"day": "yyyyMMdd", "month": "yyyyMM"}[grain]
    return F.coalesce(F.date_format(time, pattern).cast("int"), F.lit(0))


class PartitionedTable:
    """A table cut by one derived whole number, of which a change rewrites only some parts.

    The new parts are staged completely and then replace the old ones by dynamic partition
    overwrite. A crash in between leaves a complete stage, from which the repeated call goes on;
    callers delete a stage once nothing will repeat the call. One writer at a time. The driver
    sees the numbers of the touched parts, never rows.
    """

    def __init__(self, spark: SparkSession, path: str, part: Column):
        self.spark = spark
        self.path = path
        self.part = part.cast("int").alias("_part")

    def parts(self, *frames: DataFrame) -> list[int]:
        """Parts that some rows belong to."""
        found = {r[0] for f in frames for r in f.select(self.part).distinct().collect()}
        return sorted(found)

    def rows(self, parts: Sequence[int] | None = None) -> DataFrame | None:
        """The table or some parts of it; None before its first row was written."""
        files, home = _file_system(self.spark, self.path)
        if not files.exists(home):
            return None
        if not any(f.getPath().getName().startswith("_part=") for f in files.listStatus(home)):
            return None
        found = self.spark.read.parquet(self.path)
        if parts is not None:
            found = found.where(F.col("_part").isin(list(parts)))
        return found.drop("_part")

    def staged(self, stage: str) -> bool:
        return exists(self.spark, f"{stage}/_SUCCESS")

    def replace(self, rows: DataFrame, parts: Sequence[int], stage: str) -> None:
        """Let ``rows`` be all that the given parts hold. ``rows`` may read the table.

        A complete ``stage`` is taken in their place: it holds what the first call began to write.
        Where its files hold few parts each, as rows that came from the table do, they are written
        as they lie; else rows are shuffled by part.
        """
        if not self.staged(stage):
            rows.write.mode("overwrite").option("compression", "zstd").parquet(stage)
        written = self.spark.read.schema(rows.schema).parquet(stage)
        placed = written.select(self.part, "_metadata.file_path").distinct()
        lie = {r[0]: r[1] for r in placed.groupBy("_part").count().collect()}
        few = FEW_PARTS * (len(written.inputFiles()) + len(lie))
        self._overwrite(written.select("*", self.part), sum(lie.values()) <= few)
        for part in set(parts) - set(lie):
            remove(self.spark, f"{self.path}/_part={part}")

    def with_new(self, near: DataFrame, new: DataFrame) -> DataFrame:
        """Rows read from the table beside new ones, of which each task gets few parts."""
        placed = new.select("*", self.part).hint("rebalance", "_part").drop("_part")
        return near.unionByName(placed)

    def _overwrite(self, rows: DataFrame, clustered: bool) -> None:
        # Small parts share a task and a large one is split into many, by size.
        placed = rows if clustered else rows.hint("rebalance", "_part")
        (
            placed.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("_part")
            .parquet(self.path)
        )

    def upsert(
        self, batch: DataFrame, key: str, stage: str, unique: bool = False, add: bool = False
    ) -> None:
        """Insert or replace rows by key; a key must keep its part. Repeating changes nothing.

        The batch is read more than once, so pass a frame over written files. ``unique`` says that
        it has one row per key. The first batch needs no stage: it does not read the table, and
        repeating it replaces what a crash has left. With ``add``, for keys that are mostly new,
        rows are added to the parts that hold none of the batch's keys, and only the others are
        rewritten. What a crash has left of added rows holds their keys, so repeating rewrites it.
        """
        columns = [c for c in batch.columns if c != "_arrived"]
        if self.staged(stage):
            # An earlier call ended while it was overwriting.
            self.replace(self.spark.read.parquet(stage).select(*columns), [], stage)
            remove(self.spark, stage)
        parts = self.parts(batch)
        near = self.rows(parts)
        last = batch.select(*columns) if unique else latest_per_key(batch, key)
        if near is None:
            self._overwrite(last.select(*columns, self.part), False)
            return
        if add:
            keys = batch.select(F.col(key).alias("_pk"))
            again = self.parts(near.join(keys, F.col(key) == F.col("_pk"), "left_semi"))
            new = last.where(~self.part.isin(again))
            new.select(*columns, self.part).hint("rebalance", "_part").write.mode("append").partitionBy(
                "_part"
            ).parquet(self.path)
            if not again:
                return
            parts, near, last = again, self.rows(again), last.where(self.part.isin(again))
        merged = near.join(last.select(F.col(key).alias("_pk")), F.col(key) == F.col("_pk"), "left_anti")
        self.replace(self.with_new(merged, last).select(*columns), parts, stage)


class RunLog:
    """One row per entity and run; the newest row of an entity is its watermark."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def append(self, rows: DataFrame) -> None:
        rows.coalesce(1).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], RUN_LOG_DDL)
        return self.spark.read.schema(RUN_LOG_DDL).parquet(self.path)

    def watermarks(self) -> DataFrame:
        """Newest watermark per entity; unreadable values fall back to a cold start."""
        newest = self.read().groupBy("entity").agg(
            F.max_by(F.struct("high_watermark_ts", "high_watermark_id"), "run_ts").alias("w")
        )
        return newest.select(
            "entity",
            F.coalesce(
                F.try_to_timestamp("w.high_watermark_ts"), F.lit(EPOCH).cast("timestamp")
            ).alias("prior_ts"),
            F.coalesce(F.expr("try_cast(w.high_watermark_id AS BIGINT)"), F.lit(0)).alias(
                "prior_id"
            ),
        )

    def priors(self) -> dict[str, tuple[str, int]]:
        """Watermarks by entity as (text, number): one small row per entity."""
        rows = self.watermarks().withColumn("prior_ts", F.col("prior_ts").cast("string")).collect()
        return {r.entity: (r.prior_ts, r.prior_id) for r in rows}
