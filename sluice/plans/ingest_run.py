"""One ingest run over a list of entities, in full or incremental mode."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sluice.operators.audit import stack
from sluice.operators.ingest import incremental_window, stamp_lineage
from sluice.schemas import ENTITIES, ENTITY_ORDER, EntitySpec
from sluice.session import remove
from sluice.sources.layers import EPOCH, PartitionedTable, RunLog, key_range
from sluice.sources.readers import (
    drift_by_file,
    read_all_names,
    read_entity,
    read_jdbc,
    resolve_by_file,
    resolve_column,
    with_arrival,
)

Source = str | dict[str, str] | DataFrame
# The names under which orders have carried their customer.
CUSTOMER_NAMES = ("customer_id", "user_id")


class Ingest:
    """Raw tables and the run log below one shared folder."""

    def __init__(self, spark: SparkSession, root: str, width: int = 10_000_000):
        self.spark = spark
        self.root = root.rstrip("/")
        self.width = width
        self.log = RunLog(spark, f"{self.root}/run_log")

    def raw(self, entity: str) -> PartitionedTable:
        path = f"{self.root}/raw/raw_{entity}"
        return PartitionedTable(self.spark, path, key_range(ENTITIES[entity].pk, self.width))

    def _read(self, spec: EntitySpec, source: Source, stage: str) -> tuple[DataFrame, bool | None]:
        """Typed rows of a source, and whether its customer column drifted as a whole.

        Rows of files know where they arrived, so that of two versions of a key in one window the
        later one wins. Files of orders may differ in the name of the customer column; their
        rows say so themselves, and the second value is None.
        """
        if spec.name != "orders":
            if isinstance(source, str):
                files = with_arrival(self.spark.read.schema(spec.ddl).parquet(source))
                return read_entity(self.spark, spec, files, ["_arrived"]), None
            return read_entity(self.spark, spec, source), None
        if isinstance(source, str):
            slot = CUSTOMER_NAMES[0]
            rows = read_all_names(self.spark, spec, source, CUSTOMER_NAMES, slot)
            drift_by_file(rows, CUSTOMER_NAMES, slot).write.mode("overwrite").parquet(f"{stage}-files")
            files = self.spark.read.parquet(f"{stage}-files")
            resolved = resolve_by_file(rows, files, CUSTOMER_NAMES, slot)
            return read_entity(self.spark, spec, resolved, ["_schema_drift", "_arrived"]), None
        if isinstance(source, dict):
            source = read_jdbc(self.spark, spec, source)
        source, drift = resolve_column(source, CUSTOMER_NAMES, CUSTOMER_NAMES[0])
        return read_entity(self.spark, spec, source), drift

    def ingest_entity(
        self, spec: EntitySpec, source: Source, run_ts: str, prior: tuple[str, int]
    ) -> DataFrame:
        """Extract, stamp and upsert one entity; the result is its run-log row."""
        prior_ts, prior_id = prior
        full_load = prior == (EPOCH, 0)
        stage = f"{self.root}/stage/{spec.name}/{run_ts.replace(' ', 'T').replace(':', '')}"
        rows, drift = self._read(spec, source, stage)
        if not full_load:
            rows = incremental_window(rows, spec, prior_ts, prior_id)

        # The source is read once: the window is staged, and its size and watermark are
        # observed on the way. Only these scalars come back to the driver.
        seen = Observation(f"{spec.name}_window")
        drifted = F.col("_schema_drift") if "_schema_drift" in rows.columns else F.lit(bool(drift))
        rows.observe(
            seen,
            F.count(F.lit(1)).alias("n"),
            F.max(spec.watermark).cast("string").alias("t"),
            F.max(spec.pk).alias("i"),
            F.max(drifted).alias("d"),
        ).write.mode("overwrite").option("compression", "zstd").parquet(stage)
        rows_read, newest, highest, any_drift = (seen.get[k] for k in ("n", "t", "i", "d"))
        high_ts = max(newest or prior_ts, prior_ts)
        high_id = max(prior_id if highest is None else highest, prior_id)

        table = self.raw(spec.name)
        staged = self.spark.read.schema(rows.schema).parquet(stage)
        if rows_read:
            own = [*spec.column_names, *spec.lineage]
            own += [c for c in rows.columns if c == "_arrived"]
            stamped = stamp_lineage(staged, run_ts, high_ts, drift).select(*own)
            table.upsert(stamped, spec.pk, f"{stage}-merged")
        for used in (stage, f"{stage}-files", f"{stage}-merged"):
            remove(self.spark, used)
        current = table.rows()
        return self.spark.range(1).select(
            F.lit(run_ts).cast("timestamp").alias("run_ts"),
            F.lit(spec.name).alias("entity"),
            F.lit(rows_read).cast("bigint").alias("rows_read"),
            F.lit(rows_read).cast("bigint").alias("rows_upserted"),
            F.lit(0 if current is None else current.count()).cast("bigint").alias("table_total"),
            F.lit(full_load).alias("full_load"),
            F.lit(bool(any_drift)).alias("schema_drift"),
            F.lit(high_ts).alias("high_watermark_ts"),
            F.lit(str(high_id)).alias("high_watermark_id"),
        )

    def run(
        self,
        sources: Mapping[str, Source],
        run_ts: str,
        entities: Iterable[str] = ENTITY_ORDER,
        mode: str = "incremental",
    ) -> DataFrame:
        """Ingest the entities side by side; the result is their run-log rows."""
        if mode not in ("full", "incremental"):
            raise ValueError(f"mode must be full or incremental, not {mode!r}")
        names = list(entities)
        priors = {} if mode == "full" else self.log.priors()

        def ingest(entity: str) -> DataFrame:
            prior = priors.get(entity, (EPOCH, 0))
            return self.ingest_entity(ENTITIES[entity], sources[entity], run_ts, prior)

        with ThreadPoolExecutor(len(names)) as pool:
            done = list(pool.map(ingest, names))
        self.log.append(stack(done))
        of_run = F.col("run_ts") == F.lit(run_ts).cast("timestamp")
        return self.log.read().where(of_run & F.col("entity").isin(names))
