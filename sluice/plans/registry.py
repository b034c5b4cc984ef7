"""Every query of the engine, keyed by name, over a folder of Parquet tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.expressions import comparable, outside, portable, ts
from sluice.operators import (
    audit,
    classify,
    detect,
    gold,
    grade,
    history,
    ingest,
    ledger,
    logs,
    refresh,
    slo,
)
from sluice.plans import basket, intents
from sluice.plans.incremental import GoldTables, OrderTables
from sluice.plans.ingest_run import CUSTOMER_NAMES, Ingest
from sluice.plans.medallion import RUN_TS, Medallion, publish
from sluice.schemas import (
    ENTITIES,
    ENTITY_ORDER,
    ORDER_REJECT_KEYS,
    ORDER_STATUSES,
    PAYMENT_REJECT_KEYS,
    PAYMENT_STATUSES,
)
from sluice.session import configure, scratch_dir
from sluice.sources.layers import EPOCH, LayerStore, PartitionedTable, RunLog, key_range
from sluice.sources.readers import (
    drift_by_file,
    read_all_names,
    read_entity,
    read_log_lines,
    resolve_by_file,
    resolve_column,
    with_arrival,
)
from sluice.sources.retail import Retail, derive_ledger, derive_orders
from sluice.streaming import jobs, payments, volumes

# Where the second ingest run starts, as its first run left it.
PRIOR_TS = "1999-01-01 00:00:00"
LEDGER_SINCE = "2024-01-15 00:00:00"
# Where the first drop of a streamed table ends.
STREAM_CUT = "1998-01-01 00:00:00"


class Lake:
    """Raw entities, the medallion over them, and a second drop of orders."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = configure(spark)
        self.src = Retail(spark, root)
        self.root = root
        self._settled: set[str] = set()
        self.tables = Medallion(self.src.raw, keep=self._keep)

    def _keep(self, name: str, df: DataFrame) -> DataFrame:
        """Write a table that has several consumers to the shared folder, once."""
        path = scratch_dir(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def settle(self, *entities: str) -> Lake:
        """Write out entities that are about to be read more than once, as their source holds them."""
        for entity in entities:
            if entity not in self._settled:
                self._settled.add(entity)
                self.src.__dict__[entity] = self._keep(f"source_{entity}", self.src.raw(entity))
        return self

    @cached_property
    def first_raw(self) -> DataFrame:
        """Raw orders as the first run left them: all it had seen by then."""
        self.settle("orders")
        return self.src.orders.where(F.col("_ingested_at") < ts(PRIOR_TS))

    @cached_property
    def prior(self) -> tuple[str, int]:
        """High watermark of the first run: two scalars."""
        high = ingest.high_watermark(self.first_raw, ENTITIES["orders"], EPOCH, 0)
        row = high.select(F.col("high_ts").cast("string").alias("t"), "high_id").first()
        return row.t, row.high_id

    @cached_property
    def batch(self) -> DataFrame:
        """The second run's window, re-stamped; some totals changed at the source."""
        spec = ENTITIES["orders"]
        rows = ingest.incremental_window(self.src.orders, spec, *self.prior)
        zero = F.lit(0).cast("decimal(12,2)")
        changed = rows.withColumn(
            "total_amount",
            F.when(F.col("order_id") % 7 == 0, zero).otherwise(F.col("total_amount")),
        )
        drift = F.col("_schema_drift")
        return ingest.stamp_lineage(
            changed.drop("_ingested_at", "_source_watermark"), RUN_TS, RUN_TS
        ).select(*spec.column_names, "_ingested_at", "_source_watermark", drift)

    @cached_property
    def second_raw(self) -> DataFrame:
        """Written out, as the classification reads it more than once."""
        return self._keep("second_raw", ingest.upsert(self.first_raw, self.batch, "order_id"))

    @cached_property
    def before(self) -> Medallion:
        return Medallion(
            lambda e: self.first_raw if e == "orders" else self.src.raw(e), keep=self._keep
        )

    @cached_property
    def after(self) -> Medallion:
        return Medallion(
            lambda e: self.second_raw if e == "orders" else self.src.raw(e), keep=self._keep
        )


def _stack_entities(make: Callable[[str], DataFrame]) -> DataFrame:
    """One frame per entity, tagged with its name."""
    return audit.stack(
        [make(e).select(F.lit(e).alias("entity"), "*") for e in ENTITY_ORDER]
    )


def _verdicts(lake: Lake, entity: str) -> DataFrame:
    pk = ENTITIES[entity].pk
    return lake.tables.classified(entity).select(pk, "reject_rule", "reject_reason")


# -- ingest -----------------------------------------------------------------------


def ingest_scan(lake: Lake) -> DataFrame:
    return read_entity(lake.spark, ENTITIES["orders"], lake.src.orders)


def ingest_window(lake: Lake, entity: str) -> DataFrame:
    spec = ENTITIES[entity]
    source = lake.src.source(entity)
    earlier = source.where(F.col(spec.watermark) < ts(PRIOR_TS if spec.pk_arms else "1994-06-01"))
    high = ingest.high_watermark(earlier, spec, EPOCH, 0)
    prior = high.select(F.col("high_ts").cast("string"), "high_id").first()
    arms = ingest.window_arms(spec, prior[0], prior[1])
    window = ingest.incremental_window(source, spec, prior[0], prior[1])
    return window.select(spec.pk, spec.watermark, *[c.alias(name) for name, c in arms.items()])


def ingest_schema_drift(lake: Lake) -> DataFrame:
    drifted = lake.src.source("orders").withColumnRenamed("customer_id", "user_id")
    fixed, drift = resolve_column(drifted, ["customer_id", "user_id"], "customer_id")
    return fixed.select("order_id", "customer_id", F.lit(drift).alias("_schema_drift"))


def _drifting_orders(lake: Lake) -> DataFrame:
    """Files of orders in one folder; those of every third order name their customer otherwise."""
    path = scratch_dir(lake.spark, "mixed-orders")
    rows = lake.src.source("orders").select(*ENTITIES["orders"].column_names)
    third = F.col("order_id") % 3 == 0
    rows.where(~third).write.mode("append").parquet(path)
    rows.where(third).withColumnRenamed("customer_id", "user_id").write.mode("append").parquet(path)
    return read_all_names(lake.spark, ENTITIES["orders"], path, CUSTOMER_NAMES, "customer_id")


def ingest_mixed_drift(lake: Lake) -> DataFrame:
    rows = _drifting_orders(lake)
    files = lake._keep("drift-files", drift_by_file(rows, CUSTOMER_NAMES, "customer_id"))
    resolved = resolve_by_file(rows, files, CUSTOMER_NAMES, "customer_id")
    return resolved.select("order_id", "customer_id", "_schema_drift")


def ingest_drift_files(lake: Lake) -> DataFrame:
    files = drift_by_file(_drifting_orders(lake), CUSTOMER_NAMES, "customer_id")
    return files.groupBy("live", "_schema_drift").agg(F.sum("rows").alias("rows"))


def ingest_last_write(lake: Lake) -> DataFrame:
    """Three drops of orders in one window, the later ones with other states of some of them."""
    path = scratch_dir(lake.spark, "drops")
    rows = lake.src.source("orders").select("order_id", "status")
    drops = (
        rows,
        rows.where("order_id % 7 = 0").withColumn("status", F.lit("returned")),
        rows.where("order_id % 5 = 0").withColumn("status", F.lit("delivered")),
    )
    for drop in drops:
        drop.write.mode("append").parquet(path)
    return ingest.latest_per_key(with_arrival(lake.spark.read.schema(rows.schema).parquet(path)), "order_id")


def ingest_stamp(lake: Lake) -> DataFrame:
    spec = ENTITIES["orders"]
    rows = lake.src.source("orders")
    high = ingest.high_watermark(rows, spec, EPOCH, 0).select(F.col("high_ts").cast("string"))
    stamped = ingest.stamp_lineage(rows, RUN_TS, high.first()[0], False)
    return stamped.select("order_id", *spec.lineage)


def ingest_high_watermark(lake: Lake) -> DataFrame:
    return _stack_entities(
        lambda e: ingest.high_watermark(lake.src.source(e), ENTITIES[e], EPOCH, 0)
    )


def watermark_state(lake: Lake) -> DataFrame:
    """Two runs are logged: what had been read by the prior time, then everything."""
    log = RunLog(lake.spark, scratch_dir(lake.spark, "runlog"))
    for run_ts, part in ((PRIOR_TS, True), (RUN_TS, False)):
        rows = []
        for entity in ENTITY_ORDER:
            spec = ENTITIES[entity]
            df = lake.src.source(entity)
            if part:
                df = df.where(F.col(spec.watermark) < ts(PRIOR_TS))
            counts = df.agg(
                F.count("*").alias("n"),
                F.max(spec.watermark).cast("string").alias("t"),
                F.max(spec.pk).cast("string").alias("i"),
            )
            rows.append(
                counts.select(
                    ts(run_ts).alias("run_ts"),
                    F.lit(entity).alias("entity"),
                    F.col("n").alias("rows_read"),
                    F.col("n").alias("rows_upserted"),
                    F.col("n").alias("table_total"),
                    F.lit(part).alias("full_load"),
                    F.lit(False).alias("schema_drift"),
                    F.col("t").alias("high_watermark_ts"),
                    F.col("i").alias("high_watermark_id"),
                )
            )
        log.append(audit.stack(rows))
    return log.watermarks()


def ingest_upsert(lake: Lake) -> DataFrame:
    return lake.second_raw.select("order_id", "total_amount", "status", "_ingested_at")


def ingest_load_stats(lake: Lake) -> DataFrame:
    spec = ENTITIES["orders"]
    return ingest.load_stats(spec, lake.first_raw, lake.batch, full_load=False)


def ingest_run(lake: Lake) -> DataFrame:
    """A full run over the four entities, then an incremental one; both run logs."""
    lake.settle("orders", "payments")
    runs = Ingest(lake.spark, scratch_dir(lake.spark, "ingest"))
    sources = {e: lake.src.source(e) for e in ENTITY_ORDER}
    runs.run(sources, PRIOR_TS, mode="full")
    runs.run(sources, RUN_TS, mode="incremental")
    return runs.log.read()


def purge_keys(lake: Lake) -> DataFrame:
    gone = lake.src.orders.where(F.col("status") == "cancelled")
    return ingest.purge_keys(lake.src.source("orders"), gone, "order_id").select(
        "order_id", "status"
    )


def purge_orphans(lake: Lake) -> DataFrame:
    kept = ingest.purge_orphans(lake.src.source("payments"), lake.src.orders, "order_id")
    return kept.select("payment_id", "order_id")


def sample_k(lake: Lake) -> DataFrame:
    return ingest.sample_rows(lake.src.source("orders"), "order_id", 100, seed=7)


def latest_n(lake: Lake) -> DataFrame:
    return ingest.latest_rows(lake.src.source("orders"), "order_id", 500)


def write_layers(lake: Lake) -> DataFrame:
    """Publish all layers, then count the rows of every written table."""
    store = LayerStore(lake.spark, scratch_dir(lake.spark, "layers"))
    written = publish(Medallion(lake.tables.raw), store)
    return intents.table_counts(written)


# -- classification -----------------------------------------------------------------


def bronze(lake: Lake, entity: str) -> DataFrame:
    return lake.tables.bronze(entity)


def dedupe_business_key(lake: Lake) -> DataFrame:
    return classify.mark_duplicates(lake.tables.bronze("orders"), flag="duplicate").select(
        "order_id", "duplicate"
    )


def domain_check(lake: Lake) -> DataFrame:
    def check(entity: str, domain: tuple[str, ...]) -> DataFrame:
        checked = lake.tables.bronze(entity).select(
            F.lit(entity).alias("entity"), "status", (~outside("status", domain)).alias("known")
        )
        return checked.groupBy("entity", "status", "known").agg(F.count("*").alias("rows"))

    return check("orders", ORDER_STATUSES).unionByName(check("payments", PAYMENT_STATUSES))


def late_flag(lake: Lake) -> DataFrame:
    return lake.tables.bronze("orders").select("order_id", classify.late_flag().alias("is_late"))


def split_invariant(lake: Lake) -> DataFrame:
    t = lake.tables.share("orders", "payments")
    return _stack_entities(
        lambda e: audit.split_invariant(t.bronze(e), t.silver(e), t.rejects(e), ENTITIES[e].pk)
    )


def reject_histogram(lake: Lake) -> DataFrame:
    return _stack_entities(lambda e: audit.reject_histogram(lake.tables.rejects(e)))


def baseline_audit(lake: Lake) -> DataFrame:
    return audit.baseline_audit(*[lake.tables.bronze(e) for e in ENTITY_ORDER])


# -- refresh ------------------------------------------------------------------------


def evict_reprocessed(lake: Lake) -> DataFrame:
    kept = refresh.evict_reprocessed(lake.before.silver("orders"), lake.second_raw, "order_id")
    return kept.select("order_id", "_ingested_at")


def append_only_new(lake: Lake) -> DataFrame:
    before, after = lake.before.silver("orders"), lake.after.silver("orders")
    return refresh.append_only_new(after, before, "order_id").select("order_id", "_ingested_at")


def refresh_orders(lake: Lake) -> DataFrame:
    before = lake.before.silver("orders")
    now = lake.after.classified("orders")
    return refresh.refresh(before, now, "orders", "order_id", "strict")


def refresh_payments(lake: Lake, mode: str) -> DataFrame:
    lake.settle("payments")
    before = lake.before.silver("payments")
    now = lake.after.classified("payments")
    return refresh.refresh(before, now, "payments", "payment_id", mode)


def transition_report(lake: Lake) -> DataFrame:
    before = lake.before.share("orders").classified("orders")
    after = lake.after.share("orders").classified("orders")
    return refresh.transition_report(before, after, "order_id")


# -- gold ---------------------------------------------------------------------------


def live_tables(lake: Lake) -> OrderTables:
    """Two batches of orders applied one after the other: the first drop, then the second."""
    root = scratch_dir(lake.spark, "live")
    t = lake.settle("payments").tables
    made = GoldTables(
        lake.spark,
        root,
        lambda: t.silver("customers"),
        lambda: t.silver("products"),
        lambda: t.bronze("payments"),
        grain="month",
    )
    tables = OrderTables(lake.spark, root, grain="month", gold_tables=made)
    tables.apply(lake.first_raw, 0)
    tables.apply(lake.batch, 1)
    return tables


def gold_integrity(lake: Lake) -> DataFrame:
    t = lake.tables.share_gold()
    return audit.gold_integrity(t.obt, t.daily, t.silver("orders"))


def reconcile_status(lake: Lake) -> DataFrame:
    lake.tables.share("orders")
    named = intents.intent_frame(lake.tables, "order_status_breakdown")
    direct = lake.tables.silver("orders").groupBy("status").agg(
        F.count("*").alias("order_count"), F.sum("total_amount").alias("total_amount")
    )
    return audit.reconcile(named, direct, ["status"], ["order_count", "total_amount"])


def reconcile_category(lake: Lake) -> DataFrame:
    lake.tables.share_gold()
    named = intents.intent_frame(lake.tables, "revenue_by_category")
    unrealised = F.col("status").isin("cancelled", "returned")
    zero = F.lit(0).cast("decimal(12,2)")
    direct = lake.tables.obt.groupBy("product_category").agg(
        F.count("*").alias("order_count"),
        F.sum(F.when(unrealised, zero).otherwise(F.col("total_amount"))).alias("gross_revenue"),
    )
    return audit.reconcile(named, direct, ["product_category"], ["order_count", "gross_revenue"])


def catalogue(lake: Lake) -> DataFrame:
    """What may be asked while only the daily table has been built."""
    return intents.catalogue({"gold_revenue_daily": lake.tables.share_gold().daily})


# -- detection, ledger, history --------------------------------------------------------


def probe_reject(lake: Lake) -> DataFrame:
    t = lake.tables.share("orders", "payments")
    return detect.reject_probe(t.rejects("orders"), ORDER_REJECT_KEYS, "order_id").unionByName(
        detect.reject_probe(t.rejects("payments"), PAYMENT_REJECT_KEYS, "payment_id")
    )


def probe_evidence(lake: Lake) -> DataFrame:
    """One row per evidence row of every reject and flag."""
    t = lake.tables.share("orders", "payments")
    parts = [
        (detect.reject_evidence(t.rejects("orders"), ORDER_REJECT_KEYS, "order_id"), "order_id"),
        (detect.reject_evidence(t.rejects("payments"), PAYMENT_REJECT_KEYS, "payment_id"), "payment_id"),
        (detect.flag_evidence(t.silver("orders")), "order_id"),
    ]
    return audit.stack(
        [
            found.select(
                "failure_key", "found", "count", F.posexplode("sample_rows").alias("at", "row")
            ).select(
                "failure_key",
                "found",
                "count",
                "at",
                F.col(f"row.{pk}").alias("pk"),
                F.col("row.status").alias("status"),
                F.col("row._ingested_at").alias("ingested_at"),
            )
            for found, pk in parts
        ]
    )


def log_files_by_run(lake: Lake) -> DataFrame:
    """The log lines as text files of three groups, read back in their order."""
    root = scratch_dir(lake.spark, "logs")
    groups = ("logs/event.log", "storage/err", "storage/out")
    for i, group in enumerate(groups):
        lines = lake.src.log_lines.where(F.col("seq") % 3 == i)
        placed = lines.repartitionByRange(4, "seq").sortWithinPartitions("seq")
        placed.select("line").write.text(f"{root}/{group}")
    return logs.failures_by_run(read_log_lines(lake.spark, [f"{root}/{g}" for g in groups]))


def detection_sweep(lake: Lake) -> DataFrame:
    return detect.detection_sweep(lake.tables.share("orders"))


def cascade_triage(lake: Lake) -> DataFrame:
    failed = logs.run_result_failures(lake.src.run_documents)
    return detect.cascade_triage(detection_sweep(lake), failed)


def ambiguous_drop(lake: Lake) -> DataFrame:
    """Silver now against a baseline in which fewer orders were cancelled and some
    products cost more."""
    lake.tables.share("orders")
    orders, products = lake.tables.silver("orders"), lake.tables.silver("products")
    spared = (F.col("status") == "cancelled") & (F.col("order_id") % 3 != 0)
    base_orders = orders.withColumn(
        "status", F.when(spared, F.lit("placed")).otherwise(F.col("status"))
    )
    dearer = F.when(F.col("product_id") % 5 == 0, F.col("unit_price") * 2)
    base_products = products.withColumn("unit_price", F.coalesce(dearer, F.col("unit_price")))
    return detect.ambiguous_drop(base_orders, orders, base_products, products)


def defect_survival(lake: Lake) -> DataFrame:
    t = lake.tables.share("orders", "payments").share_gold()
    return detect.defect_survival(lake.src.ledger, t, audit.leak_checks(t.obt))


def incident_route(lake: Lake) -> DataFrame:
    windows = lake.src.diagnoses.select("window_id")
    return ledger.route_incidents(lake.src.ledger, "window_id", windows)


def ledger_window(lake: Lake) -> DataFrame:
    return ledger.ledger_window(lake.src.ledger, LEDGER_SINCE)


def ledger_cursor(lake: Lake) -> DataFrame:
    window = ledger.ledger_window(lake.src.ledger, LEDGER_SINCE)
    return ledger.next_cursor(window, LEDGER_SINCE)


def graded(lake: Lake) -> DataFrame:
    return grade.grade(lake.src.diagnoses, lake.src.ledger, "window_id")


def graded_tiers(lake: Lake, *tiers: str) -> DataFrame:
    return graded(lake).where(F.col("tier").isin(*tiers))


def grade_evidence(lake: Lake) -> DataFrame:
    return graded(lake).select("window_id", "matched", "evidence_score")


def grade_by_range(lake: Lake) -> DataFrame:
    return grade.grade_by_range(
        lake.src.timed_diagnoses, lake.src.ledger, "window_id", "span_start", "span_end"
    )


def similar_topk(lake: Lake) -> DataFrame:
    return history.similar_topk(lake.src.incident_notes, lake.src.incident_history)


def recurrence(lake: Lake) -> DataFrame:
    return history.recurrence(lake.src.incident_notes, lake.src.incident_history)


def similar_topk_recent(lake: Lake) -> DataFrame:
    """A look-back shorter than the history."""
    return history.similar_topk(lake.src.incident_notes, lake.src.incident_history, recent=20)


def recurrence_recent(lake: Lake) -> DataFrame:
    return history.recurrence(lake.src.incident_notes, lake.src.incident_history, recent=20)


def similar_topk_whole(lake: Lake) -> DataFrame:
    return history.similar_topk_whole(lake.src.incident_notes, lake.src.incident_history)


def run_result_summary(lake: Lake) -> DataFrame:
    """Failed nodes as text, one after the other."""
    found = logs.run_result_summary(lake.src.odd_run_documents)
    shown = F.transform("failed_nodes", lambda n: F.concat_ws(":", n["node"], n["status"], n["message"]))
    return found.withColumn("failed_nodes", F.array_join(shown, ";"))


def log_failure_fields(lake: Lake) -> DataFrame:
    """Fields as sorted text."""
    pairs = F.transform(F.map_entries("fields"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    found = logs.failure_fields(lake.src.log_lines)
    return found.withColumn("fields", F.array_join(F.array_sort(pairs), ";"))


# -- service levels ----------------------------------------------------------------------


def freshness_samples(lake: Lake) -> DataFrame:
    """Each order is injected at its order time and first seen with its first payment."""
    k = F.col("order_id")
    injected = lake.src.source("orders").select(
        "order_id",
        F.col("ordered_at").alias("injected_at"),
        (k % 90 * 1.5).alias("ingest_s"),
        (k % 240 * 1.0).alias("build_s"),
        (k % 30 * 0.5).alias("gold_wait_s"),
    )
    seen = lake.src.source("payments").select("order_id", F.col("paid_at").alias("seen_at"))
    return slo.freshness_lag(injected, seen)


def latency_nearest_rank(lake: Lake) -> DataFrame:
    return slo.latency_nearest_rank(lake.src.latency_samples, "role", "latency_ms")


QUANTILES = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}


def latency_sketch(lake: Lake) -> DataFrame:
    """Sketches per worker and hour, merged by role.

    Where the answers stand among all samples is shown as whether the asked rank lies
    within the stated error.
    """
    kept = slo.latency_sketches(lake.src.latency_samples, ["role", "worker", "run_id"])
    merged = slo.merge_sketches(slo.merge_sketches(kept, ["role", "worker"]), ["role"])
    merged = lake._keep("latency-sketch", slo.sketch_quantiles(merged, QUANTILES))
    ok = lake.src.latency_samples.where((F.col("outcome") == "ok") & F.col("latency_ms").isNotNull())
    places = []
    for name in QUANTILES:
        places += [
            F.count_if(F.col("latency_ms") < F.col(name)).alias(f"below_{name}"),
            F.count_if(F.col("latency_ms") <= F.col(name)).alias(f"upto_{name}"),
        ]
    placed = ok.join(merged.select("role", *QUANTILES), "role").groupBy("role").agg(*places)

    def near(name: str, p: float) -> Column:
        n = F.col("operations")
        low = F.col(f"below_{name}") / n <= p + slo.SKETCH_ERROR
        high = F.col(f"upto_{name}") / n >= p - slo.SKETCH_ERROR
        return (low & high).alias(f"{name}_near")

    return merged.join(placed, "role").select(
        "role",
        "operations",
        "errors",
        "timeouts",
        "max_ms",
        *[near(name, p) for name, p in QUANTILES.items()],
    )


def load_verdict(lake: Lake) -> DataFrame:
    """One run per hour of events."""
    runs = lake.src.latency_samples.groupBy("run_id").agg(
        F.sum("rows_committed").alias("rows_committed"), F.lit(3600).alias("seconds")
    )
    edges = slo.lock_wait_edges(lake.src.activity).withColumnRenamed("sampled_at", "run_id")
    return slo.load_verdict(runs, edges, floor_per_day=4_000)


# -- streams ------------------------------------------------------------------------------


def _event_stream(lake: Lake) -> DataFrame:
    ddl = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE"
    return (
        lake.spark.readStream.schema(ddl)
        .option("pathGlobFilter", "events.parquet")
        .parquet(lake.root)
    )


def stream_ingest(lake: Lake) -> DataFrame:
    root = scratch_dir(lake.spark, "stream-ingest")
    ddl = "o_orderkey BIGINT, o_custkey BIGINT, o_orderdate TIMESTAMP"
    source = (
        lake.spark.readStream.schema(ddl)
        .option("pathGlobFilter", "orders.parquet")
        .parquet(lake.root)
    )
    tables = OrderTables(lake.spark, root, grain="month")
    lines, parts = lake.src.table("lineitem"), lake.src.table("part")
    query = jobs.stream_ingest(
        source, tables, f"{root}/checkpoint", lambda df: derive_orders(df, lines, parts)
    )
    query.awaitTermination()
    return tables.silver()


def stream_incident_route(lake: Lake) -> DataFrame:
    root = scratch_dir(lake.spark, "stream-routes")
    routes = jobs.stream_routes(derive_ledger(_event_stream(lake)))
    query = jobs.upsert_windows(routes, f"{root}/table", "window_start", f"{root}/checkpoint")
    query.awaitTermination()
    return jobs.read_windows(lake.spark, f"{root}/table", "window_start")


def stream_minute_volume(lake: Lake) -> DataFrame:
    root = scratch_dir(lake.spark, "stream-minutes")
    counts = jobs.stream_minute_counts(_event_stream(lake), "ts")
    query = jobs.upsert_windows(counts, f"{root}/table", "minute", f"{root}/checkpoint")
    query.awaitTermination()
    return jobs.read_windows(lake.spark, f"{root}/table", "minute")


def _drop(path: str, rows: DataFrame) -> None:
    """One more drop in a folder that a stream reads, as many files as there are tasks."""
    rows.write.mode("append").parquet(path)


def _arrived(lake: Lake, path: str, like: DataFrame) -> DataFrame:
    """All files that came since the last drain, in one batch."""
    return lake.spark.readStream.schema(like.schema).parquet(path)


def stream_volume_spike(lake: Lake) -> DataFrame:
    """Accepted orders in two drops, the spike test after the second."""
    root = scratch_dir(lake.spark, "stream-spike")
    rows = lake.tables.share("orders").silver("orders").select("ordered_at")
    found = volumes.MinuteVolumes(lake.spark, root, grain="month")
    for part in (F.col("ordered_at") < ts(STREAM_CUT), F.col("ordered_at") >= ts(STREAM_CUT)):
        _drop(f"{root}/source", rows.where(part))
        counts = jobs.stream_minute_counts(_arrived(lake, f"{root}/source", rows), "ordered_at")
        volumes.stream_volumes(counts, found, f"{root}/checkpoint").awaitTermination()
    return found.spike()


def stream_payments(lake: Lake) -> DataFrame:
    """Payments and accepted orders as two streams of three drops.

    A drop has at most as many files as a batch takes, so that no task writes or reads a whole
    drop. Where it has fewer, a batch also takes files of the next one; as the delay covers all
    times and the markers come last, the verdicts do not depend on that. Every fifth early order comes one drop after its payments. The third drop is a marker
    beyond all times, which makes the verdicts of all orphans final.
    """
    root = scratch_dir(lake.spark, "stream-payments")
    lake.settle("payments")
    paid = lake.tables.bronze("payments").select(*ENTITIES["payments"].column_names, "_ingested_at")
    orders = lake.tables.share("orders").silver("orders").select("order_id", "ordered_at")
    early_payment = F.coalesce("paid_at", "_ingested_at") < ts(STREAM_CUT)
    early_order = (F.col("ordered_at") < ts(STREAM_CUT)) & (F.col("order_id") % 5 != 0)
    marker = lambda df, time: lake.spark.range(1).select(
        *[(ts("2100-01-01") if n == time else F.lit(None)).cast(k).alias(n) for n, k in df.dtypes]
    )
    files = max(2, lake.spark.sparkContext.defaultParallelism)
    for part in (early_payment, ~early_payment):
        _drop(f"{root}/payments", paid.where(part).coalesce(files))
    for part in (early_order, ~early_order):
        _drop(f"{root}/orders", orders.where(part).coalesce(files))
    _drop(f"{root}/payments", marker(paid, "paid_at"))
    _drop(f"{root}/orders", marker(orders, "ordered_at"))
    by_drop = lambda path, like: (
        lake.spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)
    )
    verdicts = payments.stream_payment_verdicts(
        by_drop(f"{root}/payments", paid),
        by_drop(f"{root}/orders", orders),
        # In the given tables orders and shipping dates lie up to seven years apart.
        delay="3000 days",
        reach="2600 days",
        ahead="2600 days",
    )
    table = PartitionedTable(lake.spark, f"{root}/verdicts", key_range("payment_id"))
    payments.keep_verdicts(verdicts, table, f"{root}/checkpoint").awaitTermination()
    return table.rows().select("payment_id", "reject_rule", "reject_reason")


def stream_ledger_once(lake: Lake) -> DataFrame:
    """Three polls of the ledger, each from half an hour before the last one's end."""
    root = scratch_dir(lake.spark, "stream-ledger")
    rows = lake.src.ledger.select("incident_id", "failure_key", "injected_at")
    cuts = ("2024-01-08 00:00:00", LEDGER_SINCE)
    back = F.expr("INTERVAL 30 MINUTES")
    at = F.col("injected_at")
    for since, until in zip((None, *cuts), (*cuts, None), strict=True):
        poll = rows if since is None else rows.where(at >= ts(since) - back)
        _drop(f"{root}/polls", poll if until is None else poll.where(at <= ts(until)))
        once = jobs.stream_ledger_once(_arrived(lake, f"{root}/polls", rows))
        jobs.append_rows(once, f"{root}/ledger", f"{root}/checkpoint").awaitTermination()
    return lake.spark.read.schema(rows.schema).parquet(f"{root}/ledger")


def _as_of(lake: Lake) -> str:
    """Newest order time: one scalar."""
    newest = lake.src.source("orders").agg(F.max("ordered_at").cast("string"))
    return newest.first()[0]


INTENT_WINDOW = {"start_date": "1996-01-01", "end_date": "1998-12-31"}

QUERIES: dict[str, Callable[[Lake], DataFrame]] = {
    # ingest
    "ingest_scan": ingest_scan,
    "ingest_window_orders": lambda k: ingest_window(k, "orders"),
    "ingest_window_payments": lambda k: ingest_window(k, "payments"),
    "ingest_window_customers": lambda k: ingest_window(k, "customers"),
    "ingest_schema_drift": ingest_schema_drift,
    "ingest_mixed_drift": ingest_mixed_drift,
    "ingest_drift_files": ingest_drift_files,
    "ingest_last_write": ingest_last_write,
    "ingest_stamp": ingest_stamp,
    "ingest_high_watermark": ingest_high_watermark,
    "watermark_state": watermark_state,
    "ingest_upsert": ingest_upsert,
    "ingest_load_stats": ingest_load_stats,
    "ingest_run": ingest_run,
    "purge_keys": purge_keys,
    "purge_orphans": purge_orphans,
    "sample_k": sample_k,
    "latest_n": latest_n,
    "write_layers": write_layers,
    # classification
    **{f"bronze_{e}": (lambda k, e=e: bronze(k, e)) for e in ENTITY_ORDER},
    **{f"classify_{e}": (lambda k, e=e: _verdicts(k, e)) for e in ENTITY_ORDER},
    "dedupe_business_key": dedupe_business_key,
    "domain_check": domain_check,
    **{f"silver_{e}": (lambda k, e=e: k.tables.silver(e)) for e in ENTITY_ORDER},
    "late_flag": late_flag,
    **{f"rejects_{e}": (lambda k, e=e: k.tables.rejects(e)) for e in ENTITY_ORDER},
    "split_invariant": split_invariant,
    "reject_histogram": reject_histogram,
    "baseline_audit": baseline_audit,
    # refresh
    "evict_reprocessed": evict_reprocessed,
    "append_only_new": append_only_new,
    "refresh_orders": refresh_orders,
    "refresh_payments": lambda k: refresh_payments(k, "strict"),
    "refresh_payments_reference": lambda k: refresh_payments(k, "reference"),
    "transition_report": transition_report,
    # gold
    "payment_rollup": lambda k: gold.payment_rollup(k.tables.silver("payments")),
    "gold_orders_obt": lambda k: k.tables.obt,
    "gold_revenue_daily": lambda k: k.tables.daily,
    "gold_obt_incremental": lambda k: live_tables(k).gold.obt.rows(),
    "gold_daily_incremental": lambda k: live_tables(k).gold.daily(),
    "gold_integrity": gold_integrity,
    "gold_leak_check": lambda k: audit.leak_checks(k.tables.share_gold().obt),
    "gold_duplicate_keys": lambda k: audit.duplicate_keys(k.tables.obt),
    "bronze_duplicate_keys": lambda k: audit.duplicate_keys(k.tables.bronze("orders")),
    "reconcile_status": reconcile_status,
    "reconcile_category": reconcile_category,
    # named questions
    "revenue_by_period": lambda k: intents.intent_frame(k.tables, "revenue_by_period"),
    "revenue_by_category": lambda k: intents.run_intent(k.tables, "revenue_by_category"),
    "revenue_by_country": lambda k: intents.run_intent(k.tables, "revenue_by_country"),
    "top_products": lambda k: intents.run_intent(k.tables, "top_products"),
    "order_status_breakdown": lambda k: intents.run_intent(k.tables, "order_status_breakdown"),
    "intent_params": lambda k: intents.run_intent(k.tables, "revenue_by_country", INTENT_WINDOW),
    "intent_order_by": lambda k: intents.run_intent(
        k.tables, "top_products", order_by="units_sold desc"
    ),
    "intent_limit": lambda k: intents.run_intent(k.tables, "top_products", limit=5000),
    "report_executive_summary": lambda k: intents.report_rows(
        k.tables.share_gold(), "executive_summary"
    ),
    "report_daily_revenue": lambda k: intents.report_rows(
        k.tables.share_gold(), "daily_revenue", INTENT_WINDOW
    ),
    "schema_info": lambda k: intents.schema_info(k.tables.share_gold()),
    "catalogue": catalogue,
    "table_counts": lambda k: intents.table_counts(
        k.tables.share("orders", "payments").share_gold()
    ),
    "portable_rows": lambda k: portable(k.tables.daily),
    # query basket
    "bq_full_scan": lambda k: basket.full_scan(k.tables.obt),
    "bq_rev_category": lambda k: basket.revenue_by_category(k.tables.obt),
    "bq_rev_country": lambda k: basket.revenue_by_country(k.tables.obt),
    "bq_top_products": lambda k: basket.top_products(k.tables.obt),
    "bq_status": lambda k: basket.status_breakdown(k.tables.obt),
    "bq_running_revenue": lambda k: basket.running_revenue(k.tables.daily),
    "bq_join_daily": lambda k: basket.daily_with_orders(
        k.tables.share_gold().daily, k.tables.obt
    ),
    "sq_daily_30d": lambda k: basket.daily_totals(k.src.source("orders"), _as_of(k)),
    "sq_category": lambda k: basket.category_revenue(
        k.src.source("orders"), k.src.source("products")
    ),
    "sq_segment": lambda k: basket.segment_average(
        k.src.source("orders"), k.src.source("customers")
    ),
    "sq_status": lambda k: basket.status_totals(k.src.source("orders")),
    # detection
    "probe_reject": probe_reject,
    "probe_evidence": probe_evidence,
    "probe_flag": lambda k: detect.flag_probe(k.tables.silver("orders")),
    "volume_spike": lambda k: detect.volume_spike(k.tables.silver("orders"), "ordered_at"),
    "detection_sweep": detection_sweep,
    "cascade_triage": cascade_triage,
    "ambiguous_drop": ambiguous_drop,
    "incident_occurrence": lambda k: ledger.occurrences(k.src.ledger),
    "defect_survival": defect_survival,
    "incident_route": incident_route,
    "log_failures": lambda k: logs.parse_failures(k.src.log_lines),
    "log_failures_latest": lambda k: logs.log_failures(k.src.log_lines),
    "log_failures_by_run": lambda k: logs.failures_by_run(k.src.log_lines),
    "log_files_by_run": log_files_by_run,
    "run_result_failures": lambda k: logs.run_result_failures(k.src.run_documents),
    "run_result_summary": run_result_summary,
    "log_failure_fields": log_failure_fields,
    # ledger, grading, history
    "ledger_window": ledger_window,
    "ledger_cursor": ledger_cursor,
    "ledger_latest": lambda k: ledger.ledger_latest(k.src.ledger),
    "grade_single": lambda k: graded_tiers(k, "exact", "alias", "miss"),
    "grade_cascade": lambda k: graded_tiers(k, "cascade"),
    "grade_evidence": grade_evidence,
    "grade_no_run": lambda k: graded_tiers(k, "no-run"),
    "grade_by_range": grade_by_range,
    "scorecard": lambda k: grade.scorecard(graded(k)),
    "similar_topk": similar_topk,
    "recurrence": recurrence,
    "similar_topk_whole": similar_topk_whole,
    "similar_topk_recent": similar_topk_recent,
    "recurrence_recent": recurrence_recent,
    "validate_text": lambda k: logs.validate_text(k.src.reports),
    # service levels
    "freshness_lag": freshness_samples,
    "freshness_report": lambda k: slo.freshness_report(freshness_samples(k)),
    "latency_summary": lambda k: slo.latency_summary(k.src.latency_samples),
    "latency_nearest_rank": latency_nearest_rank,
    "latency_sketch": latency_sketch,
    "merge_stats": lambda k: slo.merge_stats(k.src.latency_samples, ["role", "worker"]),
    "lock_wait_edges": lambda k: slo.lock_wait_edges(k.src.activity),
    "load_verdict": load_verdict,
    "gate_rollup": lambda k: slo.gate_rollup(k.src.gates, "suite"),
    # streams
    "stream_ingest": stream_ingest,
    "stream_incident_route": stream_incident_route,
    "stream_minute_volume": stream_minute_volume,
    "stream_volume_spike": stream_volume_spike,
    "stream_payments": stream_payments,
    "stream_ledger_once": stream_ledger_once,
}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """One registered query, with result types every client reads alike."""
    return comparable(QUERIES[name](Lake(spark, sf_dir)))
