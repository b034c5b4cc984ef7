"""The four source entities, the incident ledger and the sample tables, derived from
the TPC-H-like tables, the event stream and the text tables.

The given tables are clean, so defects are laid over them by modular expressions on
the key. Every derivation keeps all rows and uses only joins on unique keys and
aggregations that combine before the shuffle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.schemas import (
    ENTITIES,
    FAILURE_KEYS,
    FAILURE_LINE_PREFIX,
    ORDER_STATUSES,
    ORPHAN_ORDER_ID,
    PAYMENT_METHODS,
)
from sluice.sources.readers import project

TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderdate TIMESTAMP",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_returnflag STRING, l_shipdate TIMESTAMP",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, "
    "props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "pages": "page_id BIGINT, url STRING, html STRING",
}


def every(key: str, n: int) -> Column:
    return F.col(key) % n == 0


def pick(values: tuple[str, ...], index: Column) -> Column:
    """The value at a 0-based index."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def plus_days(col: Column, days: Column) -> Column:
    return col + F.make_dt_interval(days=days.cast("int"))


def _lineage(df: DataFrame, watermark: str, delay: Column) -> DataFrame:
    return df.withColumns(
        {
            "_ingested_at": plus_days(F.col(watermark), delay),
            "_source_watermark": F.col(watermark),
        }
    )


def derive_customers(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    origin = F.when(every("c_custkey", 83), F.lit("1999-01-01")).otherwise(F.lit("1993-01-01"))
    rows = customer.join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("full_name"),
        F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("city"),
        F.when(every("c_custkey", 89), F.lit("")).otherwise(F.col("c_mktsegment")).alias("segment"),
        plus_days(origin.cast("timestamp"), F.col("c_custkey") % 700).alias("created_at"),
    )
    return _lineage(rows, "created_at", F.col("customer_id") % 20)


def derive_products(part: DataFrame) -> DataFrame:
    price = F.col("p_retailprice").cast("decimal(10,2)")
    share = F.lit("0.6").cast("decimal(2,1)")
    rows = part.select(
        F.col("p_partkey").alias("product_id"),
        F.concat("p_brand", F.lit("-"), F.col("p_partkey").cast("string")).alias("sku"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        price.alias("unit_price"),
        F.when(every("p_partkey", 97), F.lit(-1).cast("decimal(10,2)"))
        .otherwise((price * share).cast("decimal(10,2)"))
        .alias("cost"),
        plus_days(F.lit("1993-06-01").cast("timestamp"), F.col("p_partkey") % 500).alias(
            "created_at"
        ),
    )
    return _lineage(rows, "created_at", F.col("product_id") % 20)


def derive_orders(orders: DataFrame, lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """One order per order key, plus an exact copy under the next id for some keys."""
    lines = lineitem.groupBy("l_orderkey").agg(
        F.min("l_partkey").alias("product_id"),
        F.sum("l_quantity").cast("int").alias("line_quantity"),
    )
    priced = (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(
            part.select("p_partkey", F.col("p_retailprice").cast("decimal(10,2)").alias("price")),
            F.col("product_id") == F.col("p_partkey"),
            "left",
        )
        .withColumn("k", F.col("o_orderkey"))
    )
    bad_price = F.lit("-49.99").cast("decimal(10,2)")
    copies = F.when(every("k", 127), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return priced.withColumn("copy", F.explode(copies)).select(
        (F.col("k") * 2 + F.col("copy")).alias("order_id"),
        F.when(~every("k", 101), F.col("o_custkey")).alias("customer_id"),
        "product_id",
        F.when(every("k", 103), F.lit(-5)).otherwise(F.col("line_quantity")).alias("quantity"),
        F.when(every("k", 107), bad_price)
        .when(~every("k", 139), F.col("price"))
        .alias("unit_price"),
        F.when(every("k", 107), bad_price.cast("decimal(12,2)"))
        .when(every("k", 109), F.lit(0).cast("decimal(12,2)"))
        .otherwise((F.col("line_quantity") * F.col("price")).cast("decimal(12,2)"))
        .alias("total_amount"),
        F.when(every("k", 113), F.lit("<script>"))
        .otherwise(pick(ORDER_STATUSES, F.col("k") % 5))
        .alias("status"),
        F.col("o_orderdate").alias("ordered_at"),
        plus_days(F.col("o_orderdate"), F.col("k") % 20).alias("_ingested_at"),
        F.col("o_orderdate").alias("_source_watermark"),
        every("k", 137).alias("_schema_drift"),
    )


def derive_payments(lineitem: DataFrame) -> DataFrame:
    """One payment per order line number; repeated line numbers are summed.

    The flag is compared by its code: a text maximum would turn the hash aggregation
    into a sorting one.
    """
    paid = lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).alias("price"),
        F.max(F.ascii("l_returnflag")).alias("flag"),
        F.max("l_shipdate").alias("paid_at"),
    )
    keyed = paid.withColumn("payment_id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    rows = keyed.select(
        "payment_id",
        F.when(every("payment_id", 131), F.lit(ORPHAN_ORDER_ID).cast("bigint"))
        .otherwise(F.col("l_orderkey") * 2)
        .alias("order_id"),
        pick(PAYMENT_METHODS, F.col("l_linenumber") % 5).alias("method"),
        F.when(every("payment_id", 199), F.lit(-1).cast("decimal(12,2)"))
        .otherwise(F.col("price").cast("decimal(12,2)"))
        .alias("amount"),
        F.when(every("payment_id", 197), F.lit("unknown"))
        .when(F.col("flag") == ord("A"), F.lit("authorized"))
        .when(F.col("flag") == ord("N"), F.lit("captured"))
        .otherwise(F.lit("refunded"))
        .alias("status"),
        "paid_at",
    )
    return _lineage(rows, "paid_at", F.col("payment_id") % 9)


def derive_ledger(events: DataFrame) -> DataFrame:
    """Every error event is one injected incident."""
    key = pick(FAILURE_KEYS, F.col("event_id") % len(FAILURE_KEYS))
    return events.where(F.col("event_type") == "error").select(
        F.col("event_id").alias("incident_id"),
        key.alias("failure_key"),
        F.concat(F.lit("seen for user "), F.col("user_id").cast("string")).alias("detail"),
        pick(("Data Profiler", "Pipeline Watch", "Manager"), F.col("user_id") % 3).alias(
            "detected_by"
        ),
        F.col("ts").alias("injected_at"),
        ten_minutes(F.col("ts")).alias("window_id"),
    )


def ten_minutes(col: Column) -> Column:
    """Number of the ten-minute window a time falls into."""
    return F.floor(F.unix_micros(col) / F.lit(600_000_000)).cast("bigint")


class Retail:
    """Lazy frames over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}.parquet")

    # -- the four entities, as they stand in the raw zone ---------------------------
    @cached_property
    def customers(self) -> DataFrame:
        return derive_customers(self.table("customer"), self.table("nation"), self.table("region"))

    @cached_property
    def products(self) -> DataFrame:
        return derive_products(self.table("part"))

    @cached_property
    def orders(self) -> DataFrame:
        return derive_orders(self.table("orders"), self.table("lineitem"), self.table("part"))

    @cached_property
    def payments(self) -> DataFrame:
        return derive_payments(self.table("lineitem"))

    def raw(self, entity: str) -> DataFrame:
        return getattr(self, entity)

    def source(self, entity: str) -> DataFrame:
        """The entity as its source system shows it, without lineage stamps."""
        return project(self.raw(entity), ENTITIES[entity])

    # -- incidents -------------------------------------------------------------------
    @cached_property
    def ledger(self) -> DataFrame:
        return derive_ledger(self.table("events"))

    @cached_property
    def diagnoses(self) -> DataFrame:
        """One diagnosis per ten-minute window with traffic, covering every tier."""
        last = (
            self.ledger.groupBy("window_id")
            .agg(F.max_by("failure_key", F.struct("injected_at", "incident_id")).alias("last_key"))
            .withColumnRenamed("window_id", "_w")
        )
        windows = self.table("events").select(ten_minutes(F.col("ts")).alias("window_id")).distinct()
        kind = F.col("window_id") % 6
        surface = (
            F.when(F.col("last_key") == "orphan_payment", "silver_payments_rejects")
            .when(F.col("last_key") == "late_arrival", "silver_orders.is_late")
            .otherwise("silver_orders_rejects")
        )
        swapped = (
            F.when(F.col("last_key") == "negative_price", "recurring_incident")
            .when(F.col("last_key") == "recurring_incident", "negative_price")
            .otherwise("late_arrival")
        )
        named = F.array(F.lit("missing_customer"), F.lit("volume_spike"), F.lit("negative_price"))
        return windows.join(last, F.col("window_id") == F.col("_w"), "left").select(
            "window_id",
            F.when(kind == 1, swapped)
            .when(kind == 2, F.lit("multi_failure_cascade"))
            .when(kind == 3, F.lit("schema_drift"))
            .when(kind == 4, F.lit(None))
            .otherwise(F.coalesce(F.col("last_key"), F.lit("slow_source")))
            .alias("failure_key"),
            F.when(kind == 2, named)
            .otherwise(F.array().cast("array<string>"))
            .alias("sub_failures"),
            F.when(kind == 5, F.concat(F.lit(" "), surface, F.lit(" ")))
            .when(kind == 0, surface)
            .when(kind == 1, F.lit(""))
            .otherwise(F.lit("silver_orders_rejects"))
            .alias("evidence_surface"),
        )

    @cached_property
    def timed_diagnoses(self) -> DataFrame:
        """The diagnoses with spans of time that overlap: 10 minutes to six hours."""
        begin = F.col("window_id") * 600 - 780
        return self.diagnoses.withColumns(
            {
                "span_start": F.timestamp_seconds(begin),
                "span_end": F.timestamp_seconds(begin + (F.col("window_id") % 51 + 1) * 420),
            }
        )

    @cached_property
    def incident_history(self) -> DataFrame:
        """Past incidents whose notes are the benchmark passages."""
        return self.table("benchmark").select(
            F.col("item_id").alias("incident_id"),
            pick(FAILURE_KEYS, F.col("item_id") % len(FAILURE_KEYS)).alias("failure_key"),
            F.col("text").alias("detail"),
            F.lit("Manager").alias("detected_by"),
            plus_days(F.lit("2024-01-01").cast("timestamp"), F.col("item_id")).alias("injected_at"),
        )

    @cached_property
    def incident_notes(self) -> DataFrame:
        """Free-text descriptions to look up in the history.

        Dealt by key, as a lookup takes far longer than moving its text, however the files are cut.
        """
        notes = self.table("documents").select(F.col("doc_id").alias("query_id"), "text")
        return notes.repartition("query_id")

    @cached_property
    def reports(self) -> DataFrame:
        """Post-mortem reports, one per document and one per web page."""

        def report(df: DataFrame, prefix: str, key: str, label: str, cause: str, body: str):
            return df.select(
                F.concat(F.lit(prefix), F.col(key).cast("string")).alias("report_id"),
                F.when(every(key, 11), F.lit("  ")).otherwise(F.col(label)).alias("incident_key"),
                F.when(every(key, 7), F.lit(" too short ")).otherwise(F.col(cause)).alias(
                    "root_cause"
                ),
                F.col(body).alias("evidence"),
                F.when(every(key, 13), F.lit("dump 0x00 follows")).otherwise(F.col(label)).alias(
                    "proposed_fix"
                ),
                F.col(cause).alias("recurrence_note"),
            )

        documents = report(self.table("documents"), "d", "doc_id", "source", "text", "lang")
        pages = report(self.table("pages"), "p", "page_id", "url", "url", "html")
        return documents.unionByName(pages)

    @cached_property
    def log_lines(self) -> DataFrame:
        """One log line per event; error events write the failure contract line."""
        run = F.concat(F.lit("r-"), F.col("user_id").cast("string"))
        failed = F.concat(
            F.lit(f"ERROR {FAILURE_LINE_PREFIX} run_id="),
            run,
            F.lit(" job=backbone attempt="),
            (F.col("event_id") % 3).cast("string"),
            F.lit(" error=step failed: code="),
            (F.col("event_id") % 100).cast("string"),
            F.lit(" props "),
            F.col("props"),
            F.lit("  "),
        )
        healthy = F.concat(F.lit("INFO run_id="), run, F.lit(" type="), F.col("event_type"))
        return self.table("events").select(
            F.col("event_id").alias("seq"),
            F.when(F.col("event_type") == "error", failed).otherwise(healthy).alias("line"),
        )

    @cached_property
    def run_documents(self) -> DataFrame:
        """One run-results JSON document per event; some are cut short."""
        status = pick(
            ("success", "Error", "fail", "SKIPPED", "runtime error", "pass"), F.col("event_id") % 6
        )
        body = F.concat(
            F.lit('{"results":[{"unique_id":"model.'),
            F.col("event_type"),
            F.lit('","status":"'),
            status,
            F.lit('","message":"user '),
            F.col("user_id").cast("string"),
            F.lit('"},{"unique_id":"model.gold","status":"success","message":null}]}'),
        )
        return self.table("events").select(
            F.col("event_id").alias("document_id"),
            F.when(every("event_id", 17), F.substring(body, 1, 20)).otherwise(body).alias("body"),
        )

    @cached_property
    def odd_run_documents(self) -> DataFrame:
        """Run documents of which some are of another shape."""
        return self.run_documents.withColumn(
            "body",
            F.when(every("document_id", 19), F.lit("[1, 2]"))
            .when(every("document_id", 23), F.lit('{"metadata":{}}'))
            .when(every("document_id", 29), F.lit('{"results":{"unique_id":"x"}}'))
            .when(every("document_id", 31), F.lit('{"results":["loose",{"status":"FAIL"}]}'))
            .when(every("document_id", 37), F.lit(None).cast("string"))
            .otherwise(F.col("body")),
        )

    # -- sample tables for the service-level statistics -------------------------------
    @cached_property
    def latency_samples(self) -> DataFrame:
        outcome = (
            F.when(every("user_id", 17), "timeout").when(every("user_id", 13), "error").otherwise("ok")
        )
        return self.table("events").select(
            F.col("event_type").alias("role"),
            (F.col("user_id") % 4).alias("worker"),
            F.col("value").alias("latency_ms"),
            outcome.alias("outcome"),
            F.when(outcome == "ok", F.col("user_id") % 25 + 1)
            .otherwise(F.lit(0))
            .cast("bigint")
            .alias("rows_committed"),
            F.date_trunc("hour", "ts").alias("run_id"),
        )

    @cached_property
    def activity(self) -> DataFrame:
        """Database activity: one row per (sample, pid)."""
        app = (
            F.when(F.col("kind") < "e", "dagster_ingest")
            .when(F.col("kind") < "s", "oltp_writer")
            .otherwise("console")
        )
        seen = (
            self.table("events")
            .groupBy(F.date_trunc("hour", "ts").alias("sampled_at"), F.col("user_id").alias("pid"))
            .agg(F.min("event_type").alias("kind"), F.min("event_id").alias("first_id"))
        )
        return seen.select(
            "sampled_at",
            "pid",
            app.alias("app"),
            F.when(F.col("first_id") % 3 != 0, "Lock").otherwise("Client").alias("wait_event_type"),
            F.lit("transactionid").alias("wait_event"),
            F.concat(F.lit("update orders set status = "), F.col("kind")).alias("query"),
            F.array(F.col("pid") + 1, F.col("pid") + 2, F.col("pid") + 7).alias("blocking_pids"),
        )

    @cached_property
    def gates(self) -> DataFrame:
        """Daily gate results, one gate per event type."""
        per = (
            self.table("events")
            .groupBy(F.to_date("ts").alias("suite"), F.col("event_type").alias("gate"))
            .agg(F.count("*").alias("n"), F.max("value").alias("worst"))
        )
        return per.select(
            "suite",
            "gate",
            F.when(F.col("n") % 7 != 0, F.lit("SKIP"))
            .when(F.col("worst") > 300, F.lit("FAIL"))
            .when(F.col("worst") > 290, F.lit("ERROR"))
            .otherwise(F.lit("PASS"))
            .alias("status"),
        )
