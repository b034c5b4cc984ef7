"""Freshness, latency, lock-wait and load statistics over sample tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.expressions import round_to, seconds_between
from sluice.functions.ranking import nearest_rank, percentiles
from sluice.schemas import ANALYTICS_APP, FRESHNESS_BUDGET_S, LOAD_FLOORS, WRITER_APP

# Size of a latency sketch and the error of its ranks.
SKETCH_K = 800
SKETCH_ERROR = 0.01

STAGES = ("ingest_s", "build_s", "gold_wait_s")


def freshness_lag(injections: DataFrame, sightings: DataFrame) -> DataFrame:
    """End-to-end lag of each injected order: first sighting minus injection.

    ``injections`` holds (order_id, injected_at, stage seconds...), ``sightings`` any
    number of (order_id, seen_at) rows per order.
    """
    first = sightings.groupBy("order_id").agg(F.min("seen_at").alias("visible_at"))
    joined = injections.join(first, "order_id", "left")
    lag = seconds_between(F.col("visible_at"), F.col("injected_at"))
    return joined.select(
        *injections.columns,
        "visible_at",
        lag.alias("end_to_end_lag_s"),
        F.col("visible_at").isNotNull().alias("visible"),
    )


def freshness_report(samples: DataFrame, budget_s: float = FRESHNESS_BUDGET_S) -> DataFrame:
    """Medians and the verdict in one row; without samples the run is inconclusive."""
    measured = samples.where(F.col("visible"))
    names = ("end_to_end_lag_s", *STAGES)
    pairs = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
    long = measured.select(F.explode(F.array(*pairs)).alias("m")).select("m.metric", "m.value")
    medians = percentiles(long, ["metric"], "value", {"median": 0.5})
    by_name = medians.agg(
        *[F.max(F.when(F.col("metric") == n, F.col("median"))).alias(f"_{n}") for n in names]
    ).withColumn("_one", F.lit(1))
    extremes = measured.agg(
        F.count("*").alias("samples"),
        F.min("end_to_end_lag_s").alias("_min"),
        F.max("end_to_end_lag_s").alias("_max"),
    ).withColumn("_one", F.lit(1))

    def shown(col: str):
        return F.coalesce(round_to(F.col(col), 3), F.lit(0.0))

    verdict = (
        F.when(F.col("samples") == 0, "INCONCLUSIVE")
        .when(F.col("_end_to_end_lag_s") <= budget_s, "PASS")
        .otherwise("FAIL")
    )
    return extremes.join(by_name, "_one").select(
        verdict.alias("verdict"),
        F.lit(float(budget_s)).alias("budget_s"),
        "samples",
        shown("_end_to_end_lag_s").alias("median_lag_s"),
        shown("_min").alias("min_lag_s"),
        shown("_max").alias("max_lag_s"),
        *[shown(f"_{s}").alias(f"median_{s}") for s in STAGES],
    )


def latency_summary(samples: DataFrame, by: Sequence[str] = ("role",)) -> DataFrame:
    """Operations, errors, timeouts and interpolated percentiles per group."""
    by = list(by)
    tally = merge_stats(samples, by)
    ok = samples.where(F.col("outcome") == "ok")
    points = percentiles(ok, by, "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99})
    rounded = points.select(
        *by, *[round_to(F.col(p), 2).alias(p) for p in ("p50_ms", "p95_ms", "p99_ms")]
    )
    out = tally.join(rounded, by, "left")
    return out.select(
        *by,
        F.col("operations").alias("count"),
        "errors",
        "timeouts",
        "rows_committed",
        *[F.coalesce(p, F.lit(0.0)).alias(p) for p in ("p50_ms", "p95_ms", "p99_ms")],
        round_to(F.coalesce("max_ms", F.lit(0.0)), 2).alias("max_ms"),
    )


def merge_stats(samples: DataFrame, by: Sequence[str] = ("role",)) -> DataFrame:
    """Tallies of all workers of a role taken together."""
    ok = F.col("outcome") == "ok"
    return samples.groupBy(*by).agg(
        F.count_if(ok).alias("operations"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
        F.count_if(F.col("outcome") == "timeout").alias("timeouts"),
        F.coalesce(F.sum(F.when(ok, F.col("rows_committed"))), F.lit(0)).alias("rows_committed"),
        F.max(F.when(ok, F.col("latency_ms"))).alias("max_ms"),
    )


def latency_sketches(samples: DataFrame, by: Sequence[str], k: int = SKETCH_K) -> DataFrame:
    """One small KLL sketch of the successful latencies per group, with the tallies.

    A row has a bounded size whatever the number of samples, so it can be kept per
    worker and hour and merged later without the samples. Groups without a success
    have an empty sketch.
    """
    value = F.when(F.col("outcome") == "ok", F.col("latency_ms").cast("double"))
    ok = F.col("outcome") == "ok"
    return samples.groupBy(*by).agg(
        F.count_if(ok & F.col("latency_ms").isNotNull()).alias("operations"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
        F.count_if(F.col("outcome") == "timeout").alias("timeouts"),
        F.max(value).alias("max_ms"),
        F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch"),
    )


def merge_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches and tallies of coarser groups; may be merged again."""
    return sketches.groupBy(*by).agg(
        F.sum("operations").alias("operations"),
        F.sum("errors").alias("errors"),
        F.sum("timeouts").alias("timeouts"),
        F.max("max_ms").alias("max_ms"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    )


def sketch_quantiles(sketches: DataFrame, points: dict[str, float]) -> DataFrame:
    """Quantiles of each sketch, NULL for an empty one.

    The rank of an answer is off by at most ``SKETCH_ERROR`` with the default size, at a
    confidence of 99%.
    """
    filled = F.kll_sketch_get_n_double("sketch") > 0
    found = {
        name: F.when(filled, F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))))
        for name, p in points.items()
    }
    return sketches.withColumns(found).drop("sketch")


def latency_nearest_rank(samples: DataFrame, by: str, value: str) -> DataFrame:
    """Nearest-rank p50, p95 and maximum per group, and over all samples as ``*``."""
    both = samples.select(
        F.explode(F.array(F.col(by), F.lit("*"))).alias(by), F.col(value).cast("double").alias(value)
    )
    return nearest_rank(both, [by], value, {"p50_ms": 50, "p95_ms": 95, "max_ms": 100})


def lock_wait_edges(activity: DataFrame) -> DataFrame:
    """Who waits behind whom: one row per (sample, waiter, blocker).

    ``waiter_query`` is a short form for display, ``waiter_text`` the whole query. Only
    lock waits with a known blocker count. The blocker side is unique on
    (sample, pid), so a pid many sessions wait for is split on the waiter side.
    """
    waiting = activity.where(
        (F.col("wait_event_type") == "Lock") & (F.size("blocking_pids") > 0)
    ).select(
        "sampled_at",
        F.col("pid").alias("waiter_pid"),
        F.col("app").alias("waiter_app"),
        "wait_event_type",
        "wait_event",
        F.left("query", F.lit(200)).alias("waiter_query"),
        F.col("query").alias("waiter_text"),
        F.explode("blocking_pids").alias("blocker_pid"),
    )
    blockers = activity.select(
        "sampled_at", F.col("pid").alias("blocker_pid"), F.col("app").alias("blocker_app")
    )
    attributable = (F.col("waiter_app") == WRITER_APP) & (F.col("blocker_app") == ANALYTICS_APP)
    return (
        waiting.join(blockers, ["sampled_at", "blocker_pid"])
        .select(
            "sampled_at",
            "waiter_pid",
            "waiter_app",
            "blocker_pid",
            "blocker_app",
            "wait_event_type",
            "wait_event",
            "waiter_query",
            "waiter_text",
        )
        .withColumn("analytics_attributable", attributable)
    )


def load_verdict(
    runs: DataFrame,
    edges: DataFrame,
    floor_per_day: float = LOAD_FLOORS["full"],
    max_waits: int = 0,
) -> DataFrame:
    """Per run: the load reached, the lock waits seen, and a three-way verdict.

    ``runs`` holds (run_id, rows_committed, seconds), ``edges`` (run_id,
    analytics_attributable). Below the floor nothing is proven either way.
    """
    waits = edges.groupBy("run_id").agg(
        F.count_if("analytics_attributable").alias("_attributable"),
        F.count_if(~F.col("analytics_attributable")).alias("_other"),
    )
    per_day = F.when(
        F.col("seconds") > 0, F.col("rows_committed") / F.col("seconds") * 86_400
    ).otherwise(F.lit(0.0))
    attributable = F.coalesce("_attributable", F.lit(0))
    met = per_day >= floor_per_day
    clean = attributable <= max_waits
    return runs.join(waits, "run_id", "left").select(
        "run_id",
        "rows_committed",
        "seconds",
        round_to(per_day, 1).alias("achieved_per_day"),
        met.alias("load_floor_met"),
        attributable.alias("attributable_waits"),
        F.coalesce("_other", F.lit(0)).alias("other_waits"),
        F.when(~met, "INCONCLUSIVE").when(clean, "PASS").otherwise("FAIL").alias("verdict"),
    )


def gate_rollup(gates: DataFrame, by: str) -> DataFrame:
    """Overall verdict per suite. Errors count as failures, skips count for nothing."""
    counts = gates.groupBy(by).agg(
        F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status").isin("FAIL", "ERROR")).alias("failed"),
        F.count_if(F.col("status") == "SKIP").alias("skipped"),
    )
    return counts.withColumn(
        "overall",
        F.when(F.col("failed") > 0, "FAIL")
        .when(F.col("passed") == 0, "INCONCLUSIVE")
        .otherwise("PASS"),
    )
