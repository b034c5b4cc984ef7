"""The incident ledger: cursor windows, occurrence numbers and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.expressions import ts
from sluice.functions.ranking import ordinal
from sluice.schemas import CASCADE_KEY, HUMAN_GATED_KEYS


def ledger_window(ledger: DataFrame, since: str, after_id: int | None = None) -> DataFrame:
    """Incidents at or after the cursor.

    The time cursor alone reads its last incident again (at least once). With
    ``after_id`` the cursor is (time, id) and strictly after.
    """
    start = ts(since)
    if after_id is None:
        return ledger.where(F.col("injected_at") >= start)
    later = F.col("injected_at") > start
    same = (F.col("injected_at") == start) & (F.col("incident_id") > after_id)
    return ledger.where(later | same)


def next_cursor(window: DataFrame, since: str) -> DataFrame:
    """One row: the cursor to poll from next; an empty window leaves it where it was."""
    last = F.max(F.struct("injected_at", "incident_id"))
    return window.agg(last.alias("c"), F.count("*").alias("incidents")).select(
        F.coalesce("c.injected_at", ts(since)).alias("cursor_ts"),
        F.col("c.incident_id").alias("cursor_id"),
        "incidents",
    )


def ledger_latest(ledger: DataFrame) -> DataFrame:
    """The most recent failure key."""
    return ledger.agg(
        F.max_by("failure_key", F.struct("injected_at", "incident_id")).alias("failure_key")
    )


def occurrences(ledger: DataFrame) -> DataFrame:
    """Each incident with its occurrence number within its failure key.

    Fourteen keys share the whole ledger, so ranks are built over range partitions.
    """
    order = [F.asc("injected_at"), F.asc("incident_id")]
    return ordinal(
        ledger.select("incident_id", "failure_key", "injected_at"), ["failure_key"], order, "occurrence"
    )


def window_keys(ledger: DataFrame, window_col: str) -> DataFrame:
    """Per window: distinct keys, the last key, and the number of incidents.

    All three combine before the shuffle; the keys are a closed set of fourteen.
    """
    return ledger.groupBy(window_col).agg(
        F.array_sort(F.collect_set("failure_key")).alias("keys"),
        F.max_by("failure_key", F.struct("injected_at", "incident_id")).alias("last_key"),
        F.count("*").alias("incidents"),
    )


def keys_in_spans(
    spans: DataFrame, ledger: DataFrame, span_col: str, start: str, end: str, cell_s: int = 600
) -> DataFrame:
    """What ``window_keys`` returns, for spans of time: ``start`` included, ``end`` not.

    An interval join by cells of time. A span covers whole cells and at most two in
    part. For whole cells it meets one summary per cell and key instead of the
    incidents; only in its outer cells does it meet single incidents. Spans without an
    incident are left out. ``cell_s`` should be near the length of a usual span; a long
    one is dealt out over its cells.
    """
    if cell_s < 1:
        raise ValueError("cell_s must be at least 1")

    def cell(micros: Column) -> Column:
        return F.floor(micros / F.lit(cell_s * 1_000_000)).cast("bigint")

    begin, stop = F.unix_micros(start), F.unix_micros(end)
    covered = spans.where(begin < stop).select(
        F.col(span_col),
        begin.alias("_begin"),
        stop.alias("_stop"),
        F.explode(F.sequence(cell(begin), cell(stop - 1))).alias("_cell"),
    )
    width = F.lit(cell_s * 1_000_000)
    whole = (F.col("_begin") <= F.col("_cell") * width) & ((F.col("_cell") + 1) * width <= F.col("_stop"))

    at = F.unix_micros("injected_at")
    last = F.struct("injected_at", "incident_id")
    incidents = ledger.select("failure_key", last.alias("_last"), at.alias("_at"), cell(at).alias("_cell"))
    by_cell = incidents.groupBy("_cell", "failure_key").agg(
        F.max("_last").alias("_last"), F.count("*").alias("_n")
    )
    inner = covered.where(whole).join(by_cell, "_cell").select(span_col, "failure_key", "_last", "_n")
    outer = (
        covered.where(~whole)
        .join(incidents, "_cell")
        .where((F.col("_at") >= F.col("_begin")) & (F.col("_at") < F.col("_stop")))
        .select(span_col, "failure_key", "_last", F.lit(1).cast("bigint").alias("_n"))
    )
    return inner.unionByName(outer).groupBy(span_col).agg(
        F.array_sort(F.collect_set("failure_key")).alias("keys"),
        F.max_by("failure_key", "_last").alias("last_key"),
        F.sum("_n").alias("incidents"),
    )


def route(keys: Column, incidents: Column) -> Column:
    """Cascade if the window names one or holds several distinct keys."""
    cascade = F.array_contains(keys, CASCADE_KEY) | (F.size(keys) > 1)
    return F.when(incidents == 0, "no-run").when(cascade, "cascade").otherwise("base")


def route_incidents(ledger: DataFrame, window_col: str, windows: DataFrame | None = None) -> DataFrame:
    """Route of every window; windows without incidents appear if they are given."""
    found = window_keys(ledger, window_col)
    if windows is not None:
        found = windows.join(found, window_col, "left")
    keys = F.coalesce("keys", F.array().cast("array<string>"))
    incidents = F.coalesce("incidents", F.lit(0))
    chosen = route(keys, incidents)
    return found.select(
        window_col,
        chosen.alias("route"),
        keys.alias("failure_keys"),
        incidents.alias("incidents"),
        F.when(chosen == "base", F.col("last_key")).alias("dispatch_key"),
        # A destructive repair waits for a person.
        F.coalesce(
            (chosen == "base") & F.col("last_key").isin(*HUMAN_GATED_KEYS), F.lit(False)
        ).alias("human_gated"),
    )
