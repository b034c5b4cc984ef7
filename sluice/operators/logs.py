"""Failure lines in run logs, failed nodes in run results, checks on report text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.expressions import strip
from sluice.schemas import (
    FAILED_NODE_STATUSES,
    FAILURE_LINE_PREFIX,
    GARBAGE_MARKERS,
    MIN_ROOT_CAUSE_CHARS,
)

RUN_RESULTS_DDL = "results ARRAY<STRUCT<unique_id: STRING, status: STRING, message: STRING>>"


def parse_failures(lines: DataFrame) -> DataFrame:
    """Failure lines of (seq, line) as fields; ``error`` runs to the end of the line."""
    tail = strip(F.regexp_extract("line", f"{FAILURE_LINE_PREFIX}(.*)$", 1))
    with_tail = lines.where(F.col("line").contains(FAILURE_LINE_PREFIX)).withColumn("_tail", tail)
    has_error = F.col("_tail").contains("error=")
    head = F.when(has_error, F.regexp_extract("_tail", "^(.*?)error=", 1)).otherwise(F.col("_tail"))
    error = F.when(has_error, strip(F.regexp_extract("_tail", "error=(.*)$", 1)))

    def field(name: str) -> Column:
        # The last assignment of a name wins.
        pattern = rf"(?:.*\s|^){name}=(\S*)"
        return F.when(F.col("_head").rlike(pattern), F.regexp_extract("_head", pattern, 1))

    parsed = with_tail.withColumns({"_head": head, "error": error})
    return parsed.select(
        "seq", field("run_id").alias("run_id"), field("job").alias("job"), "error"
    ).where(
        F.col("run_id").isNotNull() | F.col("job").isNotNull() | F.col("error").isNotNull()
    )


def failure_fields(lines: DataFrame) -> DataFrame:
    """Failure lines with every ``name=value`` before ``error=`` as a map.

    The last assignment of a name wins; a word without ``=`` is no field. Lines without any field and without an error are left out.
    """
    tail = strip(F.regexp_extract("line", f"{FAILURE_LINE_PREFIX}(.*)$", 1))
    has_error = F.col("_tail").contains("error=")
    head = F.when(has_error, F.regexp_extract("_tail", "^(.*?)error=", 1)).otherwise(F.col("_tail"))
    words = F.filter(F.split("_head", r"\s+"), lambda w: F.instr(w, "=") > 0)

    def name(word: Column) -> Column:
        return F.substring_index(word, "=", 1)

    def value(key: Column) -> Column:
        last = F.element_at(F.filter("_words", lambda w: name(w) == key), -1)
        return F.substring(last, F.length(key) + 2, F.length(last))

    found = (
        lines.where(F.col("line").contains(FAILURE_LINE_PREFIX))
        .withColumn("_tail", tail)
        .withColumn("_head", head)
        .withColumn("_words", words)
        .withColumn("_names", F.array_distinct(F.transform("_words", name)))
    )
    return found.select(
        "seq",
        F.map_from_arrays("_names", F.transform("_names", value)).alias("fields"),
        F.when(has_error, strip(F.regexp_extract("_tail", "error=(.*)$", 1))).alias("error"),
    ).where((F.size("fields") > 0) | F.col("error").isNotNull())


def log_failures(lines: DataFrame, run_id: str = "latest") -> DataFrame:
    """One record and the number of matching failures.

    ``latest`` takes the last failure line; a run id takes the first line of that run.
    """
    parsed = parse_failures(lines)
    record = F.struct("run_id", "job", "error")
    if run_id == "latest":
        chosen = F.max_by(record, "seq")
    else:
        parsed = parsed.where(F.col("run_id") == run_id)
        chosen = F.min_by(record, "seq")
    found = parsed.agg(chosen.alias("r"), F.count("*").alias("count"))
    return found.select(
        (F.col("count") > 0).alias("found"), "r.run_id", "r.job", "r.error", "count"
    )


def failures_by_run(lines: DataFrame) -> DataFrame:
    """First failure line and failure count of every run at once."""
    first = F.min_by(F.struct("job", "error"), "seq")
    grouped = parse_failures(lines).groupBy("run_id").agg(
        first.alias("r"), F.count("*").alias("count")
    )
    return grouped.select("run_id", "r.job", "r.error", "count")


def run_result_failures(documents: DataFrame, body: str = "body") -> DataFrame:
    """Failed nodes of run-result JSON documents. A malformed document has none."""
    parsed = documents.withColumn("_doc", F.from_json(F.col(body), RUN_RESULTS_DDL))
    kept = [c for c in documents.columns if c != body]
    nodes = parsed.select(*kept, F.explode("_doc.results").alias("_n"))
    status = F.lower("_n.status")
    return nodes.where(status.isin(*FAILED_NODE_STATUSES)).select(
        *kept,
        F.coalesce("_n.unique_id", F.lit("<unknown>")).alias("node"),
        status.alias("status"),
        F.coalesce("_n.message", F.lit("")).alias("message"),
    )


def run_result_summary(documents: DataFrame, body: str = "body") -> DataFrame:
    """One row per run-result document of any shape.

    ``parsed`` is false where the text is no JSON object. ``results`` that are missing
    or no list count as none. A result that is no object is a node without id and
    status; it counts in ``total_nodes`` and does not fail. ``failed_nodes`` holds
    (node, status, message) in the document's order; ``found`` says it has any.
    """
    doc = F.try_parse_json(F.col(body))
    kept = [c for c in documents.columns if c != body]
    results = F.coalesce(
        F.try_variant_get("_doc", "$.results", "array<variant>"), F.array().cast("array<variant>")
    )
    is_object = F.coalesce(F.schema_of_variant("_doc").startswith("OBJECT"), F.lit(False))

    def node(result: Column) -> Column:
        text = lambda path: F.try_variant_get(result, path, "string")
        return F.struct(
            F.coalesce(text("$.unique_id"), F.lit("<unknown>")).alias("node"),
            F.lower(F.coalesce(text("$.status"), F.lit(""))).alias("status"),
            F.coalesce(text("$.message"), F.lit("")).alias("message"),
        )

    read = documents.withColumn("_doc", doc).withColumn("_results", results)
    nodes = F.transform("_results", node)
    failed = F.filter(nodes, lambda n: n["status"].isin(*FAILED_NODE_STATUSES))
    return read.select(
        *kept,
        is_object.alias("parsed"),
        F.size("_results").alias("total_nodes"),
        failed.alias("failed_nodes"),
    ).withColumn("found", F.size("failed_nodes") > 0)


def validate_text(reports: DataFrame) -> DataFrame:
    """Accept or refuse each report; the first failing check gives the reason."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    # All markers in one case-blind pass over the whole text.
    markers = "(?i)" + "|".join(re.escape(m) for m in GARBAGE_MARKERS)

    def garbage(name: str) -> Column:
        return text(name).rlike(markers)

    checks = [
        (strip(text("incident_key")) == "", "incident_key is missing"),
        (
            F.length(strip(text("root_cause"))) < MIN_ROOT_CAUSE_CHARS,
            "root_cause is too short",
        ),
    ]
    for name in ("root_cause", "evidence", "proposed_fix", "recurrence_note"):
        checks.append((garbage(name), f"{name} contains raw garbage"))
    reason = F.lit(None).cast("string")
    for condition, message in reversed(checks):
        reason = F.when(condition, message).otherwise(reason)
    return reports.withColumn("reason", reason).select(
        "report_id", F.col("reason").isNull().alias("ok"), "reason"
    )
