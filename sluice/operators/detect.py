"""Evidence probes over silver tables, the detection sweep and cascade triage."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators.audit import stack
from sluice.schemas import (
    AMBIGUOUS_EVIDENCE,
    CASCADE_EVIDENCE,
    CASCADE_KEY,
    CASCADE_MEMBERS,
    EXPECTED_SURFACE,
    FLAG_COLUMNS,
    ORDER_REJECT_KEYS,
    PAYMENT_REJECT_KEYS,
    PIPELINE_MEMBERS,
    RECURRING_RULE,
    SPIKE_FACTOR,
    SPIKE_FLOOR,
)

Silver = Mapping[str, DataFrame]


def _rule_map(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Failure keys with the reject rule each is stamped with (a fixed small table)."""
    rows = [
        F.struct(
            F.lit(k).alias("failure_key"),
            F.lit(RECURRING_RULE.get(k, k)).alias("reject_rule"),
            F.lit(EXPECTED_SURFACE[k]).alias("evidence_surface"),
        )
        for k in keys
    ]
    return df.sparkSession.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _reject_counts(rejects: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row per key, found or not: a single pass over the reject table."""
    counted = rejects.groupBy("reject_rule").agg(F.count("*").alias("n"))
    return (
        _rule_map(rejects, keys)
        .join(counted, "reject_rule", "left")
        .select(
            "failure_key",
            "reject_rule",
            "evidence_surface",
            F.coalesce("n", F.lit(0)).alias("count"),
        )
    )


def reject_probe(
    rejects: DataFrame, keys: tuple[str, ...], pk: str, sample_limit: int = 5
) -> DataFrame:
    """Count per key, and the lowest keys of the rejected rows as evidence."""
    if sample_limit < 0:
        raise ValueError("sample_limit must not be negative")
    counts = _reject_counts(rejects, keys)
    # Top-n per rule: every task keeps n rows per rule before the shuffle.
    per_rule = Window.partitionBy("reject_rule").orderBy(F.asc_nulls_last(pk))
    samples = (
        rejects.select("reject_rule", pk)
        .withColumn("_n", F.row_number().over(per_rule))
        .where(F.col("_n") <= sample_limit)
        .groupBy("reject_rule")
        .agg(F.array_sort(F.collect_list(pk)).alias("sample_keys"))
    )
    return counts.join(samples, "reject_rule", "left").select(
        "failure_key",
        (F.col("count") > 0).alias("found"),
        "reject_rule",
        "count",
        "evidence_surface",
        F.coalesce("sample_keys", F.array().cast("array<bigint>")).alias("sample_keys"),
    )


def flag_probe(silver_orders: DataFrame) -> DataFrame:
    """Counts of the accepted-but-flagged rows, one row per flag, in one pass."""
    counts = silver_orders.agg(
        *[F.count_if(F.col(flag)).alias(key) for key, flag in FLAG_COLUMNS.items()]
    )
    rows = [
        F.struct(
            F.lit(key).alias("failure_key"),
            (F.col(key) > 0).alias("found"),
            F.col(key).alias("count"),
            F.lit(EXPECTED_SURFACE[key]).alias("evidence_surface"),
        )
        for key in FLAG_COLUMNS
    ]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def reject_evidence(
    rejects: DataFrame, keys: tuple[str, ...], pk: str, sample_limit: int = 5
) -> DataFrame:
    """The finding per key with whole rejected rows as evidence, lowest key first.

    ``sample_rows`` is an array of structs with all columns of the rejects.
    """
    found = _reject_counts(rejects, keys)
    samples = _sample_rows(rejects, "reject_rule", pk, sample_limit)
    return _with_samples(found, samples, "reject_rule").select(
        "failure_key", "found", "reject_rule", "count", "evidence_surface", "sample_rows"
    )


def flag_evidence(silver_orders: DataFrame, pk: str = "order_id", sample_limit: int = 5) -> DataFrame:
    """The finding per flag with whole flagged rows as evidence, lowest key first."""
    flags = F.array(
        *[F.when(F.col(flag), F.lit(key)) for key, flag in FLAG_COLUMNS.items()]
    )
    flagged = silver_orders.withColumn("_flag", F.explode(F.array_compact(flags)))
    found = flag_probe(silver_orders).drop("found")
    samples = _sample_rows(flagged, "_flag", pk, sample_limit)
    return _with_samples(found.withColumn("_flag", F.col("failure_key")), samples, "_flag").select(
        "failure_key", "found", "count", "evidence_surface", "sample_rows"
    )


def _sample_rows(rows: DataFrame, rule: str, pk: str, limit: int) -> DataFrame:
    """Per rule its ``limit`` lowest rows; every task keeps that many before the shuffle."""
    if limit < 0:
        raise ValueError("sample_limit must not be negative")
    per_rule = Window.partitionBy(rule).orderBy(F.asc_nulls_last(pk))
    columns = [c for c in rows.columns if not c.startswith("_flag")]
    ranked = rows.select(rule, F.struct(*columns).alias("_row"), F.row_number().over(per_rule).alias("_n"))
    picked = F.array_sort(F.collect_list(F.struct("_n", "_row")))
    return ranked.where(F.col("_n") <= limit).groupBy(rule).agg(picked["_row"].alias("sample_rows"))


def _with_samples(found: DataFrame, samples: DataFrame, rule: str) -> DataFrame:
    kind = samples.schema["sample_rows"].dataType
    rows = F.coalesce("sample_rows", F.array().cast(kind))
    joined = found.join(samples, rule, "left")
    return joined.withColumn("sample_rows", rows).withColumn("found", F.col("count") > 0)


def profile(tables: Silver, failure_key: str, sample_limit: int = 5) -> DataFrame:
    """The answer for one key as a row; an unknown key is answered, not refused.

    ``sample_rows`` are JSON texts here, as keys of different tables share the columns.
    """
    if failure_key in ORDER_REJECT_KEYS:
        found = reject_evidence(tables["silver_orders_rejects"], (failure_key,), "order_id", sample_limit)
    elif failure_key in PAYMENT_REJECT_KEYS:
        found = reject_evidence(
            tables["silver_payments_rejects"], (failure_key,), "payment_id", sample_limit
        )
    elif failure_key in FLAG_COLUMNS:
        found = flag_evidence(tables["silver_orders"], sample_limit=sample_limit).where(
            F.col("failure_key") == failure_key
        )
    elif failure_key == "volume_spike":
        found = volume_spike(tables["silver_orders"], "ordered_at").withColumn(
            "sample_rows", F.array().cast("array<struct<order_id: bigint>>")
        )
    else:
        return tables["silver_orders"].sparkSession.range(1).select(
            F.lit(failure_key).alias("failure_key"),
            F.lit(False).alias("found"),
            F.lit(0).cast("bigint").alias("count"),
            F.lit("").alias("evidence_surface"),
            F.array().cast("array<string>").alias("sample_rows"),
            F.lit("no probe for this failure key").alias("detail"),
        )
    return found.select(
        "failure_key",
        "found",
        F.col("count").cast("bigint").alias("count"),
        "evidence_surface",
        F.transform("sample_rows", lambda r: F.to_json(r)).alias("sample_rows"),
        F.lit("").alias("detail"),
    )


def minute_counts(df: DataFrame, ts_col: str) -> DataFrame:
    return df.groupBy(F.date_trunc("minute", F.col(ts_col)).alias("minute")).agg(
        F.count("*").alias("rows")
    )


def _spike(stats: DataFrame, factor: int, floor: int) -> DataFrame:
    """The finding from total rows, latest and median minute, and number of minutes."""
    limit = F.greatest(F.col("median_minute_rows") * factor, F.lit(float(floor)))
    return stats.select(
        F.lit("volume_spike").alias("failure_key"),
        (F.col("latest_minute_rows") > limit).alias("found"),
        F.col("latest_minute_rows").alias("count"),
        F.lit(EXPECTED_SURFACE["volume_spike"]).alias("evidence_surface"),
        "total_rows",
        "latest_minute_rows",
        "median_minute_rows",
        "minutes_observed",
    )


def spike_test(
    minutes: DataFrame, factor: int = SPIKE_FACTOR, floor: int = SPIKE_FLOOR
) -> DataFrame:
    """Latest minute against the typical one, from per-minute counts.

    One aggregation, no global window; the median runs over distinct counts.
    """
    stats = minutes.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.max_by("rows", "minute"), F.lit(0)).alias("latest_minute_rows"),
        F.coalesce(F.median("rows"), F.lit(0.0)).alias("median_minute_rows"),
        F.count("*").alias("minutes_observed"),
    )
    return _spike(stats, factor, floor)


def spike_from_histogram(
    histogram: DataFrame, latest: DataFrame, factor: int = SPIKE_FACTOR, floor: int = SPIKE_FLOOR
) -> DataFrame:
    """The same from how many ``minutes`` have how many ``rows``, and the latest minute's row.

    The exact median comes from the counts of counts: no minute is read.
    """
    newest = latest.agg(F.max("rows").alias("rows")).scalar()
    stats = histogram.agg(
        F.coalesce(F.sum(F.col("rows") * F.col("minutes")), F.lit(0)).alias("total_rows"),
        F.coalesce(F.percentile("rows", 0.5, F.col("minutes")), F.lit(0.0)).alias("median_minute_rows"),
        F.coalesce(F.sum("minutes"), F.lit(0)).alias("minutes_observed"),
    )
    return _spike(stats.withColumn("latest_minute_rows", F.coalesce(newest, F.lit(0))), factor, floor)


def volume_spike(
    df: DataFrame, ts_col: str, factor: int = SPIKE_FACTOR, floor: int = SPIKE_FLOOR
) -> DataFrame:
    return spike_test(minute_counts(df, ts_col), factor, floor)


def probe(silver: Silver, failure_key: str, sample_limit: int = 5) -> DataFrame:
    """The probe of one failure key. Keys without a probe raise ``KeyError``."""
    if failure_key in ORDER_REJECT_KEYS:
        return reject_probe(silver["silver_orders_rejects"], (failure_key,), "order_id", sample_limit)
    if failure_key in PAYMENT_REJECT_KEYS:
        rejected = silver["silver_payments_rejects"]
        return reject_probe(rejected, (failure_key,), "payment_id", sample_limit)
    if failure_key in FLAG_COLUMNS:
        return flag_probe(silver["silver_orders"]).where(F.col("failure_key") == failure_key)
    if failure_key == "volume_spike":
        return volume_spike(silver["silver_orders"], "ordered_at")
    raise KeyError(f"no detection probe for failure key {failure_key!r}")


def detection_sweep(silver: Silver) -> DataFrame:
    """All eleven probes, with one aggregation pass per surface table."""
    columns = ["failure_key", "evidence_surface", "found", "count"]
    found = (F.col("count") > 0).alias("found")
    orders = _reject_counts(silver["silver_orders_rejects"], ORDER_REJECT_KEYS)
    payments = _reject_counts(silver["silver_payments_rejects"], PAYMENT_REJECT_KEYS)
    return stack(
        [
            orders.select("failure_key", "evidence_surface", found, "count"),
            payments.select("failure_key", "evidence_surface", found, "count"),
            flag_probe(silver["silver_orders"]).select(*columns),
            volume_spike(silver["silver_orders"], "ordered_at").select(*columns),
        ]
    )


def _present(items: list[tuple[str, Column]]) -> Column:
    """Names whose condition holds, in the given order."""
    marked = F.array(*[F.when(cond, F.lit(name)) for name, cond in items])
    return F.filter(marked, lambda x: x.isNotNull())


def cascade_triage(sweep: DataFrame, run_failures: DataFrame) -> DataFrame:
    """One cascade diagnosis: which members show evidence, and on which routes.

    Schema drift counts as found on its flag or on any failed run node.
    """
    hits = sweep.agg(
        *[
            F.coalesce(
                F.max(F.when(F.col("failure_key") == m, F.col("found"))), F.lit(False)
            ).alias(m)
            for m in CASCADE_MEMBERS
        ]
    )
    failed = run_failures.agg((F.count("*") > 0).alias("_failed_nodes"))
    both = hits.withColumn("_one", F.lit(1)).join(failed.withColumn("_one", F.lit(1)), "_one")
    seen = {m: F.col(m) for m in CASCADE_MEMBERS}
    seen["schema_drift"] = seen["schema_drift"] | F.col("_failed_nodes")
    pipeline = [c for m, c in seen.items() if m in PIPELINE_MEMBERS]
    data = [c for m, c in seen.items() if m not in PIPELINE_MEMBERS]
    any_of = lambda conds: F.greatest(*conds, F.lit(False))
    routes = _present([("pipeline_error", any_of(pipeline)), ("data_defect", any_of(data))])
    members = _present(list(seen.items()))
    return both.select(
        F.lit(CASCADE_KEY).alias("failure_key"),
        members.alias("sub_failures"),
        routes.alias("routes"),
        F.when(F.size(members) > 0, F.lit(0.6)).otherwise(F.lit(0.0)).alias("confidence"),
        F.lit(CASCADE_EVIDENCE).alias("evidence_surface"),
    )


def ambiguous_drop(
    baseline_orders: DataFrame,
    current_orders: DataFrame,
    baseline_products: DataFrame,
    current_products: DataFrame,
    surge_ratio: float = 2.0,
    cut_to: float = 0.5,
) -> DataFrame:
    """Cancellation surge, price cut, or both: only both at once is ambiguous.

    A surge is a cancelled share of at least ``surge_ratio`` times the baseline share; a
    cut is a price at or below ``cut_to`` of the baseline price, within a cent.
    """

    def share(df: DataFrame, name: str) -> DataFrame:
        cancelled = F.count_if(F.col("status") == "cancelled")
        return df.agg((cancelled / F.count("*")).alias(name)).withColumn("_one", F.lit(1))

    before = baseline_products.select("product_id", F.col("unit_price").alias("_before"))
    priced = current_products.select("product_id", F.col("unit_price").alias("_now"))
    is_cut = (
        F.col("_now").cast("double") <= F.col("_before").cast("double") * cut_to + 0.01
    ) & (F.col("_before") > 0)
    cuts = (
        before.join(priced, "product_id")
        .agg(F.count_if(is_cut).alias("cut_products"))
        .withColumn("_one", F.lit(1))
    )
    one = share(baseline_orders, "baseline_share").join(
        share(current_orders, "current_share"), "_one"
    ).join(cuts, "_one")
    surge = (F.col("current_share") > 0) & (
        F.col("current_share") >= F.col("baseline_share") * surge_ratio
    )
    cut = F.col("cut_products") > 0
    return one.select(
        "baseline_share",
        "current_share",
        "cut_products",
        surge.alias("cancellation_surge"),
        cut.alias("price_cut"),
        F.when(surge & cut, "ambiguous_anomaly")
        .when(surge, "cancellation_surge")
        .when(cut, "price_cut")
        .otherwise("none")
        .alias("verdict"),
        F.lit(AMBIGUOUS_EVIDENCE).alias("evidence_surface"),
    )


def defect_survival(ledger: DataFrame, silver: Silver, leaks: DataFrame) -> DataFrame:
    """Per quarantine key: how often injected, caught in quarantine, leaked into gold."""
    keys = tuple(k for k in ORDER_REJECT_KEYS if k not in RECURRING_RULE)
    caught = stack(
        [
            _reject_counts(silver["silver_orders_rejects"], keys),
            _reject_counts(silver["silver_payments_rejects"], PAYMENT_REJECT_KEYS),
        ]
    ).select("failure_key", F.col("count").alias("caught"))
    injected = ledger.groupBy("failure_key").agg(F.count("*").alias("injected"))
    survived = (F.col("caught") >= 1) & (F.col("leaked") == 0)
    return (
        caught.join(injected, "failure_key", "left")
        .join(leaks, "failure_key", "left")
        .select(
            "failure_key",
            F.coalesce("injected", F.lit(0)).alias("injected"),
            "caught",
            F.coalesce("leaked", F.lit(0)).alias("leaked"),
        )
        .withColumn("verdict", F.when(survived, "PASS").otherwise("FAIL"))
    )
