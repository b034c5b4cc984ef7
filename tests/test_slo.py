import random
import statistics
from datetime import datetime, timedelta

import pytest

from sluice.functions.ranking import nearest_rank, percentiles
from sluice.operators import slo

T = datetime(2024, 1, 1)
SAMPLE_DDL = (
    "order_id BIGINT, ingest_s DOUBLE, build_s DOUBLE, gold_wait_s DOUBLE, "
    "end_to_end_lag_s DOUBLE, visible BOOLEAN"
)


def samples(spark, lags):
    rows = [(i, 1.0 * i, 2.0, 3.0, float(x), True) for i, x in enumerate(lags)]
    return spark.createDataFrame(rows, SAMPLE_DDL)


@pytest.mark.parametrize(
    ("lags", "verdict", "median"),
    [
        ([10, 20, 30], "PASS", 20.0),
        ([5, 9, 9000], "PASS", 9.0),
        ([301, 301, 301], "FAIL", 301.0),
        ([300], "PASS", 300.0),
        ([1, 2], "PASS", 1.5),
        ([], "INCONCLUSIVE", 0.0),
    ],
)
def test_freshness_verdict(spark, lags, verdict, median):
    row = slo.freshness_report(samples(spark, lags)).first()
    assert (row.verdict, row.median_lag_s, row.samples) == (verdict, median, len(lags))


def test_freshness_lag_uses_the_first_sighting(spark):
    injected = spark.createDataFrame([(1, T), (2, T)], "order_id BIGINT, injected_at TIMESTAMP")
    seen = spark.createDataFrame(
        [(1, T + timedelta(seconds=90)), (1, T + timedelta(seconds=30.5))],
        "order_id BIGINT, seen_at TIMESTAMP",
    )
    rows = {r.order_id: (r.end_to_end_lag_s, r.visible) for r in slo.freshness_lag(injected, seen).collect()}
    assert rows == {1: (30.5, True), 2: (None, False)}


def interpolate(values, p):
    values = sorted(values)
    k = (len(values) - 1) * p
    low = int(k)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (k - low)


def by_rank(values, p):
    values = sorted(values)
    k = max(0, min(len(values) - 1, int(round((p / 100.0) * len(values) + 0.5)) - 1))
    return values[k]


def test_percentiles_over_a_hot_group_match_python(spark):
    rng = random.Random(11)
    groups = {"hot": 3000, "warm": 40, "one": 1}
    data = [(g, float(rng.choice([7, rng.randint(1, 900)]))) for g, n in groups.items() for _ in range(n)]
    data.append(("warm", None))
    df = spark.createDataFrame(data, "role STRING, x DOUBLE").repartition(4)
    points = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    got = {r.role: r for r in percentiles(df, ["role"], "x", points).collect()}
    ranks = {r.role: r for r in nearest_rank(df, ["role"], "x", {"p50": 50, "p95": 95, "top": 100}).collect()}
    for g, n in groups.items():
        values = [x for k, x in data if k == g and x is not None]
        assert got[g].n == n
        assert got[g].p50 == pytest.approx(statistics.median(values))
        for name, p in points.items():
            assert got[g][name] == pytest.approx(interpolate(values, p))
        for name, p in (("p50", 50), ("p95", 95), ("top", 100)):
            assert ranks[g][name] == by_rank(values, p)


def test_latency_summary(spark):
    rows = [
        ("w", 0, 10.0, "ok", 5), ("w", 1, 30.0, "ok", 5), ("w", 1, 99.0, "error", 0),
        ("w", 0, 98.0, "timeout", 0), ("r", 0, 7.0, "error", 0),
    ]
    df = spark.createDataFrame(
        rows, "role STRING, worker INT, latency_ms DOUBLE, outcome STRING, rows_committed BIGINT"
    )
    out = {r.role: r for r in slo.latency_summary(df).collect()}
    w = out["w"]
    assert (w["count"], w.errors, w.timeouts, w.rows_committed) == (2, 1, 1, 10)
    assert (w.p50_ms, w.p95_ms, w.max_ms) == (20.0, 29.0, 30.0)
    assert (out["r"]["count"], out["r"].p99_ms, out["r"].max_ms) == (0, 0.0, 0.0)
    merged = slo.merge_stats(df, ["role", "worker"])
    assert merged.count() == 3


def activity(spark):
    rows = [
        (T, 1, "oltp_writer", "Lock", "tx", "update x" * 50, [2, 3, 9]),
        (T, 2, "dagster_ingest", "Client", None, "select", []),
        (T, 3, "oltp_writer", "Lock", "tx", "update", []),
        (T + timedelta(1), 2, "oltp_writer", "Lock", "tx", "q", [1]),
    ]
    ddl = (
        "sampled_at TIMESTAMP, pid BIGINT, app STRING, wait_event_type STRING, wait_event STRING, "
        "query STRING, blocking_pids ARRAY<BIGINT>"
    )
    return spark.createDataFrame(rows, ddl)


def test_lock_wait_edges(spark):
    rows = slo.lock_wait_edges(activity(spark)).collect()
    assert {(r.waiter_pid, r.blocker_pid): r.analytics_attributable for r in rows} == {
        (1, 2): True,
        (1, 3): False,
    }
    assert all(len(r.waiter_query) <= 200 for r in rows)


def test_load_verdict(spark):
    runs = spark.createDataFrame(
        [("full", 20000, 4.0), ("idle", 1, 100.0), ("zero", 5, 0.0), ("blocked", 20000, 4.0)],
        "run_id STRING, rows_committed BIGINT, seconds DOUBLE",
    )
    edges = spark.createDataFrame(
        [("blocked", True), ("full", False)], "run_id STRING, analytics_attributable BOOLEAN"
    )
    rows = {r.run_id: r for r in slo.load_verdict(runs, edges).collect()}
    assert {k: r.verdict for k, r in rows.items()} == {
        "full": "PASS",
        "idle": "INCONCLUSIVE",
        "zero": "INCONCLUSIVE",
        "blocked": "FAIL",
    }
    assert rows["full"].achieved_per_day == 432_000_000.0 and rows["full"].other_waits == 1


def test_gate_rollup(spark):
    gates = [("a", "PASS"), ("a", "SKIP"), ("b", "SKIP"), ("c", "PASS"), ("c", "ERROR")]
    df = spark.createDataFrame(gates, "suite STRING, status STRING")
    got = {r.suite: r.overall for r in slo.gate_rollup(df, "suite").collect()}
    assert got == {"a": "PASS", "b": "INCONCLUSIVE", "c": "FAIL"}
