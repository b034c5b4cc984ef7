import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sluice.operators import detect, grade, history, ledger, logs

LEDGER_DDL = "incident_id BIGINT, failure_key STRING, detail STRING, injected_at TIMESTAMP, window_id BIGINT"
T = datetime(2024, 1, 1)


def ledger_of(spark, windows):
    rows, i = [], 0
    for window, keys in windows.items():
        for key in keys:
            i += 1
            rows.append((i, key, "note", T + timedelta(minutes=i), window))
    return spark.createDataFrame(rows, LEDGER_DDL)


def test_grading_rubric(spark):
    book = ledger_of(
        spark,
        {
            1: ["negative_price"],
            2: ["negative_price"],
            3: ["late_arrival", "negative_price"],
            4: ["missing_customer", "volume_spike", "schema_drift", "multi_failure_cascade"],
            5: ["late_arrival"],
            6: ["missing_customer"],
            8: ["slow_source"],
        },
    )
    ddl = "window_id BIGINT, failure_key STRING, sub_failures ARRAY<STRING>, evidence_surface STRING"
    diagnoses = spark.createDataFrame(
        [
            (1, "negative_price", [], " silver_orders_rejects "),
            (2, "recurring_incident", [], ""),
            (3, "late_arrival", [], "silver_orders_rejects"),
            (4, "missing_customer", ["missing_customer", "volume_spike", "volume_spike", "late_arrival"], "x"),
            (5, "multi_failure_cascade", None, None),
            (6, None, [], "silver_orders_rejects"),
            (7, "negative_price", [], "silver_orders_rejects"),
            (8, "slow_source", None, "dagster_logs"),
        ],
        ddl,
    )
    graded = {r.window_id: r for r in grade.grade(diagnoses, book, "window_id").collect()}
    got = {w: (r.tier, r.diagnosis_score, r.evidence_score, r.label) for w, r in graded.items()}
    assert got == {
        1: ("exact", 1.0, 1.0, "correct"),
        2: ("alias", 0.7, 0.0, "incorrect"),
        3: ("miss", 0.0, 1.0, "incorrect"),
        4: ("cascade", 0.8333, 0.0, "incorrect"),
        5: ("cascade", 0.5, 0.0, "incorrect"),
        6: ("no-run", 0.0, 0.0, "incorrect"),
        7: ("no-run", 0.0, 0.0, "incorrect"),
        8: ("exact", 1.0, 1.0, "correct"),
    }
    card = {r.tier: r for r in grade.scorecard(grade.grade(diagnoses, book, "window_id")).collect()}
    assert card["exact"].diagnoses == 2 and card["exact"].correct == 2
    assert card["no-run"].mean_score == 0.0


def test_a_claimed_cascade_earns_the_base_score(spark):
    book = ledger_of(spark, {1: ["late_arrival"]})
    ddl = "window_id BIGINT, failure_key STRING, sub_failures ARRAY<STRING>, evidence_surface STRING"
    claim = spark.createDataFrame([(1, "multi_failure_cascade", ["late_arrival"], "")], ddl)
    row = grade.grade(claim, book, "window_id").first()
    assert (row.diagnosis_score, row.label) == (1.0, "correct")


def test_routing(spark):
    book = ledger_of(
        spark, {1: ["late_arrival", "late_arrival"], 2: ["late_arrival", "schema_drift"],
                3: ["multi_failure_cascade"], 4: ["destructive_fix"]}
    )
    windows = spark.createDataFrame([(i,) for i in range(1, 6)], "window_id BIGINT")
    rows = {r.window_id: r for r in ledger.route_incidents(book, "window_id", windows).collect()}
    assert {w: r.route for w, r in rows.items()} == {1: "base", 2: "cascade", 3: "cascade", 4: "base", 5: "no-run"}
    assert rows[1].dispatch_key == "late_arrival" and not rows[1].human_gated
    assert rows[4].human_gated and rows[5].incidents == 0


def test_cursor_is_at_least_once_unless_the_id_is_given(spark):
    book = ledger_of(spark, {1: ["a", "b", "c"]})
    since = "2024-01-01 00:02:00"
    assert [r.incident_id for r in ledger.ledger_window(book, since).collect()] == [2, 3]
    assert [r.incident_id for r in ledger.ledger_window(book, since, after_id=2).collect()] == [3]
    cursor = ledger.next_cursor(ledger.ledger_window(book, since), since).first()
    assert (cursor.cursor_id, cursor.incidents) == (3, 2)
    empty = ledger.next_cursor(book.where("false"), since).first()
    assert (str(empty.cursor_ts), empty.cursor_id, empty.incidents) == (since, None, 0)


def test_occurrence_numbers_over_a_hot_key(spark):
    book = spark.range(4000).select(
        F.col("id").alias("incident_id"),
        F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("failure_key"),
        F.timestamp_seconds((F.col("id") * 7919) % 500).alias("injected_at"),
    )
    rows = ledger.occurrences(book).collect()
    expected, seen = {}, {}
    for r in sorted(rows, key=lambda r: (r.injected_at, r.incident_id)):
        seen[r.failure_key] = seen.get(r.failure_key, 0) + 1
        expected[r.incident_id] = seen[r.failure_key]
    assert {r.incident_id: r.occurrence for r in rows} == expected


def brute_topk(queries, past, k):
    out = set()
    split = lambda s: set(re.findall("[a-z0-9_]+", s.lower()))
    for qid, text in queries:
        scored = []
        for iid, key, detail in past:
            q, p = split(text), split(f"{key} {detail}")
            if q & p:
                scored.append((len(q & p) / len(q | p), iid))
        scored.sort(key=lambda s: -s[0])
        out |= {(qid, i + 1, iid, round(score, 9)) for i, (score, iid) in enumerate(scored[:k])}
    return out


def test_similar_incidents_match_brute_force(spark):
    words = ["Alpha", "beta", "the", "the", "gamma_1", "é", "delta", "price", "orders"]
    pick = lambda n, step: " ".join(words[(n * step + j * j) % len(words)] for j in range(1 + n % 6))
    past = [(i, ["negative_price", "late_arrival"][i % 2], pick(i, 5)) for i in range(40)]
    queries = [(i, pick(i, 3)) for i in range(30)] + [(99, "nothing shared"), (98, "")]
    ddl = "incident_id BIGINT, failure_key STRING, detail STRING"
    frame = spark.createDataFrame(past, ddl).withColumn("injected_at", F.timestamp_seconds("incident_id"))
    asked = spark.createDataFrame(queries, "query_id BIGINT, text STRING")
    for recent in (40, 7):
        newest = sorted(past, reverse=True)[:recent]
        got = {
            (r.query_id, r["rank"], r.incident_id, round(r.score, 9))
            for r in history.similar_topk(asked, frame, 3, recent).collect()
        }
        assert got == brute_topk(queries, newest, 3)
    with pytest.raises(ValueError):
        history.similar_topk(asked, frame, 3, 0)


def test_recurrence(spark):
    ddl = "incident_id BIGINT, failure_key STRING, detail STRING"
    past = spark.createDataFrame(
        [(1, "negative_price", "negative unit price"), (2, "negative_price", "price below zero"),
         (3, "missing_customer", "no customer")], ddl
    ).withColumn("injected_at", F.timestamp_seconds("incident_id"))
    asked = spark.createDataFrame([(1, "price below zero again")], "query_id BIGINT, text STRING")
    row = history.recurrence(asked, past).first()
    assert (row.failure_key, row.times_seen) == ("negative_price", 2)


def test_failure_lines(spark):
    lines = [
        "INFO all fine run_id=r0",
        "x BACKBONE_RUN_FAILURE run_id=r1 job=j1 error=bad error=twice  a=b ",
        "BACKBONE_RUN_FAILURE run_id=r2 run_id=r3 note",
        "BACKBONE_RUN_FAILURE nothing here",
        "BACKBONE_RUN_FAILURE job=j4 run_id=r1 error=",
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "seq INT, line STRING")
    got = {r.seq: (r.run_id, r.job, r.error) for r in logs.parse_failures(df).collect()}
    assert got == {
        1: ("r1", "j1", "bad error=twice  a=b"),
        2: ("r3", None, None),
        4: ("r1", "j4", ""),
    }
    latest = logs.log_failures(df).first()
    assert (latest.found, latest.job, latest["count"]) == (True, "j4", 3)
    first = logs.log_failures(df, "r1").first()
    assert (first.job, first["count"]) == ("j1", 2)
    assert not logs.log_failures(df, "r9").first().found
    runs = {r.run_id: (r.job, r["count"]) for r in logs.failures_by_run(df).collect()}
    assert runs == {"r1": ("j1", 2), "r3": (None, 1)}


def test_run_results(spark):
    docs = [
        (1, '{"results":[{"unique_id":"m.a","status":"ERROR","message":"boom"},{"unique_id":"m.b","status":"success"}]}'),
        (2, '{"results":[{"status":"skipped","message":null}]}'),
        (3, "not json"),
        (4, '{"results":[]}'),
    ]
    df = spark.createDataFrame(docs, "document_id INT, body STRING")
    got = [tuple(r) for r in logs.run_result_failures(df).orderBy("document_id").collect()]
    assert got == [(1, "m.a", "error", "boom"), (2, "<unknown>", "skipped", "")]


def test_report_validation(spark):
    good = "the price feed lost its sign"
    rows = [
        ("a", "k", good, "e", "f", "n"),
        ("b", " \t", good, "e", "f", "n"),
        ("c", "k", " short      ", "e", "f", "n"),
        ("d", "k", good, "<SCRIPT>x", "f", "n"),
        ("e", "k", good, "e", "f", "was 0x00"),
        ("f", "k", good, None, "�", "n"),
    ]
    ddl = ", ".join(
        f"{c} STRING"
        for c in ("report_id", "incident_key", "root_cause", "evidence", "proposed_fix", "recurrence_note")
    )
    got = {r.report_id: r.reason for r in logs.validate_text(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {
        "a": None,
        "b": "incident_key is missing",
        "c": "root_cause is too short",
        "d": "evidence contains raw garbage",
        "e": "recurrence_note contains raw garbage",
        "f": "proposed_fix contains raw garbage",
    }


def silver(spark, order_rules, payment_rules=(), late=0, drift=0, clean=1):
    orders = [(i, r) for i, r in enumerate(order_rules)]
    flags = [(i, i < late, i < drift, T) for i in range(max(late, drift, clean))]
    return {
        "silver_orders_rejects": spark.createDataFrame(orders, "order_id BIGINT, reject_rule STRING"),
        "silver_payments_rejects": spark.createDataFrame(
            list(enumerate(payment_rules)), "payment_id BIGINT, reject_rule STRING"
        ),
        "silver_orders": spark.createDataFrame(
            flags, "order_id BIGINT, is_late BOOLEAN, _schema_drift BOOLEAN, ordered_at TIMESTAMP"
        ),
    }


def test_probes(spark):
    tables = silver(spark, ["negative_price"] * 8 + ["missing_customer"], ["orphan_payment"], late=2)
    row = detect.probe(tables, "negative_price").first()
    assert (row.found, row["count"], row.sample_keys) == (True, 8, [0, 1, 2, 3, 4])
    row = detect.probe(tables, "recurring_incident", sample_limit=0).first()
    assert (row.reject_rule, row["count"], row.sample_keys) == ("negative_price", 8, [])
    assert not detect.probe(tables, "destructive_fix").first().found
    assert detect.probe(tables, "late_arrival").first()["count"] == 2
    assert not detect.probe(tables, "schema_drift").first().found
    with pytest.raises(KeyError):
        detect.probe(tables, "slow_source")
    sweep = {r.failure_key: (r.found, r["count"]) for r in detect.detection_sweep(tables).collect()}
    assert len(sweep) == 11
    assert sweep["orphan_payment"] == (True, 1) and sweep["volume_spike"] == (False, 2)


@pytest.mark.parametrize(("latest", "found"), [(200, False), (201, True)])
def test_volume_spike_threshold(spark, latest, found):
    base = spark.range(30).select(F.timestamp_seconds(F.col("id") * 60).alias("ordered_at"))
    burst = spark.range(latest).select(F.timestamp_seconds(F.lit(3600)).alias("ordered_at"))
    row = detect.volume_spike(base.unionByName(burst), "ordered_at").first()
    assert (row.found, row["count"], row.minutes_observed) == (found, latest, 31)
    assert detect.volume_spike(base.where("false"), "ordered_at").first().found is False


def test_cascade_triage(spark):
    none = spark.createDataFrame([], "node STRING")
    some = spark.createDataFrame([("m",)], "node STRING")
    tables = silver(spark, ["missing_customer"])
    sweep = detect.detection_sweep(tables)
    row = detect.cascade_triage(sweep, none).first()
    assert (row.sub_failures, row.routes, row.confidence) == (["missing_customer"], ["data_defect"], 0.6)
    row = detect.cascade_triage(sweep, some).first()
    assert row.sub_failures == ["missing_customer", "schema_drift"]
    assert row.routes == ["pipeline_error", "data_defect"]
    row = detect.cascade_triage(detect.detection_sweep(silver(spark, [])), none).first()
    assert (row.sub_failures, row.routes, row.confidence) == ([], [], 0.0)


def test_ambiguous_drop(spark):
    o = lambda cancelled: spark.range(100).select(
        F.when(F.col("id") < cancelled, "cancelled").otherwise("placed").alias("status")
    )
    p = lambda price: spark.createDataFrame([(1, price), (2, 8.0)], "product_id BIGINT, unit_price DOUBLE")
    verdict = lambda *a: detect.ambiguous_drop(*a).first().verdict
    assert verdict(o(5), o(10), p(10.0), p(5.0)) == "ambiguous_anomaly"
    assert verdict(o(5), o(9), p(10.0), p(5.0)) == "price_cut"
    assert verdict(o(5), o(10), p(10.0), p(6.0)) == "cancellation_surge"
    assert verdict(o(0), o(0), p(10.0), p(10.0)) == "none"


def test_history_ties_go_to_the_newer_incident(spark):
    ddl = "incident_id BIGINT, failure_key STRING, detail STRING"
    past = spark.createDataFrame([(i, "k", "same words") for i in range(9)], ddl).withColumn(
        "injected_at", F.timestamp_seconds("incident_id")
    )
    asked = spark.createDataFrame([(1, "same words"), (2, None)], "query_id BIGINT, text STRING")
    rows = history.similar_topk(asked, past, 3).collect()
    assert [(r["rank"], r.incident_id) for r in rows] == [(1, 8), (2, 7), (3, 6)]
