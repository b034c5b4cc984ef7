"""Search without look-back, spans of time, sketches, run documents of any shape."""

import bisect
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sluice.operators import detect, grade, history, ledger, logs, slo
from sluice.plans import intents
from sluice.sources.readers import read_log_lines
from sluice.streaming import jobs

T = datetime(2024, 1, 1)
HISTORY_DDL = "incident_id BIGINT, failure_key STRING, detail STRING, injected_at TIMESTAMP"


def texts_of(rng, n, vocabulary):
    # Low numbers are frequent, so that words are skewed.
    return [
        " ".join(f"w{int(vocabulary * rng.random() ** 3)}" for _ in range(rng.randint(0, 30)))
        for _ in range(n)
    ]


@pytest.mark.parametrize(("vocabulary", "k"), [(12, 1), (60, 3), (400, 50)])
def test_whole_search_equals_the_bounded_one(spark, vocabulary, k):
    rng = random.Random(vocabulary)
    past = [
        (i, f"key{i % 3}", None if i % 17 == 0 else t, T + timedelta(hours=i // 4))
        for i, t in enumerate(texts_of(rng, 60, vocabulary))
    ]
    past.append((500, "key1", past[5][2], T))
    asked = list(enumerate(texts_of(rng, 40, vocabulary)))
    asked += [(100, None), (101, ""), (102, "unknown words only"), (103, past[5][2]), (104, past[5][2])]
    history_rows = spark.createDataFrame(past, HISTORY_DDL)
    queries = spark.createDataFrame(asked, "query_id BIGINT, text STRING")
    bounded = history.similar_topk(queries, history_rows, k, recent=1000)
    whole = history.similar_topk_whole(queries, history_rows, k)
    columns = ["query_id", "rank", "incident_id", "failure_key", "overlap", "score"]
    assert sorted(whole.select(columns).collect()) == sorted(bounded.select(columns).collect())
    some = history.similar_topk_whole(queries, history_rows, k, min_score=0.3)
    expected = bounded.where("score >= 0.3")
    assert sorted(some.select(columns).collect()) == sorted(expected.select(columns).collect())


def test_whole_search_of_empty_tables(spark):
    none = spark.createDataFrame([], HISTORY_DDL)
    queries = spark.createDataFrame([(1, "a b")], "query_id BIGINT, text STRING")
    assert history.similar_topk_whole(queries, none).count() == 0
    assert history.similar_topk_whole(queries.limit(0), none).count() == 0


def test_spans_equal_brute_force(spark):
    rng = random.Random(5)
    keys = ["negative_price", "late_arrival", "slow_source", "missing_customer"]
    # Half of all incidents fall into one ten-minute cell.
    book = [
        (i, rng.choice(keys), T + timedelta(seconds=rng.randrange(600 if i % 2 else 90_000)))
        for i in range(400)
    ]
    spans = []
    for w in range(120):
        begin = T + timedelta(seconds=rng.randrange(-5_000, 90_000))
        length = rng.choice([0, 1, 600, 1_200, 5_000, 200_000, -300])
        spans.append((w, begin, begin + timedelta(seconds=length)))
    spans += [(200, T, T + timedelta(minutes=10)), (201, None, T), (202, T, None)]
    rows = spark.createDataFrame(spans, "window_id BIGINT, a TIMESTAMP, b TIMESTAMP")
    incidents = spark.createDataFrame(book, "incident_id BIGINT, failure_key STRING, injected_at TIMESTAMP")
    expected = {}
    for w, a, b in spans:
        inside = [x for x in book if a and b and a <= x[2] < b]
        if inside:
            last = max(inside, key=lambda x: (x[2], x[0]))
            expected[w] = (sorted({x[1] for x in inside}), last[1], len(inside))
    for cell_s in (60, 600, 7_000):
        found = ledger.keys_in_spans(rows, incidents, "window_id", "a", "b", cell_s).collect()
        assert {r.window_id: (r["keys"], r.last_key, r.incidents) for r in found} == expected


def test_grading_by_range_equals_grading_by_id(spark):
    incidents = spark.createDataFrame(
        [(i, k, T + timedelta(minutes=10 * w, seconds=i), w) for i, k, w in
         [(1, "negative_price", 0), (2, "late_arrival", 1), (3, "slow_source", 1), (4, "slow_source", 3)]],
        "incident_id BIGINT, failure_key STRING, injected_at TIMESTAMP, window_id BIGINT",
    )
    diagnoses = spark.createDataFrame(
        [(w, k, [], "") for w, k in
         [(0, "negative_price"), (1, "slow_source"), (2, "slow_source"), (3, None), (4, "late_arrival")]],
        "window_id BIGINT, failure_key STRING, sub_failures ARRAY<STRING>, evidence_surface STRING",
    )
    begin = F.lit(T) + F.make_dt_interval(mins=(F.col("window_id") * 10).cast("int"))
    timed = diagnoses.withColumn("a", begin).withColumn("b", F.col("a") + F.expr("INTERVAL 10 MINUTES"))
    by_range = grade.grade_by_range(timed, incidents, "window_id", "a", "b")
    assert sorted(by_range.collect()) == sorted(grade.grade(diagnoses, incidents, "window_id").collect())


def test_merged_sketches_keep_their_rank_error(spark):
    n = 200_000
    samples = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 5)).alias("role"),
        (F.col("id") % 7).alias("worker"),
        (F.hash("id") % 100_000).cast("double").alias("latency_ms"),
        F.when(F.col("id") % 11 == 0, "error").otherwise("ok").alias("outcome"),
    )
    points = {f"p{p}": p / 100 for p in (1, 25, 50, 95, 99)}
    kept = slo.latency_sketches(samples, ["role", "worker"])
    merged = slo.sketch_quantiles(slo.merge_sketches(kept, ["role"]), points).collect()
    values = {}
    for r in samples.where("outcome = 'ok'").select("role", "latency_ms").collect():
        values.setdefault(r.role, []).append(r.latency_ms)
    assert {r.role for r in merged} == set(values)
    for r in merged:
        ordered = sorted(values[r.role])
        assert (r.operations, r.max_ms) == (len(ordered), ordered[-1])
        for name, p in points.items():
            low = bisect.bisect_left(ordered, r[name]) / len(ordered)
            high = bisect.bisect_right(ordered, r[name]) / len(ordered)
            assert low - slo.SKETCH_ERROR <= p <= high + slo.SKETCH_ERROR


def test_sketch_of_a_group_without_success(spark):
    samples = spark.createDataFrame(
        [("a", None, "error"), ("b", None, "ok"), ("b", 4.0, "ok")],
        "role STRING, latency_ms DOUBLE, outcome STRING",
    )
    found = slo.sketch_quantiles(slo.latency_sketches(samples, ["role"]), {"p50": 0.5})
    assert {r.role: (r.operations, r.errors, r.p50) for r in found.collect()} == {
        "a": (0, 1, None),
        "b": (1, 0, 4.0),
    }


def test_run_documents_of_any_shape(spark):
    bodies = [
        '{"results":[{"unique_id":"m","status":"ERROR","message":"x"},{"unique_id":"n","status":"success"}]}',
        '{"results":[{"status":"Skipped","message":null}, 7, "text", null, {"status":5}]}',
        '{"results":[{"status":"fail","unique_id":"a","message":{"code":1}}]}',
        '{"results":{"status":"fail"}}',
        '{"other":1}',
        "{}",
        '[{"status":"fail"}]',
        "12",
        "null",
        "",
        '{"results":[{"status":"fail"',
        None,
    ]
    rows = spark.createDataFrame(list(enumerate(bodies)), "document_id BIGINT, body STRING")
    found = {r.document_id: r for r in logs.run_result_summary(rows).collect()}
    assert [tuple(n) for n in found[0].failed_nodes] == [("m", "error", "x")]
    assert [tuple(n) for n in found[1].failed_nodes] == [("<unknown>", "skipped", "")]
    assert [(n.node, n.status) for n in found[2].failed_nodes] == [("a", "fail")]
    assert [found[i].total_nodes for i in range(12)] == [2, 5, 1] + [0] * 9
    assert [found[i].parsed for i in range(12)] == [True] * 6 + [False] * 6
    assert [found[i].found for i in range(12)] == [True] * 3 + [False] * 9


def test_every_field_of_a_failure_line(spark):
    prefix = logs.FAILURE_LINE_PREFIX
    lines = [
        (1, f"ERROR {prefix} run_id=r1 job=a attempt=1 attempt=2 note =x url=http://h?a=b error=k=v  "),
        (2, f"{prefix} run_id= plain"),
        (3, f"{prefix} nothing here"),
        (4, "INFO run_id=r1"),
        (5, f"{prefix} error= "),
        (6, None),
    ]
    rows = spark.createDataFrame(lines, "seq BIGINT, line STRING")
    found = {r.seq: (r.fields, r.error) for r in logs.failure_fields(rows).collect()}
    assert found == {
        1: ({"run_id": "r1", "job": "a", "attempt": "2", "": "x", "url": "http://h?a=b"}, "k=v"),
        2: ({"run_id": ""}, None),
        5: ({}, ""),
    }


def test_overlapping_polls_give_each_incident_once(spark, tmp_path):
    book = [(i, T + timedelta(minutes=i)) for i in range(200)]
    ddl = "incident_id BIGINT, injected_at TIMESTAMP"

    def poll(rows):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/polls")

    def read():
        polls = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/polls")
        once = jobs.stream_ledger_once(polls)
        jobs.append_rows(once, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
        return sorted(r.incident_id for r in spark.read.parquet(f"{tmp_path}/out").collect())

    poll(book[:100])
    poll(book[80:150] + book[90:95])
    assert read() == list(range(150))
    poll(book[130:])
    # A second start goes on where the first ended.
    assert read() == list(range(200))


def test_log_files_keep_the_order_of_their_lines(spark, tmp_path):
    prefix = logs.FAILURE_LINE_PREFIX
    first, second = tmp_path / "event.log", tmp_path / "storage"
    second.mkdir()
    first.write_text("".join(f"x\n{prefix} run_id=r{i % 3} job=j{i}\n" for i in range(300)))
    (second / "a.err").write_text(f"{prefix} run_id=r9 job=late error=a b\n\n")
    (second / "b.err").write_text(f"{prefix} run_id=r1 job=last\nINFO\n")
    (second / "c.err").write_text("")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = read_log_lines(spark, [str(first), f"{second}/*.err"])
        assert lines.rdd.getNumPartitions() > 5
        latest = logs.log_failures(lines).first()
        assert (latest.run_id, latest.job, latest["count"]) == ("r1", "last", 302)
        by_run = {r.run_id: (r.job, r["count"]) for r in logs.failures_by_run(lines).collect()}
        assert by_run == {"r0": ("j0", 100), "r1": ("j1", 101), "r2": ("j2", 100), "r9": ("late", 1)}
        backwards = logs.log_failures(read_log_lines(spark, [f"{second}/*.err", str(first)])).first()
        assert backwards.job == "j299"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_probes_show_whole_rows_and_answer_unknown_keys(spark):
    rejects = spark.createDataFrame(
        [(i, "negative_price", f"s{i}", T) for i in (9, 3, 7, 1)] + [(2, "other", "x", T)],
        "order_id BIGINT, reject_rule STRING, status STRING, _ingested_at TIMESTAMP",
    )
    silver = spark.createDataFrame(
        [(1, T, True, False), (2, T, False, False), (3, T, True, True)],
        "order_id BIGINT, ordered_at TIMESTAMP, is_late BOOLEAN, _schema_drift BOOLEAN",
    )
    tables = {"silver_orders": silver, "silver_orders_rejects": rejects, "silver_payments_rejects": rejects}
    found = detect.reject_evidence(rejects, ("negative_price", "missing_customer"), "order_id", 2)
    rows = {r.failure_key: r for r in found.collect()}
    assert [(x.order_id, x.status) for x in rows["negative_price"].sample_rows] == [(1, "s1"), (3, "s3")]
    assert rows["negative_price"]["count"] == 4
    assert (rows["missing_customer"].found, rows["missing_customer"].sample_rows) == (False, [])
    flags = {r.failure_key: r for r in detect.flag_evidence(silver).collect()}
    assert [x.order_id for x in flags["late_arrival"].sample_rows] == [1, 3]
    assert [x.order_id for x in flags["schema_drift"].sample_rows] == [3]
    none = {r.failure_key: r for r in detect.flag_evidence(silver, sample_limit=0).collect()}
    assert none["late_arrival"].sample_rows == [] and none["late_arrival"]["count"] == 2
    for key, count in (("negative_price", 4), ("late_arrival", 2), ("volume_spike", 3), ("no such key", 0)):
        answer = detect.profile(tables, key).collect()
        assert [(a.failure_key, a["count"]) for a in answer] == [(key, count)]
    assert detect.profile(tables, "no such key").first().detail


def test_unbuilt_tables_are_named(spark):
    info = intents.schema_info({"gold_revenue_daily": spark.range(3)})
    assert {(r.table_name, r.materialised, r.row_count) for r in info.collect()} == {
        ("gold_revenue_daily", True, 3),
        ("gold_orders_obt", False, None),
    }
    assert {r.materialised for r in intents.schema_info({}).collect()} == {False}


def test_a_report_scans_each_table_once(spark, tmp_path):
    rows = [
        (i, "abc"[i % 3] if i % 7 else None, f"c{i % 4}", f"s{i % 30}", "placed" if i % 5 else "returned", i % 2 == 0)
        for i in range(400)
    ]
    ddl = "order_id INT, product_category STRING, customer_country STRING, product_sku STRING, status STRING, is_late BOOLEAN"
    obt = spark.createDataFrame(rows, ddl).select(
        "*",
        F.col("product_sku").alias("product_name"),
        (F.col("order_id") % 6).alias("quantity"),
        (F.col("order_id") % 11).cast("decimal(12,2)").alias("total_amount"),
        (F.lit(T) + F.make_dt_interval(days=F.col("order_id") % 20)).alias("ordered_at"),
    )
    daily = obt.groupBy(F.to_date("ordered_at").alias("order_date"), "product_category").agg(
        F.count("*").alias("order_count"),
        F.sum("quantity").alias("units_sold"),
        F.sum("total_amount").alias("gross_revenue"),
    )
    gold = {}
    for name, df in (("gold_orders_obt", obt), ("gold_revenue_daily", daily)):
        df.write.parquet(f"{tmp_path}/{name}")
        gold[name] = spark.read.parquet(f"{tmp_path}/{name}")
    for name, params, scans in (
        ("executive_summary", None, 2),
        # The product section has no dates, the other ones no category.
        ("executive_summary", {"start_date": "2024-01-05", "category": "a"}, 2),
        ("daily_revenue", {"start_date": "2024-01-05", "end_date": "2024-01-12"}, 1),
        ("daily_revenue", {"start_date": "2030-01-01"}, 1),
    ):
        made = intents.report_rows(gold, name, params)
        assert made._jdf.queryExecution().sparkPlan().toString().count("FileScan") == scans
        found = {}
        for r in made.orderBy("section", "rank").collect():
            found.setdefault(r.section, []).append((r.label, r.order_count, r.amount))
        expected = {}
        for key, frame in intents.run_report(gold, name, params).items():
            section = next(s for s in intents.REPORTS[name] if s.key == key)
            keys = intents.INTENTS[section.intent].keys
            amount = "total_amount" if key == "status_mix" else "gross_revenue"
            shown = [
                (" / ".join(str(r[k]) for k in keys if r[k] is not None), r.order_count, r[amount])
                for r in frame.collect()
            ]
            if shown:
                expected[key] = shown
        assert found == expected
