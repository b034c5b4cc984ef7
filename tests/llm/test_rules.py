"""Thresholds, linking and hot keys of the quality, secret and license operators."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import licenses, quality, secrets
from sluice.llm.common import table


def test_bad_texts_go_and_unseen_trusted_ones_stay(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    # Every third trusted document is kept from the model, and so unseen.
    trusted = quality.trusted_rows(labels)
    judged = quality.quality_rules(docs, trusted.where("doc_id % 3 <> 0")).select("row.doc_id", "base_failed", "kept")
    known = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    rows = [(r.doc_id, r.kept, known[r.doc_id]) for r in judged.collect() if not r.base_failed and r.doc_id in known]
    bad = [kept for _, kept, (good, _) in rows if not good]
    unseen = [kept for i, kept, label in rows if label == (1, 0) and i % 3 == 0]
    assert len(bad) > 20 and len(unseen) > 80
    assert sum(bad) <= 0.1 * len(bad)
    assert sum(not k for k in unseen) <= 0.01 * len(unseen) + 1


def test_quality_keeps_columns_named_like_its_own(spark):
    names = ("_trusted", "id", "half", "key", "words", "grams", "ratios", "row", "s", "n", "b", "raw", "t0", "body")
    texts = [" ".join(f"w{(i * j) % 40}" for j in range(70)) for i in range(12)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = docs.select("*", *[F.lit("own").alias(c) for c in names])
    judged = quality.quality_rules(docs, docs.where("doc_id < 8").select("doc_id", "id")).collect()
    assert len(judged) == 14 and all(r.row["_trusted"] == "own" for r in judged)


def brute_linked(text, scope):
    found = []
    for kind, pattern, group, least in secrets.BASE + secrets.WEAK:
        for m in re.finditer(pattern, text, re.ASCII):
            if len(m.group(group)) >= least:
                found.append((kind, m.start(), m.end()))
    weak = {k for k, *_ in secrets.WEAK}
    out = set()
    for kind, a, b in found:
        for other, c, d in found:
            roles = {secrets.ROLE[kind], secrets.ROLE[other]}
            apart = b <= c or d <= a
            if kind in weak and len(roles) == 2 and "secret" in roles and apart and max(c - b, a - d) <= scope:
                out.add((kind, a, b))
    return out


def test_linked_parts_equal_brute_force(spark):
    rng = random.Random(3)
    pieces = [
        "user=somebody1",
        "Ab1" * 12,
        "Zy9" * 90,
        "s3://host.name/x",
        "token=abcdef12",
        "AKIA" + "Q" * 16,
        "plain words",
        "z " * 45,
        "é" * 60,
    ]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weak = {k for k, *_ in secrets.WEAK}
    rows = secrets.scan_secrets(docs, scope=100).collect()
    got = {r.row.doc_id: {(s.kind, s.start, s.end) for s in r.spans if s.kind in weak} for r in rows}
    want = {i: brute_linked(t, 100) for i, t in enumerate(texts)}
    assert got == want and sum(map(len, want.values())) > 20


@pytest.mark.parametrize("scan", [secrets.scan_secrets, licenses.scan_licenses])
def test_texts_without_a_finding_meet_in_no_join(spark, scan):
    docs = spark.createDataFrame([(i, "nothing to see") for i in range(500)] + [(500, "token=abcdef12")], "doc_id long, text string")
    out = scan(docs)
    assert out.count() == 501
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "isnull(key" in plan and "isnotnull(key" in plan


def test_every_trusted_text_counts(spark):
    n = 20_300
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("word w"), F.col("id") % 7).alias("text"))
    target = quality.trusted_texts(docs, docs.select("doc_id"), buckets=64)
    assert target.count() == n
    # The threshold is the exact one of the scores of all of them.
    scores = [((i * 7919) % 1009) / 1009 for i in range(n)]
    rows = [(i, i % 2, 50, [0 if i % 2 else 1, 2 + i]) for i in range(n)]
    target = spark.createDataFrame(rows, "id bigint, half bigint, n int, grams array<int>")
    model = spark.createDataFrame([([0.0, 0.0, *scores],) * 3], "ratios array<double>, without_0 array<double>, without_1 array<double>")
    found = quality.threshold(target, model, 5.0).first().t
    halves = np.array(scores) / 2
    middle = np.median(halves)
    assert abs(found - (middle - 5 * 1.4826 * np.median(np.abs(halves - middle)))) < 1e-12


@pytest.mark.parametrize("kind", ["bigint", "int", "string"])
def test_trusted_rows_are_found_by_key_of_any_kind(spark, kind):
    keys = [0, 1, -1, 7, 8, -40_000, 32_768, 32_769, 65_536, 65_537, 2_000_000_000]
    docs = [(k, f"text {k}") for k in keys] + [(7, "again"), (None, "none"), (9, "not trusted"), (-8, "nor this")]
    rows = spark.createDataFrame(docs, "k bigint, text string").withColumn("k", F.col("k").cast(kind))
    trusted = spark.createDataFrame([(k,) for k in [*keys, 7, None, 12345]], "k bigint").withColumn("k", F.col("k").cast(kind))
    found = quality.trusted_texts(rows, trusted, "k", "text", 64)
    assert found.schema["id"].dataType == rows.schema["k"].dataType
    assert sorted(int(r.id) for r in found.collect()) == sorted([*keys, 7])
