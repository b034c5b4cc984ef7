"""What lets single steps grow: derived once, written in many tasks, shuffled no more than needed."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from sluice.operators import history
from sluice.plans import registry
from sluice.sources.layers import PartitionedTable, key_range


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def incidents(spark, texts):
    rows = [(i, "negative_price" if i % 2 else "late_arrival", t, datetime(2024, 1, 1 + i % 3)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "incident_id bigint, failure_key string, detail string, injected_at timestamp")


def brute_force(asked, past, k):
    """Rows of the search over (query_id, text) and (incident_id, key, detail, time)."""
    import re

    words = lambda t: set(re.findall("[a-z0-9_]+", t.lower()))
    out = []
    for q, text in asked:
        if text is None:
            continue
        scored = []
        for i, key, detail, at in past:
            theirs = words(f"{key} {detail or ''}")
            common = len(words(text) & theirs)
            if common:
                scored.append((-common / len(words(text) | theirs), -at.timestamp(), -i, i, key, common))
        scored.sort()
        out += [(q, r + 1, s[3], s[4], s[5], -s[0]) for r, s in enumerate(scored[:k])]
    return sorted(out)


def test_search_equals_brute_force_without_a_set_per_pair(spark):
    dice = random.Random(3)
    text = lambda n: " ".join(dice.choice("abcdefghijklmnop") * dice.randint(1, 2) for _ in range(n))
    past = incidents(spark, [None, "", *[text(dice.randint(1, 12)) for _ in range(30)]])
    # Ids may repeat, texts may be null, empty or of unknown words only.
    asked = [(i % 690, text(dice.randint(1, 15))) for i in range(700)] + [(1000, None), (1001, ""), (1002, "zz ZZ !")]
    queries = spark.createDataFrame(asked, "query_id bigint, text string")
    found = history.similar_topk(queries, past, 3, 100)
    assert "MapInArrow" in plan(found) and "array_intersect" not in plan(found)
    kept = [tuple(r) for r in past.collect()]
    assert sorted(tuple(r) for r in found.collect()) == brute_force(asked, kept, 3)
    once = queries.dropDuplicates(["query_id"])
    whole = history.similar_topk_whole(once, past, 3)
    rows = [tuple(r) for r in once.collect()]
    assert sorted(tuple(r) for r in whole.collect()) == brute_force(rows, kept, 3)
    assert history.similar_topk(queries, past.limit(0)).count() == 0


def tables(spark, root):
    """Orders and line items of a few keys, twice the same line number on one order."""
    day = datetime(1997, 5, 5)
    lines = [(k, 1, n, 2.0, 10.0, "N", day) for k in range(1, 9) for n in (1, 2)] + [(3, 1, 1, 1.0, 5.0, "A", day)]
    made = {
        "lineitem": (lines, "l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_returnflag STRING, l_shipdate TIMESTAMP"),
        "orders": ([(k, 1, day) for k in range(1, 9)], "o_orderkey BIGINT, o_custkey BIGINT, o_orderdate TIMESTAMP"),
        "part": ([(1, "n", "b", "t", 5.0)], "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_retailprice DOUBLE"),
    }
    for name, (rows, ddl) in made.items():
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{root}/{name}.parquet")
    return root


def test_refreshed_payments_are_derived_once(spark, tmp_path):
    lake = registry.Lake(spark, tables(spark, str(tmp_path / "t")))
    want = sorted(map(str, lake.src.payments.collect()))
    found = registry.refresh_payments(lake, "strict")
    # No line items are added up in it any more: both classifications read what was written.
    assert "l_linenumber" not in plan(found) and "l_orderkey" not in plan(found)
    assert sorted(map(str, lake.src.payments.collect())) == want
    # Strict mode equals a full rebuild.
    rebuilt = registry.Lake(spark, lake.root).after.silver("payments")
    assert sorted(map(str, found.collect())) == sorted(map(str, rebuilt.collect())) != []


def test_a_drop_is_written_by_all_its_tasks_and_read_in_one_batch(spark, tmp_path):
    lake = registry.Lake(spark, str(tmp_path))
    path, seen = str(tmp_path / "drops"), []
    for start in (0, 100):
        rows = spark.range(start, start + 100, 1, 5)
        registry._drop(path, rows)
        stream = registry._arrived(lake, path, rows).writeStream.trigger(availableNow=True)
        stream = stream.option("checkpointLocation", str(tmp_path / "c"))
        stream.foreachBatch(lambda df, i: seen.append(df.count())).start().awaitTermination()
    assert len(list((tmp_path / "drops").glob("part-*.parquet"))) == 10
    assert seen == [100, 100]


def test_streamed_payments_equal_the_batch_verdicts_in_drops_of_many_files(spark, tmp_path):
    root = tables(spark, str(tmp_path / "t"))
    found = registry.stream_payments(registry.Lake(spark, root))
    lake = registry.Lake(spark, root)
    want = lake.tables.classified("payments").select(*found.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    assert found.count() == 16


def test_a_batch_shuffles_no_rows_that_lie_by_part(spark, tmp_path, monkeypatch):
    table = PartitionedTable(spark, str(tmp_path / "t"), key_range("id", 100))
    as_they_lie, write = [], PartitionedTable._overwrite
    monkeypatch.setattr(PartitionedTable, "_overwrite", lambda s, df, c: (as_they_lie.append(c), write(s, df, c))[1])
    rows = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], "id bigint, v int").repartition(4)
    table.upsert(rows(range(2000), 1), "id", str(tmp_path / "s0"))
    # Nothing of the table is read by the first batch, so nothing is staged.
    assert not (tmp_path / "s0").exists()
    table.upsert(rows(range(5, 2005, 10), 2), "id", str(tmp_path / "s1"))
    assert as_they_lie == [False, True]
    found = {r.id: r.v for r in table.rows().collect()}
    assert found == {i: 2 if i % 10 == 5 else 1 for i in range(2000)}
    # A part that loses all rows goes.
    table.replace(table.rows().where("id >= 100"), list(range(20)), str(tmp_path / "s2"))
    assert table.rows().agg(F.min("id")).first()[0] == 100


def test_a_repeated_first_batch_replaces_what_a_crash_left(spark, tmp_path):
    table = PartitionedTable(spark, str(tmp_path / "t"), key_range("id", 10))
    rows = spark.createDataFrame([(i % 25, i) for i in range(50)], "id bigint, _ingested_at int")
    table._overwrite(rows.where("id < 5").select("*", table.part), False)
    table.upsert(rows, "id", str(tmp_path / "s"))
    assert {r.id: r._ingested_at for r in table.rows().collect()} == {i: i + 25 for i in range(25)}
