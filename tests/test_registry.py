import pytest

import __spark_entry__ as entry
from sluice.plans import oracle, registry

NO_SQL = set()


def test_every_query_has_sql_but_for_the_named_ones():
    assert set(registry.QUERIES) - set(oracle.FINALS) == NO_SQL
    assert set(oracle.FINALS) <= set(registry.QUERIES)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["product_category", "order_count", "units_sold", "gross_revenue"]
    assert df.count() == 7 or df.count() == 6


@pytest.mark.parametrize(
    "name", ["gold_orders_obt", "split_invariant", "similar_topk", "grade_cascade", "freshness_report"]
)
def test_queries_run_on_the_smallest_tables(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() > 0


def test_sample_has_the_asked_size(spark, sf_dir):
    assert entry.queries()["sample_k"](spark, sf_dir).count() == 100
