"""The physical plans are the intended ones."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark):
    text = plan(queries()["target_record"](spark, FOLDER))
    assert "EqualTo(p_partkey,7)" in text
    text = plan(queries()["select_columns"](spark, FOLDER))
    assert "ReadSchema: struct<p_partkey:bigint,p_type:string,p_size:int>" in text


def test_top_rows_are_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(queries()["closest_rows"](spark, FOLDER))
    top = queries()["top_vulnerable"](spark, FOLDER)
    assert "TakeOrderedAndProject" in plan(top)


def test_rows_are_aggregated_before_meeting_the_queries(spark):
    text = plan(queries()["count_queries"](spark, FOLDER))
    join = text.index("BroadcastNestedLoopJoin")
    assert "HashAggregate" in text[join:]
    assert "CartesianProduct" not in text


@pytest.mark.parametrize(
    "name", ["sample_per_dataset", "shadow_tables", "query_features", "naive_features", "binary_metrics"]
)
def test_no_cartesian_product_and_no_global_row_window(spark, name):
    text = plan(queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text


def test_two_sampling_ways_both_ignore_partitioning(spark):
    from tablerisk.operators import sampling as R

    pool = spark.range(100).withColumnRenamed("id", "record_id")
    for n in (5, 90):
        a = R.sample_per_dataset(pool, R.dataset_ids(spark, 3), n, 1)
        b = R.sample_per_dataset(pool.orderBy(F.desc("record_id")), R.dataset_ids(spark, 3), n, 1)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
