"""Saved tables: rows are whole, the session's settings are as before, shuffled plans can be used again."""

import pytest
from pyspark.sql import functions as F

from crossweave.functions.components import components, settle, shuffles_end_here

KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_a_shuffled_table_is_whole_and_its_plan_runs_again(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), "id").groupBy("k").agg(F.sum("id").alias("n"))
    before = spark.conf.get(KEY)
    saved = settle(rows, "sums")
    assert spark.conf.get(KEY) == before
    # the plan's own shuffle went with the first run; it is made again
    assert sorted(map(tuple, saved.collect())) == sorted(map(tuple, rows.collect())) == sorted(map(tuple, settle(rows, "sums").collect()))
    joined = saved.join(rows.withColumnRenamed("n", "m"), "k").where("n = m")
    assert settle(joined, "joined").count() == 7


def test_settings_come_back_where_a_query_fails(spark):
    before = spark.conf.get(KEY)
    with pytest.raises(Exception, match="failed on purpose"), shuffles_end_here(spark):
        spark.range(3).select(F.raise_error(F.lit("failed on purpose"))).collect()
    assert spark.conf.get(KEY) == before


def test_components_of_a_chain_a_star_and_nothing(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
