"""Results to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.functions.dates import local_date


def search_rows(found: DataFrame, item_axes: DataFrame, limit: int = 1000) -> DataFrame:
    """Rows of a search for a spreadsheet: local date, title, source, axes, score with one decimal, address."""
    limit = min(max(limit, 1), 5000)
    order = [F.col("published_at").desc_nulls_last(), F.desc("id")]
    best = found.orderBy(*order).limit(limit)
    axes = item_axes.groupBy("item_id").agg(F.array_join(F.sort_array(F.collect_set("axis")), ", ").alias("axes"))
    rows = best.join(axes, F.col("id") == F.col("item_id"), "left")
    return rows.select("id", local_date("published_at").alias("day"), "title", "source", F.coalesce("axes", F.lit("")).alias("axes"), F.format_string("%.1f", F.coalesce("cross_score", F.lit(0.0))).alias("score"), "url")


def write_csv(rows: DataFrame, path: str) -> None:
    """Files with a byte order mark on the first header, as spreadsheets expect: one for a small result, and several, each with
    its header, for a large one, so that no task makes or holds all rows."""
    first = rows.columns[0]
    rows.withColumnRenamed(first, "﻿" + first).hint("rebalance").write.option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """What write_csv wrote, all columns as text, without the byte order mark."""
    rows = spark.read.option("header", True).csv(path)
    return rows.toDF(*[c.removeprefix("\ufeff") for c in rows.columns])


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as CSV and JSON."""
    for name, table in (("nodes", nodes), ("edges", edges)):
        table.write.option("header", True).csv(f"{path}/{name}_csv")
        table.write.json(f"{path}/{name}_json")


def overwrite_index(tables: dict[str, DataFrame], path: str, by: dict[str, str] | None = None) -> None:
    """Index tables made anew; a table with a partition column replaces the partitions that it has rows for."""
    for name, table in tables.items():
        writer = table.write.mode("overwrite")
        if by and name in by:
            writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(by[name])
        writer.parquet(f"{path}/{name}")
