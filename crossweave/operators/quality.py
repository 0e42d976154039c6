"""Checks that tables agree with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def source_ref_integrity(refs: DataFrame, items: DataFrame) -> DataFrame:
    """(period, ref_id, problem) of cited sources (period, ref_id, url) that are no items or have another URL."""
    known = items.select(F.col("id").alias("item_id"), F.col("url").alias("item_url"))
    rows = refs.join(known, F.col("ref_id") == F.col("item_id"), "left")
    problem = F.when(F.col("item_id").isNull(), "missing").when(~F.col("url").eqNullSafe(F.col("item_url")), "url")
    return rows.select("period", "ref_id", problem.alias("problem")).where("problem is not null")


def search_parity(one: DataFrame, two: DataFrame) -> DataFrame:
    """(side, id) of ids that one of two results has and the other has not, repeats counted."""
    a, b = one.select("id"), two.select("id")
    return a.exceptAll(b).select(F.lit("first").alias("side"), "id").union(b.exceptAll(a).select(F.lit("second"), "id"))


def index_consistency(kw_week: DataFrame, kw_item: DataFrame, items: DataFrame) -> DataFrame:
    """(keyword, week, counted, listed) where the count of a keyword's week is not the number of items listed for it."""
    kept = items.where("kept").select(F.col("id").alias("item_id"), F.col("published_week").alias("week"))
    listed = kw_item.join(kept, "item_id").groupBy("keyword", "week").agg(F.count("*").alias("listed"))
    rows = kw_week.select("keyword", "week", F.col("n").alias("counted")).join(listed, ["keyword", "week"], "full_outer")
    rows = rows.select("keyword", "week", F.coalesce("counted", F.lit(0)).alias("counted"), F.coalesce("listed", F.lit(0)).alias("listed"))
    return rows.where("counted <> listed")
