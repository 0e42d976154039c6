"""What write-ups are made from: selections, no model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossweave.functions.dates import week_month
from crossweave.operators.axes import with_axes


def annotation_backlog(items: DataFrame, sources: DataFrame, model: str, regulatory: bool = False, k: int = 300) -> DataFrame:
    """Items without an insight or with another model's, never those written by hand."""
    open_ = F.coalesce("insight_model", F.lit("")) != "manual"
    rows = items.where(open_ & (F.col("insight").isNull() | (F.coalesce("insight_model", F.lit("")) != model)))
    if regulatory:
        rows = rows.join(F.broadcast(sources.where("regulatory").select(F.col("source").alias("s"))), F.col("source") == F.col("s"), "left_semi")
        order = [F.col("published_at").desc_nulls_last(), F.desc("id")]
    else:
        rows = rows.where("kept")
        order = [F.col("cross_score").desc_nulls_last(), F.col("relevance").desc_nulls_last(), F.asc("id")]
    return rows.orderBy(*order).limit(k).select("id", "title")


def week_highlights(items: DataFrame, item_axes: DataFrame, week: str, per_axis: int = 5) -> DataFrame:
    best = items.where(F.col("kept") & (F.col("published_week") == week)).orderBy(F.col("cross_score").desc_nulls_last(), "id").limit(3 * per_axis)
    return with_axes(best.select("id", "title", "cross_score"), item_axes).withColumn("axes", F.array_join("axes", "+"))


def week_crossed_material(items: DataFrame, item_axes: DataFrame, sources: DataFrame, week: str, first: int = 40, listed: int = 20, least: int = 3) -> DataFrame:
    """(kind, id): of the week's first 40 those with two axes, and its regulatory items.

    The 40 are cut before axes are looked at. Fewer than three crossed items and no regulatory one:
    nothing is told."""
    rows = items.where(F.col("published_week") == week)
    best = rows.where("kept").orderBy(F.col("cross_score").desc_nulls_last(), "id").limit(first)
    crossed = with_axes(best.select("id", "cross_score"), item_axes).where(F.size("axes") >= 2)
    reg = rows.join(F.broadcast(sources.where("regulatory").select(F.col("source").alias("s"))), F.col("source") == F.col("s"), "left_semi").select("id")
    counts = crossed.agg(F.count("*").alias("n")).crossJoin(reg.agg(F.count("*").alias("r")))
    told = crossed.orderBy(F.col("cross_score").desc_nulls_last(), "id").limit(listed).select(F.lit("crossed").alias("kind"), "id").union(reg.select(F.lit("regulatory"), "id"))
    return told.crossJoin(F.broadcast(counts)).where((F.col("n") >= least) | (F.col("r") > 0)).select("kind", "id")


def recent_titles(keywords: DataFrame, kw_week: DataFrame, kw_item: DataFrame, items: DataFrame, weeks: int = 2, titles: int = 3) -> DataFrame:
    """(keyword, week, place, id): of each keyword its last active weeks, and of each week the best titles."""
    mine = kw_week.join(F.broadcast(keywords.select("keyword")), "keyword", "left_semi")
    late = F.row_number().over(Window.partitionBy("keyword").orderBy(F.desc("week")))
    active = mine.withColumn("r", late).where(F.col("r") <= weeks).select("keyword", "week")
    rows = kw_item.join(active, "keyword").join(items.where("kept").select("id", "published_week", "cross_score", "published_at"), (F.col("item_id") == F.col("id")) & (F.col("week") == F.col("published_week")))
    place = F.row_number().over(Window.partitionBy("keyword", "week").orderBy(F.col("cross_score").desc_nulls_last(), F.col("published_at").asc_nulls_last(), "id"))
    return rows.withColumn("place", place).where(F.col("place") <= titles).select("keyword", "week", "place", "id")


def month_material(items: DataFrame, sources: DataFrame, digests: DataFrame, month: str, best: int = 30, latest: int = 10) -> DataFrame:
    """(kind, place, ref): the month's weekly leads, its best kept items and its latest regulatory ones."""
    leads = digests.where((week_month("week") == month) & (F.coalesce("lead", F.lit("")) != "")).select(F.lit("lead").alias("kind"), F.row_number().over(Window.orderBy("week")).alias("place"), F.col("week").alias("ref"))
    rows = items.where(week_month("published_week") == month)
    order = [F.col("cross_score").desc_nulls_last(), F.asc("id")]
    top = rows.where("kept").orderBy(*order).limit(best).select(F.lit("item").alias("kind"), F.row_number().over(Window.orderBy(*order)).alias("place"), F.col("id").cast("string").alias("ref"))
    recent = [F.col("published_at").desc_nulls_last(), F.desc("id")]
    reg = rows.join(F.broadcast(sources.where("regulatory").select(F.col("source").alias("s"))), F.col("source") == F.col("s"), "left_semi")
    reg = reg.orderBy(*recent).limit(latest).select(F.lit("regulatory").alias("kind"), F.row_number().over(Window.orderBy(*recent)).alias("place"), F.col("id").cast("string").alias("ref"))
    return leads.union(top).union(reg)


def annotation_outcomes(items: DataFrame, results: DataFrame, model: str, at: str) -> DataFrame:
    """(id, insight, insight_model, insight_at): a null result is tried again, an empty one is done, a text is stored."""
    new = results.where("result is not null").select(F.col("id").alias("rid"), "result")
    rows = items.select("id", "insight", "insight_model", "insight_at").join(new, F.col("id") == F.col("rid"), "left")
    got = F.col("result").isNotNull()
    return rows.select("id", F.when(got, F.col("result")).otherwise(F.col("insight")).alias("insight"), F.when(got, F.lit(model)).otherwise(F.col("insight_model")).alias("insight_model"), F.when(got, F.to_timestamp(F.lit(at))).otherwise(F.col("insight_at")).alias("insight_at"))
