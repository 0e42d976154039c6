"""Reviews of months and weeks against the period before, in local time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossweave.functions.dates import LOCAL_ZONE, iso_week, local_date, week_monday, week_month


def _utc(day: Column) -> Column:
    return F.to_utc_timestamp(day.cast("timestamp"), LOCAL_ZONE)


def period_window(spark: SparkSession, periods: list[str], now: str) -> DataFrame:
    """(period, start, end, cutoff, prev_start, prev_end, status) of months 'YYYY-MM' and ISO weeks.

    Times are UTC instants of local midnights. A period in progress is cut at now and compared with
    the same elapsed time of the one before. Other texts have no row."""
    rows = spark.createDataFrame([(p,) for p in periods], "period string")
    monday = week_monday("period")
    month = F.when(F.col("period").rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.try_to_timestamp(F.concat("period", F.lit("-01"))).cast("date"))
    first = F.coalesce(monday, month)
    last = F.when(monday.isNotNull(), F.date_add(monday, 7)).otherwise(F.add_months(month, 1))
    before = F.when(monday.isNotNull(), F.date_sub(monday, 7)).otherwise(F.add_months(month, -1))
    rows = rows.select("period", _utc(first).alias("start"), _utc(last).alias("end"), _utc(before).alias("prev_start"), F.to_timestamp(F.lit(now)).alias("now")).where("start is not null")
    rows = rows.withColumn("cutoff", F.greatest("start", F.least("now", "end")))
    # in whole microseconds: a shorter month before ends at this one's start
    elapsed = F.unix_micros("cutoff") - F.unix_micros("start")
    prev_end = F.when(F.col("now") >= F.col("end"), F.col("start")).otherwise(F.least(F.col("start"), F.timestamp_micros(F.unix_micros("prev_start") + elapsed)))
    status = F.when(F.col("now") < F.col("start"), "future").when(F.col("now") < F.col("end"), "in_progress").otherwise("closed")
    return rows.select("period", "start", "end", "cutoff", "prev_start", prev_end.alias("prev_end"), status.alias("status"))


def _marked(items: DataFrame, window: DataFrame) -> DataFrame:
    """Kept items within the period or the one before, with current and before flags; the window has one row for each period asked."""
    rows = items.where("kept").crossJoin(F.broadcast(window))
    current = (F.col("published_at") >= F.col("start")) & (F.col("published_at") < F.col("cutoff"))
    before = (F.col("published_at") >= F.col("prev_start")) & (F.col("published_at") < F.col("prev_end"))
    return rows.withColumn("current", current).withColumn("before", before).where("current or before")


def period_totals(items: DataFrame, window: DataFrame) -> DataFrame:
    """(period, current, before, latest): one conditional scan."""
    sums = _marked(items, window).groupBy("period").agg(F.count_if("current").alias("current"), F.count_if("before").alias("before"), F.max(F.when(F.col("current"), F.col("published_at"))).alias("latest"))
    return window.select("period").join(sums, "period", "left").select("period", F.coalesce("current", F.lit(0)).alias("current"), F.coalesce("before", F.lit(0)).alias("before"), "latest")


def period_days(items: DataFrame, window: DataFrame) -> DataFrame:
    return _marked(items, window).where("current").groupBy("period", local_date("published_at").alias("day")).agg(F.count("*").alias("n"))


def axis_compare(items: DataFrame, item_axes: DataFrame, window: DataFrame) -> DataFrame:
    """(period, axis, current, before, share, prev_share): an item of several axes counts in each; a share is
    of the period's kept items, 0 without any now, null without any before."""
    marked = _marked(items, window).select("period", "id", "current", "before")
    sums = marked.join(item_axes, F.col("id") == F.col("item_id")).groupBy("period", "axis").agg(F.count_if("current").alias("current"), F.count_if("before").alias("before"))
    totals = marked.groupBy("period").agg(F.count_if("current").alias("t"), F.count_if("before").alias("b"))
    share = F.when(F.col("t") > 0, F.col("current") / F.col("t")).otherwise(0.0)
    return sums.join(F.broadcast(totals), "period").select("period", "axis", "current", "before", share.alias("share"), F.when(F.col("b") > 0, F.col("before") / F.col("b")).alias("prev_share"))


def safe_url(url: Column) -> Column:
    return F.when(url.rlike(r"(?i)^https?://[^\s/]+"), url).otherwise(F.lit(""))


def period_top(items: DataFrame, window: DataFrame, k: int = 30) -> DataFrame:
    rows = _marked(items, window).where("current")
    place = F.row_number().over(Window.partitionBy("period").orderBy(F.coalesce("cross_score", F.lit(0.0)).desc(), F.col("published_at").desc_nulls_last(), F.desc("id")))
    return rows.withColumn("place", place).where(F.col("place") <= k).select("period", "place", "id", "title", safe_url(F.col("url")).alias("url"), F.substring("summary", 1, 500).alias("summary"))


def period_status(window: DataFrame, editorial: DataFrame) -> DataFrame:
    """final only where the period is closed and its text is signed off."""
    signed = editorial.select(F.col("period").alias("p"), F.col("final"))
    return window.join(signed, F.col("period") == F.col("p"), "left").select("period", F.when((F.col("status") == "closed") & F.coalesce("final", F.lit(False)), "final").otherwise(F.col("status")).alias("status"))


def available_periods(items: DataFrame, editorial: DataFrame, digests: DataFrame, now: str, publication_week: str, weeks: int = 104, months: int = 24) -> DataFrame:
    """(period, kind): the last weeks and months back to the first kept item, and all with a text, up to what is published."""
    spark = items.sparkSession
    first = items.where("kept").agg(F.min("published_at").alias("first"))
    local_now = local_date(F.to_timestamp(F.lit(now)))
    monday_now = F.date_sub(local_now, F.weekday(local_now))
    back_weeks = spark.range(weeks).select(F.expr("cast(id as int)").alias("k")).crossJoin(F.broadcast(first))
    back_weeks = back_weeks.select(F.date_sub(monday_now, F.col("k") * 7).alias("d"), "first").where(F.date_add("d", 7) > local_date("first")).select(iso_week(F.col("d").cast("timestamp")).alias("period"))
    back_months = spark.range(months).select(F.expr("cast(id as int)").alias("k")).crossJoin(F.broadcast(first))
    back_months = back_months.select(F.add_months(F.trunc(local_now, "month"), -F.col("k")).alias("d"), "first").where(F.add_months("d", 1) > local_date("first")).select(F.date_format("d", "yyyy-MM").alias("period"))
    known = editorial.select("period").union(digests.select(F.col("week").alias("period")))
    every = back_weeks.union(back_months).union(known).distinct()
    week = week_monday("period").isNotNull()
    rows = every.select("period", F.when(week, "week").otherwise("month").alias("kind"))
    last_month = week_month(F.lit(publication_week))
    return rows.where(F.when(F.col("kind") == "week", F.col("period") <= publication_week).otherwise(F.col("period") <= last_month))


def editorial_precedence(periods: DataFrame, editorial: DataFrame, snapshots: DataFrame, digests: DataFrame) -> DataFrame:
    """(period, origin, text): the authored text, else a snapshot of the same period, else a digest's lead, else none."""
    a = editorial.select("period", F.col("summary").alias("authored"))
    b = snapshots.where(F.col("body_period") == F.col("period")).select("period", F.col("summary").alias("snapshot"))
    c = digests.where(F.coalesce("lead", F.lit("")) != "").select(F.col("week").alias("period"), "lead")
    rows = periods.select("period").join(a, "period", "left").join(b, "period", "left").join(c, "period", "left")
    origin = F.when(F.col("authored").isNotNull(), "authored").when(F.col("snapshot").isNotNull(), "snapshot").when(F.col("lead").isNotNull(), "lead").otherwise("none")
    return rows.select("period", origin.alias("origin"), F.coalesce("authored", "snapshot", "lead").alias("text"))


def editorial_violations(editorial: DataFrame, window: DataFrame) -> DataFrame:
    """(period, rule) for every rule that an authored text breaks."""
    rows = editorial.join(F.broadcast(window.select("period", "start", F.col("end").alias("stop"))), "period", "left")
    ids = F.transform("sources", lambda s: s["id"])
    used = F.flatten(F.array(F.flatten(F.transform("sections", lambda s: s["source_ids"])), F.flatten(F.transform("tasks", lambda t: t["source_ids"]))))
    day = F.to_timestamp("as_of")
    rules = {
        "period": F.col("start").isNull(),
        "as_of": day.isNull() | (day < F.col("start")) | (day >= F.col("stop")),
        "summary": F.trim(F.coalesce("summary", F.lit(""))) == "",
        "source": F.exists("sources", lambda s: s["id"].isNull() | (F.trim(F.coalesce(s["title"], F.lit(""))) == "") | (safe_url(F.coalesce(s["url"], F.lit(""))) == "")),
        "reference": F.size(F.array_except(used, ids)) > 0,
        "final_day": F.coalesce("final", F.lit(False)) & (local_date(day) != F.date_sub(local_date("stop"), 1)),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]))
    return rows.select("period", F.explode(broken).alias("rule"))


def task_candidates(digests: DataFrame, editorial: DataFrame, cutoff: str | None = None, latest: int = 60) -> DataFrame:
    """(task_key, period, title, origin, n_sources): tasks of the latest digests and all texts, the text's winning."""
    kind = "array<struct<title:string,source_ids:array<bigint>>>"
    recent = digests.orderBy(F.desc("week")).limit(latest).select(F.col("week").alias("period"), F.explode(F.col("tasks").cast(kind)).alias("t"), F.lit(1).alias("rank"), F.array().cast("array<bigint>").alias("known"))
    texts = editorial.select("period", F.explode(F.col("tasks").cast(kind)).alias("t"), F.lit(0).alias("rank"), F.transform("sources", lambda s: s["id"]).alias("known"))
    rows = texts.union(recent).select(F.concat_ws(":", "period", "t.title").alias("task_key"), "period", F.col("t.title").alias("title"), "rank", F.size(F.array_intersect(F.coalesce("t.source_ids", F.array().cast("array<bigint>")), "known")).alias("n_sources"))
    if cutoff:
        rows = rows.where(F.col("period") <= cutoff)
    place = F.row_number().over(Window.partitionBy("task_key").orderBy("rank"))
    best = rows.withColumn("place", place).where("place = 1")
    return best.select("task_key", "period", "title", F.when(F.col("rank") == 0, "editorial").otherwise("digest").alias("origin"), "n_sources").orderBy(F.desc("period"), "task_key")


def month_report(items: DataFrame, item_axes: DataFrame, sources: DataFrame, months: list[str]) -> DataFrame:
    """(month, axis, n, kept, total, regulatory) by local calendar month, one pass over the items."""
    month = F.date_format(local_date("published_at"), "yyyy-MM")
    rows = items.withColumn("month", month).where(F.col("month").isin(*months)).join(F.broadcast(sources.select("source", "regulatory")), "source", "left")
    kept = F.coalesce("kept", F.lit(False))
    totals = rows.groupBy("month").agg(F.count_if(kept).alias("kept"), F.count("*").alias("total"), F.count_if(F.coalesce("regulatory", F.lit(False))).alias("regulatory"))
    axes = rows.where(kept).select("id", "month").join(item_axes, F.col("id") == F.col("item_id")).groupBy("month", "axis").agg(F.count_distinct("item_id").alias("n"))
    return axes.join(F.broadcast(totals), "month")


def month_axis_delta(report: DataFrame, month: str, before: str) -> DataFrame:
    """Change of an axis's share of kept items in points; null where the month before has none."""
    one = report.where(F.col("month") == month).select("axis", (F.lit(100.0) * F.col("n") / F.col("kept")).alias("now"))
    two = report.where((F.col("month") == before) & (F.col("kept") > 0)).select("axis", (F.lit(100.0) * F.col("n") / F.col("kept")).alias("was"))
    return one.join(two, "axis", "left").select("axis", (F.col("now") - F.col("was")).alias("delta"))


def report_months(items: DataFrame) -> DataFrame:
    return items.where("kept").select(week_month("published_week").alias("month")).where("month is not null").distinct().orderBy(F.desc("month"))


def review_material(items: DataFrame, window: DataFrame, k: int = 20) -> DataFrame:
    """(period, total, place, id): kept items of the period up to its cutoff, the best of them."""
    rows = _marked(items, window).where("current").withColumn("total", F.count("*").over(Window.partitionBy("period")))
    place = F.row_number().over(Window.partitionBy("period").orderBy(F.coalesce("cross_score", F.lit(0.0)).desc(), "id"))
    return rows.withColumn("place", place).where(F.col("place") <= k).select("period", "total", "place", "id")
