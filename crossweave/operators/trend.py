"""Rising keywords and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossweave.functions.dates import iso_week, week_monday


def week_dimension(spark, week: str, back: int) -> DataFrame:
    """(week, age): the week itself (age 0) and `back` weeks before it; no rows where the text is no week."""
    monday = week_monday(F.lit(week))
    rows = spark.range(back + 1).select(F.col("id").cast("int").alias("age"), monday.alias("monday"))
    return rows.where("monday is not null").select(iso_week(F.expr("date_sub(monday, 7 * age)")).alias("week"), "age")


def latest_week(items: DataFrame) -> DataFrame:
    return items.where("kept").agg(F.max("published_week").alias("week"))


def pieces_of(keywords: DataFrame, column: str = "keyword", *more: str) -> DataFrame:
    """(whole, part, more) for every proper part of each keyword, so that containment is an equality join."""
    n = F.length(column)
    starts = F.sequence(F.lit(1), n)
    parts = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substr(F.col(column), i, k))))
    return keywords.select(F.col(column).alias("whole"), F.explode(F.array_distinct(parts)).alias("part"), *more).where("whole <> part")


def fragments(counted: DataFrame, ratio: float = 0.9) -> DataFrame:
    """(keyword) of those that another keyword of the table (keyword, n) holds with at least ratio times the count.

    Of a keyword's parts only those that are keywords themselves go on; their largest holder decides."""
    parts = pieces_of(counted, "keyword", "n").withColumnRenamed("n", "whole_n")
    known = parts.join(counted.select(F.col("keyword").alias("part")), "part", "left_semi")
    hosts = known.groupBy("part").agg(F.max("whole_n").alias("host_n"))
    return counted.join(hosts, F.col("keyword") == F.col("part")).where(F.col("host_n") >= F.lit(ratio) * F.col("n")).select("keyword")


def rising_keywords(kw_week: DataFrame, items: DataFrame, weeks: DataFrame, min_freq: int = 5) -> DataFrame:
    """(keyword, n, share, prev_share, score, is_new) of the keywords of the week with age 0.

    Shares are of the kept items, so that a week with more items lifts no keyword; the share before
    is over all the weeks before together, and one item's share is added to the divisor. Fragments of
    other candidates go."""
    dim = F.broadcast(weeks)
    counts = kw_week.join(dim, "week").groupBy("keyword").agg(F.sum(F.when(F.col("age") == 0, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(F.col("age") > 0, F.col("n")).otherwise(0)).alias("before"))
    kept = items.where("kept").select(F.col("published_week").alias("week")).join(dim, "week")
    totals = kept.agg(F.greatest(F.count_if(F.col("age") == 0), F.lit(1)).alias("kept_now"), F.greatest(F.count_if(F.col("age") > 0), F.lit(1)).alias("kept_before"))
    chosen = counts.where(F.col("n") >= min_freq)
    whole = chosen.join(fragments(chosen.select("keyword", "n")), "keyword", "left_anti").crossJoin(F.broadcast(totals))
    share, before = F.col("n") / F.col("kept_now"), F.col("before") / F.col("kept_before")
    return whole.select("keyword", "n", share.alias("share"), before.alias("prev_share"), (share / (before + 1 / F.col("kept_now"))).alias("score"), (F.col("before") == 0).alias("is_new"))


def top_rising(rising: DataFrame, k: int) -> DataFrame:
    """The first k by score in two decimals, then count, then keyword."""
    return rising.orderBy(F.desc(F.round("score", 2)), F.desc("n"), "keyword").limit(k)


def keyword_series(kw_week: DataFrame, weeks: DataFrame, keywords: list[str]) -> DataFrame:
    """(keyword, week, n) over all the weeks, with zeros."""
    spark = kw_week.sparkSession
    words = spark.createDataFrame([(k,) for k in keywords], "keyword string")
    grid = F.broadcast(weeks.select("week").crossJoin(words))
    return grid.join(kw_week.where(F.col("keyword").isin(*keywords)), ["keyword", "week"], "left").select("keyword", "week", F.coalesce("n", F.lit(0)).alias("n"))


def rising_by_axis(rising: DataFrame, axis_terms: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """Rising keywords whose own text holds a term of one of the axes; case and spaces do not count."""
    flat = lambda c: F.lower(F.replace(c, F.lit(" "), F.lit("")))
    terms = axis_terms.where(F.col("axis").isin(*axes)).select(flat(F.col("keyword")).alias("term")).distinct()
    parts = rising.select("keyword", flat(F.col("keyword")).alias("flat"))
    n = F.length("flat")
    cut = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substr(F.col("flat"), i, k))))
    held = parts.select("keyword", F.explode(F.array_distinct(cut)).alias("term")).join(terms, "term", "left_semi").select("keyword").distinct()
    return rising.join(held, "keyword", "left_semi")


def rising_groups(rising: DataFrame, axis_terms: DataFrame, groups: dict[str, tuple[str, ...]], k: int = 5) -> DataFrame:
    """(grp, place, keyword, n, score): the first k of each group of axes."""
    out = None
    for name, axes in groups.items():
        part = rising_by_axis(rising, axis_terms, axes).select(F.lit(name).alias("grp"), "keyword", "n", "score")
        out = part if out is None else out.union(part)
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc(F.round("score", 2)), F.desc("n"), "keyword"))
    return out.withColumn("place", place).where(F.col("place") <= k).select("grp", "place", "keyword", "n", "score")


def rising_with_series(rising: DataFrame, kw_week: DataFrame, weeks: DataFrame, k: int = 8) -> DataFrame:
    """(keyword, series): the first k, each with its counts by week, oldest first, as one text."""
    best = top_rising(rising, k).select("keyword")
    grid = F.broadcast(best.crossJoin(weeks.select("week")))
    rows = grid.join(kw_week, ["keyword", "week"], "left").select("keyword", "week", F.coalesce("n", F.lit(0)).alias("n"))
    points = F.transform(F.sort_array(F.collect_list(F.struct("week", "n"))), lambda p: F.concat_ws(":", p["week"], p["n"]))
    return rows.groupBy("keyword").agg(F.array_join(points, ",").alias("series"))
