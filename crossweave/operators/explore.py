"""Search and dashboards over items and the aggregate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossweave.functions.dates import local_date, week_label, week_month
from crossweave.operators.axes import axes_arrays, with_axes
from crossweave.operators.search_index import TextIndex


def search_items(items: DataFrame, item_axes: DataFrame, kw_item: DataFrame, text: str | None = None, axis: str | None = None, since: str | None = None, until: str | None = None, kept_only: bool = True, texts: TextIndex | None = None) -> DataFrame:
    """Items by kept, local dates (until included), axis and literal text.

    The text is found in the title, in the summary, or as an indexed keyword of the item; it has no
    wildcards. With an index of texts the items need no summaries: the other tests come first, the index
    names candidates among what is left, and only ids meet the items. Without one the items are scanned."""
    rows = items.where("kept") if kept_only else items
    day = local_date("published_at")
    if since:
        rows = rows.where(day >= F.to_date(F.lit(since)))
    if until:
        rows = rows.where(day < F.date_add(F.to_date(F.lit(until)), 1))
    if axis:
        rows = rows.join(item_axes.where(F.col("axis") == axis).select("item_id"), F.col("id") == F.col("item_id"), "left_semi")
    if text:
        flagged = kw_item.where(F.col("keyword") == text).select(F.col("item_id").alias("hit_id"))
        if texts:
            hits = texts.ids(text, rows).select(F.col("id").alias("hit_id")).union(flagged)
            return rows.join(hits, F.col("id") == F.col("hit_id"), "left_semi")
        rows = rows.join(flagged.distinct().withColumn("hit", F.lit(True)), F.col("id") == F.col("hit_id"), "left")
        rows = rows.where(F.col("title").contains(text) | F.col("summary").contains(text) | F.coalesce("hit", F.lit(False))).drop("hit_id", "hit")
    return rows


def search_total(found: DataFrame) -> DataFrame:
    return found.agg(F.count_distinct("id").alias("total"))


#: Keys of each order: column and whether it descends; nulls come last, and the id, which is never null, ends each.
ORDERS = {
    "oldest": (("published_at", False), ("id", False)),
    "newest": (("published_at", True), ("id", True)),
    "relevance": (("cross_score", True), ("published_at", True), ("id", True)),
}


def search_order(order: str) -> list[Column]:
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in ORDERS[order]]


def beyond(order: str, last: dict) -> Column:
    """Rows that come after the row with these keys."""
    test = F.lit(False)
    for column, down in reversed(ORDERS[order]):
        value = last[column]
        if value is None:
            test = F.col(column).isNull() & test
        else:
            further = F.col(column) < F.lit(value) if down else F.col(column) > F.lit(value)
            test = F.coalesce(further, F.lit(True)) | F.coalesce(F.col(column) == F.lit(value), F.lit(False)) & test
    return test


def search_page(found: DataFrame, item_axes: DataFrame, order: str = "relevance", page: int = 1, size: int = 25, texts: TextIndex | None = None, after: dict | None = None) -> DataFrame:
    """One page with place, axes and a short summary; axes and summaries are attached to the page's rows alone.

    `after` has the keys of the row before the page (see ORDERS and last_keys): what comes after them is
    sought, so that no page before is sorted; without it the page is counted off from the first row."""
    size = min(max(size, 1), 200)
    if after is not None:
        rows = found.where(beyond(order, after)).orderBy(*search_order(order)).limit(size)
    else:
        rows = found.orderBy(*search_order(order)).offset((page - 1) * size).limit(size)
    if texts:
        shown = rows.collect()  # `size` rows at most
        rows = found.sparkSession.createDataFrame(shown, rows.schema)
        rows = rows.join(texts.named([r["id"] for r in shown]).select("id", "summary"), "id", "left")
    rows = with_axes(rows, item_axes)
    place = F.row_number().over(Window.orderBy(*search_order(order))) + F.lit((page - 1) * size)
    return rows.select(place.alias("place"), "id", "title", F.substring("summary", 1, 300).alias("summary"), "source", "published_at", "cross_score", F.array_join("axes", "+").alias("axes"))


def last_keys(page: DataFrame, order: str = "relevance") -> dict | None:
    """The keys of a page's last row, from which the next page goes on; None for an empty page."""
    last = page.orderBy(F.desc("place")).select(*[c for c, _ in ORDERS[order]]).first()
    return last.asDict() if last else None


def keyword_items(items: DataFrame, kw_item: DataFrame, keyword: str, page: int = 1, size: int = 20) -> DataFrame:
    """A page of an indexed keyword's items, kept or not, with the total and the kept items of the page."""
    rows = items.join(kw_item.where(F.col("keyword") == keyword).select("item_id"), F.col("id") == F.col("item_id"), "left_semi")
    total = rows.agg(F.count("*").alias("total"))
    order = [F.coalesce("kept", F.lit(False)).desc(), F.coalesce("cross_score", F.lit(0.0)).desc(), F.col("published_at").desc_nulls_last(), F.desc("id")]
    part = rows.orderBy(*order).offset((page - 1) * size).limit(size)
    place = F.row_number().over(Window.orderBy(*order))
    shown = part.select(place.alias("place"), "id", "kept", "cross_score", F.count_if(F.coalesce("kept", F.lit(False))).over(Window.partitionBy()).alias("page_kept"))
    return shown.crossJoin(F.broadcast(total))


def related_items(items: DataFrame, item_axes: DataFrame, item_id: int, k: int = 8) -> DataFrame:
    """Kept items that share an axis with the item, best score first."""
    mine = item_axes.where(F.col("item_id") == item_id).select("axis")
    near = item_axes.join(F.broadcast(mine), "axis", "left_semi").select("item_id").distinct()
    rows = items.where(F.col("kept") & (F.col("id") != item_id)).join(near, F.col("id") == F.col("item_id"), "left_semi")
    return rows.orderBy(F.col("cross_score").desc_nulls_last(), "id").limit(k).select("id", "title", "cross_score")


def corpus_stats(items: DataFrame, item_axes: DataFrame) -> DataFrame:
    """Totals in one pass over the items joined with their number of axes."""
    n = item_axes.groupBy("item_id").agg(F.count("*").alias("k"))
    rows = items.join(n, F.col("id") == F.col("item_id"), "left")
    kept = F.coalesce("kept", F.lit(False))
    sums = rows.agg(F.count("*").alias("total"), F.count_if(kept).alias("kept"), F.count_if(F.coalesce("insight", F.lit("")) != "").alias("annotated"), F.count_if(kept & (F.coalesce("k", F.lit(0)) >= 3)).alias("wide"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"), F.max(F.when(kept, F.col("published_week"))).alias("week"))
    weekly = items.where("kept").groupBy("published_week").agg(F.count("*").alias("n"))
    return sums.join(F.broadcast(weekly), F.col("week") == F.col("published_week"), "left").select("total", "kept", "annotated", "wide", "first_at", "last_at", "week", F.coalesce("n", F.lit(0)).alias("week_kept"))


def source_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.coalesce("kept", F.lit(False))).alias("kept"))


def week_list(items: DataFrame, digests: DataFrame, publication_week: str | None = None) -> DataFrame:
    """Kept items by week, latest first, up to the week that is published; saved tells of a digest."""
    n = items.where("kept and published_week is not null").groupBy(F.col("published_week").alias("week")).agg(F.count("*").alias("n"))
    if publication_week:
        n = n.where(F.col("week") <= publication_week)
    saved = digests.select(F.col("week").alias("saved_week")).distinct()
    return n.join(saved, F.col("week") == F.col("saved_week"), "left").select("week", "n", F.col("saved_week").isNotNull().alias("saved")).orderBy(F.desc("week"))


def month_tree(weeks: DataFrame, reviews: DataFrame) -> DataFrame:
    """(month, n, weeks, review): weeks folded into the months of their Thursdays."""
    rows = weeks.withColumn("month", week_month("week")).groupBy("month").agg(F.sum("n").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("week", "n")), False), lambda p: F.concat_ws(":", p["week"], p["n"])), ",").alias("weeks"))
    have = reviews.select(F.col("period").alias("review_month")).distinct()
    return rows.join(have, F.col("month") == F.col("review_month"), "left").select("month", "n", "weeks", F.col("review_month").isNotNull().alias("review"))


def month_totals(items: DataFrame, month: str) -> DataFrame:
    """(kept, before, delta) of a month by its weeks; delta is null without items before."""
    rows = items.where("kept").groupBy(F.col("published_week").alias("week")).agg(F.count("*").alias("n")).withColumn("month", week_month("week"))
    before = F.date_format(F.add_months(F.to_date(F.lit(month + "-01")), -1), "yyyy-MM")
    sums = rows.agg(F.sum(F.when(F.col("month") == month, F.col("n")).otherwise(0)).alias("kept"), F.sum(F.when(F.col("month") == before, F.col("n")).otherwise(0)).alias("before"))
    return sums.withColumn("delta", F.when(F.col("before") > 0, F.col("kept") - F.col("before")))


def in_month(items: DataFrame, month: str) -> DataFrame:
    return items.where("kept").where(week_month("published_week") == month)


def month_axes(items: DataFrame, item_axes: DataFrame, month: str) -> DataFrame:
    rows = item_axes.join(in_month(items, month).select("id"), F.col("id") == F.col("item_id"))
    return rows.groupBy("axis").agg(F.count_distinct("item_id").alias("n"))


def month_top(items: DataFrame, month: str, k: int = 8) -> DataFrame:
    return in_month(items, month).orderBy(F.col("cross_score").desc_nulls_last(), F.desc("id")).limit(k).select("id", "title", "cross_score")


def cross_items(items: DataFrame, item_axes: DataFrame, weeks: DataFrame, n_axes: int, limit: int = 60) -> DataFrame:
    """Kept items of the weeks with exactly n axes, best first."""
    rows = items.where("kept").join(F.broadcast(weeks.select(F.col("week").alias("w"))), F.col("published_week") == F.col("w"), "left_semi")
    rows = with_axes(rows, item_axes).where(F.size("axes") == n_axes)
    rows = rows.orderBy(F.col("cross_score").desc_nulls_last(), F.col("published_at").desc_nulls_last(), F.desc("id")).limit(limit)
    return rows.select("id", "title", "published_week", "cross_score", F.array_join("axes", "+").alias("combo"))


def cross_combos(items: DataFrame, item_axes: DataFrame, weeks: DataFrame) -> DataFrame:
    """Kept items of the weeks by combination of two axes or more, whatever number is looked at."""
    rows = items.where("kept").join(F.broadcast(weeks.select(F.col("week").alias("w"))), F.col("published_week") == F.col("w"), "left_semi")
    return with_axes(rows.select("id"), item_axes).where(F.size("axes") >= 2).groupBy(F.array_join("axes", "+").alias("combo")).agg(F.count("*").alias("n"))


def cross_weeks(items: DataFrame, item_axes: DataFrame, weeks: DataFrame, n_axes: int) -> DataFrame:
    rows = with_axes(items.where("kept").select("id", "published_week"), item_axes).where(F.size("axes") == n_axes).groupBy("published_week").agg(F.count("*").alias("n"))
    return weeks.join(rows, F.col("week") == F.col("published_week"), "left").select("week", week_label("week").alias("label"), F.coalesce("n", F.lit(0)).alias("n"))


def recurring(kw_week: DataFrame, weeks: DataFrame, wanted: Column, fragments, least_total: int = 3, least_weeks: int = 2, limit: int = 40) -> DataFrame:
    """(keyword, total, weeks, series): keywords of a kind (organisations) in several weeks, without fragments among them."""
    rows = kw_week.where(wanted).join(F.broadcast(weeks.select("week")), "week")
    points = F.transform(F.sort_array(F.collect_list(F.struct("week", "n"))), lambda p: F.concat_ws(":", p["week"], p["n"]))
    sums = rows.groupBy("keyword").agg(F.sum("n").alias("total"), F.count_distinct("week").alias("weeks"), F.array_join(points, ",").alias("series"))
    whole = sums.join(fragments(sums.select("keyword", F.col("total").alias("n"))), "keyword", "left_anti")
    return whole.where((F.col("total") >= least_total) & (F.col("weeks") >= least_weeks)).orderBy(F.desc("weeks"), F.desc("total"), "keyword").limit(limit)


def keyword_week_items(items: DataFrame, kw_item: DataFrame, keyword: str, week: str, limit: int = 20) -> DataFrame:
    """Kept items of a keyword and week, best first, then oldest, with the total before the cut."""
    rows = items.where(F.col("kept") & (F.col("published_week") == week)).join(kw_item.where(F.col("keyword") == keyword).select("item_id"), F.col("id") == F.col("item_id"), "left_semi")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.col("cross_score").desc_nulls_last(), F.col("published_at").asc_nulls_last(), "id").limit(limit).select("id", "title", "cross_score", "published_at").crossJoin(F.broadcast(total))


def regulatory_items(items: DataFrame, sources: DataFrame, days: int | None = None, text: str | None = None, now: str | None = None, limit: int = 100, texts: TextIndex | None = None) -> DataFrame:
    """Items of regulatory sources, kept or not, newest first; text is found in any case, by the index of texts if there is one."""
    rows = items.join(F.broadcast(sources.where("regulatory").select(F.col("source").alias("s"))), F.col("source") == F.col("s"), "left_semi")
    if days is not None:
        rows = rows.where(F.col("published_at") >= F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(days)))
    if text and texts:
        rows = rows.join(texts.ids(text, rows, True), "id", "left_semi")
    elif text:
        rows = rows.where(F.lower("title").contains(text.lower()) | F.lower("summary").contains(text.lower()))
    return rows.orderBy(F.col("published_at").desc_nulls_last(), F.desc("id")).limit(limit)


#: Fixed value: how a line of an insight begins that names something to check.
CHECK_MARK = "▸ 확인 필요:"


def checklist(items: DataFrame) -> DataFrame:
    """(item_id, name, detail) from insight lines that name something to check, cut at the first dash."""
    lines = F.regexp_extract_all("insight", F.lit(rf"(?m)^{CHECK_MARK}[ \t]*(.+)$"), 1)
    rows = items.select(F.col("id").alias("item_id"), F.explode(lines).alias("line"))
    parts = F.split("line", "—", 2)
    return rows.select("item_id", F.trim(parts[0]).alias("name"), F.trim(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))).alias("detail"))


def checklist_rollup(items: DataFrame) -> DataFrame:
    return checklist(items).groupBy("name").agg(F.count_distinct("item_id").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_set("item_id")), lambda x: x.cast("string")), ",").alias("ids"))


def without_checklist(insight: Column) -> Column:
    return F.trim(F.regexp_replace(insight, rf"(?m)^{CHECK_MARK}.*$\n?", ""))


def source_health(items: DataFrame, sources: DataFrame, now: str, late_days: int = 3) -> DataFrame:
    sums = items.groupBy("source").agg(F.count("*").alias("n"), F.max("published_at").alias("last_published"), F.max("collected_at").alias("last_collected"))
    rows = sums.join(F.broadcast(sources.select("source", "live")), "source", "left")
    live = F.coalesce("live", F.lit(False))
    return rows.select("source", "n", "last_published", "last_collected", live.alias("live"), (live & (F.datediff(F.to_timestamp(F.lit(now)), "last_published") > late_days)).alias("late"))


def issue_timeline(items: DataFrame, text: str, now: str, days: int = 60, page: int = 1, size: int = 50, texts: TextIndex | None = None) -> DataFrame:
    """Kept items with the literal text in the last 7 to 365 days up to now, oldest first, with their total.

    With an index of texts the items need no summaries."""
    days = min(max(days, 7), 365)
    at = F.to_timestamp(F.lit(now))
    rows = items.where("kept").where((F.col("published_at") <= at) & (F.col("published_at") >= at - F.make_dt_interval(F.lit(days))))
    if texts:
        rows = rows.join(texts.ids(text, rows), "id", "left_semi")
    else:
        rows = rows.where(F.col("title").contains(text) | F.col("summary").contains(text))
    total = rows.agg(F.count("*").alias("total"))
    part = rows.orderBy("published_at", "id").offset((page - 1) * size).limit(size)
    return part.select("id", "source", "published_at").crossJoin(F.broadcast(total))


def axes_of_items(item_axes: DataFrame) -> DataFrame:
    return axes_arrays(item_axes).select("item_id", F.array_join("axes", "+").alias("axes"))
