"""Queries of search and dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossweave.operators import explore as xp
from crossweave.operators import trend as tr
from crossweave.operators.keywords import is_org
from crossweave.plans.registry import query
from crossweave.plans.sql import sql
from crossweave.sources import adapter as ad

TEXT, KEYWORD, MONTH = "that", "that", "2024-03"

_FOUND = f"""found AS (SELECT i.* FROM items i WHERE kept AND CAST(published_at + INTERVAL 9 HOUR AS DATE) >= DATE '2024-01-10' AND CAST(published_at + INTERVAL 9 HOUR AS DATE) <= DATE '2024-03-10'
  AND i.id IN (SELECT item_id FROM item_axes WHERE axis = 'ai') AND (contains(title, '{TEXT}') OR contains(summary, '{TEXT}') OR i.id IN (SELECT item_id FROM kw_item WHERE keyword = '{TEXT}')))
"""


def _found_sql(body: str, *more: str) -> str:
    return sql("", "items", "item_axes", "kw_item", *more).rstrip() + "," + _FOUND + body


def _found(t):
    return xp.search_items(t.facts, t.item_axes, t.kw_item, TEXT, "ai", "2024-01-10", "2024-03-10", texts=t.texts)


@query("search_items", _found_sql("SELECT id FROM found"))
def search(t):
    return _found(t).select("id")


@query("search_total", _found_sql("SELECT count(*) AS total FROM found"))
def total(t):
    return xp.search_total(_found(t))


def _page_sql(order: str, size: int, offset: int) -> str:
    return _found_sql(f"SELECT CAST(row_number() OVER (ORDER BY {order}) AS INT) AS place, f.id, title, substring(summary, 1, 300) AS summary, source, published_at, cross_score, coalesce(a.axes, '') AS axes FROM found f LEFT JOIN axes_of a ON a.item_id = f.id ORDER BY place LIMIT {size} OFFSET {offset}", "axes_of")


@query("search_page", _page_sql("cross_score DESC NULLS LAST, published_at DESC NULLS LAST, f.id DESC", 25, 0))
def page(t):
    return xp.search_page(_found(t), t.item_axes, texts=t.texts)


@query("search_page_oldest", _page_sql("published_at ASC NULLS LAST, f.id ASC", 10, 10))
def oldest(t):
    """The second page, sought from the last row of the first."""
    found = _found(t)
    first = xp.search_page(found, t.item_axes, "oldest", 1, 10, t.texts)
    return xp.search_page(found, t.item_axes, "oldest", 2, 10, t.texts, xp.last_keys(first, "oldest"))


@query("keyword_items", sql(f"""SELECT CAST(row_number() OVER (ORDER BY kept DESC, cross_score DESC, published_at DESC, id DESC) AS INT) AS place, id, kept, cross_score, count(*) FILTER (kept) OVER () AS page_kept, total FROM (
  SELECT *, count(*) OVER () AS total FROM items WHERE id IN (SELECT item_id FROM kw_item WHERE keyword = '{KEYWORD}') ORDER BY kept DESC, cross_score DESC, published_at DESC, id DESC LIMIT 20)""", "items", "kw_item"))
def keyword_items(t):
    return xp.keyword_items(t.facts, t.kw_item, KEYWORD)


@query("related_items", sql("SELECT id, title, cross_score FROM items WHERE kept AND id <> 11 AND id IN (SELECT item_id FROM item_axes WHERE axis IN (SELECT axis FROM item_axes WHERE item_id = 11)) ORDER BY cross_score DESC, id LIMIT 8", "items", "item_axes"))
def related(t):
    return xp.related_items(t.facts, t.item_axes, 11)


@query("corpus_stats", sql("""SELECT count(*) AS total, count(*) FILTER (kept) AS kept, count(*) FILTER (coalesce(insight, '') <> '') AS annotated, count(*) FILTER (kept AND n_axes >= 3) AS wide, min(published_at) AS first_at, max(published_at) AS last_at,
  max(published_week) FILTER (kept) AS week, (SELECT count(*) FROM items WHERE kept AND published_week = (SELECT max(published_week) FROM items WHERE kept)) AS week_kept FROM items JOIN axis_n USING (id)""", "items", "axis_n"))
def stats(t):
    return xp.corpus_stats(t.facts, t.item_axes)


@query("source_counts", sql("SELECT source, count(*) AS n, count(*) FILTER (kept) AS kept FROM items GROUP BY source", "items"))
def source_counts(t):
    return xp.source_counts(t.facts)


@query("week_list", sql("SELECT published_week AS week, count(*) AS n, published_week IN (SELECT week FROM digests) AS saved FROM items WHERE kept AND published_week <= '2024-W11' GROUP BY published_week", "items", "digests"))
def weeks(t):
    return xp.week_list(t.facts, t.digests, "2024-W11")


@query("month_tree", sql("""SELECT month, CAST(sum(n) AS BIGINT) AS n, string_agg(week || ':' || n, ',' ORDER BY week DESC) AS weeks, month = '2024-02' AS review FROM (SELECT published_week AS week, strftime(date_trunc('week', min(published_at)) + INTERVAL 3 DAY, '%Y-%m') AS month, count(*) AS n FROM items WHERE kept GROUP BY 1) GROUP BY month""", "items"))
def months(t):
    n = xp.week_list(t.facts, t.digests)
    return xp.month_tree(n.select("week", "n"), t.spark.createDataFrame([("2024-02",)], "period string"))


_MONTH = "in_month AS (SELECT *, strftime(date_trunc('week', published_at) + INTERVAL 3 DAY, '%Y-%m') AS month FROM items WHERE kept)\n"


@query("month_view", sql("", "items").rstrip() + "," + _MONTH + f"SELECT count(*) FILTER (month = '{MONTH}') AS kept, count(*) FILTER (month = '2024-02') AS before, CASE WHEN count(*) FILTER (month = '2024-02') > 0 THEN count(*) FILTER (month = '{MONTH}') - count(*) FILTER (month = '2024-02') END AS delta FROM in_month")
def month(t):
    return xp.month_totals(t.facts, MONTH)


@query("month_view_axes", sql("", "items", "item_axes").rstrip() + "," + _MONTH + f"SELECT axis, count(DISTINCT id) AS n FROM in_month JOIN item_axes ON item_id = id WHERE month = '{MONTH}' GROUP BY axis")
def month_axes(t):
    return xp.month_axes(t.facts, t.item_axes, MONTH)


@query("month_view_top", sql("", "items").rstrip() + "," + _MONTH + f"SELECT id, title, cross_score FROM in_month WHERE month = '{MONTH}' ORDER BY cross_score DESC, id DESC LIMIT 8")
def month_top(t):
    return xp.month_top(t.facts, MONTH)


@query("cross_items", sql("SELECT i.id, title, published_week, cross_score, axes AS combo FROM items i JOIN axes_of a ON a.item_id = i.id JOIN weeks ON week = published_week WHERE kept AND a.n = 2 ORDER BY cross_score DESC, published_at DESC, i.id DESC LIMIT 60", "items", "axes_of", "weeks"))
def cross(t):
    return xp.cross_items(t.facts, t.item_axes, t.weeks, 2)


@query("cross_combos", sql("SELECT axes AS combo, count(*) AS n FROM items i JOIN axes_of a ON a.item_id = i.id JOIN weeks ON week = published_week WHERE kept AND a.n >= 2 GROUP BY axes", "items", "axes_of", "weeks"))
def combos(t):
    return xp.cross_combos(t.facts, t.item_axes, t.weeks)


@query("cross_weeks", sql("SELECT w.week, count(i.id) AS n FROM weeks w LEFT JOIN (SELECT i.id, published_week FROM items i JOIN axes_of a ON a.item_id = i.id WHERE kept AND a.n = 3) i ON i.published_week = w.week GROUP BY w.week", "items", "axes_of", "weeks"))
def cross_weeks(t):
    return xp.cross_weeks(t.facts, t.item_axes, t.weeks, 3).select("week", "n")


_ORGS = """org_weeks AS (SELECT keyword, week, n FROM kw_week JOIN weeks USING (week) WHERE length(keyword) >= 5 AND (keyword LIKE '%tion' OR keyword LIKE '%ment')),
totals AS (SELECT keyword, CAST(sum(n) AS BIGINT) AS total, count(*) AS weeks, string_agg(week || ':' || n, ',' ORDER BY week) AS series FROM org_weeks GROUP BY keyword),
orgs AS (SELECT * FROM totals c WHERE total >= 3 AND weeks >= 2 AND NOT EXISTS (SELECT 1 FROM totals o WHERE o.keyword <> c.keyword AND contains(o.keyword, c.keyword) AND o.total >= 0.9::DOUBLE * c.total) ORDER BY weeks DESC, total DESC, keyword LIMIT 40)
"""


def _orgs(t):
    return xp.recurring(t.kw_week, t.weeks, is_org("keyword", ad.ORG_ENDINGS), tr.fragments)


@query("recurring_orgs", sql("", "kw_week", "weeks").rstrip() + "," + _ORGS + "SELECT keyword, total, weeks, series FROM orgs")
def recurring(t):
    return _orgs(t)


@query("org_week_items", sql("SELECT *, count(*) OVER () AS total FROM (SELECT id, title, cross_score, published_at FROM items WHERE kept AND published_week = '2024-W12' AND id IN (SELECT item_id FROM kw_item WHERE keyword = 'tion')) ORDER BY cross_score DESC, published_at, id LIMIT 20", "items", "kw_item"))
def org_week(t):
    return xp.keyword_week_items(t.facts, t.kw_item, "tion", ad.WEEK)


@query("regulatory_items", sql("SELECT id, published_at FROM items WHERE source = 'src0' AND published_at >= TIMESTAMP '2024-03-20' - INTERVAL 30 DAY AND (contains(lower(title), 'the') OR contains(lower(summary), 'the')) ORDER BY published_at DESC, id DESC LIMIT 100", "items"))
def regulatory(t):
    return xp.regulatory_items(t.facts, t.sources, 30, "The", ad.NOW, texts=t.texts).select("id", "published_at")


@query("checklist_rollup", sql("SELECT source AS name, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM items WHERE id % 7 = 0 GROUP BY source", "items"))
def checklist(t):
    return xp.checklist_rollup(t.facts)


@query("checklist_removed", sql("SELECT id, CASE WHEN insight IS NOT NULL THEN 'note' END AS insight FROM items", "items"))
def removed(t):
    return t.facts.select("id", xp.without_checklist(F.col("insight")).alias("insight"))


@query("source_health", sql("SELECT source, count(*) AS n, max(published_at) AS last_published, max(collected_at) AS last_collected, live, live AND date_diff('day', max(published_at), TIMESTAMP '2024-03-28') > 3 AS late FROM items JOIN sources USING (source) GROUP BY source, live", "items", "sources"))
def health(t):
    return xp.source_health(t.facts, t.sources, "2024-03-28 00:00:00")


@query("issue_timeline", sql(f"SELECT *, count(*) OVER () AS total FROM (SELECT id, source, published_at FROM items WHERE kept AND published_at <= TIMESTAMP '2024-03-20' AND published_at >= TIMESTAMP '2024-03-20' - INTERVAL 60 DAY AND (contains(title, '{TEXT}') OR contains(summary, '{TEXT}'))) ORDER BY published_at, id LIMIT 50", "items"))
def timeline(t):
    return xp.issue_timeline(t.facts, TEXT, ad.NOW, texts=t.texts)


@query("axes_of_items", sql("SELECT item_id, axes FROM axes_of", "axes_of"))
def axes_of(t):
    return xp.axes_of_items(t.item_axes)


@query("axis_dimension", sql("SELECT axis, CASE axis WHEN 'ai' THEN 'AI' WHEN 'bigdata' THEN 'Data' ELSE 'Shops' END AS label, count(*) AS items FROM item_axes GROUP BY axis", "item_axes"))
def dimension(t):
    names = t.spark.createDataFrame(list(ad.LABELS.items()), "axis string, label string")
    return t.item_axes.groupBy("axis").agg(F.count("*").alias("items")).join(F.broadcast(names), "axis").select("axis", "label", "items")
