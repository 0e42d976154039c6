"""Queries of digests and period reviews."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from crossweave.functions.dates import week_label
from crossweave.functions.text import grams2
from crossweave.operators import digest as dg
from crossweave.operators import periods as pe
from crossweave.operators import trend as tr
from crossweave.plans.registry import query
from crossweave.plans.sql import sql
from crossweave.sources import adapter as ad

PERIODS = ["2024-02", "2024-03", "2024-W10", "2024-W12", "2024-W54", "2024-13"]
TITLE_CUT = 0.9

_POOL = """pool AS (SELECT *, published_week AS week, source = 'src0' AS regulatory, row_number() OVER (PARTITION BY published_week ORDER BY kept DESC, CASE WHEN kept THEN cross_score END DESC NULLS LAST, CASE WHEN kept THEN relevance END DESC NULLS LAST, CASE WHEN NOT kept THEN published_at END DESC NULLS LAST, id) AS place
  FROM (SELECT i.*, r.relevance FROM items i LEFT JOIN relevance r USING (id)) WHERE kept OR source = 'src0')
"""


def _pool_sql(body: str) -> str:
    return sql("", "items", "relevance").rstrip() + "," + _POOL + body


def _pool(t):
    return dg.digest_pool(t.ranked_items, t.sources)


@query("digest_pool", _pool_sql("SELECT week, CAST(place AS INT) AS place, id, regulatory FROM pool"))
def pool(t):
    return _pool(t).select("week", F.col("place").cast("int").alias("place"), "id", "regulatory")


@query("digest_regulatory", _pool_sql("SELECT week, CAST(rank AS INT) AS rank, id, title FROM (SELECT *, row_number() OVER (PARTITION BY week ORDER BY place) AS rank FROM pool WHERE regulatory) WHERE rank <= 5"))
def regulatory(t):
    return dg.digest_regulatory(_pool(t))


_GRAMS = r"""grams AS (SELECT id, published_week AS week, list_sort(list_distinct(list_transform(range(1, length(s)), lambda i: substring(s, i, 2)))) AS g FROM (SELECT id, published_week, regexp_replace(title, '[^\p{L}\p{N}]', '', 'g') AS s FROM base))
"""


@query("title_bigrams", sql("", "base").rstrip() + "," + _GRAMS + "SELECT id, array_to_string(g, ',') AS grams FROM grams")
def bigrams(t):
    return t.base.select("id", F.array_join(F.sort_array(grams2("title")), ",").alias("grams"))


@query("title_containment", sql("", "base").rstrip() + "," + _GRAMS + f"SELECT x.week, x.id AS a, y.id AS b FROM grams x JOIN grams y ON x.week = y.week AND x.id < y.id WHERE len(x.g) >= 4 AND len(y.g) >= 4 AND len(list_intersect(x.g, y.g)) / least(len(x.g), len(y.g)) >= {dg.CUT}")
def containment(t):
    """All pairs of titles that the reference takes for one event."""
    return dg.title_pairs(t.base.select(F.col("published_week").alias("week"), "id", "title"))


_CLASSES = "kinds AS (SELECT week, g, min(id) AS rep FROM (SELECT week, id, list_sort(g) AS g FROM grams WHERE len(g) >= 4) GROUP BY week, g)\n"


@query("title_classes", sql("", "base").rstrip() + "," + _GRAMS.rstrip() + "," + _CLASSES + f"SELECT 'same' AS kind, k.week, k.rep AS a, x.id AS b FROM kinds k JOIN grams x ON x.week = k.week AND list_sort(x.g) = k.g UNION ALL SELECT 'close', x.week, least(x.rep, y.rep), greatest(x.rep, y.rep) FROM kinds x JOIN kinds y ON x.week = y.week AND x.rep < y.rep WHERE len(list_intersect(x.g, y.g)) / least(len(x.g), len(y.g)) >= {TITLE_CUT}")
def classes(t):
    """Each title's class, and the close pairs of classes."""
    members, close = dg.title_classes(t.base.select(F.col("published_week").alias("week"), "id", "title"), TITLE_CUT)
    return members.select(F.lit("same").alias("kind"), "week", F.col("rep").alias("a"), F.col("id").alias("b")).union(close.select(F.lit("close"), "week", "a", "b"))


@query("digest_crossing")
def crossing(t):
    return dg.digest_sections(_pool(t), t.item_axes, [], cut=TITLE_CUT)


@query("digest_by_axis")
def by_axis(t):
    found = dg.digest_sections(_pool(t), t.item_axes, list(ad.AXES), cut=TITLE_CUT)
    return found.where("section <> 'crossing'")


@query("digest_trending", sql("SELECT keyword, n FROM rising ORDER BY round(score, 2) DESC, n DESC, keyword LIMIT 15", "rising"))
def trending(t):
    return tr.top_rising(t.rising, 15).select("keyword", "n")


@query("digest_upsert", sql("SELECT coalesce(d.week, n.week) AS week, d.lead, CASE WHEN d.week IS NULL THEN NULL ELSE 'kept' END AS tasks, CAST(n.n AS VARCHAR) AS total_kept FROM (SELECT published_week AS week, count(*) AS n FROM items WHERE kept GROUP BY 1) n FULL JOIN digests d ON d.week = n.week", "items", "digests"))
def upsert(t):
    n = t.facts.where("kept").groupBy(F.col("published_week").alias("week")).agg(F.count("*").alias("n"))
    new = n.select("week", F.create_map(F.lit("total_kept"), F.col("n").cast("string")).alias("body"))
    return dg.digest_upsert(t.digests, new).select("week", "lead", F.try_element_at("body", F.lit("tasks")).alias("tasks"), F.try_element_at("body", F.lit("total_kept")).alias("total_kept"))


@query("week_label", sql("SELECT DISTINCT published_week AS week, strftime(thursday, '%Y년 %-m월 ') || ((day(thursday) - 1) // 7 + 1) || '주차' AS label FROM (SELECT published_week, date_trunc('week', published_at) + INTERVAL 3 DAY AS thursday FROM base)", "base"))
def labels(t):
    return t.base.select(F.col("published_week").alias("week")).distinct().select("week", week_label("week").alias("label"))


@query("humanize_weeks")
def humanize(t):
    rows = t.base.select("id", F.concat(F.lit("between W"), F.weekofyear("published_at"), F.lit(" and "), "published_week", F.lit(", not W60")).alias("text"))
    return dg.humanize_weeks(rows, 2024)


_WINDOWS = """win AS (SELECT * FROM (VALUES
  ('2024-02', TIMESTAMP '2024-01-31 15:00:00', TIMESTAMP '2024-02-29 15:00:00', TIMESTAMP '2024-02-29 15:00:00', TIMESTAMP '2023-12-31 15:00:00', TIMESTAMP '2024-01-31 15:00:00', 'closed'),
  ('2024-03', TIMESTAMP '2024-02-29 15:00:00', TIMESTAMP '2024-03-31 15:00:00', TIMESTAMP '2024-03-20 00:00:00', TIMESTAMP '2024-01-31 15:00:00', TIMESTAMP '2024-02-20 00:00:00', 'in_progress'),
  ('2024-W10', TIMESTAMP '2024-03-03 15:00:00', TIMESTAMP '2024-03-10 15:00:00', TIMESTAMP '2024-03-10 15:00:00', TIMESTAMP '2024-02-25 15:00:00', TIMESTAMP '2024-03-03 15:00:00', 'closed'),
  ('2024-W12', TIMESTAMP '2024-03-17 15:00:00', TIMESTAMP '2024-03-24 15:00:00', TIMESTAMP '2024-03-20 00:00:00', TIMESTAMP '2024-03-10 15:00:00', TIMESTAMP '2024-03-13 00:00:00', 'in_progress')) v(period, "start", stop, cutoff, prev_start, prev_end, status)),
marked AS (SELECT i.*, w.period, published_at >= w."start" AND published_at < cutoff AS cur, published_at >= prev_start AND published_at < prev_end AS bef FROM items i, win w WHERE kept)
"""


def _window_sql(body: str, *more: str) -> str:
    return sql("", "items", *more).rstrip() + "," + _WINDOWS + body


def _windows(t):
    """The periods asked for, of which only those that the corpus reaches matter."""
    return pe.period_window(t.spark, PERIODS, ad.NOW)


@query("period_window", _window_sql('SELECT w.period, w."start", w.stop AS "end", w.cutoff, w.prev_start, w.prev_end, w.status, count(*) FILTER (cur) AS n FROM win w JOIN marked m ON m.period = w.period GROUP BY ALL'))
def window(t):
    w = _windows(t)
    return w.join(pe.period_totals(t.facts, w).select("period", F.col("current").alias("n")), "period")


@query("period_observations", _window_sql("SELECT period, count(*) FILTER (cur) AS current, count(*) FILTER (bef) AS before, max(published_at) FILTER (cur) AS latest FROM marked GROUP BY period"))
def observations(t):
    return pe.period_totals(t.facts, _windows(t))


@query("period_days", _window_sql("SELECT period, CAST(published_at + INTERVAL 9 HOUR AS DATE) AS day, count(*) AS n FROM marked WHERE cur GROUP BY 1, 2"))
def days(t):
    return pe.period_days(t.facts, _windows(t))


@query("period_axis_compare", _window_sql("""SELECT a.period, a.axis, a.current, a.before, CASE WHEN t > 0 THEN current / t ELSE 0.0::DOUBLE END AS share, CASE WHEN b > 0 THEN before / b END AS prev_share FROM (SELECT period, axis, count(*) FILTER (cur) AS current, count(*) FILTER (bef) AS before FROM marked JOIN item_axes ON item_id = id WHERE cur OR bef GROUP BY 1, 2) a
JOIN (SELECT period AS p, count(*) FILTER (cur) AS t, count(*) FILTER (bef) AS b FROM marked GROUP BY 1) x ON p = period""", "item_axes"))
def compare(t):
    return pe.axis_compare(t.facts, t.item_axes, _windows(t))


@query("period_top_articles", _window_sql("SELECT period, CAST(place AS INT) AS place, id, title, url, substring(summary, 1, 500) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY coalesce(cross_score, 0) DESC, published_at DESC, id DESC) AS place FROM marked WHERE cur) WHERE place <= 30"))
def articles(t):
    return pe.period_top(t.items, _windows(t))


def _editorial(t):
    """A text for each month of the corpus, citing two of its items; odd months are signed off."""
    month = F.date_format(pe.local_date("published_at"), "yyyy-MM")
    rows = t.facts.where("kept").select(month.alias("period"), F.col("id").cast("long").alias("id"), "title", "url")
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("period").orderBy("id", "title", "url"))).where("r <= 2")
    cited = rows.groupBy("period").agg(F.sort_array(F.collect_list(F.struct("id", "title", "url"))).alias("sources"))
    ids = F.transform("sources", lambda s: s["id"])
    sections = F.array(F.struct(F.lit("one").alias("title"), F.when(F.col("period") == "2024-02", F.array(F.lit(-1).cast("long"))).otherwise(ids).alias("source_ids")))
    tasks = F.array(F.struct(F.lit("check").alias("title"), ids.alias("source_ids")))
    return cited.select("period", F.when(F.col("period") != "2024-01", F.concat("period", F.lit("-20T00:00:00Z"))).otherwise("2023-01-01T00:00:00Z").alias("as_of"), (F.substring("period", 7, 1).cast("int") % 2 == 1).alias("final"), F.concat(F.lit("text of "), "period").alias("summary"), "sources", sections.alias("sections"), tasks.alias("tasks"))


@query("period_status", _window_sql("SELECT period, status FROM win"))
def status(t):
    return pe.period_status(_windows(t), _editorial(t))


@query("available_periods", sql("""SELECT DISTINCT * FROM (SELECT strftime(d, '%G-W%V') AS period, 'week' AS kind FROM (SELECT DATE '2024-03-18' - to_days(CAST(7 * k AS INT)) AS d FROM range(104) r(k)) WHERE d + INTERVAL 7 DAY > (SELECT CAST(min(published_at) + INTERVAL 9 HOUR AS DATE) FROM items WHERE kept) AND strftime(d, '%G-W%V') <= '2024-W11'
  UNION ALL SELECT strftime(d, '%Y-%m'), 'month' FROM (SELECT DATE '2024-03-01' - to_months(CAST(k AS INT)) AS d FROM range(24) r(k)) WHERE d + INTERVAL 1 MONTH > (SELECT CAST(min(published_at) + INTERVAL 9 HOUR AS DATE) FROM items WHERE kept)
  UNION ALL SELECT week, 'week' FROM digests WHERE week <= '2024-W11')""", "items", "digests"))
def available(t):
    return pe.available_periods(t.facts, _editorial(t), t.digests, ad.NOW, "2024-W11")


@query("editorial_precedence", sql("SELECT DISTINCT period, CASE WHEN period LIKE '%-W%' THEN CASE WHEN period IN (SELECT week FROM digests) THEN CASE WHEN period = '2024-W06' THEN 'snapshot' ELSE 'lead' END ELSE 'none' END ELSE 'authored' END AS origin FROM (SELECT published_week AS period FROM items WHERE kept UNION ALL SELECT strftime(published_at + INTERVAL 9 HOUR, '%Y-%m') FROM items WHERE kept)", "items", "digests"))
def precedence(t):
    weeks = t.facts.where("kept").select(F.col("published_week").alias("period")).distinct()
    texts = _editorial(t)
    snapshots = t.digests.where("week in ('2024-W06', '2024-W08')").select(F.col("week").alias("period"), F.when(F.col("week") == "2024-W06", F.col("week")).otherwise("2024-W01").alias("body_period"), F.lit("snap").alias("summary"))
    return pe.editorial_precedence(weeks.union(texts.select("period")), texts, snapshots, t.digests).select("period", "origin")


@query("editorial_validation", sql("SELECT DISTINCT m AS period, rule FROM (SELECT strftime(published_at + INTERVAL 9 HOUR, '%Y-%m') AS m FROM items WHERE kept), (VALUES ('2024-01', 'as_of'), ('2024-01', 'final_day'), ('2024-02', 'reference'), ('2024-03', 'final_day')) v(p, rule) WHERE m = p", "items"))
def validation(t):
    return pe.editorial_violations(_editorial(t), pe.period_window(t.spark, ["2024-01", "2024-02", "2024-03"], ad.NOW))


@query("task_candidates", sql("SELECT period || ':check' AS task_key, period, 'check' AS title, 'editorial' AS origin, CAST(least(2, count(*)) AS INT) AS n_sources FROM (SELECT strftime(published_at + INTERVAL 9 HOUR, '%Y-%m') AS period FROM items WHERE kept) GROUP BY period UNION ALL SELECT week || ':look', week, 'look', 'digest', 0 FROM digests", "items", "digests"))
def tasks(t):
    d = t.digests.select("week", F.array(F.struct(F.lit("look").alias("title"), F.array().cast("array<bigint>").alias("source_ids"))).alias("tasks"))
    return pe.task_candidates(d, _editorial(t))


_MONTHS = "rows_of AS (SELECT *, strftime(published_at + INTERVAL 9 HOUR, '%Y-%m') AS month FROM items),\nrep AS (SELECT r.month, a.axis, count(DISTINCT r.id) AS n, x.kept, x.total, x.regulatory FROM rows_of r JOIN item_axes a ON a.item_id = r.id JOIN (SELECT month AS m, count(*) FILTER (kept) AS kept, count(*) AS total, count(*) FILTER (source = 'src0') AS regulatory FROM rows_of GROUP BY 1) x ON x.m = r.month WHERE r.kept AND r.month IN ('2024-02', '2024-03') GROUP BY ALL)\n"


@query("month_report", sql("", "items", "item_axes").rstrip() + "," + _MONTHS + "SELECT month, axis, n, kept, total, regulatory FROM rep")
def month_report(t):
    return pe.month_report(t.facts, t.item_axes, t.sources, ["2024-02", "2024-03"])


@query("month_axis_delta", sql("", "items", "item_axes").rstrip() + "," + _MONTHS + "SELECT x.axis, 100.0::DOUBLE * x.n / x.kept - 100.0::DOUBLE * y.n / y.kept AS delta FROM rep x LEFT JOIN rep y ON y.axis = x.axis AND y.month = '2024-02' WHERE x.month = '2024-03'")
def month_delta(t):
    return pe.month_axis_delta(month_report(t), "2024-03", "2024-02")


@query("report_months", sql("SELECT DISTINCT strftime(date_trunc('week', published_at) + INTERVAL 3 DAY, '%Y-%m') AS month FROM items WHERE kept", "items"))
def report_months(t):
    return pe.report_months(t.facts)


@query("review_material", _window_sql("SELECT period, total, CAST(place AS INT) AS place, id FROM (SELECT period, count(*) OVER (PARTITION BY period) AS total, row_number() OVER (PARTITION BY period ORDER BY coalesce(cross_score, 0) DESC, id) AS place, id FROM marked WHERE cur) WHERE place <= 20"))
def material(t):
    return pe.review_material(t.facts, _windows(t))
