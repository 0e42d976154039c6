"""Queries of alerts, evaluation, material, integrity and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossweave.functions.components import settle
from crossweave.operators import alerts as al
from crossweave.operators import evaluate as ev
from crossweave.operators import explore as xp
from crossweave.operators import material as ma
from crossweave.operators import quality as qu
from crossweave.plans.registry import query
from crossweave.plans.sql import sql
from crossweave.sources import adapter as ad
from crossweave.streaming import streams as st

#: Tasks that write a part of a replayed table.
FILES = 4
WATCH = ["th_t", "thing", "nosuchword", "ation"]

_HITS = "hits AS (SELECT keyword, place, id, title FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY published_at DESC, id DESC) AS place FROM items, (VALUES " + ", ".join(f"('{k}')" for k in WATCH) + ") k(keyword) WHERE published_at >= TIMESTAMP '2024-03-20' - INTERVAL 7 DAY AND published_at <= TIMESTAMP '2024-03-20' AND (kept OR source = 'src0') AND (title ILIKE '%' || keyword || '%' OR summary ILIKE '%' || keyword || '%')) WHERE place <= 20)\n"


def _hits_sql(body: str) -> str:
    return sql("", "items").rstrip() + "," + _HITS + body


def _hits(t, seen=None):
    return al.alert_hits(t.base, t.sources, WATCH, ad.NOW, 7, seen, t.facts)


def _seen(t):
    return t.base.where("id % 3 = 0").select("id")


@query("alert_hits", _hits_sql("SELECT keyword, CAST(place AS INT) AS place, id, title FROM hits WHERE id % 3 <> 0"))
def alert_hits(t):
    return _hits(t, _seen(t))


@query("alert_state", _hits_sql("SELECT id FROM (SELECT id FROM items WHERE id % 3 = 0 UNION SELECT id FROM hits) ORDER BY id DESC LIMIT 300"))
def alert_state(t):
    return al.alert_state(_seen(t), _hits(t), 300)


@query("alert_summary", _hits_sql("SELECT keyword, count(*) AS n, (SELECT count(DISTINCT id) FROM hits) AS total FROM hits GROUP BY keyword"))
def alert_summary(t):
    return al.alert_summary(_hits(t))


@query("watch_hits", _hits_sql("SELECT keyword, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY place) AS ids FROM hits GROUP BY keyword"))
def watch_hits(t):
    return al.watch_groups(_hits(t))


@query("label_sample", sql("SELECT id, kept, coalesce(axes, '') AS axes FROM (SELECT id, kept, row_number() OVER (PARTITION BY kept ORDER BY md5('0:' || id), id) AS place FROM items) LEFT JOIN axes_of ON item_id = id WHERE place <= 25", "items", "axes_of"))
def label_sample(t):
    return ev.label_sample(t.facts, t.item_axes, 50)


@query("label_refresh", sql("SELECT l.doc_id AS id, l.quality AS label, i.kept, i.kept <> (l.toxic = 1) AS changed FROM labels l JOIN items i ON i.id = l.doc_id", "items"))
def label_refresh(t):
    rows = t.raw("labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), (F.col("toxic") == 1).alias("kept"))
    return ev.label_refresh(rows, t.facts)


def _measures(n: str = "kept") -> str:
    tp, fp, fn, tn = (f"count(*) FILTER (label = {a} AND {b}{n})" for a, b in ((1, ""), (0, ""), (1, "NOT "), (0, "NOT ")))
    return f"{tp} AS tp, {fp} AS fp, {fn} AS fn, {tn} AS tn, coalesce({tp} / nullif({tp} + {fp}, 0), 0.0::DOUBLE) AS precision, coalesce({tp} / nullif({tp} + {fn}, 0), 0.0::DOUBLE) AS recall, coalesce(2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0.0::DOUBLE) AS f1"


@query("confusion_matrix", sql(f"SELECT {_measures()} FROM labelled WHERE label IN (0, 1)", "labelled"))
def confusion(t):
    return ev.confusion_matrix(t.labels)


GRID = [-0.2, -0.1, -0.05, 0.0, 0.05, 0.1, 0.2]


_RATED = "rated AS (SELECT g AS threshold, label, relevance >= g AS d FROM labelled JOIN relevance USING (id), unnest([" + ", ".join(f"{g}::DOUBLE" for g in GRID) + "]) u(g) WHERE label IN (0, 1))\n"


@query("threshold_pr", sql("", "labelled", "relevance").rstrip() + "," + _RATED + "SELECT threshold, count(*) FILTER (d) AS passed, coalesce(count(*) FILTER (label = 1 AND d) / nullif(count(*) FILTER (d), 0), 0.0::DOUBLE) AS precision, coalesce(count(*) FILTER (label = 1 AND d) / nullif(count(*) FILTER (label = 1), 0), 0.0::DOUBLE) AS recall FROM rated GROUP BY threshold")
def threshold_pr(t):
    return ev.threshold_pr(t.labels, t.relevance, GRID)


@query("error_cases", sql("SELECT kind, CAST(place AS INT) AS place, id FROM (SELECT l.id, CASE WHEN kept THEN 'false positive' ELSE 'false negative' END AS kind, row_number() OVER (PARTITION BY kept ORDER BY relevance DESC NULLS LAST, l.id) AS place FROM labelled l LEFT JOIN relevance r USING (id) WHERE label IN (0, 1) AND (label = 1) <> kept) WHERE place <= 10", "labelled", "relevance"))
def errors(t):
    return ev.error_cases(t.labels, t.relevance)


@query("stratified_folds", sql("SELECT id, label, CAST(row_number() OVER (PARTITION BY label ORDER BY md5('0:' || id), id) % 2 AS INT) AS fold FROM labelled", "labelled"))
def folds(t):
    return ev.stratified_folds(t.labels)


@query("majority_vote", sql("SELECT id, count(*) FILTER ((id * 7 + s * 5) % 3 = 0) AS votes, 5 AS runs, count(*) FILTER ((id * 7 + s * 5) % 3 = 0) * 2 > 5 AS decision FROM labelled, range(5) r(s) GROUP BY id", "labelled"))
def vote(t):
    votes = t.labels.select("id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("s")).select("id", ((F.col("id") * 7 + F.col("s") * 5) % 3 == 0).alias("vote"))
    return ev.majority_vote(votes)


_RUNS = "runs AS (SELECT fold, " + _measures() + " FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('0:' || id), id) % 5 AS fold FROM labelled WHERE label IN (0, 1)) GROUP BY fold)\n"


@query("metric_spread", sql("", "labelled").rstrip() + "," + _RUNS + "SELECT 'precision' AS metric, avg(precision) AS mean, min(precision) AS least, max(precision) AS most FROM runs UNION ALL SELECT 'recall', avg(recall), min(recall), max(recall) FROM runs")
def spread(t):
    dealt = ev.stratified_folds(t.labels.where("label in (0, 1)"), 5).join(t.labels.select("id", "kept"), "id")
    return ev.metric_spread(dealt.groupBy("fold").agg(*ev.measures(F.col("label"), F.col("kept"))))


@query("metrics_by_bucket", sql(f"SELECT CASE WHEN n_axes >= 2 THEN 'several' WHEN n_axes = 1 THEN 'one' ELSE 'none' END AS bucket, count(*) AS n, avg(CAST(label AS DOUBLE)) AS base_rate, {_measures()} FROM labelled JOIN axis_n USING (id) WHERE label IN (0, 1) GROUP BY 1", "labelled", "axis_n"))
def buckets(t):
    return ev.metrics_by_bucket(t.labels, t.item_axes)


@query("relevance_by_axes", sql("SELECT n_axes, count(*) AS n, avg(CAST(label AS DOUBLE)) AS rate FROM labelled JOIN axis_n USING (id) WHERE label IN (0, 1) GROUP BY n_axes", "labelled", "axis_n"))
def by_axes(t):
    return ev.relevance_by_axes(t.labels, t.item_axes)


@query("annotation_backlog", sql("SELECT id, title FROM items LEFT JOIN relevance USING (id) WHERE kept AND coalesce(insight_model, '') <> 'manual' AND (insight IS NULL OR coalesce(insight_model, '') <> 'm2') ORDER BY cross_score DESC NULLS LAST, relevance DESC NULLS LAST, id LIMIT 300", "items", "relevance"))
def backlog(t):
    return ma.annotation_backlog(t.ranked_items, t.sources, "m2")


@query("annotation_backlog_regulatory", sql("SELECT id, title FROM items WHERE source = 'src0' AND coalesce(insight_model, '') <> 'manual' AND (insight IS NULL OR coalesce(insight_model, '') <> 'm1') ORDER BY published_at DESC, id DESC LIMIT 300", "items"))
def backlog_regulatory(t):
    return ma.annotation_backlog(t.facts, t.sources, "m1", True)


@query("week_highlights", sql("SELECT i.id, title, cross_score, coalesce(axes, '') AS axes FROM items i LEFT JOIN axes_of a ON a.item_id = i.id WHERE kept AND published_week = '2024-W12' ORDER BY cross_score DESC, i.id LIMIT 15", "items", "axes_of"))
def highlights(t):
    return ma.week_highlights(t.facts, t.item_axes, ad.WEEK)


@query("week_crossed_material", sql("", "items", "axis_n").rstrip() + ", best AS (SELECT id, cross_score FROM items WHERE kept AND published_week = '2024-W12' ORDER BY cross_score DESC, id LIMIT 40), crossed AS (SELECT id, cross_score FROM best JOIN axis_n USING (id) WHERE n_axes >= 2), reg AS (SELECT id FROM items WHERE source = 'src0' AND published_week = '2024-W12')\nSELECT * FROM (SELECT 'crossed' AS kind, id FROM (SELECT id FROM crossed ORDER BY cross_score DESC, id LIMIT 20) UNION ALL SELECT 'regulatory', id FROM reg) WHERE (SELECT count(*) FROM crossed) >= 3 OR (SELECT count(*) FROM reg) > 0")
def crossed(t):
    return ma.week_crossed_material(t.facts, t.item_axes, t.sources, ad.WEEK)


@query("org_recent_titles", sql("", "kw_week", "kw_item", "items").rstrip() + """, chosen AS (SELECT keyword FROM kw_week WHERE length(keyword) >= 5 AND (keyword LIKE '%tion' OR keyword LIKE '%ment') GROUP BY keyword HAVING sum(n) >= 5),
active AS (SELECT keyword, week FROM (SELECT keyword, week, row_number() OVER (PARTITION BY keyword ORDER BY week DESC) AS r FROM kw_week WHERE keyword IN (SELECT keyword FROM chosen)) WHERE r <= 2)
SELECT keyword, week, CAST(place AS INT) AS place, id FROM (SELECT a.keyword, a.week, i.id, row_number() OVER (PARTITION BY a.keyword, a.week ORDER BY cross_score DESC, published_at, i.id) AS place FROM active a JOIN kw_item k ON k.keyword = a.keyword JOIN items i ON i.id = k.item_id AND i.published_week = a.week WHERE i.kept) WHERE place <= 3""")
def recent(t):
    chosen = t.kw_week.where(t.is_org()).groupBy("keyword").agg(F.sum("n").alias("n")).where("n >= 5")
    return ma.recent_titles(chosen, t.kw_week, t.kw_item, t.facts)


@query("month_material", sql("", "items", "digests").rstrip() + """, rows_of AS (SELECT *, strftime(date_trunc('week', published_at) + INTERVAL 3 DAY, '%Y-%m') AS month FROM items)
SELECT kind, CAST(place AS INT) AS place, ref FROM (SELECT 'lead' AS kind, row_number() OVER (ORDER BY week) AS place, week AS ref FROM digests WHERE week IN (SELECT published_week FROM rows_of WHERE month = '2024-03')
UNION ALL SELECT 'item', row_number() OVER (ORDER BY cross_score DESC, id), CAST(id AS VARCHAR) FROM (SELECT * FROM rows_of WHERE month = '2024-03' AND kept ORDER BY cross_score DESC, id LIMIT 30)
UNION ALL SELECT 'regulatory', row_number() OVER (ORDER BY published_at DESC, id DESC), CAST(id AS VARCHAR) FROM (SELECT * FROM rows_of WHERE month = '2024-03' AND source = 'src0' ORDER BY published_at DESC, id DESC LIMIT 10))""")
def month_material(t):
    return ma.month_material(t.facts, t.sources, t.digests, "2024-03")


@query("annotation_outcomes", sql("SELECT id, CASE id % 3 WHEN 0 THEN insight WHEN 1 THEN '' ELSE 'new' END AS insight, CASE id % 3 WHEN 0 THEN insight_model ELSE 'm3' END AS insight_model FROM items", "items"))
def outcomes(t):
    results = t.base.select("id", F.when(F.col("id") % 3 == 1, "").when(F.col("id") % 3 == 2, "new").alias("result"))
    return ma.annotation_outcomes(t.facts, results, "m3", ad.NOW).select("id", "insight", "insight_model")


@query("source_ref_integrity", sql("SELECT 'p' AS period, id AS ref_id, 'url' AS problem FROM items WHERE id % 5 = 0 UNION ALL SELECT 'p', -1 - id, 'missing' FROM items WHERE id % 11 = 0", "items"))
def integrity(t):
    cited = t.base.select(F.lit("p").alias("period"), F.col("id").alias("ref_id"), F.when(F.col("id") % 5 == 0, "http://other").otherwise(F.col("url")).alias("url"))
    gone = t.base.where("id % 11 = 0").select(F.lit("p"), -1 - F.col("id"), "url")
    return qu.source_ref_integrity(cited.union(gone), t.base)


@query("search_parity", sql("SELECT 'second' AS side, id FROM items WHERE kept AND NOT (contains(title, 'that') OR contains(summary, 'that')) AND id IN (SELECT item_id FROM kw_item WHERE keyword = 'that')", "items", "kw_item"))
def parity(t):
    """A search of titles and summaries against one that also knows keywords."""
    plain = t.items.where(F.col("kept") & (F.col("title").contains("that") | F.col("summary").contains("that")))
    return qu.search_parity(plain, xp.search_items(t.facts, t.item_axes, t.kw_item, "that", texts=t.texts))


@query("index_consistency", sql("SELECT keyword, week, coalesce(n, 0) AS counted, coalesce(listed, 0) AS listed FROM kw_week FULL JOIN (SELECT keyword, published_week AS week, count(*) AS listed FROM kw_item JOIN items ON id = item_id WHERE kept GROUP BY 1, 2) l USING (keyword, week) WHERE coalesce(n, 0) <> coalesce(listed, 0)", "kw_week", "kw_item", "items"))
def consistency(t):
    return qu.index_consistency(t.kw_week, t.kw_item, t.facts)


def _events(t):
    return t.raw("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")


@query("stream_ingest", sql("SELECT source, count(*) AS n FROM base WHERE id % 50 <> 0 GROUP BY source", "base"))
def stream_ingest(t):
    """Landed lines streamed in twice: each key is held once."""
    base = st.scratch(t.spark)
    rows = t.base.select(F.to_json(F.struct("source", "source_id", "title", "summary", "url", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"))).alias("value"), "id")
    lines = rows.select(F.when(F.col("id") % 50 == 0, F.substring("value", 1, 30)).otherwise(F.col("value")).alias("value"))
    for k in range(2):
        lines.write.mode("append").text(f"{base}/in")
        st.stream_ingest(t.spark, f"{base}/in", f"{base}/items", f"{base}/checkpoint", ad.COLLECTED)
    return t.spark.read.parquet(f"{base}/items").groupBy("source").agg(F.count("*").alias("n"))


@query("stream_bounded_dedup", "SELECT event_type, count(*) + count(*) FILTER (event_id % 10 = 0 AND ts < (SELECT max(ts) FROM events) - INTERVAL 15 DAY) AS n FROM events GROUP BY event_type")
def stream_dedup(t):
    """Events of which every third comes twice within the delay, and every tenth of the first days again at the end: the
    state of that has been let go by then, so that these are new."""
    base = st.scratch(t.spark)
    rows = _events(t).select("*", F.lit(0).alias("again"))
    newest = rows.agg(F.max("ts").alias("newest"))
    late = rows.where("event_id % 10 = 0").crossJoin(F.broadcast(newest)).where("ts < newest - interval 15 days").select("event_id", F.col("newest").alias("ts"), "event_type", F.lit(1).alias("again"))
    doubled = rows.union(rows.where("event_id % 3 = 0"))
    st.replay(doubled, lambda s: st.run_to_table(st.bounded_dedup(s, ["event_id"], "ts", "2 days"), f"{base}/checkpoint", f"{base}/out"), 4, then=late, files=FILES)
    return t.spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"))


@query("stream_weekly_counts", "SELECT date_trunc('week', ts)::TIMESTAMP AS week_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_weekly(t):
    """Weekly counts of a stream, complete at its end."""
    base = st.scratch(t.spark)
    st.replay(_events(t), lambda s: st.run_to_table(st.weekly_counts(s, "ts", "event_type"), f"{base}/checkpoint", f"{base}/out", "complete"), 3, files=FILES)
    rows = t.spark.read.parquet(f"{base}/out")
    last = rows.agg(F.max("batch").alias("last"))
    return rows.join(F.broadcast(last), F.col("batch") == F.col("last")).select("week_start", "event_type", "n")


@query("stream_weekly_counts_bounded", "SELECT date_trunc('week', ts)::TIMESTAMP AS week_start, event_type, count(*) AS n FROM events WHERE date_trunc('week', ts) + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1, 2")
def stream_weekly_bounded(t):
    """Weekly counts with a watermark: a week is told once, when no row of it is awaited, and its state let go."""
    base = st.scratch(t.spark)
    last = _events(t).orderBy(F.desc("ts")).limit(1)  # one more file, so that the watermark reaches its end
    st.replay(_events(t).join(last.select("event_id"), "event_id", "left_anti"), lambda s: st.run_to_table(st.weekly_counts(s, "ts", "event_type", "1 day"), f"{base}/checkpoint", f"{base}/out"), 3, then=last, files=FILES)
    return t.spark.read.parquet(f"{base}/out").select("week_start", "event_type", "n")


@query("stream_sliding_counts", "SELECT w AS window_start, w + INTERVAL 28 DAY AS window_end, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('week', ts)::TIMESTAMP - to_days(7 * k) for k in range(4)]) AS w FROM events) GROUP BY 1, 2, 3")
def stream_sliding(t):
    base = st.scratch(t.spark)
    st.replay(_events(t), lambda s: st.run_to_table(st.sliding_counts(s, "ts", "event_type"), f"{base}/checkpoint", f"{base}/out", "complete"), 2, files=FILES)
    rows = t.spark.read.parquet(f"{base}/out")
    last = rows.agg(F.max("batch").alias("last"))
    return rows.join(F.broadcast(last), F.col("batch") == F.col("last")).select("window_start", "window_end", "event_type", "n")


@query("stream_sliding_compare", """WITH own AS (SELECT date_trunc('week', ts)::TIMESTAMP AS week, user_id, count(*) AS k FROM events WHERE ts IS NOT NULL GROUP BY 1, 2),
ended AS (SELECT DISTINCT week AS week_start FROM own WHERE week + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY),
counts AS (SELECT week_start, user_id, CAST(coalesce(sum(k) FILTER (week = week_start), 0) AS BIGINT) AS n, CAST(coalesce(sum(k) FILTER (week < week_start), 0) AS BIGINT) AS before
  FROM ended JOIN own ON week BETWEEN week_start - INTERVAL 28 DAY AND week_start GROUP BY 1, 2),
totals AS (SELECT week_start, greatest(sum(n), 1) AS now, greatest(sum(before), 1) AS past FROM counts GROUP BY 1)
SELECT week_start, user_id, n, before, n / now AS share, before / past AS prev_share, (n / now) / (before / past + 1 / now) AS score, before = 0 AS is_new FROM counts JOIN totals USING (week_start) WHERE n >= 3""")
def stream_compare(t):
    """Users' events of each ended week against the four weeks before, from a stream that joins a week with its own past."""
    base = st.scratch(t.spark)
    rows = t.raw("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    last = rows.orderBy(F.desc("ts")).limit(1)  # one more file, so that the watermark reaches its end
    st.replay(rows.join(last.select("event_id"), "event_id", "left_anti"), lambda s: st.stream_compare(s, "ts", "user_id", "1 day", f"{base}/counts", f"{base}/out", f"{base}/checkpoint", least=3), 3, then=last, files=FILES)
    return t.spark.read.parquet(f"{base}/out").select("week_start", "user_id", "n", "before", "share", "prev_share", "score", "is_new")


@query("stream_alerts", _hits_sql("SELECT keyword, id, count(*) AS n FROM hits GROUP BY keyword, id"))
def stream_alerts(t):
    """Watch hits streamed in twice: each item is told once."""
    base = st.scratch(t.spark)
    hits = settle(_hits(t).select("keyword", "id"), "hits").repartition(2)
    hits.write.parquet(f"{base}/in/a=1")
    hits.write.parquet(f"{base}/in/a=2")
    stream = t.spark.readStream.schema("keyword string, id long").option("maxFilesPerTrigger", 2).option("recursiveFileLookup", True).parquet(f"{base}/in")
    st.stream_alerts(stream, f"{base}/state", f"{base}/out", f"{base}/checkpoint")
    return t.spark.read.parquet(f"{base}/out").groupBy("keyword", "id").agg(F.count("*").alias("n"))


@query("late_data_routing", """SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) FILTER (NOT late) AS on_time, count(*) FILTER (late) AS late, count(*) AS n
FROM (SELECT ts, event_id % 10 = 0 AND ts < (SELECT max(ts) FROM events WHERE event_id % 10 <> 0) - INTERVAL 5 DAY AS late FROM events) GROUP BY 1""")
def late_routing(t):
    """Every tenth event comes after all others: those that are late by then are kept aside and still counted."""
    base = st.scratch(t.spark)
    rows = _events(t)
    st.replay(rows.where("event_id % 10 <> 0"), lambda s: st.route_late(s, "ts", "5 days", f"{base}/counts", f"{base}/late", f"{base}/edges", f"{base}/checkpoint"), 3, then=rows.where("event_id % 10 = 0"), files=FILES)
    return st.routed_counts(t.spark, f"{base}/counts", f"{base}/late")


@query("stream_source_freshness", "SELECT event_type, max(ts) AS last_at, date_diff('day', max(ts), TIMESTAMP '2024-02-03') > 3 AS late FROM events GROUP BY event_type")
def stream_freshness(t):
    base = st.scratch(t.spark)
    st.replay(_events(t), lambda s: st.run_to_table(st.freshness(s, "ts", "event_type", "2024-02-03 00:00:00"), f"{base}/checkpoint", f"{base}/out", "complete"), 2, files=FILES)
    rows = t.spark.read.parquet(f"{base}/out")
    last = rows.agg(F.max("batch").alias("last"))
    return rows.join(F.broadcast(last), F.col("batch") == F.col("last")).select("event_type", "last_at", "late")


@query("rising_weeks_covered", sql("SELECT w.week, count(DISTINCT k.keyword) AS n FROM weeks w LEFT JOIN kw_week k USING (week) GROUP BY w.week", "weeks", "kw_week"))
def covered(t):
    rows = t.weeks.join(t.kw_week, "week", "left")
    return rows.groupBy("week").agg(F.count_distinct("keyword").alias("n"))

