"""Queries of embeddings: relevance, thresholds, near duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossweave.operators import vectors as ve
from crossweave.plans.registry import query
from crossweave.plans.sql import sql

GRID = [-0.2, -0.1, 0.0, 0.1, 0.2, 0.3, 0.5]
WEEK_CUT, GLOBAL_CUT, THRESHOLD = 0.25, 0.40, 0.0

_COSINE = "list_dot_product(CAST(x.e AS DOUBLE[]), CAST(y.e AS DOUBLE[])) / sqrt(list_dot_product(CAST(x.e AS DOUBLE[]), CAST(x.e AS DOUBLE[]))) / sqrt(list_dot_product(CAST(y.e AS DOUBLE[]), CAST(y.e AS DOUBLE[])))"


def _clusters(rows: str, cut: float) -> str:
    """Parts of SQL: pairs of (id, block, place, e), reach and survivors."""
    return f""", vec AS ({rows}),
pairs AS (SELECT x.id AS a, y.id AS b FROM vec x JOIN vec y ON x.block = y.block AND x.id < y.id WHERE {_COSINE} >= {cut}),
both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, p.b FROM reach r JOIN both_ways p ON p.a = r.other),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
survivors AS (SELECT r.root, arg_min(v.id, (v.place, v.id)) AS survivor FROM roots r JOIN vec v ON v.id = r.node GROUP BY r.root),
clusters AS (SELECT r.node AS id, s.survivor FROM roots r JOIN survivors s USING (root))
"""


_WEEKLY = _clusters("SELECT i.id, coalesce(published_week, '?') AS block, -cross_score AS place, embedding AS e FROM items i JOIN embeddings ON vec_id = i.id", WEEK_CUT)
_GLOBAL = _clusters(f"SELECT r.id, 'all' AS block, -relevance AS place, embedding AS e FROM relevance r JOIN embeddings ON vec_id = r.id WHERE relevance >= {THRESHOLD}", GLOBAL_CUT)


def _with(head: tuple[str, ...], more: str, body: str) -> str:
    return sql("", *head).rstrip() + more + body


@query("missing_embeddings", sql("SELECT id FROM base WHERE id NOT IN (SELECT vec_id FROM embeddings)", "base"))
def missing(t):
    return ve.missing_embeddings(t.base, t.vectors)


@query("centroid", sql("SELECT dim, floor(x / sqrt((SELECT sum(x * x) FROM seed_dims WHERE label = 0)) * 1e9 + 0.5) AS x FROM seed_dims WHERE label = 0", "seed_dims"))
def centroid(t):
    rows = ve.centroid(t.raw("embeddings").where("label = 0")).select(F.posexplode("centroid").alias("dim", "x"))
    return rows.select((F.col("dim") + 1).cast("long").alias("dim"), F.floor(F.col("x") * 1e9 + 0.5).cast("double").alias("x"))


@query("contrast_relevance", sql("SELECT id, floor(relevance * 1e9 + 0.5) AS relevance FROM relevance", "relevance"))
def relevance(t):
    return t.relevance.select("id", F.floor(F.col("relevance") * 1e9 + 0.5).cast("double").alias("relevance"))


@query("similarity_quantiles", sql("SELECT " + ", ".join(f"floor(quantile_cont(relevance, {m}) * 1e8 + 0.5) AS p{round(m * 100)}" for m in (0.5, 0.75, 0.9, 0.95, 0.99)) + ", floor(avg(relevance) * 1e8 + 0.5) AS mean, floor(min(relevance) * 1e8 + 0.5) AS least, floor(max(relevance) * 1e8 + 0.5) AS most FROM relevance", "relevance"))
def quantiles(t):
    rows = ve.similarity_quantiles(t.relevance)
    return rows.select(*[F.floor(F.col(c) * 1e8 + 0.5).cast("double").alias(c) for c in rows.columns])


@query("threshold_sweep", sql("SELECT g AS threshold, count(*) FILTER (relevance >= g) AS passed, 100.0::DOUBLE * count(*) FILTER (relevance >= g) / count(*) AS pct FROM relevance, unnest([" + ", ".join(f"{g}::DOUBLE" for g in GRID) + "]) u(g) GROUP BY g", "relevance"))
def sweep(t):
    return ve.threshold_sweep(t.relevance, GRID)


@query("near_dup_clusters", _with(("items",), _WEEKLY, "SELECT id, survivor FROM clusters"))
def clusters(t):
    rows = t.facts.select("id", F.coalesce("published_week", F.lit("?")).alias("block"), (-F.col("cross_score")).alias("place"))
    return ve.near_dup_clusters(rows.join(t.vectors, "id"), WEEK_CUT)


@query("weekly_dedup", _with(("items",), _WEEKLY, "SELECT id, survivor FROM clusters WHERE id <> survivor"))
def weekly(t):
    return ve.weekly_dedup(t.facts, t.vectors, WEEK_CUT).where("id <> survivor")


@query("global_dedup", _with(("relevance",), _GLOBAL, "SELECT id, survivor FROM clusters"))
def whole(t):
    return ve.global_dedup(t.relevance, t.item_vectors, GLOBAL_CUT, THRESHOLD)


@query("kept_flag_axes", _with(("items", "item_axes"), _WEEKLY, "SELECT b.id, b.id IN (SELECT item_id FROM item_axes) AND b.id NOT IN (SELECT id FROM clusters WHERE id <> survivor) AS kept FROM items b"))
def kept_axes(t):
    return ve.kept_flag_axes(t.facts, t.item_axes, ve.weekly_dedup(t.facts, t.vectors, WEEK_CUT))


@query("kept_flag_embedding", _with(("relevance", "base", "item_axes"), _GLOBAL, f"SELECT b.id, b.id IN (SELECT item_id FROM item_axes) AND b.id NOT IN (SELECT id FROM clusters WHERE id <> survivor) AND coalesce(r.relevance >= {THRESHOLD}, false) AS kept FROM base b LEFT JOIN relevance r USING (id)"))
def kept_embedding(t):
    found = ve.global_dedup(t.relevance, t.item_vectors, GLOBAL_CUT, THRESHOLD)
    return ve.kept_flag_embedding(t.base, t.relevance, t.item_axes, found, THRESHOLD)


@query("changed_flags", _with(("items", "item_axes"), _WEEKLY, "SELECT id, false AS kept FROM items WHERE kept AND id IN (SELECT id FROM clusters WHERE id <> survivor)"))
def changed(t):
    return ve.changed_flags(t.facts, ve.kept_flag_axes(t.facts, t.item_axes, ve.weekly_dedup(t.facts, t.vectors, WEEK_CUT)))


@query("source_similarity", sql(f"SELECT source, count(*) FILTER (relevance >= {THRESHOLD}) AS passed, count(*) AS total, floor(avg(relevance) * 1e8 + 0.5) AS mean FROM base JOIN relevance USING (id) GROUP BY source", "base", "relevance"))
def by_source(t):
    return ve.source_similarity(t.base, t.relevance, THRESHOLD).withColumn("mean", F.floor(F.col("mean") * 1e8 + 0.5).cast("double"))


@query("top_similar", sql("SELECT id, title FROM relevance JOIN base USING (id) ORDER BY relevance DESC, id LIMIT 10", "relevance", "base"))
def top(t):
    return ve.top_similar(t.base, t.relevance).select("id", "title")


@query("borderline_items", sql(f"SELECT id FROM relevance WHERE abs(relevance - {THRESHOLD}) <= 0.02::DOUBLE ORDER BY abs(relevance - {THRESHOLD}), id LIMIT 20", "relevance"))
def borderline(t):
    return ve.borderline_items(t.relevance, THRESHOLD).select("id")


@query("similarity_query", sql("SELECT id, title, floor(relevance * 1e9 + 0.5) AS relevance FROM base JOIN relevance USING (id) WHERE contains(title, 'on')", "relevance", "base"))
def matching(t):
    return ve.similarity_query(t.base, t.relevance, "on").select("id", "title", F.floor(F.col("relevance") * 1e9 + 0.5).cast("double").alias("relevance"))
