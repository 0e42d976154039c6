"""Registered queries against their SQL on the smallest tables, streams against tables, and invariants."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from crossweave.plans import registry, reviews
from crossweave.sources.adapter import Tables

#: One query or more of every group; the whole list is compared by the driver's own check.
COMPARED = [
    "normalize_items", "clean_text", "parse_topic_pages", "insert_ignore", "enrich_summary", "axis_match", "item_axes", "cross_score", "top_by_score",
    "contrast_relevance", "weekly_dedup", "extract_keywords", "kw_week", "kw_neighbors", "kw_item", "rising_keywords", "rising_groups", "bridge_scores",
    "search_page", "keyword_items", "corpus_stats", "month_tree", "recurring_orgs", "digest_pool", "title_containment", "period_axis_compare", "available_periods",
    "task_candidates", "alert_hits", "confusion_matrix", "metric_spread", "month_material", "index_consistency", "stream_ingest", "stream_weekly_counts", "late_data_routing",
    "stream_sliding_counts", "stream_sliding_compare", "index_delta", "pair_delta", "similarity_quantiles", "label_sample", "stratified_folds", "digest_regulatory",
]


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def shown(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", COMPARED)
def test_query_is_its_sql(spark, sf_dir, con, name):
    df = registry.QUERIES[name](spark, sf_dir)
    found = con.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    spots = [found.columns.index(c) for c in columns]
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(shown(r[k]) for k in spots) for r in found.fetchall())


def test_every_query_is_registered_once():
    names = entry.queries()
    assert set(registry.ORACLES) <= set(registry.QUERIES) <= set(names)
    assert len(registry.QUERIES) > 120


def test_entry_has_rows(spark):
    assert set(entry.entry(spark).columns) == {"keyword", "n", "share", "prev_share", "score", "is_new"}


def test_dedup_keeps_one_of_each_group(spark, sf_dir):
    rows = registry.QUERIES["near_dup_clusters"](spark, sf_dir).collect()
    survivors = {r["survivor"] for r in rows}
    assert survivors == {r["id"] for r in rows if r["id"] == r["survivor"]}


def test_week_counts_sum_to_kept_keyword_rows(spark, sf_dir):
    total = sum(r["n"] for r in registry.QUERIES["kw_week"](spark, sf_dir).collect())
    assert total == sum(r["n"] for r in registry.QUERIES["keywords_scope"](spark, sf_dir).collect())


def test_greedy_choices_are_the_same_in_every_run(spark, sf_dir):
    for name in ("digest_crossing", "suggest_keywords", "ego_expand"):
        runs = [sorted(map(tuple, registry.QUERIES[name](spark, sf_dir).collect())) for _ in range(2)]
        assert runs[0] == runs[1]


def test_neighbors_of_every_keyword_and_edges_of_chosen_nodes(spark, sf_dir, con):
    test_query_is_its_sql(spark, sf_dir, con, "neighbors_topk_all")
    t = Tables(spark, sf_dir)
    every = {r["keyword"] for r in t.kw_neighbor.where("cooc >= 3").select("keyword").distinct().collect()}
    assert {r["keyword"] for r in registry.QUERIES["neighbors_topk_all"](spark, sf_dir).collect()} == every
    chosen = {r["keyword"] for r in registry.QUERIES["ego_expand"](spark, sf_dir).collect()}
    expected = {tuple(sorted(r)) for r in t.kw_neighbor.select("keyword", "neighbor").collect() if set(r) <= chosen}
    assert {(r["a"], r["b"]) for r in registry.QUERIES["ego_chosen_edges"](spark, sf_dir).collect()} == expected


def test_editorial_cites_two_items_without_gathering_a_month(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = reviews._editorial(t)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    months: dict[str, list] = {}
    for r in t.items.where("kept").select(F.date_format(F.col("published_at") + F.expr("interval 9 hours"), "yyyy-MM").alias("m"), "id").collect():
        months.setdefault(r["m"], []).append(r["id"])
    assert {r["period"]: [x["id"] for x in r["sources"]] for r in found.collect()} == {m: sorted(ids)[:2] for m, ids in months.items()}


def test_topic_pages_decode_what_their_sql_decodes(spark, tmp_path):
    rows = [(1, "<title>a &amp; b &quot;c&quot; | Site</title>"), (2, "<title>&lt;x&gt; &#39;y&#39; &amp;amp;</title>")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    expected = duckdb.connect().sql(registry.ORACLES["parse_topic_pages"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, registry.QUERIES["parse_topic_pages"](spark, str(tmp_path)).collect())) == sorted(expected)
