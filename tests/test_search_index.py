"""Searches by the index of trigrams against scans, and pages that are sought against pages that are counted off."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from crossweave.operators import explore, search_index
from crossweave.plans import registry

SF = "/root/testdata/sf0.01"
ROWS = [(1, "AI in shops", None), (2, None, "open data, 100% öffentlich"), (3, "", ""), (4, "ΑΣ end", "x_y data Öffentlich"), (5, "ab", "c"), (6, "emoji 🙂🙂🙂!", "long " * 3000 + "needle"), (None, "open data", "no id"), (7, "OPEN DATA", "repeat"), (8, "abc", "İstanbul")]
LOOKED_FOR = ["open data", "Data", "data", "100%", "öffentlich", "needle", "ab", "abc", "ab c", "ΑΣ", "🙂🙂🙂", "x_y", "long long", "nothing here", "İst", "", "a" * 50]


@pytest.fixture
def texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "PART_ROWS", 3)
    rows = spark.createDataFrame(ROWS, "id long, title string, summary string").withColumn("part", F.lit("clash"))
    parts, bounds = search_index.parted(rows)
    parts.write.partitionBy("part").parquet(f"{tmp_path}/texts")
    search_index.postings(rows).write.partitionBy("folder").parquet(f"{tmp_path}/grams")
    return search_index.TextIndex(spark.read.parquet(f"{tmp_path}/grams"), spark.read.parquet(f"{tmp_path}/texts"), bounds)


@pytest.mark.parametrize("few", [1000, 0])
def test_index_finds_what_a_scan_finds(texts, monkeypatch, few):
    monkeypatch.setattr(search_index, "FEW", few)
    assert len(texts.bounds) > 1
    for text in LOOKED_FOR:
        for fold in (lambda s: s, str.lower):
            found = texts.ids(text, any_case=fold is str.lower).where("id is not null")
            expected = {i for i, t, s in ROWS if i and any(fold(text) in fold(x) for x in (t, s) if x is not None)}
            assert {r["id"] for r in found.collect()} == expected, text
    some = texts.texts.where("id in (2, 7)").select("id")
    assert {r["id"] for r in texts.ids("open data", some).join(some, "id", "left_semi").collect()} == {2}


def test_an_empty_table_has_an_index(spark):
    rows = spark.createDataFrame([], "id long, title string, summary string")
    parts, bounds = search_index.parted(rows)
    assert bounds == [] and parts.count() == 0 and search_index.postings(rows).count() == 0
    assert search_index.TextIndex(search_index.postings(rows), parts, bounds).ids("abc").count() == 0


def test_a_rare_text_reads_few_parts_and_no_summary_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(search_index, "PART_ROWS", 100)
    t = registry.Tables(spark, SF)
    assert len(t.texts.bounds) > 5
    rare = max((r["title"] for r in t.base.select("title").limit(50).collect()), key=len)
    plan = t.texts.ids(rare)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan and "Exchange" not in plan
    found = explore.search_items(t.facts, t.item_axes, t.kw_item, "that", texts=t.texts)
    assert "summary" not in found.columns
    scanned = explore.search_items(t.items, t.item_axes, t.kw_item, "that")
    assert {r["id"] for r in found.select("id").collect()} == {r["id"] for r in scanned.select("id").collect()}


@pytest.mark.parametrize("order", ["relevance", "newest", "oldest"])
def test_pages_that_are_sought_are_those_counted_off(spark, order):
    rows = [(k, f"t{k}", "s", "src", None if k % 7 == 0 else f"2024-01-0{k % 5 + 1} 00:00:00", None if k % 5 == 0 else float(k % 3)) for k in range(40)]
    found = spark.createDataFrame(rows, "id long, title string, summary string, source string, at string, cross_score double").withColumn("published_at", F.col("at").cast("timestamp"))
    axes = spark.createDataFrame([(1, "ai")], "item_id long, axis string")
    last, sought, counted = None, [], []
    for page in range(1, 7):
        rows_of = lambda df: [r["id"] for r in df.orderBy("place").collect()]
        now = explore.search_page(found, axes, order, page, 9, after=last) if last else explore.search_page(found, axes, order, 1, 9)
        sought.append(rows_of(now))
        counted.append(rows_of(explore.search_page(found, axes, order, page, 9)))
        last = explore.last_keys(now, order) or last
    assert sought[:5] == counted[:5] and sorted(sum(counted, [])) == list(range(40)) and counted[5] == sought[5] == []
