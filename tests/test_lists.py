"""An index from lists of keywords by item against the same from rows, and results that no task holds whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossweave.operators import deltas
from crossweave.operators import graph as gr
from crossweave.operators import index as ix
from crossweave.operators import keywords as kw
from crossweave.sources import sinks

#: Item 3 comes twice.
LISTS = [(1, "w1", ["that", "thing", "nation"]), (2, "w1", ["that"]), (3, "w2", ["that", "nation"]), (3, "w2", ["that", "mention"]), (4, None, ["thing", "that"]), (5, "w2", [])]


def tables(spark):
    lists = spark.createDataFrame(LISTS, "item_id long, week string, keywords array<string>")
    items = spark.createDataFrame([(1, "w1", True), (2, "w1", False), (3, "w2", True), (4, None, True), (5, "w2", True)], "id long, published_week string, kept boolean")
    axes = spark.createDataFrame([(1, "x"), (1, "y"), (2, "y"), (3, "x"), (4, "x"), (4, "z")], "item_id long, axis string")
    return lists, lists.select("item_id", F.explode("keywords").alias("keyword"), "week"), items, axes


def found(df):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=str)


def test_lists_give_what_rows_give(spark):
    lists, rows, items, axes = tables(spark)
    assert found(ix.listed(lists)) == found(rows)
    assert found(ix.kw_df(lists)) == found(ix.kw_df(rows))
    assert {r["keyword"]: (r["df"], r["n_docs"]) for r in ix.kw_df(lists).collect()} == {"that": (4, 4), "thing": (2, 4), "nation": (2, 4), "mention": (1, 4)}
    assert found(ix.kw_week(lists, items)) == found(ix.kw_week(rows, items))
    expected = rows.join(axes, "item_id").groupBy("keyword", "axis").agg(F.count("*").alias("n"))
    assert found(ix.axis_hits(lists, axes)) == found(ix.axis_hits(rows, axes)) == found(expected)
    df, org = ix.kw_df(rows), kw.is_org("keyword", ("tion",), 5)
    assert found(ix.kw_meta(lists, df, axes, 2)) == found(ix.kw_meta(rows, df, axes, 2))
    assert found(ix.kw_item(lists, df, org, 2, 2, 2)) == found(ix.kw_item(rows, df, org, 2, 2, 2))
    assert found(ix.listed(gr.graph_docs(lists, items)).select("item_id", "keyword")) == found(gr.graph_docs(rows, items).select("item_id", "keyword"))


def test_keyword_lists_are_the_tokens_and_move_no_row(spark):
    items = spark.createDataFrame([(1, "That thing", "nation", "w1"), (2, None, "that that", None), (3, "", None, "w2"), (None, "thing", "", "w2")], "id long, title string, summary string, published_week string")
    lists = kw.keyword_lists(items)
    assert found(ix.listed(lists)) == found(kw.indexed(kw.token_keywords(items), items))
    assert "Exchange" not in ix.listed(lists)._jdf.queryExecution().executedPlan().toString()


def test_newest_items_are_picked_before_the_shuffle(spark):
    lists, rows, _, _ = tables(spark)
    plan = ix.kw_item(lists, ix.kw_df(rows), kw.is_org("keyword", ("tion",), 5), 2, 2, 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_a_large_csv_is_several_files_each_with_its_header(spark, tmp_path):
    key, before = "spark.sql.adaptive.coalescePartitions.enabled", spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set(key, "false")
    try:
        sinks.write_csv(spark.range(2000).select(F.concat(F.lit("k,"), F.col("id").cast("string")).alias("keyword"), "id"), str(tmp_path / "out"))
    finally:
        spark.conf.set(key, before)
    files = [p.read_bytes() for p in (tmp_path / "out").glob("part-*.csv")]
    assert len(files) > 1 and all(f.startswith(b"\xef\xbb\xbfkeyword,id\n") for f in files)
    assert sorted(map(tuple, sinks.read_csv(spark, str(tmp_path / "out")).collect())) == sorted((f"k,{k}", str(k)) for k in range(2000))


def test_pairs_after_a_change_without_a_table_of_pairs(spark, tmp_path):
    path = str(tmp_path / "index")
    lists, _, items, axes = tables(spark)
    lists = lists.where("item_id <> 3")
    deltas.begin(path, lists, items, axes, parts=4)
    now = spark.createDataFrame([(2, "that", "w1"), (2, "nation", "w1"), (6, "that", "w1"), (6, "nation", "w1")], "item_id long, keyword string, week string")
    after = items.where("id <> 6").union(spark.createDataFrame([(6, "w1", True)], items.schema))
    deltas.change(path, 1, spark.createDataFrame([(2,), (6,)], "id long"), now, (items, axes), (after, axes), parts=4)
    assert not (tmp_path / "index/pairs").exists()
    assert {(r["a"], r["b"]): r["n"] for r in deltas.counted_pairs(spark, path, 1, 2).collect()} == {("nation", "that"): 3, ("nation", "thing"): 1, ("that", "thing"): 2}


def test_grams_of_a_run_of_ascii_words_and_of_others(spark):
    items = spark.createDataFrame([(1, "one two three", "x. y"), (2, "é un deux trois", None), (3, "", "")], "id long, title string, summary string")
    got = {}
    for r in kw.extract_keywords(items).collect():
        got.setdefault(r["item_id"], set()).add(r["keyword"])
    assert got == {
        1: {"one", "two", "three", "x", "y", "one two", "two three", "three x"},
        2: {"é", "un", "deux", "trois", "éun", "un deux", "deux trois", "éundeux", "éundeuxtrois"},
    }
