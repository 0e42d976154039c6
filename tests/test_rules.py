"""Pinned cases of the operators' rules, on tiny tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from crossweave.functions.dates import iso_week, local_date, parse_time, previous_weeks, week_label, week_month
from crossweave.functions.text import clean_text, fold_key, grams2
from crossweave.operators import alerts, axes, digest, evaluate, explore, graph, index, keywords, periods, quality, score, trend, vectors
from crossweave.sources import ingest

AXES = {
    "ai": ["AI", "인공지능", "RAG", "machine learning"],
    "bigdata": ["공공데이터", "데이터개방"],
    "smallbiz": ["소상공인", "상권", "골목상권"],
}


def items_of(spark, texts):
    return spark.createDataFrame([(k, t, "") for k, t in enumerate(texts)], "id long, title string, summary string")


def found(spark, text):
    return {r["axis"] for r in axes.item_axes(items_of(spark, [text]), AXES).collect()}


def values(df, column):
    return [r[column] for r in df.collect()]


def test_axis_keywords_are_split_and_trimmed(spark):
    lines = spark.createDataFrame([("ai", "AI, 인공지능, RAG"), ("ai", "machine learning")], "axis string, line string")
    assert sorted(values(axes.axis_keywords(lines), "keyword")) == ["AI", "RAG", "machine learning", "인공지능"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("He SAID it was a RAID array", set()),
        ("AI가 상권을 분석한다", {"ai", "smallbiz"}),
        ("공공 데이터 개방 확대", {"bigdata"}),
        ("골목 상권 활성화", {"smallbiz"}),
        ("더 이상 권장하지 않는다", set()),
        ("소상공인 AI 공공데이터", {"ai", "bigdata", "smallbiz"}),
    ],
)
def test_axis_rules(spark, text, expected):
    assert found(spark, text) == expected


def test_match_and_axes_agree(spark):
    rows = items_of(spark, ["AI ai 상권", "nothing"])
    hits = axes.axis_match(rows, AXES).collect()
    assert {(r["axis"], r["keyword"]) for r in hits} == {("ai", "ai"), ("smallbiz", "상권")}


def test_scores_grow_with_axes(spark):
    rows = items_of(spark, ["", "", "", "", ""])
    tags = spark.createDataFrame([(1, "ai"), (2, "ai"), (2, "bigdata"), (3, "ai"), (3, "bigdata"), (3, "smallbiz"), (4, "ai"), (4, "bigdata"), (4, "smallbiz"), (4, "other")], "item_id long, axis string")
    got = {r["id"]: r["cross_score"] for r in score.cross_score(rows, tags, {1: 0.5, 2: 3.0, 3: 8.0}, {"ai": 1.0, "bigdata": 1.2, "smallbiz": 1.2}).collect()}
    assert got[0] == 0 and got[1] == 0.5 and got[2] == 6.6 and got[3] == 27.2 and got[4] > got[3]
    assert got[2] > 4 * got[1]
    gated = score.cross_score(rows, tags, {1: 0.5, 2: 0.0, 3: 8.0}, {}, 2)
    got = {r["id"]: r["cross_score"] for r in gated.collect()}
    assert got[1] == 0 and got[2] == 16.0  # a weight of 0 counts as none


@pytest.mark.parametrize(
    "week, expected",
    [("2026-W01", ["2025-W52", "2025-W51"]), ("2026-W35", ["2026-W34", "2026-W33"]), ("garbage", []), ("2025-W53", []), ("2026-W00", [])],
)
def test_previous_weeks(spark, week, expected):
    assert spark.range(1).select(previous_weeks(F.lit(week), 2).alias("w")).first()["w"] == expected


def test_weeks_and_days(spark):
    row = spark.range(1).select(
        iso_week(F.lit("2025-12-29").cast("timestamp")).alias("w"),
        local_date(F.lit("2026-08-31 15:00:00").cast("timestamp")).cast("string").alias("d"),
        week_label(F.lit("2026-W01")).alias("l"),
        week_label(F.lit("W99")).alias("g"),
        week_month(F.lit("2026-W01")).alias("m"),
        parse_time(F.lit("2026-01-01T09:00:00+09:00")).cast("string").alias("t"),
        parse_time(F.lit("x")).alias("x"),
    ).first()
    assert row["w"] == "2026-W01" and row["d"] == "2026-09-01" and row["m"] == "2026-01"
    assert row["l"] == "2026년 1월 1주차" and row["g"] == "W99"
    assert row["t"] == "2026-01-01 00:00:00" and row["x"] is None


def test_text_helpers(spark):
    row = spark.range(1).select(clean_text(F.lit("<b>a</b>&amp;lt;  b\n")).alias("c"), fold_key(F.lit("A　i  b")).alias("k"), grams2(F.lit("a-b c")).alias("g")).first()
    assert row["c"] == "a &lt; b" and row["k"] == "aib" and row["g"] == ["ab", "bc"]


def test_insert_ignore_counts(spark, tmp_path):
    target = str(tmp_path / "items")
    kind = "source string, source_id string, url string, collected_at timestamp"
    five = spark.createDataFrame([("s", str(k), "u", None) for k in range(5)], kind)
    assert ingest.append_new(spark, target, five) == 5
    assert ingest.append_new(spark, target, five) == 0
    assert ingest.append_new(spark, target, five.union(spark.createDataFrame([("s", "9", "u", None), ("s", "9", "v", None)], kind))) == 1
    assert ingest.append_new(spark, target, five.limit(0)) == 0


def test_broken_lines_are_rejects(spark):
    lines = spark.createDataFrame([('{"source":"a","source_id":"1"}',), ('{"source":"a","sou',), ("[]",)], "value string")
    good, bad = ingest.parse_lines(lines)
    assert good.count() == 1 and bad.count() == 2


def test_keywords(spark):
    def grams(text):
        return set(values(keywords.extract_keywords(items_of(spark, [text])), "keyword"))

    assert "공공데이터" in grams("공공 데이터")
    assert "Apache Iceberg" in grams("Apache Iceberg")
    assert "one two three" not in grams("one two three")
    words = ["new", "features for", "분석", "Apache", "CCTV", "RAG", "상권분석", "12", "a", "AI"]
    rows = spark.createDataFrame([(w,) for w in words], "keyword string").where(keywords.keyword_acceptable("keyword", ("분석",)))
    assert set(values(rows, "keyword")) == {"Apache", "CCTV", "RAG", "상권분석"}


def test_fragments(spark):
    rows = spark.createDataFrame([("인공지능", 137), ("인공", 138), ("지능", 154), ("데이터", 500), ("공공데이터", 221)], "keyword string, n long")
    assert values(trend.fragments(rows), "keyword") == ["인공"]


@pytest.mark.parametrize("least", [3, 5])
def test_rare_rising_topics_keep_items(spark, least):
    words = spark.createDataFrame([(k, "신규합성", "2026-W40") for k in range(least)], "item_id long, keyword string, week string")
    df = index.kw_df(words)
    assert index.kw_item(words, df, keywords.is_org(), weekly_min=least).count() == least
    assert index.kw_item(words, df, keywords.is_org(), weekly_min=least + 1).count() == 0


def test_neighbours_are_symmetric(spark):
    rows = [(d, k, "w") for d in range(40) for k in (("aa", "bb") if d % 2 else ("cc", "dd"))]
    words = spark.createDataFrame(rows, "item_id long, keyword string, week string")
    df = index.kw_df(words)
    got = {(r["keyword"], r["neighbor"]): r["npmi"] for r in index.neighbors(index.cooccurrence(words, df), df).collect()}
    assert set(got) == {("aa", "bb"), ("bb", "aa"), ("cc", "dd"), ("dd", "cc")} and got["aa", "bb"] == got["bb", "aa"] == pytest.approx(1.0)


def test_ego_center_ignores_case_and_spaces(spark):
    meta = spark.createDataFrame([("AI 모델", 5, "ai"), ("ai모델", 9, "ai"), ("AI-모델", 50, "ai")], "keyword string, df long, axis string")
    for q in ("AI 모델", "ai모델", "A I 모 델", "AI　모델", "ＡＩ".replace("ＡＩ", "Ai") + "\t모델"):
        assert graph.ego_center(meta, q).first()["keyword"] == "ai모델"


def test_shortest_hops(spark):
    nodes = spark.createDataFrame([("c", 0), ("x", 1), ("y", 2), ("z", 2)], "keyword string, hop int")
    edges = spark.createDataFrame([("c", "x"), ("c", "y")], "a string, b string")
    assert {r["keyword"]: r["hop"] for r in graph.shortest_hops(nodes, edges, "c").collect()} == {"c": 0, "x": 1, "y": 1, "z": 2}


def explore_items(spark):
    rows = [(1, "AI 상권", "2026-08-31 14:59:59", 1.0, True), (2, "AI 상권", "2026-08-31 15:00:00", 2.0, True), (3, "AI 상권", "2026-09-01 14:59:59.999999", 3.0, True), (4, "AI 상권", "2026-09-01 15:00:00", 4.0, True), (5, "100% AI", None, 5.0, False)]
    df = spark.createDataFrame([(i, t, "", p, s, k, "s") for i, t, p, s, k in rows], "id long, title string, summary string, p string, cross_score double, kept boolean, source string")
    return df.withColumn("published_at", F.col("p").cast("timestamp")).drop("p")


def test_search_by_local_day_and_literally(spark):
    rows = explore_items(spark)
    none = spark.createDataFrame([], "item_id long, axis string")
    links = spark.createDataFrame([("상권분석", 2)], "keyword string, item_id long")
    day = explore.search_items(rows, none, links, None, None, "2026-09-01", "2026-09-01")
    assert sorted(values(day, "id")) == [2, 3]
    assert explore.search_items(rows, none, links, "%").count() == 0
    assert values(explore.search_items(rows, none, links, "%", kept_only=False), "id") == [5]
    assert values(explore.search_items(rows, none, links, "상권분석", None, "2026-09-01", "2026-09-01"), "id") == [2]
    assert explore.search_items(rows, none, links, "상권분석", None, "2026-09-02", "2026-09-02").count() == 0
    every = explore.search_items(rows, none, links, kept_only=False)
    assert values(explore.search_page(every, none, "newest", 1, 5), "id") == [4, 3, 2, 1, 5]
    pages = [values(explore.search_page(every, none, "relevance", p, 2), "id") for p in (1, 2, 3)]
    assert pages == [[5, 4], [3, 2], [1]]


def test_keyword_items_order(spark):
    rows = [(30, True, 9.0), (31, True, None), (32, None, 5.0), (33, False, 7.0)]
    df = spark.createDataFrame([(i, k, s) for i, k, s in rows], "id long, kept boolean, cross_score double").withColumn("published_at", F.lit("2026-01-01").cast("timestamp"))
    links = spark.createDataFrame([("AI", i) for i, _, _ in rows], "keyword string, item_id long")
    got = explore.keyword_items(df, links, "AI").orderBy("place").collect()
    assert [r["id"] for r in got] == [30, 31, 33, 32] and got[0]["page_kept"] == 2 and got[0]["total"] == 4


def test_period_windows(spark):
    got = {r["period"]: r for r in periods.period_window(spark, ["2026-09", "2026-W01", "2026-W54", "../secret", "2026-13"], "2026-09-15 00:00:00").collect()}
    assert set(got) == {"2026-09", "2026-W01"}
    month, week = got["2026-09"], got["2026-W01"]
    assert str(month["start"]) == "2026-08-31 15:00:00" and month["status"] == "in_progress" and str(month["prev_end"]) == "2026-08-15 00:00:00"
    assert str(week["start"]) == "2025-12-28 15:00:00" and str(week["end"]) == "2026-01-04 15:00:00" and week["status"] == "closed"


def test_editorial_rules(spark):
    kind = "period string, as_of string, final boolean, summary string, sources array<struct<id:bigint,title:string,url:string>>, sections array<struct<title:string,source_ids:array<bigint>>>, tasks array<struct<title:string,source_ids:array<bigint>>>"
    good = ("2026-09", "2026-09-10T00:00:00Z", False, "text", [(1, "t", "https://a.b/c")], [("s", [1])], [("t", [1])])
    bad = ("2026-08", "2026-09-30T00:00:00Z", True, " ", [(2, "t", "javascript:alert(1)")], [("s", [3])], [])
    win = periods.period_window(spark, ["2026-08", "2026-09"], "2026-09-15 00:00:00")
    got = periods.editorial_violations(spark.createDataFrame([good, bad], kind), win).collect()
    assert {(r["period"], r["rule"]) for r in got} == {("2026-08", x) for x in ("as_of", "summary", "source", "reference", "final_day")}


def test_syndicated_titles_chain(spark):
    rows = [(1, 1, "모두의 AI 사업자 선정"), (2, 2, "모두의 AI 사업자 최종 선정"), (3, 3, "전혀 다른 소식 하나")]
    pool = spark.createDataFrame([("2026-W35", p, i, t, None, False) for p, i, t in rows], "week string, place int, id long, title string, relevance double, regulatory boolean")
    tags = spark.createDataFrame([(i, a) for i in (1, 2, 3) for a in ("ai", "bigdata")], "item_id long, axis string")
    got = digest.digest_sections(pool, tags, ["ai"]).where("section = 'crossing'").orderBy("place")
    assert values(got, "id") == [1, 3]
    pairs = digest.title_pairs(spark.createDataFrame([("w", i, t) for _, i, t in rows], "week string, id long, title string"))
    assert [(r["a"], r["b"]) for r in pairs.collect()] == [(1, 2)]


def test_digest_upsert_keeps_what_others_wrote(spark):
    kind = "week string, lead string, body map<string,string>"
    old = spark.createDataFrame([("w1", "lead", {"a": "1", "tasks": "t"})], kind)
    new = spark.createDataFrame([("w1", None, {"a": "2"}), ("w2", None, {"a": "3"})], kind)
    got = {r["week"]: (r["lead"], r["body"]) for r in digest.digest_upsert(old, new).collect()}
    assert got == {"w1": ("lead", {"a": "2", "tasks": "t"}), "w2": (None, {"a": "3"})}


def test_humanized_weeks(spark):
    rows = spark.createDataFrame([("from W35 to 2026-W01, not W60 or AW35",), (None,)], "text string")
    got = values(digest.humanize_weeks(rows, 2026), "text")
    assert got == ["from 2026년 8월 4주차 to 2026년 1월 1주차, not W60 or AW35", None]


def test_near_duplicates_chain_and_survivor(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.95, 0.31]), (3, [0.8, 0.6]), (4, [0.0, 1.0]), (5, None)]
    vecs = spark.createDataFrame([("w", i, v, float(-i)) for i, v in rows], "block string, id long, embedding array<float>, place double")
    got = {r["id"]: r["survivor"] for r in vectors.near_dup_clusters(vecs, 0.9).collect()}
    assert got == {1: 3, 2: 3, 3: 3}


def test_confusion_matrix(spark):
    rows = [(1, True)] * 14 + [(0, True)] * 11 + [(1, False)] * 13 + [(0, False)] * 12 + [(None, True)]
    got = evaluate.confusion_matrix(spark.createDataFrame(rows, "label int, kept boolean")).first()
    assert (got["tp"], got["fp"], got["fn"], got["tn"]) == (14, 11, 13, 12)
    assert round(got["precision"], 3) == 0.56 and round(got["recall"], 3) == 0.519
    empty = evaluate.confusion_matrix(spark.createDataFrame([], "label int, kept boolean")).first()
    assert empty["precision"] == 0 and empty["f1"] == 0


def test_alerts_cut_before_seen(spark):
    rows = spark.createDataFrame([(i, f"thing {i}", "", "s", True) for i in range(30)], "id long, title string, summary string, source string, kept boolean").withColumn("published_at", F.lit("2026-01-01").cast("timestamp"))
    sources = spark.createDataFrame([("s", False)], "source string, regulatory boolean")
    seen = spark.createDataFrame([(29,), (28,)], "id long")
    got = alerts.alert_hits(rows, sources, ["THING"], "2026-01-02 00:00:00", 7, seen)
    assert sorted(values(got, "id")) == list(range(10, 28))
    assert values(alerts.alert_state(seen, got, 3), "id") == [29, 28, 27]


def test_parity_and_references(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(2,), (3,)], "id long")
    assert {(r["side"], r["id"]) for r in quality.search_parity(a, b).collect()} == {("first", 1), ("second", 3)}
    refs = spark.createDataFrame([("p", 1, "u"), ("p", 2, "u"), ("p", 9, "u")], "period string, ref_id long, url string")
    items = spark.createDataFrame([(1, "u"), (2, "v")], "id long, url string")
    assert {(r["ref_id"], r["problem"]) for r in quality.source_ref_integrity(refs, items).collect()} == {(2, "url"), (9, "missing")}


def test_topic_pages_dates_and_states(spark):
    pages = [
        (1, '<title>A | Site</title><meta property="og:title" content="Real"><meta property="article:published_time" content="2026-01-01T00:00:00Z">'),
        (2, '<title>B - Site</title><script>{"datePublished": "2026-01-02T00:00:00Z"}</script>'),
        (3, '<title>C</title><time datetime="2026-01-03T00:00:00Z">x</time>'),
        (4, "<title>404 Not Found</title>"),
        (5, "<title>Just a moment...</title>"),
        (6, None),
    ]
    got = {r["page_id"]: r for r in ingest.topic_pages(spark.createDataFrame(pages, "page_id long, html string")).collect()}
    assert [got[k]["title"] for k in (1, 2, 3)] == ["Real", "B", "C"]
    assert [str(got[k]["published_at"])[:10] for k in (1, 2, 3)] == ["2026-01-01", "2026-01-02", "2026-01-03"]
    assert [got[k]["state"] for k in (4, 5, 6)] == ["not_found", "bot_challenge", "not_found"]


def test_chosen_nodes_meet_the_neighbours_without_shuffling_them(spark, tmp_path):
    rows = [("a", f"n{k}", 0.9 - k / 100, 5, 9) for k in range(6)] + [("n0", "n1", 0.5, 4, 9), ("n1", "n0", 0.5, 4, 9)]
    spark.createDataFrame(rows, "keyword string, neighbor string, npmi double, cooc long, df long").write.parquet(f"{tmp_path}/n")
    table = spark.read.parquet(f"{tmp_path}/n")
    found = graph.ego_expand(table, "a")
    edges = graph.induced_edges(table, found)
    assert {(r["a"], r["b"]) for r in edges.collect()} >= {("a", "n0"), ("n0", "n1")}
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
