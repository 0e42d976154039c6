"""Queries that SQL does not state, against plain versions over the collected tables; readers, sinks and streams against files."""

from __future__ import annotations

import inspect
import random
import re
import shutil
import string
from collections import Counter, deque
from datetime import date
from itertools import combinations
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from crossweave.functions.components import shared_folder
from crossweave.operators import alerts, digest, graph, index, keywords
from crossweave.plans import registry, reviews, words
from crossweave.sources import adapter as ad
from crossweave.sources import ingest, sinks
from crossweave.streaming import streams

SF = "/root/testdata/sf0.01"


def rows_of(spark, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in registry.QUERIES[name](spark, SF).collect())


def pairs_of(title):
    s = "".join(ch for ch in title or "" if ch.isalnum())
    return {s[i : i + 2] for i in range(len(s) - 1)}


def plain_sections(pool, axes_of, order, cut):
    out = []
    for week in sorted({r["week"] for r in pool}):
        rows = sorted((r for r in pool if r["week"] == week and not r["regulatory"] and axes_of.get(r["id"])), key=lambda r: r["place"])
        told, seen = set(), []

        def fresh(r, told=told, seen=seen):
            if r["id"] in told:
                return False
            told.add(r["id"])
            own = pairs_of(r["title"])
            like = [p for p in seen if len(own) >= 4 and len(p) >= 4 and len(own & p) >= cut * min(len(own), len(p))]
            seen.append(own)
            return not like

        def fill(candidates, room, fresh=fresh):
            chosen = []
            for r in candidates:
                if len(chosen) == room:
                    break
                if fresh(r):
                    chosen.append(r["id"])
            return chosen

        three = fill([r for r in rows if len(axes_of[r["id"]]) == 3], 5)
        crossing = three + fill([r for r in rows if len(axes_of[r["id"]]) == 2], 5 - len(three))
        out += [(week, "crossing", k, i) for k, i in enumerate(crossing, 1)]
        by_relevance = sorted(rows, key=lambda r: -(r["relevance"] or 0.0))
        for axis in order:
            out += [(week, axis, k, i) for k, i in enumerate(fill([r for r in by_relevance if axis in axes_of[r["id"]]], 5), 1)]
    return sorted(out)


def test_digest_sections_are_the_plain_choice(spark):
    t = registry.tables(spark, SF)
    pool = reviews._pool(t).select("week", "place", "id", "title", "relevance", "regulatory").collect()
    axes_of = {}
    for r in t.item_axes.collect():
        axes_of.setdefault(r["item_id"], set()).add(r["axis"])
    expected = plain_sections(pool, axes_of, list(ad.AXES), reviews.TITLE_CUT)
    columns = ("week", "section", "place", "id")
    assert rows_of(spark, "digest_crossing", *columns) == [r for r in expected if r[1] == "crossing"]
    assert rows_of(spark, "digest_by_axis", *columns) == [r for r in expected if r[1] != "crossing"]
    assert len({r[0] for r in expected}) > 5


@pytest.mark.parametrize("cut", [0.22, 0.9])
def test_sections_of_a_large_week_with_close_titles(spark, cut):
    rng = random.Random(31)
    themes = [[rng.choice(string.ascii_lowercase) * rng.choice((1, 2)) + "".join(rng.choices(string.ascii_lowercase, k=4)) for _ in range(6)] for _ in range(9)]
    rows, axes = [], {}
    for i in range(6000):
        week = "2024-W01" if i % 20 else f"2024-W0{2 + i // 20 % 4}"
        title = None if i % 97 == 0 else "AI" if i % 89 == 0 else " ".join(rng.sample(rng.choice(themes), rng.choice((2, 3, 6))))
        rows.append((week, i // 3, i, title, rng.choice((None, 0.1, 0.2, 0.5, -0.3)), i % 50 == 7))
        axes[i] = set(rng.sample(["a", "b", "c"], rng.choices((0, 1, 2, 3), (20, 70, 9, 1))[0]))
    # places are those of a week, without gaps or ties
    rows.sort(key=lambda r: (r[0], r[1], r[2]))
    rows = [(r[0], k, *r[2:]) for k, r in enumerate(rows)]
    pool = spark.createDataFrame(rows, "week string, place int, id long, title string, relevance double, regulatory boolean")
    item_axes = spark.createDataFrame([(i, x) for i, own in axes.items() for x in own], "item_id long, axis string")
    expected = plain_sections(pool.collect(), axes, ["c", "a", "b"], cut)
    found = digest.digest_sections(pool, item_axes, ["c", "a", "b"], cut=cut)
    assert sorted(tuple(r) for r in found.select("week", "section", "place", "id").collect()) == expected
    assert "applyInPandas" not in inspect.getsource(digest)


def test_humanize_weeks_is_the_plain_rewrite(spark):
    def name(year, week):
        thursday = date.fromisocalendar(year, week, 4)
        return f"{thursday.year}년 {thursday.month}월 {(thursday.day + 6) // 7}주차"

    weeks = {r["id"]: r["published_week"] for r in registry.tables(spark, SF).base.select("id", "published_week").collect()}
    for i, text in rows_of(spark, "humanize_weeks", "id", "text"):
        label = name(2024, int(weeks[i][-2:]))
        assert text == f"between {label} and {label}, not W60"
    odd = spark.createDataFrame([(1, "W1, aW2, W3b, 2020-W53, 2024-W53, W0, W123"), (2, None), (3, "")], "id long, text string")
    got = {r["id"]: r["text"] for r in digest.humanize_weeks(odd, 2024).collect()}
    assert got == {1: f"{name(2024, 1)}, aW2, {name(2024, 3)}b, {name(2020, 53)}, 2024-W53, W0, W123", 2: None, 3: ""}


def test_suggestions_are_the_plain_choice(spark):
    found = [(r["keyword"], r["df"]) for r in registry.tables(spark, SF).kw_meta.collect() if "th" in r["keyword"]]
    first = sorted(found, key=lambda r: (-r[1], r[0]))[:80]
    chosen = []
    for k, n in first:
        fragment = [w for w, m in first if k in w and w != k and 2 * m >= n]
        if not fragment and not [c for c, m in chosen if c in k and 2 * n >= m] and len(chosen) < 10:
            chosen.append((k, n))
    assert rows_of(spark, "suggest_keywords", "place", "keyword", "df") == [(p, k, n) for p, (k, n) in enumerate(chosen, 1)]
    assert len(chosen) > 3


def test_a_rare_extension_of_a_chosen_word_stays(spark):
    meta = spark.createDataFrame([("shop", 100), ("shops", 60), ("shopper", 10), ("workshop", 49), ("bishop", 50), ("sho", 90), ("stop shop", 30)], "keyword string, df long")
    found = graph.suggest_keywords(meta, "sho", 10, ("stop shop",)).orderBy("place").collect()
    # shop is a fragment of shops (60 of 100) and sho of shop; bishop and workshop hold shop, which is not chosen; shopper holds neither
    assert [(r["place"], r["keyword"]) for r in found] == [(1, "shops"), (2, "bishop"), (3, "workshop"), (4, "shopper")]
    meta = spark.createDataFrame([("shop", 100), ("shops", 30), ("shopshop", 50)], "keyword string, df long").where("keyword <> 'shopshop'")
    assert [r["keyword"] for r in graph.suggest_keywords(meta, "shop").orderBy("place").collect()] == ["shop", "shops"]  # 30 is under half of 100


def plain_expansion(neighbours, center, hops=2, per_hop=8, most=40):
    chosen, edge = {center: 0}, [center]
    for hop in range(1, hops + 1):
        room = most - len(chosen)
        if room <= 0 or not edge:
            break
        share, following = max(2, room // len(edge)), []
        for k in edge:
            new = 0
            for n in neighbours.get(k, [])[:per_hop]:
                if new == share or len(chosen) == most:
                    break
                held = any(min(len(n), len(c)) > 2 and (n in c or c in n) for c in chosen)
                if n not in chosen and not held:
                    chosen[n] = hop
                    following.append(n)
                    new += 1
        edge = following
    return chosen


def test_ego_networks_are_the_plain_walk(spark):
    t = registry.tables(spark, SF)
    table = t.kw_neighbor.collect()
    neighbours = {}
    for r in sorted(table, key=lambda r: r["neighbor"], reverse=True):
        neighbours.setdefault(r["keyword"], []).append((r["npmi"], r["neighbor"]))
    ranked = {k: [n for _, n in sorted(v, key=lambda x: -x[0])] for k, v in neighbours.items()}
    hub = words._hub(t)
    chosen = plain_expansion(ranked, hub)
    assert rows_of(spark, "ego_expand", "keyword", "hop") == sorted(chosen.items())
    near = {}
    for r in table:
        if r["keyword"] in chosen and r["neighbor"] in chosen:
            near.setdefault(r["keyword"], set()).add(r["neighbor"])
            near.setdefault(r["neighbor"], set()).add(r["keyword"])
    steps, todo = {hub: 0}, deque([hub])
    while todo:
        k = todo.popleft()
        for n in near.get(k, ()):
            if n not in steps:
                steps[n] = steps[k] + 1
                todo.append(n)
    assert rows_of(spark, "ego_shortest_hops", "keyword", "hop") == sorted((k, steps.get(k, hop)) for k, hop in chosen.items())
    assert len(chosen) > 10


def test_readers_of_landed_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"source": "s", "source_id": "1", "title": "t", "meta": {"a": "b"}}\n\n   \n{"source": "s", "source_id"\nnot json\n{"source": "s", "source_id": "2"}\n', encoding="utf-8")
    good, bad = ingest.read_jsonl(spark, str(tmp_path / "a.jsonl"))
    assert sorted((r["source_id"], r["title"], r["meta"]) for r in good.collect()) == [("1", "t", {"a": "b"}), ("2", None, None)]
    assert sorted(r["line"] for r in bad.collect()) == ["not json", '{"source": "s", "source_id"']
    (tmp_path / "feed.xml").write_text('<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><title>One &amp; two</title><link href="https://x.org/t?id=7"/><summary>s</summary><published>2024-01-02T03:04:05Z</published></entry><entry><title>No link</title></entry></feed>', encoding="utf-8")
    entries = ingest.read_feed(spark, str(tmp_path / "feed.xml"))
    assert sorted(((r["link"], r["title"]) for r in entries.collect()), key=str) == [("https://x.org/t?id=7", "One & two"), (None, "No link")]
    assert [(r["source_id"], r["title"], str(r["published_at"])) for r in ingest.feed_entries(entries).collect()] == [("7", "One & two", "2024-01-02 03:04:05")]


def test_news_table_of_a_database_is_read_with_its_filter_pushed_down(spark):
    """Against the embedded database that Spark itself brings along."""
    address, driver = "jdbc:derby:memory:news;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.createDataFrame([(f"https://x.org/{k}", f"t<b>{k}</b>", "d", f"2024-0{1 + k % 3}-05", "kw" if k % 2 else "") for k in range(9)], "link string, title string, description string, pub_date string, keyword string")
    rows.write.format("jdbc").options(url=address, dbtable="news", driver=driver, createTableColumnTypes="link VARCHAR(99), title VARCHAR(99), description VARCHAR(99), pub_date VARCHAR(20), keyword VARCHAR(20)").mode("overwrite").save()
    found = ingest.jdbc_import(spark, address, "news", "2024-02-01", driver)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(PUB_DATE,2024-02-01\)|PushedFilters: \[[^]]*>= .?2024-02-01", plan, re.I), plan
    got = sorted((r["url"], r["title"], r["published_at"], r["meta"]["keyword"]) for r in found.collect())
    assert got == sorted((f"https://x.org/{k}", f"t {k}", f"2024-0{1 + k % 3}-05", "kw" if k % 2 else "") for k in range(9) if k % 3)


def test_files_of_trends_and_graphs(spark, tmp_path):
    rows = spark.createDataFrame([("a, b", 2), ('q"x', 1)], "keyword string, n long")
    sinks.write_csv(rows, str(tmp_path / "trend"))
    raw = b"".join(p.read_bytes() for p in (tmp_path / "trend").glob("part-*.csv"))
    assert raw.startswith(b"\xef\xbb\xbfkeyword,n\n") and raw.count(b"\n") == 3
    assert sorted(map(tuple, sinks.read_csv(spark, str(tmp_path / "trend")).collect())) == [("a, b", "2"), ('q"x', "1")]
    sinks.write_graph(rows, rows.limit(0), str(tmp_path / "graph"))
    assert spark.read.json(str(tmp_path / "graph/nodes_json")).count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "graph/nodes_csv")).columns == ["keyword", "n"]


def test_index_tables_are_replaced(spark, tmp_path):
    first = spark.createDataFrame([("a", "w1", 1), ("b", "w2", 2)], "keyword string, week string, n long")
    again = spark.createDataFrame([("c", "w2", 3)], "keyword string, week string, n long")
    sinks.overwrite_index({"whole": first, "by_week": first}, str(tmp_path), {"by_week": "week"})
    sinks.overwrite_index({"whole": again, "by_week": again}, str(tmp_path), {"by_week": "week"})
    read = lambda name: sorted((r["keyword"], r["week"], r["n"]) for r in spark.read.parquet(str(tmp_path / name)).collect())
    assert read("whole") == [("c", "w2", 3)] and read("by_week") == [("a", "w1", 1), ("c", "w2", 3)]


def test_tokenizer_of_another_kind(spark):
    """Any function of a column serves; here Python code in Arrow batches, which cuts at capitals."""

    @F.pandas_udf("array<array<string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [re.findall("[A-Z][a-z]+", run) for run in t.split(".")])

    items = spark.createDataFrame([(1, "NewYork. Paris", "")], "id long, title string, summary string")
    assert {r["keyword"] for r in keywords.extract_keywords(items, cut).collect()} == {"New", "York", "New York", "Paris"}


def test_remembered_alerts_are_the_largest_ids(spark):
    """With more ids than are remembered the smallest are forgotten, and told again when they come late."""
    seen = spark.range(alerts.REMEMBERED).select("id")
    state = alerts.alert_state(seen, spark.range(alerts.REMEMBERED, alerts.REMEMBERED + 1))
    got = state.agg(F.count("*"), F.min("id"), F.max("id")).first()
    assert tuple(got) == (5000, 1, 5000)


def test_an_item_is_told_once_for_a_keyword(spark, tmp_path):
    hits = spark.createDataFrame([("k", 1), ("j", 1), ("k", 2)], "keyword string, id long")
    for k in range(2):
        hits.coalesce(1).write.parquet(str(tmp_path / f"in/a={k}"))
    stream = spark.readStream.schema("keyword string, id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    streams.stream_alerts(stream, str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert sorted((r["keyword"], r["id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("j", 1), ("k", 1), ("k", 2)]


def alert_runs(spark, folder, rows_of_batch, most=5000):
    """A function that streams all batches landed so far, and one that reads what was told, by batch."""
    for k, rows in enumerate(rows_of_batch):
        spark.createDataFrame(rows, "keyword string, id long, title string").coalesce(1).write.parquet(f"{folder}/in/b={k}")

    def run():
        stream = spark.readStream.schema("keyword string, id long, title string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        streams.stream_alerts(stream, f"{folder}/state", f"{folder}/out", f"{folder}/checkpoint", most)

    def told():
        return sorted((r["batch"], r["keyword"], r["id"], r["title"]) for r in spark.read.parquet(f"{folder}/out").collect())

    return run, told


@pytest.mark.parametrize("crash", ["before output", "after output", "after state"])
def test_alerts_are_told_once_wherever_a_batch_breaks_off(spark, tmp_path, crash):
    batches = [[("a", k, f"t{k}") for k in range(10)], [("a", k, "again") for k in range(5, 15)] + [("b", 20, "y"), ("b", 20, "x")]]
    run, told = alert_runs(spark, tmp_path, batches)
    run()
    first = told()
    assert first == sorted([(0, "a", k, f"t{k}") for k in range(10)] + [(1, "a", k, "again") for k in range(10, 15)] + [(1, "b", 20, "x")])
    last = tmp_path / "checkpoint/commits/1"
    last.unlink()
    (last.parent / ".1.crc").unlink(missing_ok=True)
    if crash != "after state":
        shutil.rmtree(tmp_path / "state/slot=1")
    if crash == "before output":
        shutil.rmtree(tmp_path / "out/batch=1")
    run()
    assert told() == first
    run()  # nothing landed since
    assert told() == first


def test_one_more_than_is_remembered_forgets_the_least(spark, tmp_path):
    batches = [[("a", k, "t") for k in range(5001)], [("a", 0, "t"), ("a", 1, "t"), ("a", 5000, "t")], [("a", 1, "t"), ("a", 2, "t")]]
    run, told = alert_runs(spark, tmp_path, batches)
    run()
    # 0 was forgotten, told again, and not remembered, as it is the least
    assert [(b, i) for b, _, i, _ in told() if b] == [(1, 0)]


def test_late_rows_are_kept_aside_and_a_batch_run_again_counts_once(spark, tmp_path):
    at = lambda *days: spark.createDataFrame([(d, f"2024-01-{d:02d} 00:00:00") for d in days], "event_id long, ts string").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    path = [str(tmp_path / x) for x in ("counts", "late", "edges")]
    work = lambda checkpoint: lambda s: streams.route_late(s, "ts", "5 days", *path, str(tmp_path / checkpoint))
    streams.replay(at(2, 3, 10, 20), work("first"), 2, then=at(4, 16))
    expected = [("2024-01-01", 2, 1, 3), ("2024-01-08", 1, 0, 1), ("2024-01-15", 2, 0, 2)]
    assert sorted(tuple(r) for r in streams.routed_counts(spark, *path[:2]).collect()) == expected
    assert [r["event_id"] for r in spark.read.parquet(path[1]).collect()] == [4]
    streams.replay(at(2, 3, 10, 20), work("second"), 2, then=at(4, 16))
    assert sorted(tuple(r) for r in streams.routed_counts(spark, *path[:2]).collect()) == expected


def test_all_pairs_and_classes_of_titles_agree(spark):
    t = registry.tables(spark, SF)
    titles = t.base.select(F.col("published_week").alias("week"), "id", "title")
    members, close = digest.title_classes(titles, reviews.TITLE_CUT)
    rep = {r["id"]: (r["week"], r["rep"]) for r in members.collect()}
    linked = {(r["week"], r["a"], r["b"]) for r in close.collect()}
    by_week = {}
    for i, (week, r) in rep.items():
        by_week.setdefault(week, []).append((i, r))
    expected = set()
    for week, found in by_week.items():
        for i, r in found:
            for j, s in found:
                if i < j and (r == s or (week, min(r, s), max(r, s)) in linked):
                    expected.add((week, i, j))
    assert {tuple(r) for r in digest.title_pairs(titles, reviews.TITLE_CUT).collect()} == expected


@pytest.mark.parametrize(("block", "held"), [(1 << 24, 1 << 22), (40, 1 << 22), (300, 7)])
def test_cooccurrence_is_brute_force(spark, monkeypatch, block, held):
    """Also where blocks are split by document and counts are added up again and again."""
    monkeypatch.setattr(index, "BLOCK_PAIRS", block)
    monkeypatch.setattr(index, "HELD_PAIRS", held)
    rng = random.Random(8)
    docs = {i: {w for w in map(str, range(14)) if rng.random() < 0.4} | {"hot"} for i in range(60)} | {99: set(), 100: {"alone"}}
    rows = spark.createDataFrame([(i, w) for i, ws in docs.items() for w in ws], "item_id long, keyword string")
    df = index.kw_df(rows)
    counts = Counter(p for ws in docs.values() for p in combinations(sorted(ws), 2))
    for least in (1, 12):
        got = {(r["a"], r["b"]): r["n"] for r in index.cooccurrence(rows, df, 2, least=least).collect()}
        assert got == {p: n for p, n in counts.items() if n >= least}
    assert index.cooccurrence(rows.limit(0), df.limit(0), 2).count() == 0


@pytest.mark.parametrize("dense", [0, 1 << 24])
def test_pairs_counted_in_a_table_and_by_sorting(spark, monkeypatch, dense):
    monkeypatch.setattr(index, "DENSE", dense)
    rng = random.Random(9)
    docs = {i: {f"k{min(rng.randrange(60), rng.randrange(60)):02d}" for _ in range(rng.choice((1, 5, 30)))} for i in range(200)}
    rows = spark.createDataFrame([(i, w) for i, ws in docs.items() for w in ws], "item_id long, keyword string")
    df = index.kw_df(rows)
    counts = Counter(p for ws in docs.values() for p in combinations(sorted(ws), 2))
    for block in (1 << 24, 300):
        monkeypatch.setattr(index, "BLOCK_PAIRS", block)
        assert {(r["a"], r["b"]): r["n"] for r in index.cooccurrence(rows, df, 1).collect()} == counts
    named = index.neighbors(index.cooccurrence(rows, df, 3), df, ("k01",), cut=0.05, top=4)
    numbers = index.counted_neighbors(*index.pair_counts(rows, df, 3), ("k01",), cut=0.05, top=4)
    assert sorted(map(tuple, named.collect())) == sorted(map(tuple, numbers.collect())) != []


def test_scratch_on_a_cluster_needs_the_shared_folder():
    def session(master, folder=None):
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": folder} if folder else {}), conf=SimpleNamespace(get=lambda *_: None, set=lambda *_: None))

    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_folder(session(master))
        assert shared_folder(session(master, "hdfs://shared")) == "hdfs://shared"
    assert "crossweave" in shared_folder(session("local[8]")) and "crossweave" in shared_folder(session("local"))


@pytest.mark.parametrize("cut", [0.22, 0.5, 0.9, 1.0])
def test_title_pairs_are_brute_force(spark, cut):
    titles = [(k, x) for k, x in enumerate(["abcdef", "abcdeg", "bcdefg", "abcdefghijkl", "xyzxyz", "a-b c!def", "abc", None, "zzzzzz", "ghijklabcdef", "abcdef"])]
    df = spark.createDataFrame([("w", k, x) for k, x in titles], "week string, id long, title string")
    g = {k: pairs_of(x) for k, x in titles}
    expected = {(i, j) for i in g for j in g if i < j and min(len(g[i]), len(g[j])) >= 4 and len(g[i] & g[j]) / min(len(g[i]), len(g[j])) >= cut}
    assert {(r["a"], r["b"]) for r in digest.title_pairs(df, cut).collect()} == expected


@pytest.mark.parametrize("dense", [0, 400, 1 << 26])
def test_strongest_neighbors_without_a_table_of_pairs(spark, monkeypatch, dense):
    """The same as from all pairs, with ties, keywords that hold others, and stop words; a number is dealt to as many tiles as there are groups, at most."""
    monkeypatch.setattr(index, "DENSE", dense)
    rng = random.Random(11)
    names = [f"k{n}" for n in range(40)]  # k1 is held by k10 to k19
    docs = {i: {names[min(rng.randrange(40), rng.randrange(40))] for _ in range(rng.choice((2, 5, 20)))} for i in range(150)}
    rows = spark.createDataFrame([(i, w) for i, ws in docs.items() for w in ws], "item_id long, keyword string")
    df = index.kw_df(rows)
    for stop, top in (((), 3), (("k01", "k7"), 4)):
        named = index.neighbors(index.cooccurrence(rows, df, 3), df, stop, cut=0.02, top=top)
        got = index.strongest_neighbors(rows, df, stop, 3, cut=0.02, top=top)
        assert sorted(map(tuple, named.collect())) == sorted(map(tuple, got.collect())) != []
    coded, lists = index._coded(rows, df, 1, None)
    groups = index._groups(spark, coded.count())
    sent = sum(len(r["a"]) + len(r["b"]) for r in index._dealt(lists, groups).collect()) // 2
    assert sent <= (groups + 1) * sum(map(len, docs.values()))
    assert index.strongest_neighbors(rows.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [3, 4096])
def test_title_tiles_deal_only_their_classes(spark, monkeypatch, tile):
    """Titles of a few characters meet on every pair of them; what leaves the tiles are close pairs alone, each once."""
    monkeypatch.setattr(digest, "TILE", tile)
    rng = random.Random(12)
    titles = [(f"w{k % 2}" if k % 9 else None, k, "".join(rng.choice("abc") for _ in range(rng.choice((5, 8, 12))))) for k in range(90)]
    df = spark.createDataFrame(titles, "week string, id long, title string")
    sets = {k: (w, pairs_of(x)) for w, k, x in titles}
    expected = {(i, j) for i, (v, g) in sets.items() for j, (w, h) in sets.items() if i < j and v == w and v and min(len(g), len(h)) >= 4 and len(g & h) / min(len(g), len(h)) >= 0.8}
    got = [(r["a"], r["b"]) for r in digest.title_pairs(df, 0.8).collect()]
    assert set(got) == expected and len(got) == len(expected)
    close = digest.title_classes(df, 0.8)[1]
    assert "Aggregate" not in close._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
