"""The index after changes by signed counts against the index made anew."""

from __future__ import annotations

import random
import shutil
from itertools import combinations

import pytest

from crossweave.operators import deltas
from crossweave.sources.adapter import Tables

LEAST = 3


def tables(spark, docs):
    """docs: id -> (keywords, week, kept, axes)"""
    keywords = spark.createDataFrame([(i, k, w) for i, (ks, w, _, _) in docs.items() for k in ks], "item_id long, keyword string, week string")
    items = spark.createDataFrame([(i, w, kept) for i, (_, w, kept, _) in docs.items()], "id long, published_week string, kept boolean")
    axes = spark.createDataFrame([(i, a) for i, (_, _, _, ax) in docs.items() for a in ax], "item_id long, axis string")
    return keywords, items, axes


def rebuilt(docs):
    week, df, axis, pairs = {}, {}, {}, {}
    for ks, w, kept, ax in docs.values():
        for k in ks:
            df[k] = df.get(k, 0) + 1
            if kept and w:
                week[k, w] = week.get((k, w), 0) + 1
            for a in ax:
                axis[k, a] = axis.get((k, a), 0) + 1
    for ks, _, _, _ in docs.values():
        for p in combinations(sorted(k for k in ks if df[k] >= LEAST), 2):
            pairs[p] = pairs.get(p, 0) + 1
    best = {k: min(((-n, a) for (j, a), n in axis.items() if j == k), default=(0, None))[1] for k in df if df[k] >= LEAST}
    return week, df, best, pairs


def stored(spark, path, number):
    week = {(r["keyword"], r["week"]): r["n"] for r in deltas.read(spark, path, "kw_week", number).collect()}
    df = {r["keyword"]: r["df"] for r in deltas.kw_df(spark, path, number).collect()}
    best = {r["keyword"]: r["axis"] for r in deltas.kw_meta(spark, path, number, LEAST).collect()}
    return week, df, best, {(r["a"], r["b"]): r["n"] for r in deltas.pair_counts(spark, path, number, LEAST).collect()}


def doc(r):
    return (r.sample("abcdefghij", r.randint(0, 5)), r.choice(["2024-W01", "2024-W02", "2024-W03", None]), r.choice([True, False, None]), r.sample(["x", "y"], r.randint(0, 2)))


def test_changes_give_the_index_made_anew(spark, tmp_path):
    """Items that change, come and go; a change that broke off is run again, and old versions stay readable."""
    r, path = random.Random(4), str(tmp_path / "index")
    docs = {i: doc(r) for i in range(20)}
    keywords, items, axes = tables(spark, docs)
    pairs = spark.createDataFrame([(a, b, n) for (a, b), n in rebuilt(docs)[3].items()], "a string, b string, n long")
    deltas.begin(path, keywords, items, axes, pairs, LEAST, 4)
    assert stored(spark, path, 0) == rebuilt(docs)
    changes = [{i: doc(r) for i in (1, 5, 9, 30, 31)} | {2: None, 3: None}, dict.fromkeys(range(32)) | {40: doc(r)}]
    history = [docs]
    for number, change in enumerate(changes, 1):
        later = {i: d for i, d in (history[-1] | change).items() if d is not None}
        ids = spark.createDataFrame([(i,) for i in change], "id long")
        (keywords, *now), (_, *was) = tables(spark, later), tables(spark, history[-1])
        for again in range(2 if number == 1 else 1):
            deltas.change(path, number, ids, keywords, tuple(was), tuple(now), True, LEAST, 4)
            assert stored(spark, path, number) == rebuilt(later)
            if number == 1 and not again:  # some parts of the version were not written
                for name in ("rows", "kw_df", "pairs"):
                    shutil.rmtree(next((tmp_path / "index" / name).glob("part=*/upto=1")))
        history.append(later)
    assert [stored(spark, path, k) for k in range(3)] == [rebuilt(d) for d in history]


def test_only_touched_parts_are_written_and_nothing_for_no_change(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = {i: (["a", f"k{i}"], "2024-W01", True, ["x"]) for i in range(40)}
    keywords, items, axes = tables(spark, docs)
    deltas.begin(path, keywords, items, axes, parts=16)
    later = docs | {7: (["a", "new"], "2024-W01", True, ["x"])}
    now = tables(spark, later)
    deltas.change(path, 1, spark.createDataFrame([(7,), (8,)], "id long"), now[0], (items, axes), now[1:], parts=16)
    written = {name: sorted(p.parent.name for p in (tmp_path / "index" / name).glob("part=*/upto=1")) for name in ("rows", "kw_df", "n_docs")}
    assert len(written["rows"]) == 1 and 1 <= len(written["kw_df"]) <= 2 and not written["n_docs"]
    assert {r["keyword"]: r["n"] for r in deltas.read(spark, path, "kw_df", 1).collect()} == rebuilt(later)[1]


def test_items_that_are_not_those_of_the_index_raise(spark, tmp_path):
    path = str(tmp_path / "index")
    keywords, items, axes = tables(spark, {1: (["a"], "2024-W01", False, [])})
    deltas.begin(path, keywords, items, axes)
    wrong = tables(spark, {1: (["a"], "2024-W01", True, [])})
    with pytest.raises(Exception, match="a count below 0"):
        deltas.change(path, 1, spark.createDataFrame([(1,)], "id long"), keywords.limit(0), wrong[1:], (items.limit(0), axes))


def test_an_index_begins_empty(spark, tmp_path):
    path = str(tmp_path / "index")
    none, items, axes = tables(spark, {})
    deltas.begin(path, none, items, axes)
    keywords, *now = tables(spark, {1: (["a", "b"], "2024-W01", True, ["x"])})
    deltas.change(path, 1, spark.createDataFrame([(1,)], "id long"), keywords, (items, axes), tuple(now))
    assert [tuple(r) for r in deltas.kw_df(spark, path, 1).sort("keyword").collect()] == [("a", 1, 1), ("b", 1, 1)]
    assert deltas.read(spark, path, "kw_df", 0).count() == 0


def test_an_index_of_rows_alone_keeps_a_list_for_each_item(spark, tmp_path):
    """Without items and axes there are no tables of weeks and axes; an item's keywords are a list, which a change replaces."""
    path = str(tmp_path / "index")
    docs = {i: (["a", f"k{i % 3}", "b"][: 1 + i % 3], "2024-W01", True, []) for i in range(12)}
    deltas.begin(path, tables(spark, docs)[0], None, None, parts=4)
    later = {i: d for i, d in (docs | {4: (["a", "k1"], None, True, [])}).items() if i != 5}
    deltas.change(path, 1, spark.createDataFrame([(4,), (5,), (6,)], "id long"), tables(spark, later)[0], (None, None), (None, None), parts=4)
    assert sorted(p.name for p in (tmp_path / "index").iterdir()) == ["kw_df", "n_docs", "rows"]
    lists = deltas.read(spark, path, "rows", 1).collect()
    assert {r["item_id"]: (sorted(r["keywords"]), r["week"]) for r in lists} == {i: (sorted(set(d[0])), d[1]) for i, d in later.items()} and len(lists) == len(later)
    assert {r["keyword"]: r["df"] for r in deltas.kw_df(spark, path, 1).collect()} == rebuilt(later)[1]
    assert {(r["a"], r["b"]): r["n"] for r in deltas.counted_pairs(spark, path, 1, LEAST).collect()} == rebuilt(later)[3]


def test_pairs_after_a_change_read_no_scores(spark, sf_dir):
    """pair_delta needs neither facts nor axes, so it makes neither."""
    from crossweave.plans import words

    t = Tables(spark, sf_dir)
    assert words.pair_delta(t).count() > 0
    assert not {"facts", "item_axes", "scored"} & set(vars(t))
