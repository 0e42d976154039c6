"""Pairs are counted from numbers that are stored once, whatever the number of groups of keywords."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from pyspark.sql import functions as F

from crossweave.operators import digest, index
from crossweave.plans import registry


def _words(spark, seed):
    rng = random.Random(seed)
    docs = {i: {f"k{min(rng.randrange(90), rng.randrange(90))}" for _ in range(rng.choice((1, 4, 25)))} for i in range(160)}
    rows = spark.createDataFrame([(i, w) for i, ws in docs.items() for w in ws], "item_id long, keyword string")
    return docs, rows, index.kw_df(rows)


def test_numbers_are_stored_once(spark):
    docs, rows, df = _words(spark, 3)
    coded, lists = index._coded(rows, df, 1, None)
    numbers = sum(len(ws) for ws in docs.values() if len(ws) > 1)
    for groups in (1, 4, 30):
        stored = index._dealt(lists, groups).collect()
        assert sum(len(r["a"]) for r in stored) == 2 * numbers
        assert sum(np.frombuffer(r["b"], np.uint16).sum() for r in stored) == numbers


@pytest.mark.parametrize("held,block", [(40, 1 << 20), (1 << 21, 25), (40, 25)])
def test_pairs_over_chunks_and_blocks(spark, monkeypatch, held, block):
    """Documents in many chunks, keywords whose pairs are counted in several turns, several groups: the counts and neighbours of all pairs."""
    monkeypatch.setattr(index, "HELD_PAIRS", held)
    monkeypatch.setattr(index, "BLOCK_PAIRS", block)
    monkeypatch.setattr(index, "DENSE", 900)
    docs, rows, df = _words(spark, 4)
    counts = Counter(p for ws in docs.values() for p in combinations(sorted(ws), 2))
    pairs = index.cooccurrence(rows, df, 1)
    assert {(r["a"], r["b"]): r["n"] for r in pairs.collect()} == counts
    named = index.neighbors(pairs, df, ("k1",), 2, cut=-0.5, top=3)
    got = index.strongest_neighbors(rows, df, ("k1",), 1, 2, cut=-0.5, top=3)
    assert sorted(map(tuple, named.collect())) == sorted(map(tuple, got.collect())) != []


def test_pairs_have_their_names_where_they_are_counted(spark, monkeypatch):
    """Long runs copied, few pairs at a time, several groups: the counts of all pairs by name, which no join looks up."""
    for name, value in (("LONG_RUNS", 0), ("TOLD", 7), ("DENSE", 900)):
        monkeypatch.setattr(index, name, value)
    docs, rows, df = _words(spark, 5)
    counts = Counter(p for ws in docs.values() for p in combinations(sorted(ws), 2))
    pairs = index.cooccurrence(rows, df, 1)
    assert "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["a"], r["b"]): r["n"] for r in pairs.collect()} == counts
    assert {(r["a"], r["b"]): r["n"] for r in index.cooccurrence(rows, df, 1, least=3).collect()} == {p: n for p, n in counts.items() if n >= 3}


def test_first_of_many_ties():
    """Ties of one kind are cut by their codes, and those that hold the keyword do not use up the room."""
    names = ["ab"] * 50 + [f"n{k}" for k in range(100)]
    spots, score, kind = np.arange(150), np.append(np.full(50, 2.0), np.full(100, 1.0)), np.append(np.full(50, 7), np.full(100, 8))
    assert index._first("a", score, spots, kind, spots, names, 3) == [149, 148, 147]
    kinds = np.append(np.full(50, 7), np.arange(100) % 2)
    assert sorted(index._first("x", score, spots, kinds, spots, names, 60)) == list(range(150))


def test_titles_are_written_once(spark, monkeypatch):
    """Classes lie in one tile each, however many tiles they meet; pairs are those of brute force."""
    monkeypatch.setattr(digest, "TILE", 8)
    rng = random.Random(5)
    rows = [("2024-W01" if n % 3 else "2024/W02", n, "".join(rng.choice("abcd") for _ in range(rng.choice((2, 9, 14))))) for n in range(90)]
    df = spark.createDataFrame(rows, "week string, id long, title string")
    members, close = digest.title_classes(df, 0.5)
    kinds = members.select("week", F.col("rep")).distinct().join(df.withColumnRenamed("id", "rep"), ["week", "rep"])
    stored = digest._tiles(kinds.select("week", "rep", F.array(F.col("rep")).alias("g")))
    assert spark.read.parquet(stored).count() == kinds.count() > 24
    gram = {n: {t[k : k + 2] for k in range(len(t) - 1)} for _, n, t in rows}
    week = {n: w for w, n, _ in rows}
    reps = sorted(r["rep"] for r in kinds.collect())
    expected = {(week[a], a, b) for a, b in combinations(reps, 2) if week[a] == week[b] and len(gram[a] & gram[b]) / min(len(gram[a]), len(gram[b])) >= 0.5}
    assert sorted(map(tuple, close.collect())) == sorted(expected) != []


def test_title_pairs_are_told_where_they_are_found(spark, monkeypatch):
    """All pairs of close titles over several tiles, equal ones in large groups and an id that comes twice among them; no join,
    broadcast or shuffle has the pairs."""
    monkeypatch.setattr(digest, "TILE", 16)
    monkeypatch.setattr(digest, "TOLD", 5)
    monkeypatch.setattr(digest, "NAMES", 7)
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcd") for _ in range(rng.choice((2, 9, 14)))) for _ in range(60)] + ["abcdabca"] * 50
    rows = [("2024-W01" if n % 3 else "2024/W02", n, text) for n, text in enumerate(texts)]
    rows += [("2024-W01", 3, "dcbadcbd"), (None, 500, "abcdabca"), ("2024-W01", None, "abcdabca")]
    found = digest.title_pairs(spark.createDataFrame(rows, "week string, id long, title string"), 0.5)
    told = found._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")
    assert len(told) == 2 and "Join" not in told[0] and "Repartition" not in told[0]
    sets = [(w, n, {t[k : k + 2] for k in range(len(t) - 1)}) for w, n, t in rows if w and n is not None]
    sets = [s for s in sets if len(s[2]) >= 4]
    pairs = [(x, y) if x[1] < y[1] else (y, x) for x, y in combinations(sets, 2) if x[0] == y[0] and x[1] != y[1]]
    expected = [(x[0], x[1], y[1]) for x, y in pairs if len(x[2] & y[2]) / min(len(x[2]), len(y[2])) >= 0.5]
    assert sorted(map(tuple, found.collect())) == sorted(expected) != []


def test_title_containment_has_the_reference_cut(spark, sf_dir):
    """The registered query tells all pairs at the operator's own cut (the reference's 0.22), not near copies alone."""
    titles = registry.tables(spark, sf_dir).base.select("published_week", "id", "title").collect()
    sets = {}
    for week, n, title in titles:
        s = "".join(c for c in title or "" if c.isalnum())
        sets[n] = (week, {s[k : k + 2] for k in range(len(s) - 1)})
    large = {n: s for n, s in sets.items() if len(s[1]) >= 4}
    expected = {(large[a][0], a, b) for a, b in combinations(sorted(large), 2) if large[a][0] == large[b][0] and len(large[a][1] & large[b][1]) / min(len(large[a][1]), len(large[b][1])) >= 0.22}
    assert {tuple(r) for r in registry.QUERIES["title_containment"](spark, sf_dir).collect()} == expected
    assert digest.CUT == 0.22
