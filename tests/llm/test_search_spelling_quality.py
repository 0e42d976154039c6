"""Lexical search, spelling variants and quality scores against plain versions, with awkward input."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from crossweave.llm import lexical, quality, spelling
from crossweave.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def frame(spark, rows, columns="doc_id long, text string"):
    """Rows with columns besides that clash with what the operators make."""
    return spark.createDataFrame(rows, columns).selectExpr("*", "'x' as score", "'y' as term", "1 as word", "2 as n", "3 as label", "4 as q")


def plain_search(docs, items, k=50):
    terms = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    terms = [(i, c) for i, c in terms if c]
    total, count = sum(sum(c.values()) for _, c in terms), len(terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        asked = set(TERM.findall((text or "").translate(LOWER)))
        found = []
        for i, c in terms:
            m = 50 + 50 * sum(c.values()) * count // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    pool = [f"t{k}" for k in range(400)] + ["Über", "über", "ÜBER", "naïve", "a.b", "x_y", "日本語"]
    rows = [(k, " ".join(rng.choice(pool[: rng.choice((20, 100, 407))]) for _ in range(rng.choice((1, 5, 40, 400))))) for k in range(300)]
    rows += [(1000 + k, "the same words in every one of many copies") for k in range(120)]
    rows += [(2000, None), (2001, ""), (2002, " ._-!\t"), (None, "t1 t2 copies"), (7, "t1 t2 t3"), (7, "t1 t2 t3"), (2003, "Long " + " ".join(f"t{k % 390}" for k in range(60_000)))]
    rng.shuffle(rows)
    return rows


ITEMS = [(0, "t1 t2 T3 t3 über"), (1, None), (2, ""), (3, "same copies of many"), (4, "nothing-known_here"), (5, " ".join(f"t{k}" for k in range(300))), (5, "日本語 x y"), (None, "naïve b")]


def test_search_is_the_plain_ranking(spark, texts):
    docs, items = frame(spark, texts).repartition(5), frame(spark, ITEMS, "item_id long, text string")
    for block, k in ((lexical.BLOCK_CHARS, 50), (2000, 50), (2000, 3)):
        found = lexical.search(lexical.build_index(docs, block), items, k).collect()
        assert sorted(map(tuple, found), key=str) == plain_search(texts, ITEMS, k)


def test_search_in_several_passes_and_of_nothing(spark, texts, monkeypatch):
    docs, items = frame(spark, texts), frame(spark, ITEMS, "item_id long, text string")
    index = lexical.build_index(docs)
    monkeypatch.setattr(lexical, "TERMS_AT_ONCE", 4)
    assert sorted(map(tuple, lexical.search(index, items).collect()), key=str) == plain_search(texts, ITEMS)
    assert lexical.search(index, items.limit(0)).count() == 0
    empty = lexical.search(lexical.build_index(docs.limit(0)), items)
    assert empty.count() == 0 and empty.columns == ["item_id", "rank", "doc_id", "score"]


def test_blocks_are_written_and_read_one_at_a_time(spark, monkeypatch):
    """A task with many blocks has each in a row group of its own, and Python code gets one at a time, whatever their number."""
    rng = random.Random(8)
    docs = spark.createDataFrame([(n, " ".join(f"w{rng.randrange(10**9)}" for _ in range(90_000))) for n in range(6)], "doc_id long, text string").coalesce(1)
    index = lexical.build_index(docs, 1 << 19)
    groups = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in index.inputFiles()]
    assert [m.row_group(k).num_rows for m in groups for k in range(m.num_row_groups)] == [1] * index.count() == [1] * 3
    index = index.coalesce(1)
    sizes = []
    save = lexical.save

    def watched(df, name, options=None):
        if name == "found":
            sizes.extend(r["n"] for r in index.select("height").mapInArrow(lambda batches: (pa.record_batch([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long").collect())
        return save(df, name, options)

    monkeypatch.setattr(lexical, "save", watched)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    items = spark.createDataFrame([(1, docs.first()["text"][:200])], "item_id long, text string")
    assert lexical.search(index, items, 1).first()["doc_id"] == 0
    assert sizes == [1] * 3 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_treap_keeps_all_cells(spark):
    rng = np.random.default_rng(3)
    grid = np.where(rng.random((37, 90)) < 0.1, rng.integers(1, 10**6, (37, 90)), 0)
    row, col = np.nonzero(grid)
    tree = lexical.Treap.unpack(*lexical.Treap.pack(row, col, grid[row, col], 7), 7)
    assert tree.maxima[0] == grid.max()
    ids = np.arange(90) * 2
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for _ in range(20):
        rows, weights = rng.choice(37, 5, replace=False), rng.integers(1, 100, 5)
        total = weights @ grid[rows]
        scores, found = tree.best(rows, weights, ids, 10, none)
        expected = [k for k in np.lexsort((ids, -total)) if total[k]][:10]
        assert found.tolist() == ids[expected].tolist() and scores.tolist() == total[expected].tolist()


def test_search_query_has_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    assert sorted(map(tuple, QUERIES["op11_lexical_search"](spark, sf_dir).collect())) == sorted(con.sql(ORACLES["op11_lexical_search"]).fetchall())


def plain_variants(docs):
    n = Counter()
    for i, text in docs:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = word.translate(LOWER)
            mark = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if mark % 31 == 0:
                at = mark % len(word)
                word = word[:at] + word[at + 1 :]
            n[word] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: set() for w in n}
    letters = sorted(set("".join(n)))
    for w in n:
        for k in range(len(w) + 1):
            tries = {w[:k] + w[k + 1 :]} | {w[:k] + c + w[k:] for c in letters} | {w[:k] + c + w[k + 1 :] for c in letters}
            for v in tries & n.keys() - {w}:
                near[w].add(v)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def test_spelling_is_the_plain_grouping(spark):
    rng = random.Random(12)
    alphabet = "abcÀÿ÷"
    base = ["".join(rng.choice(alphabet) for _ in range(rng.choice((7, 8, 9, 12)))) for _ in range(40)] + ["straßen", "x" * 3000]
    often = {w: rng.choice((1, 2, 15, 300)) for w in base}
    rows = []
    for k in range(400):
        words = []
        for _ in range(30):
            w = rng.choices(base, [often[b] for b in base])[0]
            if rng.random() < 0.15:
                at = rng.randrange(len(w))
                w = rng.choice((w[:at] + w[at + 1 :], w[:at] + rng.choice(alphabet) + w[at:], w[:at] + rng.choice(alphabet) + w[at + 1 :]))
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        rows.append((k, "; ".join(words)))
    rows += [(600, "chainlet " * 200 + "chainlets " * 20 + "chainletts " * 2)]
    rows += [(500, None), (501, ""), (502, "1234 ..."), (None, rows[0][1]), (3, rows[3][1])]
    docs = frame(spark, rows)
    expected = plain_variants(rows)
    assert len({r[2] for r in expected if r[1]}) > 5 and any(r[2] != r[1] for r in expected if r[1])
    for tile in (spelling.TILE, 16):  # the small tiles make most keys hot
        found = spelling.variants(docs, tile)
        assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert sorted(map(tuple, found.collect())) == expected
    assert spelling.variants(docs.limit(0)).count() == 0


def test_spelling_query_is_the_plain_grouping(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op12_spelling_variants"](spark, sf_dir).collect())) == plain_variants(docs)


def test_quality_of_held_out_documents(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op13_quality_classifier"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert len(rows) == docs.count()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for i, r in rows.items())
    held = [(rows[i]["score"], label) for i, label in labels.items() if i in rows and rows[i]["held_out"]]
    good, bad = [s for s, label in held if label], [s for s, label in held if not label]
    assert len(bad) > 5 and np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([(s >= 0.7) == label for s, label in held]) > 0.93


def test_quality_reads_only_text_and_is_repeatable(spark):
    rng = random.Random(13)
    good = lambda: " ".join(rng.choice(("plain", "words", "of", "prose,", "and", "more.")) for _ in range(40))
    bad = lambda: " ".join(rng.choice(("buy$$$", "###", "NOW!!!", "%%%")) for _ in range(40))
    rows = [(k, good() if k % 3 else bad()) for k in range(200)]
    extra = [(300, None), (301, ""), (302, " \n\t"), (None, rows[1][1]), (1, rows[1][1]), (303, rows[1][1]), (304, "plain words " * 40_000)]
    docs = frame(spark, rows + extra)
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(200)] + [(1, 1), (2, None), (300, 1), (None, 0), (5, 7), (9999, 1)], "doc_id long, quality int").selectExpr("*", "'z' as text", "'w' as label")
    found = quality.judge(docs, labels)
    assert dict(found.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    out = found.collect()
    assert len(out) == len(rows) + len(extra)
    by_id: dict = {}
    for r in out:
        by_id.setdefault(r["doc_id"], []).append((r["score"], r["predicted"]))
    assert len(set(by_id[1] + by_id[None] + by_id[303])) == 1  # the same text, the same score, whatever the id
    assert len(set(by_id[300] + by_id[301] + by_id[302])) == 1
    assert all(by_id[k][0][1] == int(k % 3 > 0) for k in range(200)) and by_id[304][0][1] == 1
    again = quality.judge(docs.repartition(7), labels.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    # labels of held-out rows teach nothing
    turned = labels.withColumn("quality", quality.F.expr("if(pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2, 1 - quality, quality)"))
    assert sorted(map(str, quality.judge(docs, turned).collect())) == sorted(map(str, out))


def test_quality_without_labels_or_rows(spark):
    docs = frame(spark, [(1, "a b"), (2, None)])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality.judge(docs, labels).collect()] == [0.5, 0.5]
    one_class = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert [r["predicted"] for r in quality.judge(docs, one_class).collect()] == [0, 0]
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_mean_of_vectors_is_what_the_table_gives():
    rng = np.random.default_rng(4)
    model = quality.Model(rng.normal(size=(quality.BUCKETS, 16)).astype(np.float32), rng.normal(size=(16, 2)).astype(np.float32), np.array([0.1, -0.3], np.float32))
    table, bias = model.table()
    n = quality.features("Some words, and then and then more words.\n\n" * 9)
    mean = (n / n.sum()) @ model.vectors.astype(np.float64)
    odds = np.exp(mean @ model.weights + model.bias)
    assert 1 / (1 + math.exp(-(n @ table / n.sum() + bias))) == pytest.approx(odds[1] / odds.sum(), abs=1e-5)
