"""The operators of the subpackage against brute force, round trips and held-out accuracy, with awkward input."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from html.parser import HTMLParser
from itertools import combinations

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from crossweave.llm import fingerprints, html_text, langid, mixing, ngram_join, packing, sharding, token_store, urls, vectors
from crossweave.llm.queries import QUERIES
from crossweave.llm.shared import shingle_sets
from crossweave.llm.tokens import default_tokenizer, encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    """Documents with columns besides that clash with what operators make."""
    df = spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s in rows], DOCS)
    return df.withColumn("size", F.lit("x")).withColumn("component_id", F.lit("y")).withColumn("score", F.lit("z")).withColumn("fingerprint", F.lit(1))


def words(rng, n, pool=4000):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def brute_components(rows, percent=80):
    sets = {i: shingles(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * shared >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "a b c d"), (6, "A B\tC D"), (7, "a b c e"), (8, "!!! ???"), (9, words(rng, 20_000))]
    rows.append((10, rows[-1][1].replace("w1 ", "v1 ")))
    common = words(rng, 60)
    for k in range(60):  # a passage that many share
        rows.append((100 + k, f"{words(rng, 80)} {common} {words(rng, 60)}"))
    base = words(rng, 150).split()
    for k in range(120):  # near copies with more and more changes, around the bound
        copy = list(base)
        for _ in range(rng.randrange(0, 7)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        rows.append((300 + k, " ".join(copy)))
    for k in range(40):  # small ones around every band's edge
        n = 5 + k
        text = words(rng, n)
        rows += [(1000 + 2 * k, text), (1001 + 2 * k, text + f" tail{k}")]
    rows += [(5000 + k, "the very same text in a large group of copies of it") for k in range(50)]
    rng.shuffle(rows)
    langs = ["en", "fr", None]
    return [(i, t, langs[i % 3], None if i % 11 == 0 else f"src{i % 4}") for i, t in rows]


def test_ngram_join_is_brute_force(spark, corpus):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(table(spark, corpus)).collect()}
    expected = brute_components(corpus)
    assert got == {i: (len(shingles(t)), expected[i]) for i, t, *_ in corpus}
    assert ngram_join.join(table(spark, corpus).limit(0)).count() == 0


def test_ngram_join_rows_without_or_with_the_same_id(spark):
    rows = [(None, "a b c d e f", None, None), (None, "a b c d e f", None, None), (1, "a b c d e f", None, None), (1, "other words that are here too", None, None), (2, "a b c d e f", None, None)]
    got = sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.join(table(spark, rows)).collect()), key=str)
    assert got == [(1, 1), (1, 1), (2, 1), (None, None), (None, None)]
    kept = ngram_join.one_of_each(table(spark, rows)).collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == [1, None, None]


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 300, np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(200, 300)], rng.integers(0, 2**63, 40, np.uint64)]))
        x, y = (np.unpackbits(np.frombuffer(ngram_join.sketch(s), np.uint8)) for s in (a, b))
        apart = len(set(a.tolist()) ^ set(b.tolist()))
        assert (x != y).sum() <= apart
        p, q = (set(ngram_join.block_keys(s, 8).tolist()) for s in (a, b))
        assert max(len(p - q), len(q - p)) <= apart


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">One</a></li></ul></nav><div class="ad">Buy the best of all the things that you can buy.</div>
<article><h1>The title</h1><p><b>First &amp; <i>only</i>&nbsp;line<br>of   text<p>Second.</p><div class="share">Share this on all of the sites</div><form><p>Your mail</p></form>
<script>x()</script><pre>a
b</pre></article><aside>Other news</aside><section class="comments"><p>I think that this is the best of it all and so on.</p></section><footer>&copy; us</footer></body></html>"""


def test_html_keeps_the_article_alone():
    assert html_text.main_text(PAGE) == "The title\nFirst & only line of text\nSecond.\na b"
    for odd in (None, "", "<", "<p", "<script>never closed", "<!-- open", "<a b='c", "</p></p>"):
        assert html_text.main_text(odd) == ""


def test_html_without_an_article_element():
    body = "This is the text of the page and it is about all that was in the news for the week, with more of the same to come. " * 3
    page = f"<body><div><a href=x>Home</a> <a href=y>News</a></div><h2>On the week</h2><p>{body}</p><p>Short but inside.</p><p>{body}</p><div><a href=z>Terms of use</a> | <a href=z>About us all</a></div></body>"
    assert html_text.main_text(page) == "\n".join(["On the week", body.strip(), "Short but inside.", body.strip()])


PROSE = "This is the text of the page and it is about all that was in the news for the week, with more of the same to come. " * 3


@pytest.mark.parametrize("wrapper", ["<form id='aspnetForm'>", "<div class='main-with-sidebar'>", "<div class='elementor-widget-theme-post-content'>", "<div class='entry-content privacy-policy'>", "<div class='flex hidden lg:block'>"])
@pytest.mark.parametrize("inner", ["div", "article"])
def test_html_wrapper_of_the_page_is_not_set_apart(wrapper, inner):
    page = f"<body><nav><a href=/>Home</a></nav>{wrapper}<{inner}><h1><a href=/x>On the week</a></h1><p>{PROSE}</p><p>Short but inside.</p><p>{PROSE}</p></{inner}><div class=sidebar><p>{PROSE[:100]}</p></div></{wrapper[1:5].rstrip()}><footer>Imprint of us</footer></body>"
    assert html_text.main_text(page) == "\n".join(["On the week", PROSE.strip(), "Short but inside.", PROSE.strip()])


def test_html_body_beside_a_teaser_or_before_comments():
    text = f"<h1>On the week</h1><p>{PROSE}</p><p>{PROSE}</p>"
    expected = "\n".join(["On the week", PROSE.strip(), PROSE.strip()])
    assert html_text.main_text(f"<body><div>{text}</div><div><article class='teaser'><h3><a href=/o>Other story</a></h3><p>A card.</p></article></div></body>") == expected
    assert html_text.main_text(f"<body><div>{text}</div><section class='comments'><p>{PROSE * 20}</p></section></body>") == expected
    assert html_text.main_text(f"<body><article>{text}</article><div style='display: none'><p>{PROSE * 20}</p></div></body>") == expected


def test_html_nested_comments_and_marked_parts_of_a_line():
    text = f"<h1>On the week</h1><p>{PROSE}</p><p>The end <span class='sponsored'>buy this</span>of <i hidden>x <b>y</b></i>it <a class='social-share' href=/s>Post</a>all.</p>"
    expected = "\n".join(["On the week", PROSE.strip(), "The end of it all."])
    comment = f"<p>{PROSE}</p>"
    assert html_text.main_text(f"<article>{text}<article class='comment'>{comment}</article></article>") == expected
    assert html_text.main_text(f"<article>{text}</article><article class='comment'>{comment}</article>") == expected
    assert html_text.main_text(f"<main><article>{text}<article class='related-teaser'>{comment}</article></article></main>") == expected
    assert html_text.main_text(f"<body><div>{text}</div><div class='replies'>{comment}</div></body>") == expected


def test_html_without_marks_gives_the_same_text(sf_dir):
    """The two passes alone find what the page's article element says, on pages whose texts have few stop words."""
    pages = [r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()]
    given = [html_text.main_text(p) for p in pages]
    bare = [html_text.main_text(re.sub(r"(?i)<(/?)(article|main)\b", r"<\1div", p)) for p in pages]
    assert sum(a == b for a, b in zip(given, bare, strict=True)) >= 0.95 * len(pages)
    assert all(b for a, b in zip(given, bare, strict=True) if a)


class _Plain(HTMLParser):
    """The text of the article by a plain walk: blocks outside scripts and parts that a fixed list names."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.now, self.inside, self.off = [], [], 0, []

    def end(self):
        if text := " ".join("".join(self.now).split()):
            self.blocks.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if self.off or tag in ("script", "style", "nav", "aside", "footer", "form") or set(dict(attrs).get("class", "").split()) & {"ad", "share", "comments", "related", "sidebar", "newsletter"}:
            if tag not in html_text.VOID:
                self.off.append(tag)
            return
        if tag not in html_text.INLINE:
            self.end()
        if tag == "br":
            self.now.append(" ")
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        if self.off:
            if tag in self.off:
                del self.off[len(self.off) - 1 - self.off[::-1].index(tag) :]
            return
        if tag not in html_text.INLINE:
            self.end()
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside and not self.off:
            self.now.append(data)


def test_html_query_is_a_plain_walk(spark):
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in QUERIES["op2_html_extraction"](spark, "/root/testdata/sf0.01").collect()}
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    assert len(got) == len(pages)
    for r in pages:
        plain = _Plain()
        plain.feed(r["html"])
        plain.end()
        text = "\n".join(plain.blocks)
        assert got[r["page_id"]] == (r["url"], text, len(text))


def test_html_very_long_page():
    assert html_text.main_text("<article>" + f"<p>{PROSE}</p>" * 3000 + "</article>") == "\n".join([PROSE.strip()] * 3000)
    assert html_text.main_text("<div>" * 20_000 + f"<p>{PROSE}</p>") == PROSE.strip()


def test_html_rows(spark):
    rows = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = html_text.extract(rows).collect()
    n = len(html_text.main_text(PAGE))
    assert sorted(r["n_chars"] for r in got) == [0, n, n] and len(got) == 3
    assert html_text.extract(rows.limit(0)).count() == 0


def ids_of(text):
    return encoder(default_tokenizer()).tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_is_the_tokenizer():
    rng = random.Random(2)
    parts = ["a", "b c", " ", "  ", "\n", "\n\n", "\t", "é", "'s", "12", "!!", " \n", "<|endoftext|>", "\x00", " 한국", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(500)] + [None, ""]
    e = encoder(default_tokenizer())
    for text, raw in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == ids_of(text)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_covers_every_id_once(spark, corpus):
    got = packing.pack(table(spark, corpus)).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, text, *_ in corpus:
        ids, at = [*ids_of(text), 0], 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            n = r["length"]
            assert r["start"] == at and r["doc_tokens"] == len(ids) and n & (n - 1) == 0 and n <= 1024 and r["offset"] == 0 and 1 << r["bucket"] == n
            assert r["ids_crc32"] == crc(ids[at : at + n])
            at += n
        assert at == len(ids)
    assert len({r["sequence_id"] for r in got}) == len(got)
    assert packing.pack(table(spark, corpus).limit(0)).count() == 0
    assert packing.binary_lengths(2048 + 5) == [1024, 1024, 4, 1] and packing.binary_lengths(1) == [1]


ODD = [(None, "x y", None, None), (None, None, "en", None), (4, "one two three", "en", "a"), (4, "one two three", "en", "a"), (4, "other words", "fr", "b"), (9, "", None, "a"), (2, "w " * 30_000, "en", "a")]


def test_packing_of_rows_with_the_same_or_no_id(spark):
    got = packing.pack(table(spark, ODD)).collect()
    sizes = sorted(((i, len(ids_of(t)) + 1) for i, t, *_ in ODD), key=str)
    assert sorted(((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0), key=str) == sizes
    assert sum(r["length"] for r in got) == sum(n for _, n in sizes)


def test_token_files_of_rows_with_the_same_or_no_id(spark, monkeypatch):
    """Null ids first, rows of one id follow each other, and a text longer than a shard is one of its own."""
    monkeypatch.setattr(token_store, "BLOCK_CHARS", 1000)
    got = sorted(token_store.round_trip(table(spark, ODD), shards=3).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, 2, 4, 4, 4, 9]
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(i), len(ids_of(t)) + 1, crc([*ids_of(t), 2])) for i, t, *_ in ODD)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]


def test_mixing_of_rows_with_the_same_or_no_id(spark):
    docs = table(spark, ODD).withColumn("rate", F.lit("r")).withColumn("source_size", F.lit(7))
    got = mixing.mix(docs, keep=("lang", "size", "rate", "source_size")).collect()
    assert len(got) == len(ODD) and got[0].__fields__.count("rate") == 1
    assert len({r["copies"] for r in got if r["doc_id"] == 4 and r["lang"] == "en"}) == 1
    assert sorted(r["size"] for r in got) == [0, 0, 2, 2, 3, 3, 30_000]
    mixed = mixing.mixed_documents(docs, tuple(docs.columns))
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in mixing.mix(docs).collect())


def test_language_and_fingerprints_of_repeated_rows(spark):
    docs = table(spark, [*ODD, (10, "the thing that is", "en", "s")])  # the one text that is learned from
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(docs).collect()]
    assert len(got) == len(ODD) + 1 and len({r for r in got if r[0] == 4}) == 2
    marks = fingerprints.fingerprint(table(spark, ODD)).collect()
    assert len(marks) == len(ODD) and len({r["fingerprint"] for r in marks if r["doc_id"] == 4}) == 2


def test_sharding_replaces_columns_of_its_names(spark):
    docs = table(spark, ODD).withColumn("slot", F.lit("s")).withColumn("shard", F.lit("t"))
    placed = sharding.place(docs)
    assert placed.columns == [*[c for c in docs.columns if c not in ("slot", "shard")], "slot", "shard"]
    assert len({r["shard"] for r in placed.collect() if r["doc_id"] == 4}) == 1 and placed.count() == len(ODD)


def test_without_copies_loses_no_other_text(spark):
    same = "a b c d e f"
    rows = [(None, same, None, None), (None, same, None, None), (1, same, None, "p"), (1, same, None, "q"), (1, "other words that are here too", None, None), (2, same, None, None), (3, "", None, None), (3, None, None, None), (7, same + " g", None, None), (7, "the third text of all that there is", None, None)]
    docs = table(spark, rows).withColumn("sid", F.lit("s")).withColumn("row", F.lit("r")).withColumn("kept_id", F.lit("k"))
    for parts in (1, 5):
        stay = ngram_join.without_copies(docs.repartition(parts))
        assert stay.columns == docs.columns
        got = sorted(((r["doc_id"], r["text"], r["source"]) for r in stay.collect()), key=str)
        assert got == sorted([(None, same, None), (None, same, None), (1, same, got[0][2] if got[0][1] == same else "p"), (1, "other words that are here too", None), (3, "", None), (3, None, None), (7, same + " g", None), (7, "the third text of all that there is", None)], key=str)
    assert ngram_join.without_copies(docs.limit(0)).count() == 0
    alone = docs.where("doc_id = 2 or source = 'p'")
    assert [r["doc_id"] for r in ngram_join.without_copies(alone).collect()] == [1]


def test_token_files_round_trip(spark, corpus):
    rows = [*corpus, (None, "x y", None, None)]
    got = token_store.round_trip(table(spark, rows), shards=3).collect()
    at = 0
    for i, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        r = next(r for r in got if r["doc_id"] == i)
        ids = [*ids_of(text), 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)
    assert token_store.round_trip(table(spark, corpus).limit(0)).count() == 0


def test_grammar_and_random_access(spark, tmp_path):
    rng = np.random.default_rng(3)
    ids = rng.choice(np.array([5, 6, 7, 8]), 4000)
    owner = np.repeat(np.arange(40), 100)
    seq, own, rules = token_store.repair(ids, owner, rounds=20, least=4)
    assert len(seq) < 1500 and (token_store.expand(seq, rules) == ids).all()
    lengths = token_store.expansion_lengths(rules)
    for k in (0, len(rules) // 2, len(rules) - 1):
        assert lengths[k] == len(token_store.expand(np.array([token_store.FIRST_RULE + k]), rules))
    rows = [(k, "the cat sat on the mat and the dog sat on the rug " * (k + 1), None, None) for k in range(30)]
    token_store.encode_shards(table(spark, rows), str(tmp_path / "t"), shards=1)
    block = spark.read.parquet(str(tmp_path / "t")).first().asDict()
    every = [[*ids_of(t), 2] for _, t, *_ in rows]
    assert token_store.document_ids(block, 7).tolist() == every[7]
    flat = [x for e in every for x in e]
    assert token_store.token_range(block, 33, 190).tolist() == flat[33:190]


def test_language_by_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_texts(spark):
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (3, "123 !?", "en", "s"), (10, "the thing and that is the way of it", "en", "s"), (5, "é", None, "s"), (6, "x" * 100_000, None, "s"), (None, "der die das", "de", "s")]
    got = {r["doc_id"]: r for r in langid.identify(table(spark, rows)).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (1, 2, 3))
    assert got[10]["lang_pred"] == "en" and got[5]["lang_pred"] in ("en", "de")
    assert not got[None]["held_out"]
    assert {r["lang_pred"] for r in langid.identify(table(spark, rows).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.known_languages(table(spark, rows))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([10, 5, 6, None], key=str) and kept.columns == table(spark, rows).columns


@pytest.mark.parametrize("held", [2048, 7])
def test_bundles_of_many_texts_are_those_of_each(monkeypatch, held):
    monkeypatch.setattr(langid, "VECTORS", held)
    grams = [langid.trigrams(t) for t in ("the thing and that is the way of it", "", "le la les des une dans pour", "ab" * 5000, "это и есть")]
    direct = [langid.gram_vectors(g).astype(float).sum(axis=0) for g in grams]
    assert np.array_equal(langid.bundled(grams), np.array(direct))


def test_blocks_hold_all_texts_in_order(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK_TEXTS", 3)
    monkeypatch.setattr(langid, "BLOCK_GRAMS", 20)
    texts = ["one", None, "", "a text that is longer than a block may be", "five", "six", "seven", "eight"]
    got = list(langid.blocks(texts))
    assert [first for first, _ in got] == list(np.cumsum([0, *[len(g) for _, g in got]])[:-1])
    assert all(np.array_equal(a, langid.trigrams(t)) for a, t in zip([g for _, block in got for g in block], texts, strict=True))


def test_more_values_than_languages_raise(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    rows = [(k, "a text of words", f"l{k % 3}", "s") for k in range(9)]
    assert {r["lang_pred"] for r in langid.identify(table(spark, rows)).collect()} <= {"l0", "l1", "l2"}
    with pytest.raises(ValueError, match="more than 3"):
        langid.identify(table(spark, [*rows, (9, "a text", "l4", "s")]))


def test_language_query_is_the_plain_bundle_and_cosine(spark, sf_dir):
    """Every text's bundle is made and compared with the bundles of all training texts."""
    rows = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows}
    bundles, learned = {}, {}
    for r in rows:
        grams, n = np.unique(langid.trigrams(r["text"]), return_counts=True)
        bundles[r["doc_id"]] = b = np.zeros(langid.DIMENSIONS)
        for k in range(0, len(grams), 512):
            b += n[k : k + 512].astype(float) @ langid.gram_vectors(grams[k : k + 512]).astype(float)
        if r["lang"] is not None and not held[r["doc_id"]]:
            learned[r["lang"]] = learned.get(r["lang"], 0) + b
    langs = sorted(learned)
    for r in QUERIES["op4_language_id"](spark, sf_dir).collect():
        b = bundles[r["doc_id"]]
        assert r["held_out"] == held[r["doc_id"]]
        if not b.any():
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        cosines = [float(b @ learned[k] / np.linalg.norm(b) / np.linalg.norm(learned[k])) for k in langs]
        assert r["lang_pred"] == langs[int(np.argmax(cosines))] and abs(r["score"] - max(0.0, *cosines)) < 1e-9


def test_language_of_other_scripts(spark):
    texts = {"ru": "это и есть тот самый язык который был", "el": "αυτή είναι η γλώσσα που ήταν εδώ", "uk": "це і є та сама мова яка була тут"}
    rows = [(k * 10 + i, t, la, "s") for k, (la, t) in enumerate(texts.items()) for i in range(9)]
    rows += [(1000, "тот язык есть", None, "s"), (1001, "η γλώσσα ήταν αυτή", None, "s"), (1002, "та мова є тут", None, "s"), (1000, "тот язык есть", None, "s")]
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.identify(table(spark, rows)).collect() if r["doc_id"] >= 1000]
    assert sorted(got) == [(1000, "ru"), (1000, "ru"), (1001, "el"), (1002, "uk")]


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=str) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mixing_meets_its_targets(spark, corpus):
    got = mixing.mix(table(spark, corpus)).collect()
    source = {i: s for i, _, _, s in corpus}
    size = {i: len((t or "").encode().split()) for i, t, *_ in corpus}
    sums = {}
    for i in size:
        sums[source[i]] = sums.get(source[i], 0) + size[i]
    goals = brute_targets(sums)
    assert len(got) == len(corpus)
    for r in got:
        i = r["doc_id"]
        assert r["size"] == size[i] and r["source_size"] == sums[source[i]] and r["target"] == pytest.approx(goals[source[i]])
        assert r["taken"] == r["copies"] * size[i] <= 2 * size[i] and int(r["rate"]) <= r["copies"] <= int(r["rate"]) + 1
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(table(spark, corpus).repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    assert mixing.mix(table(spark, corpus).limit(0)).count() == 0
    emptied = table(spark, corpus).withColumn("text", F.lit(None).cast("string"))
    assert {(r["taken"], r["target"]) for r in mixing.mix(emptied).collect()} == {(0, 0.0)}


def test_mixing_many_documents_comes_near(spark):
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 20 + 1).cast("int")).alias("text"))
    for r in mixing.mix(rows).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r["taken"] / r["target"] - 1) < 0.05


def test_mixed_documents_repeat_whole_rows(spark, corpus):
    docs = table(spark, corpus)
    rows = mixing.mixed_documents(docs, tuple(docs.columns))
    assert rows.columns == docs.columns
    n = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    got = {r["doc_id"]: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    assert got == {i: k for i, k in n.items() if k}


def brute_vectors(rows, cut=0.9):
    good = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            good[k] = x / np.linalg.norm(x)
    links, root = {k: 0 for k in range(len(rows))}, list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(good, 2):
        if len(good[a]) == len(good[b]) and good[a] @ good[b] >= cut:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    least = {}
    for k in good:
        least[find(k)] = min(least.get(find(k), rows[k][0]), rows[k][0])
    return sorted(((rows[k][0], links[k], least.get(find(k), rows[k][0])) for k in range(len(rows))), key=str)


def test_vector_join_is_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    centers = rng.normal(size=(12, 16))
    for k in range(500):
        rows.append((k, (centers[k % 12] + rng.normal(size=16) * rng.choice([0.05, 0.3, 1.0])).astype(np.float32).tolist()))
    rows += [(600, None), (601, []), (602, [0.0] * 16), (603, [float("nan")] + [1.0] * 15), (604, [None] + [1.0] * 15), (605, [float("inf")] + [1.0] * 15), (606, [1.0, 2.0]), (607, [2.0, 4.0]), (608, rows[0][1]), (609, [1e-30] * 16), (610, [1e30] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n_links", F.lit("x"))
    for tile in (64, 4096):
        got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.join(df, tile=tile).collect()), key=str)
        assert got == brute_vectors(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in vectors.join(df).collect())
    assert vectors.join(df.limit(0)).count() == 0


def test_fingerprints_of_edited_texts(spark, corpus):
    rows = sorted(corpus)
    got = {r["doc_id"]: r for r in fingerprints.fingerprint(table(spark, corpus)).collect()}
    assert len(got) == len(rows)
    for k, (i, text, *_) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)]
        changed = fingerprints.edited(text, after[1] or "")
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        a, b, c = (shingles(x) for x in (text, changed, after[1]))
        for near, x, y in ((r["near_edited"], a, b), (r["near_next"], a, c)):
            assert abs(near - (len(x & y) / len(x | y) if x | y else 1.0)) < 0.25
    same = {got[i]["fingerprint"] for i in range(5000, 5050)}
    assert len(same) == 1 and got[3]["fingerprint"] == got[4]["fingerprint"] != got[5]["fingerprint"]
    assert fingerprints.fingerprint(table(spark, corpus).limit(0)).count() == 0
    one = fingerprints.fingerprint(table(spark, rows[5:6])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_banded_fingerprints_find_the_components(spark, corpus):
    got = {r["doc_id"]: r["component_id"] for r in fingerprints.near_duplicates(table(spark, corpus)).collect()}
    assert got == brute_components(corpus)


def test_fingerprints_query_runs_the_band_join(spark, corpus, tmp_path):
    expected = brute_components(corpus)
    table(spark, corpus).write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["op7_fingerprints"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == expected and len(rows) == len(corpus)
    plain = sorted(fingerprints.fingerprint(table(spark, corpus)).collect())
    assert sorted(tuple(r)[:-1] for r in rows) == [tuple(r) for r in plain]


def test_fingerprint_components_of_rows_with_the_same_or_no_id(spark):
    rows = [(None, "a b c d e f", None, None), (1, "a b c d e f", None, None), (1, "a b c d e f", None, None), (7, "a b c d e f", None, None), (7, "other words that are here too", None, None), (8, "", None, None), (9, None, None, None)]
    got = sorted(((r["doc_id"], r["component_id"]) for r in fingerprints.fingerprint_components(table(spark, rows)).collect()), key=str)
    assert got == [(1, 1), (1, 1), (7, 1), (7, 7), (8, 8), (9, 9), (None, None)]
    assert fingerprints.fingerprint_components(table(spark, rows).limit(0)).count() == 0


def plain_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % 2**64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def test_signature_is_a_plain_minhash(spark):
    """Least values by Python's integers, for the sets of the query's own texts."""
    a, b = (x.tolist() for x in fingerprints._universal(fingerprints.PERMUTATIONS))
    texts = ["one", "a b c d e f g", "The quick brown fox jumps over the lazy dog again and again", "x " * 40]
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(table(spark, [(k, t, None, None) for k, t in enumerate(texts)])).collect()}
    for k, found in enumerate(shingle_sets(texts)):
        plain = [plain_mix(min((p * x + q) % 2**64 for x in found.tolist())) >> 48 for p, q in zip(a, b, strict=True)]
        assert got[k] == np.array(plain, "<u2").tobytes().hex()


def test_fingerprints_of_rows_with_the_same_or_no_id(spark):
    rows = [(None, "a b", None, None), (None, None, None, None), (4, "c d", None, None), (4, "a b", None, None), (9, "e", None, None)]
    got = [(r["doc_id"], r["n_chars"]) for r in fingerprints.fingerprint(table(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(None, 3), (None, 0), (4, 3), (4, 3), (9, 1)], key=str)


def test_sharding_table_and_placement(spark, corpus):
    names = [f"s{k}" for k in range(7)]
    full = sharding.lookup_table(names, 1009)
    counts = np.bincount(full, minlength=7)
    assert counts.sum() == 1009 and counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(full, fewer, strict=True) if a != 6)
    assert moved < 0.2 * 1009
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)
    rows = [*corpus, (None, "x", None, None), (3, "again", None, None)]
    placed = sharding.place(table(spark, rows), names, 1009).collect()
    assert len(placed) == len(rows)
    for r in placed:
        slot = int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:15], 16) % 1009
        assert r["slot"] == slot and r["shard"] == full[slot]
    assert sharding.place(table(spark, rows).limit(0)).count() == 0


def test_url_rules_and_lists(spark):
    cases = [
        (1, "http://a.example.org/es/x", "a.example.org", "/es/x", "example.org/es/", "block"),
        (2, "https://example.org/en/12?q#f", "example.org", "/en/12", "example.org/en/1", "block"),
        (3, "https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        (4, "http://notexample.org/es/x", "notexample.org", "/es/x", "org/", "allow"),
        (5, "HTTP://WWW.X.COM/fr/1", "www.x.com", "/fr/1", "com/fr/", "allow"),
        (6, "http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
        (7, "http://bad.net/p/?q=1", "bad.net", "/p/", None, "block"),
        (8, "https://www.bad.net/p.html#x", "www.bad.net", "/p.html", None, "block"),
        (9, "http://bad.net/other", "bad.net", "/other", None, "allow"),
        (10, "no scheme", "", "", None, "allow"),
        (11, None, "", "", None, "allow"),
        (12, "http://example.org", "example.org", "", None, "allow"),
        (13, "x://a/b://c", "a", "/b://c", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u, "z") for i, u, *_ in cases], "page_id long, url string, host string")
    listed = spark.createDataFrame([("http://bad.net/p",), ("http://bad.net/p/",), (None,)], "url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(pages, listed).collect()}
    assert got == {i: (h, p, rule, v) for i, _, h, p, rule, v in cases}
    assert urls.filter_urls(pages, listed.limit(0)).where("listed").count() == 0
    assert urls.filter_urls(pages.limit(0), listed).count() == 0


def test_url_query_finds_other_pages_of_a_listed_url(spark, tmp_path):
    rows = [(100, "http://a.example.net/p/x.html?q=1"), (7, "https://www.a.example.net/p/x#top"), (8, "http://a.example.net/p/y"), (8, "http://a.example.net/p/x/"), (9, None), (200, None), (300, "http://b.spam-farm.net/1"), (11, "http://b.spam-farm.net/1/index.html")]
    spark.createDataFrame(rows, "page_id long, url string").withColumn("verdict", F.lit("z")).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r["page_id"], r["path"], r["verdict"]) for r in QUERIES["op10_url_filters"](spark, str(tmp_path)).collect())
    assert got == [(7, "/p/x", "block"), (8, "/p/x/", "block"), (8, "/p/y", "allow"), (9, "", "allow"), (11, "/1/index.html", "block"), (100, "/p/x.html", "block"), (200, "", "allow"), (300, "/1", "block")]


def test_url_query_lists_pages_of_listed_labels_too(spark, tmp_path):
    rows = [(11, "http://a.casino.net/1"), (12, "http://WAREZ/x"), (13, "http://casinos.net/1"), (14, None), (15, "http://a.casino.org/1")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: (r["verdict"], r["listed"]) for r in QUERIES["op10_url_filters"](spark, str(tmp_path)).collect()}
    assert got == {11: ("block", True), 12: ("block", True), 13: ("allow", False), 14: ("allow", False), 15: ("allow", True)}


def test_every_set_posts_once_whatever_it_shares(spark):
    """Rows that are posted grow with the sets, not with how many of them share a frequent passage."""
    passage = " ".join(f"p{k}" for k in range(40))
    posted = []
    for n in (10, 40):
        docs = spark.createDataFrame([(i, f"{passage} " + " ".join(f"w{i}_{k}" for k in range(40))) for i in range(n)], "p long, text string")
        order = ngram_join._frequencies(docs, 5, 80)
        rows = ngram_join._posted(docs, 5, 80, order)
        posted.append(rows.count())
        order.unpersist()
    assert posted[1] == 4 * posted[0]


def test_bloom_filter_grows_with_its_list_within_bounds():
    assert urls.blocks_for(0) == urls.FEWEST and urls.blocks_for(10**12) == urls.MOST
    assert urls.blocks_for(1_000_000) == 1 << 15


def test_no_listed_url_is_missed(spark):
    rows = spark.range(20_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 50, F.lit(".net/p"), "id").alias("url"))
    got = urls.filter_urls(rows, rows.where("page_id % 3 = 0").select("url"))
    assert got.where("listed <> (page_id % 3 = 0)").count() == 0


def test_vector_join_of_large_clusters(spark):
    """Chains, triangles, a hub and a dense cluster of over 2,000 rows, and 70 lengths of vectors, in tiles of several sizes."""
    rng = np.random.default_rng(9)
    rows = []
    step = 0.4  # cos 0.4 = 0.92, cos 0.8 = 0.70: each links with its neighbours alone
    for k in range(60):  # a chain that winds through many planes
        angle, plane = k * step, (k * step) // (np.pi / 2)
        v = np.zeros(64)
        v[int(plane)], v[int(plane) + 1] = np.cos(angle - plane * np.pi / 2), np.sin(angle - plane * np.pi / 2)
        rows.append(v)
    center = rng.normal(size=64)
    center /= np.linalg.norm(center)
    dense = center + 0.02 * rng.normal(size=(2200, 64))
    rows += list(dense)
    for _ in range(300):  # around a hub, mostly apart from each other
        side = rng.normal(size=64)
        side -= side @ rows[0] * rows[0]
        rows.append(rows[0] + 0.47 * side / np.linalg.norm(side))
    rows += list(rng.normal(size=(700, 64)))
    order = rng.permutation(len(rows))
    x = np.array(rows, np.float32)[order]
    table_ = [(k, v.tolist()) for k, v in enumerate(x)]
    lengths = [(10_000 + 3 * d + k, (np.arange(1, d + 1) * (1.0, 2.0, -1.0)[k]).tolist()) for d in range(1, 71) for k in range(3) if d != 64]
    df = spark.createDataFrame(table_ + lengths, "vec_id long, embedding array<float>")
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = y @ y.T >= 0.9
    root = np.arange(len(x))
    while True:
        least = np.where(near, root[None, :], len(x)).min(axis=1)
        if (least == root).all():
            break
        root = least
    expected = {k: (int(near[k].sum()) - 1, int(root[k])) for k in range(len(x))}
    for d in range(1, 71):
        if d != 64:
            a = 10_000 + 3 * d
            expected |= {a: (1, a), a + 1: (1, a), a + 2: (0, a + 2)}
    for tile in (300, 4096):
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.join(df, tile=tile).collect()} == expected


def test_pairs_of_a_tile_are_found_once_in_few_blocks():
    """Tiles that are no multiple of the products' sizes, against themselves and others; each block costs a pass over all pairs."""
    rng = np.random.default_rng(6)
    given = rng.normal(size=(900, 64)).repeat(3, axis=0)[:2600] + 0.25 * rng.normal(size=(2600, 64))
    x, parts = vectors.turned(given), vectors.cuts(64)
    assert len(parts) <= 4
    unit = given / np.linalg.norm(given, axis=1, keepdims=True)
    limits = [vectors.budget(c, 64) for c in parts]
    for mine, other, same in ((slice(0, 2600), slice(0, 2600), True), (slice(0, 1300), slice(1300, 2600), False)):
        near = unit[mine] @ unit[other].T >= 0.9
        expected = sorted(zip(*np.nonzero(np.triu(near, 1) if same else near), strict=True))
        found = [vectors._pairs(x[mine], x[other], parts, k, limits, 0.9, (given[mine], given[other]), same) for k in range(len(parts))]
        assert expected and sorted(pair for p, q in found for pair in zip(p, q, strict=True)) == expected
