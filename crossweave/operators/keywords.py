"""Keywords of items: n-grams over runs of tokens, what counts as a keyword, and pruning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossweave.functions.text import ascii_only, doc_text

#: Endings that mark an organisation.
ORG_SUFFIXES = ("공단", "공사", "재단", "진흥원", "연구원", "위원회", "협회", "연합회", "정보원", "평가원", "개발원", "중앙회", "부", "청")
MOST_WORDS, MOST_ASCII_WORDS = 4, 2

Runs = Callable[[Column], Column]


def runs_by_pattern(token: str = r"[A-Za-z]+|[^\x00-\x7F\s\p{P}]+", breaks: str = r"[^\p{L} ]+") -> Runs:
    """The default tokenizer: a text as an array of runs, each an array of tokens."""

    def cut(text: Column) -> Column:
        return F.transform(F.split(text, breaks), lambda run: F.regexp_extract_all(run, F.lit(token), 0))

    return cut


def grams(run: Column) -> Column:
    """All n-grams of a run: words without spaces between if any is not ASCII, else joined by spaces and two at most.

    A run of ASCII words alone, as most are, has its words and its pairs of neighbours and is not looked at further."""
    size = F.size(run)

    def of(n: int) -> Column:
        spots = F.when(size >= n, F.sequence(F.lit(1), size - (n - 1))).otherwise(F.array().cast("array<int>"))
        parts = F.transform(spots, lambda i: F.slice(run, i, n))
        plain = F.transform(parts, lambda p: F.when(F.forall(p, ascii_only), F.when(F.lit(n <= MOST_ASCII_WORDS), F.array_join(p, " "))).otherwise(F.array_join(p, "")))
        return F.array_compact(plain)

    after = F.slice(run, 2, F.greatest(size - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(run, 1, F.greatest(size - 1, F.lit(0))), after, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(ascii_only(F.array_join(run, "")), F.concat(run, pairs)).otherwise(F.flatten(F.array(*[of(n) for n in range(1, MOST_WORDS + 1)])))


def extract_keywords(items: DataFrame, runs: Runs | None = None) -> DataFrame:
    """(item_id, keyword), each once for an item."""
    cut = runs or runs_by_pattern()
    rows = items.select(F.col("id").alias("item_id"), cut(doc_text()).alias("runs"))
    found = F.array_distinct(F.flatten(F.transform("runs", grams)))
    return rows.select("item_id", F.explode(found).alias("keyword"))


def keyword_acceptable(keyword: str = "keyword", stop_words: tuple[str, ...] = ()) -> Column:
    """2 to 40 characters, not of digits and marks alone, no stop word; ASCII ones start with a capital and have 3 at least."""
    k = F.col(keyword)
    size = (F.length(k) >= 2) & (F.length(k) <= 40)
    letters = ~k.rlike(r"(?U)^[\d\W_]+$")
    named = ~ascii_only(k) | (k.rlike(r"^[A-Z]") & (F.length(k) >= 3))
    fine = size & letters & named
    return fine & ~F.lower(k).isin([w.lower() for w in stop_words]) if stop_words else fine


def token_keywords(items: DataFrame, pattern: str = r"[a-z]{4,}") -> DataFrame:
    """(item_id, keyword) of a plain pattern over the lower-cased text."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(doc_text()), F.lit(pattern), 0))
    return items.select(F.col("id").alias("item_id"), F.explode(found).alias("keyword"))


def keyword_lists(items: DataFrame, pattern: str = r"[a-z]{4,}") -> DataFrame:
    """(item_id, week, keywords): token_keywords and the week, a row for each item, made where its text is read.

    Joins by item and counts over the index begin from it, so that a join moves a row for each item and not one for each of its
    keywords. Whether an item is kept is never stored here, where it would go stale."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(doc_text()), F.lit(pattern), 0))
    return items.where("id is not null").select(F.col("id").alias("item_id"), F.col("published_week").alias("week"), found.alias("keywords"))


def min_df_prune(keywords: DataFrame, least: int = 2) -> DataFrame:
    """Without keywords of fewer documents; a key's rows meet once, by a semi-join on the counted keys."""
    often = keywords.groupBy("keyword").agg(F.count("*").alias("df")).where(F.col("df") >= least).select("keyword")
    return keywords.join(often, "keyword", "left_semi")


def prune_report(keywords: DataFrame, least: int = 2) -> DataFrame:
    df = keywords.groupBy("keyword").agg(F.count("*").alias("df"))
    return df.agg(F.sum("df").alias("rows_before"), F.sum(F.when(F.col("df") >= least, F.col("df")).otherwise(0)).alias("rows_after"), F.count("*").alias("keywords_before"), F.count_if(F.col("df") >= least).alias("keywords_after"))


def top_keywords(keywords: DataFrame, k: int = 20) -> DataFrame:
    return keywords.groupBy("keyword").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "keyword").limit(k)


def scope(keywords: DataFrame, items: DataFrame, kept_only: bool) -> DataFrame:
    if not kept_only:
        return keywords
    return keywords.join(items.where("kept").select(F.col("id").alias("item_id")), "item_id", "left_semi")


def indexed(keywords: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, keyword, week): the raw index. Whether an item is kept is never stored here, where it would go stale."""
    return keywords.join(items.select(F.col("id").alias("item_id"), F.col("published_week").alias("week")), "item_id").select("item_id", "keyword", "week")


def replace_keywords(target: DataFrame, new: DataFrame, items: DataFrame) -> DataFrame:
    """The index with the rows of the given items (id) made anew."""
    stay = target.join(items.select(F.col("id").alias("item_id")), "item_id", "left_anti")
    return stay.unionByName(new.select(*stay.columns))


def is_org(keyword: str = "keyword", suffixes: tuple[str, ...] = ORG_SUFFIXES, least: int = 5) -> Column:
    """The only place of the rule: five characters at least and an organisation's ending."""
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | F.col(keyword).endswith(s)
    return (F.length(keyword) >= least) & ends
