"""Tagging items with topic axes, and its diagnostics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossweave.functions.text import doc_text, squish

Axes = dict[str, list[str]]


def axis_keywords(lines: DataFrame) -> DataFrame:
    """(axis, keyword) from lines (axis, line) that pack keywords with commas."""
    words = lines.select("axis", F.explode(F.split("line", ",")).alias("keyword")).select("axis", F.trim("keyword").alias("keyword"))
    return words.where("keyword <> ''")


def _alternatives(words: list[str]) -> str:
    return "|".join(re.escape(w).replace(r"\ ", " ") for w in sorted(words, key=lambda w: (-len(w), w)))


def patterns(keywords: list[str]) -> dict[str, str]:
    """Three patterns for an axis: ASCII words by their borders, short other words, long ones without spaces."""
    plain = [k for k in keywords if k.isascii()]
    other = ["".join(k.split()) for k in keywords if not k.isascii()]
    short, long = [k for k in other if len(k) < 4], [k for k in other if len(k) >= 4]
    out = {}
    if plain:
        # not \b: a particle may follow an ASCII word directly
        out["ascii"] = f"(?i)(?<![A-Za-z0-9])(?:{_alternatives(plain)})(?![A-Za-z0-9])"
    if short:
        out["short"] = _alternatives(short)
    if long:
        out["long"] = _alternatives(long)
    return out


def hits(text: Column, keywords: list[str]) -> Column:
    """Sorted distinct keywords of an axis in a text, ASCII ones in lower case."""
    found = F.array().cast("array<string>")
    p = patterns(keywords)
    if "ascii" in p:
        found = F.array_union(found, F.transform(F.regexp_extract_all(text, F.lit(p["ascii"]), 0), F.lower))
    if "short" in p:
        found = F.array_union(found, F.regexp_extract_all(text, F.lit(p["short"]), 0))
    if "long" in p:
        found = F.array_union(found, F.regexp_extract_all(squish(text), F.lit(p["long"]), 0))
    return F.sort_array(F.array_distinct(found))


def axis_match(items: DataFrame, axes: Axes) -> DataFrame:
    """(item_id, axis, keyword): every keyword of every axis that an item's title and summary hold."""
    text = items.select(F.col("id").alias("item_id"), doc_text().alias("text"))
    each = F.array(*[F.struct(F.lit(a).alias("axis"), hits(F.col("text"), ks).alias("found")) for a, ks in axes.items()])
    return text.select("item_id", F.explode(each).alias("m")).select("item_id", "m.axis", F.explode("m.found").alias("keyword"))


def item_axes(items: DataFrame, axes: Axes) -> DataFrame:
    """(item_id, axis), made anew for all items: an item that lost its axes has no row."""
    text = items.select(F.col("id").alias("item_id"), doc_text().alias("text"))
    flat = squish(F.col("text"))
    fits = []
    for axis, keywords in axes.items():
        p = patterns(keywords)
        tests = [F.col("text").rlike(p[k]) for k in ("ascii", "short") if k in p] + [flat.rlike(p[k]) for k in ("long",) if k in p]
        test = tests[0] if tests else F.lit(False)
        for t in tests[1:]:
            test = test | t
        fits.append(F.when(test, F.lit(axis)))
    return text.select("item_id", F.explode(F.array_compact(F.array(*fits))).alias("axis"))


def axes_arrays(item_axes: DataFrame) -> DataFrame:
    """(item_id, axes) with sorted axes."""
    return item_axes.groupBy("item_id").agg(F.sort_array(F.collect_set("axis")).alias("axes"))


def with_axes(items: DataFrame, item_axes: DataFrame) -> DataFrame:
    """Items with a column axes, empty for those without any."""
    joined = items.join(axes_arrays(item_axes), items["id"] == F.col("item_id"), "left").drop("item_id")
    return joined.withColumn("axes", F.coalesce("axes", F.array().cast("array<string>")))


def _share(df: DataFrame, n: str = "n") -> DataFrame:
    """With pct, the percentage of all; the window sees a few aggregated rows."""
    return df.withColumn("pct", F.lit(100.0) * F.col(n) / F.sum(n).over(Window.partitionBy()))


def axis_count_distribution(items: DataFrame, item_axes: DataFrame, min_hits: int = 1) -> DataFrame:
    counts = items.select("id").join(item_axes.groupBy("item_id").agg(F.count("*").alias("k")), F.col("id") == F.col("item_id"), "left")
    n = counts.groupBy(F.coalesce("k", F.lit(0)).cast("int").alias("n_axes")).agg(F.count("*").alias("n"))
    return _share(n).withColumn("passes", F.col("n_axes") >= min_hits)


def axis_item_counts(items: DataFrame, item_axes: DataFrame) -> DataFrame:
    total = items.agg(F.count("*").alias("total"))
    n = item_axes.groupBy("axis").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(total)).select("axis", "n", (F.lit(100.0) * F.col("n") / F.col("total")).alias("pct"))


def source_pass_rate(items: DataFrame, item_axes: DataFrame, min_hits: int = 1) -> DataFrame:
    counts = item_axes.groupBy("item_id").agg(F.count("*").alias("k"))
    joined = items.select("id", "source").join(counts, F.col("id") == F.col("item_id"), "left")
    passed = F.count_if(F.coalesce("k", F.lit(0)) >= min_hits)
    return joined.groupBy("source").agg(passed.alias("passed"), F.count("*").alias("total"), (F.lit(100.0) * passed / F.count("*")).alias("pct"))


def keyword_contribution(matches: DataFrame, top: int = 15) -> DataFrame:
    n = matches.groupBy("axis", "keyword").agg(F.count_distinct("item_id").alias("n"))
    return n.select(F.concat_ws(":", "axis", "keyword").alias("term"), "n").orderBy(F.desc("n"), "term").limit(top)


def axis_examples(items: DataFrame, matches: DataFrame, axis: str, n: int = 5) -> DataFrame:
    found = matches.where(F.col("axis") == axis).groupBy("item_id").agg(F.array_join(F.sort_array(F.collect_set("keyword")), ",").alias("keywords"))
    return items.select("id", "title").join(found, F.col("id") == F.col("item_id")).select("id", "title", "keywords").orderBy("id").limit(n)


def random_sample(items: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n items in an order that the seed draws; the same in every run."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    return items.withColumn("draw", key).orderBy("draw", "id").limit(n).drop("draw")
