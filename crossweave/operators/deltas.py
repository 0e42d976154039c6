"""The keyword index kept up to date by signed counts of the items that changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.functions.components import settle
from crossweave.operators import index as ix

PARTS = 64
#: Tables that add up, each with a count n: columns, and the column that a row's part is found by. Of `rows` an item's are
#: a list, which a change replaces as a whole.
TABLES = {
    "rows": ("item_id long, week string, keywords array<string>", "item_id"),
    "kw_week": ("keyword string, week string", "week"),
    "kw_df": ("keyword string", "keyword"),
    "n_docs": ("index string", "index"),
    "kw_axis": ("keyword string, axis string", "keyword"),
    "counted": ("keyword string", "keyword"),
    "pairs": ("a string, b string", "a"),
}


def _keys(name: str) -> list[str]:
    return [c.split()[0] for c in TABLES[name][0].split(", ")]


def _part(name: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(TABLES[name][1]), F.lit(parts)).cast("int")


def _write(rows: DataFrame, path: str, name: str, number: int, parts: int) -> None:
    """Parts of a version; those of other versions stay, and a version that is written again replaces its own."""
    dealt = rows if "part" in rows.columns else rows.withColumn("part", _part(name, parts)).hint("rebalance", "part")
    dealt = dealt.select(*_keys(name), F.col("n").cast("long").alias("n"), "part", F.lit(number).alias("upto"))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "upto").parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str, name: str, number: int, only: list[int] | None = None) -> DataFrame:
    """A table after change `number`: the newest version up to it of each part (or of some parts), by the folders' names."""
    everything = spark.read.schema(f"{TABLES[name][0]}, n long, part int, upto int").parquet(f"{path}/{name}").where(F.col("upto") <= number)
    if only is not None:
        everything = everything.where(F.col("part").isin(only))
    newest = everything.groupBy("part").agg(F.max("upto").alias("upto")).collect()  # a row for each part
    chosen = everything.where(F.concat_ws("@", "part", "upto").isin([f"{r['part']}@{r['upto']}" for r in newest]))
    return chosen.where("n > 0").select(*_keys(name), "n")


def _lists(keywords: DataFrame) -> DataFrame:
    """An index (item_id, keyword, week), or one of lists, as lists."""
    if "keywords" in keywords.columns:
        return keywords.select(*_keys("rows"))
    return keywords.groupBy("item_id", "week").agg(F.collect_list("keyword").alias("keywords")).select(*_keys("rows"))


def counted(keywords: DataFrame, items: DataFrame | None, item_axes: DataFrame | None) -> dict[str, DataFrame]:
    """The tables of an index (item_id, keyword, week), which has a keyword once for an item, or of its lists (item_id, week,
    keywords); items have id, kept and published_week. Without items or axes there are no tables of what they tell."""
    rows = _lists(keywords)
    tables = {
        "rows": rows.withColumn("n", F.lit(1)),
        "kw_df": ix.documents_of(rows).withColumnRenamed("df", "n"),
        "n_docs": ix.n_docs(rows).select(F.lit("all").alias("index"), F.col("n_docs").alias("n")),
    }
    if items is not None:
        tables["kw_week"] = ix.kw_week(rows, items)
    if item_axes is not None:
        tables["kw_axis"] = ix.axis_hits(rows, item_axes)
    return tables


def begin(path: str, keywords: DataFrame, items: DataFrame | None, item_axes: DataFrame | None, pairs: DataFrame | None = None, min_df: int = ix.MIN_DF, parts: int = PARTS) -> None:
    """Version 0: the whole index (see `counted`); with `pairs` (a, b, n), those of keywords of min_df documents, also them."""
    tables = counted(keywords, items, item_axes)
    if pairs is not None:
        tables |= {"pairs": pairs, "counted": tables["kw_df"].where(F.col("n") >= min_df).select("keyword", F.lit(1).alias("n"))}
    for name, rows in tables.items():
        _write(rows, path, name, 0, parts)


def signed(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): after less before, without what stays as it is."""
    both = before.select(*keys, (-F.col("n")).alias("n")).unionByName(after.select(*keys, "n"))
    return both.groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")


def _merge(spark: SparkSession, path: str, name: str, number: int, delta: DataFrame, parts: int) -> None:
    """The parts that a delta has rows for, with its counts added; keys that come to 0 stay for this version, so that a
    part that loses all its rows has one."""
    delta = settle(delta, name)
    touched = [r["part"] for r in delta.select(_part(name, parts).alias("part")).distinct().collect()]  # `parts` at most
    if not touched:
        return
    both = read(spark, path, name, number - 1, touched).unionByName(delta).withColumn("part", _part(name, parts))
    summed = both.repartition("part").groupBy("part", *_keys(name)).agg(F.sum("n").alias("n"))  # added where they are written
    below = F.raise_error(F.lit(f"{name}: a count below 0; the items before the change are not those of the index")).cast("long")
    _write(summed.withColumn("n", F.when(F.col("n") >= 0, F.col("n")).otherwise(below)), path, name, number, parts)


def _replace(spark: SparkSession, path: str, number: int, delta: DataFrame, new: DataFrame, parts: int) -> None:
    """The parts of `rows` that a delta has items in, with these items' lists made anew. An item without rows has an empty list
    with a count of 0 in this version, so that a part that loses all its rows has one."""
    named = settle(delta.select("item_id").distinct(), "named")
    touched = [r["part"] for r in named.select(_part("rows", parts).alias("part")).distinct().collect()]  # `parts` at most
    if not touched:
        return
    stay = read(spark, path, "rows", number - 1, touched).join(named, "item_id", "left_anti")
    come = new.join(named, "item_id", "left_semi").withColumn("n", F.lit(1))
    gone = named.select("item_id", F.lit(None).cast("string").alias("week"), F.array().cast("array<string>").alias("keywords"), F.lit(0).alias("n"))
    _write(stay.unionByName(come).unionByName(gone), path, "rows", number, parts)


def change(path: str, number: int, ids: DataFrame, keywords: DataFrame, before: tuple[DataFrame | None, DataFrame | None], after: tuple[DataFrame | None, DataFrame | None], pairs: bool = False, min_df: int = ix.MIN_DF, parts: int = PARTS) -> None:
    """Version `number` of the index, from version number - 1 and the items (id) that changed, came or went.

    `keywords` are those items' rows now, or lists of them, `before` and `after` their items and axes, or None and None for an
    index that began without. Old rows count -1 and new ones +1;
    only parts with a count that changes are read and written. A change reads nothing but the versions before it and
    writes its own, so that one that broke off is run again with the same result. `parts` is that of `begin`."""
    spark = ids.sparkSession
    changed = settle(ids.select(F.col("id").alias("item_id")).distinct(), "changed")
    touched = [r["part"] for r in changed.select(_part("rows", parts).alias("part")).distinct().collect()]  # `parts` at most
    old = settle(read(spark, path, "rows", number - 1, touched).drop("n").join(changed, "item_id", "left_semi"), "old")
    new = settle(_lists(keywords).join(changed, "item_id", "left_semi"), "new")
    was, now = counted(old, *before), counted(new, *after)
    sides = (c.pop("rows").withColumn("keywords", F.sort_array("keywords")) for c in (was, now))
    _replace(spark, path, number, signed(*sides, _keys("rows")), new, parts)
    for name in was:
        _merge(spark, path, name, number, signed(was[name], now[name], _keys(name)), parts)
    if pairs:
        _change_pairs(spark, path, number, old, new, min_df, parts)


def _change_pairs(spark: SparkSession, path: str, number: int, old: DataFrame, new: DataFrame, min_df: int, parts: int) -> None:
    """Pairs of keywords that were counted before change by the pairs of the changed items; keywords that reach min_df for the
    first time get their pairs from the documents that hold them. A keyword that falls below stays counted, and is left
    out by the reader, so that nothing is searched for when it rises again."""
    before = read(spark, path, "counted", number - 1).select("keyword")
    often = read(spark, path, "kw_df", number).where(F.col("n") >= min_df).select("keyword")
    risen = settle(often.join(before, "keyword", "left_anti"), "risen")
    one = lambda rows: ix.listed(rows).join(before, "keyword", "left_semi").select("item_id", "keyword")
    sides = [ix.named_pairs(*ix.pair_counts(r, ix.kw_df(r), 1)) for r in (settle(one(old), "old_pairs"), settle(one(new), "new_pairs"))]
    delta = signed(*sides, ["a", "b"])
    rows = ix.listed(read(spark, path, "rows", number)).select("item_id", "keyword")
    mine = rows.join(risen, "keyword", "left_semi").withColumnRenamed("keyword", "r")
    marked = before.select("keyword", F.lit(False).alias("new")).union(risen.select("keyword", F.lit(True)))
    held = rows.join(mine.select("item_id").distinct(), "item_id", "left_semi").join(marked, "keyword")
    met = mine.join(held, "item_id").where((F.col("r") < F.col("keyword")) | ((F.col("r") > F.col("keyword")) & ~F.col("new")))
    fresh = met.groupBy(F.least("r", "keyword").alias("a"), F.greatest("r", "keyword").alias("b")).agg(F.count("*").alias("n"))
    _merge(spark, path, "pairs", number, delta.unionByName(fresh), parts)
    _merge(spark, path, "counted", number, risen.select("keyword", F.lit(1).cast("long").alias("n")), parts)


def kw_df(spark: SparkSession, path: str, number: int) -> DataFrame:
    """(keyword, df, n_docs)"""
    docs = read(spark, path, "n_docs", number).select(F.col("n").alias("n_docs"))
    return read(spark, path, "kw_df", number).select("keyword", F.col("n").alias("df")).crossJoin(F.broadcast(docs))  # one row


def kw_meta(spark: SparkSession, path: str, number: int, min_df: int = ix.MIN_DF) -> DataFrame:
    """(keyword, df, axis), as index.kw_meta."""
    often = read(spark, path, "kw_df", number).where(F.col("n") >= min_df).select("keyword", F.col("n").alias("df"))
    best = read(spark, path, "kw_axis", number).groupBy("keyword").agg(F.min(F.struct((-F.col("n")).alias("n"), "axis")).alias("best"))
    return often.join(best, "keyword", "left").select("keyword", "df", F.col("best.axis").alias("axis"))


def counted_pairs(spark: SparkSession, path: str, number: int, min_df: int = ix.MIN_DF) -> DataFrame:
    """(a, b, n), as pair_counts, of an index that keeps no pairs: counted from its rows where they are read, as a table of
    all pairs is many times as large as the rows."""
    return ix.cooccurrence(ix.listed(read(spark, path, "rows", number)), kw_df(spark, path, number), min_df)


def pair_counts(spark: SparkSession, path: str, number: int, min_df: int = ix.MIN_DF) -> DataFrame:
    """(a, b, n), as index.cooccurrence; index.neighbors makes the strongest of them, whose strengths all change with n_docs."""
    often = read(spark, path, "kw_df", number).where(F.col("n") >= min_df)
    one, two = (often.select(F.col("keyword").alias(c)) for c in ("a", "b"))
    return read(spark, path, "pairs", number).join(one, "a", "left_semi").join(two, "b", "left_semi").select("a", "b", "n")
