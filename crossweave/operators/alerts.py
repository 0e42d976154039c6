"""Watch lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEWEST, REMEMBERED = 20, 5000


def alert_hits(items: DataFrame, sources: DataFrame, keywords: list[str], now: str, days: int = 7, seen: DataFrame | None = None, facts: DataFrame | None = None, newest: int = NEWEST) -> DataFrame:
    """(keyword, place, id, title): each watched keyword's newest items of the last days that are not seen.

    Kept items and those of regulatory sources count; a keyword's % and _ are wildcards and case does
    not count. The newest are cut first, seen ones go after. Keywords that are tested on each item
    are a fixed list, so one pass over the items answers all. `facts` (id, kept) tells what is kept where
    the items do not: words are tested where the texts are, and only hits meet it."""
    at = F.to_timestamp(F.lit(now))
    rows = items.where((F.col("published_at") >= at - F.make_dt_interval(F.lit(days))) & (F.col("published_at") <= at))
    tests = [F.when(F.coalesce(F.col("title").ilike(f"%{k}%"), F.lit(False)) | F.coalesce(F.col("summary").ilike(f"%{k}%"), F.lit(False)), F.lit(k)) for k in keywords]
    rows = rows.withColumn("words", F.array_compact(F.array(*tests))).where(F.size("words") > 0).drop("summary")
    if facts is not None:
        rows = rows.join(facts.select("id", "kept"), "id")
    regulatory = sources.where("regulatory").select(F.col("source").alias("s"), F.lit(True).alias("r"))
    rows = rows.join(regulatory, F.col("source") == F.col("s"), "left").where(F.coalesce("kept", F.lit(False)) | F.coalesce("r", F.lit(False)))
    hits = rows.select("id", "title", "published_at", F.explode("words").alias("keyword"))
    place = F.row_number().over(Window.partitionBy("keyword").orderBy(F.desc("published_at"), F.desc("id")))
    hits = hits.withColumn("place", place).where(F.col("place") <= newest)
    if seen is not None:
        hits = hits.join(seen.select(F.col("id").alias("seen_id")), F.col("id") == F.col("seen_id"), "left_anti")
    return hits.select("keyword", "place", "id", "title")


def alert_state(seen: DataFrame, hits: DataFrame, most: int = REMEMBERED) -> DataFrame:
    """The ids to remember after a delivery: the largest of both.

    An id under the `most` largest is forgotten, and an item that comes late with such an id is told again."""
    return seen.select("id").union(hits.select("id")).distinct().orderBy(F.desc("id")).limit(most)


def alert_summary(hits: DataFrame) -> DataFrame:
    """(keyword, n), keywords with most hits first, with the number of items in all."""
    total = hits.agg(F.count_distinct("id").alias("total"))
    return hits.groupBy("keyword").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).orderBy(F.desc("n"), "keyword")


def watch_groups(hits: DataFrame) -> DataFrame:
    """(keyword, n, ids): hits by keyword, the largest group first."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda s: s["id"].cast("string")), ",")
    return hits.groupBy("keyword").agg(F.count("*").alias("n"), ids.alias("ids")).orderBy(F.desc("n"), "keyword")
