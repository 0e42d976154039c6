"""Landed records to items: reading, normalising, idempotent appending."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossweave.functions.dates import iso_week, parse_time
from crossweave.functions.text import clean_text, unescape_all, unescape_basic

#: A landed record.
RECORD = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("published_at", T.StringType()),
        T.StructField("collected_at", T.StringType()),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
    ]
)


def read_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of landed lines: blank lines are skipped, malformed or cut ones are rejects (line)."""
    # the raw line is kept and parsed as a column, so that both outputs come from one plan without a cache
    lines = spark.read.text(path).where(F.trim("value") != "")
    return parse_lines(lines)


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    schema = T.StructType([*RECORD.fields, T.StructField("_corrupt", T.StringType())])
    rows = lines.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    return rows.where(~bad).select(*[f"r.{f.name}" for f in RECORD.fields]), rows.where(bad).select(F.col("value").alias("line"))


def normalize_items(records: DataFrame, now: str) -> DataFrame:
    """Records as items: ids as text, times in UTC (null where unreadable), now where collected is missing, empty meta, the published week."""
    at = parse_time(F.col("published_at").cast("string"))
    rows = records.select("source", F.col("source_id").cast("string").alias("source_id"), "title", "summary", "url", at.alias("published_at"), F.coalesce(parse_time(F.col("collected_at").cast("string")), F.to_timestamp(F.lit(now))).alias("collected_at"), F.coalesce("meta", F.create_map().cast("map<string,string>")).alias("meta"))
    return rows.withColumn("published_week", iso_week("published_at"))


def insert_ignore(target: DataFrame, new: DataFrame, order: Column | None = None) -> DataFrame:
    """The rows of a batch whose (source, source_id) is not in the target, one for each; the first by `order`."""
    place = F.row_number().over(Window.partitionBy("source", "source_id").orderBy(order if order is not None else F.col("collected_at").asc_nulls_last(), "url"))
    once = new.withColumn("place", place).where("place = 1").drop("place")
    return once.join(target.select("source", "source_id"), ["source", "source_id"], "left_anti").select(*new.columns)


def append_new(spark: SparkSession, path: str, new: DataFrame) -> int:
    """Appends the unseen rows to a Parquet table and tells how many they were.

    The table is partitioned by source, and only the partitions of the batch's sources are read."""
    try:
        target = spark.read.schema(new.schema).parquet(path)
    except AnalysisException as error:  # the first batch: no table yet
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        target = spark.createDataFrame([], new.schema)
    touched = target.join(new.select("source").distinct(), "source", "left_semi")
    counted = Observation()
    insert_ignore(touched, new).observe(counted, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy("source").parquet(path)
    return counted.get["n"]


def jdbc_import(spark: SparkSession, url: str, table: str, since: str, driver: str | None = None, **options: str) -> DataFrame:
    """Rows of another database's news table since a date, the date tested there, as records."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if driver:
        reader = reader.option("driver", driver)
    for k, v in options.items():
        reader = reader.option(k, v)
    return from_news_table(reader.load().where(F.col("pub_date") >= F.lit(since)))


def from_news_table(rows: DataFrame, source: str = "imported") -> DataFrame:
    """(link, title, description, pub_date, keyword) rows as records; the id is the link's hash."""
    meta = F.map_from_arrays(F.array(F.lit("keyword")), F.array(F.coalesce(F.col("keyword").cast("string"), F.lit(""))))
    return rows.where("link is not null").select(F.lit(source).alias("source"), F.substring(F.sha1("link"), 1, 16).alias("source_id"), clean_text("title").alias("title"), clean_text("description").alias("summary"), F.col("link").alias("url"), F.col("pub_date").cast("string").alias("published_at"), F.lit(None).cast("string").alias("collected_at"), meta.alias("meta"))


def story_hits(hits: DataFrame, since: str, until: str, min_points: int = 0, site: str = "https://news.example.com/item?id=") -> DataFrame:
    """Landed story hits (objectID, title, story_title, url, story_text, created_at_i, points) as records."""
    at = F.timestamp_seconds("created_at_i")
    rows = hits.where(F.col("created_at_i").isNotNull() & (F.coalesce("points", F.lit(0)) >= min_points))
    rows = rows.where((at > F.to_timestamp(F.lit(since))) & (at < F.to_timestamp(F.lit(until))))
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("story_title"))
    return rows.select(F.lit("stories").alias("source"), F.col("objectID").cast("string").alias("source_id"), title.alias("title"), F.substring(clean_text("story_text"), 1, 500).alias("summary"), F.coalesce(F.nullif(F.col("url"), F.lit("")), F.concat(F.lit(site), F.col("objectID").cast("string"))).alias("url"), at.alias("published_at"))


def news_rows(rows: DataFrame, since: str, until: str) -> DataFrame:
    """Landed news rows (originallink, link, title, description, pubDate) as records; without a link they go."""
    link = F.coalesce(F.nullif(F.col("originallink"), F.lit("")), F.nullif(F.col("link"), F.lit("")))
    at = F.try_to_timestamp(F.regexp_replace("pubDate", r"^[A-Za-z]+,\s*", ""), F.lit("dd MMM yyyy HH:mm:ss Z"))
    out = rows.select(F.lit("news").alias("source"), F.substring(F.sha1(link), 1, 16).alias("source_id"), clean_text("title", unescape_all).alias("title"), clean_text("description", unescape_all).alias("summary"), link.alias("url"), at.alias("published_at"))
    return out.where(F.col("url").isNotNull() & (F.col("published_at") >= F.to_timestamp(F.lit(since))) & (F.col("published_at") <= F.to_timestamp(F.lit(until))))


def law_rows(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Landed law rows (target, fields map) as records by a table of targets (target, seq, name, day, parts).

    The table names the fields of each target: its number, title and date, and those whose values
    make up the summary."""
    joined = rows.join(F.broadcast(targets), "target")
    value = lambda c: F.try_element_at("fields", F.col(c))
    parts = F.filter(F.transform("parts", lambda p: F.trim(F.coalesce(F.try_element_at("fields", p), F.lit("")))), lambda v: v != "")
    return joined.select(F.lit("law").alias("source"), F.concat_ws(":", "target", value("seq")).alias("source_id"), F.trim(value("name")).alias("title"), F.array_join(parts, " · ").alias("summary"), F.try_to_timestamp(value("day"), F.lit("yyyyMMdd")).alias("published_at"), F.map_filter("fields", lambda _, v: F.trim(v) != "").alias("meta")).where("source_id not like '%:'")


def topic_pages(pages: DataFrame, suffix: str = r"\s*[|-]\s*[^|-]*$", unescape=unescape_basic) -> DataFrame:
    """(page_id, state, title, summary, published_at) of landed HTML pages.

    The title is og:title, else the title element without the site's name; the date comes from
    meta, else JSON-LD, else a time element; state is ok, not_found or bot_challenge. `unescape` decodes titles."""
    html = F.coalesce("html", F.lit(""))
    tag = lambda name: F.nullif(F.regexp_extract(html, rf'(?is)<meta[^>]+(?:property|name)=["\']{name}["\'][^>]*?content=["\'](.*?)["\']', 1), F.lit(""))
    plain = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    title = F.coalesce(tag("og:title"), F.nullif(F.regexp_replace(plain, suffix, ""), F.lit("")), plain)
    date = F.coalesce(tag("article:published_time"), F.nullif(F.regexp_extract(html, r'"datePublished"\s*:\s*"([^"]+)"', 1), F.lit("")), F.nullif(F.regexp_extract(html, r'(?is)<time[^>]+datetime=["\']([^"\']+)["\']', 1), F.lit("")))
    low = F.lower(plain)
    state = F.when(low.rlike(r"just a moment|attention required|are you a robot") | F.lower(html).contains("cf-challenge"), "bot_challenge").when((html == "") | low.rlike(r"404|not found"), "not_found").otherwise("ok")
    return pages.select("page_id", state.alias("state"), clean_text(title, unescape).alias("title"), clean_text(F.coalesce(tag("og:description"), F.lit(""))).alias("summary"), parse_time(date).alias("published_at"))


def feed_entries(entries: DataFrame) -> DataFrame:
    """Landed feed entries (link, title, summary, published, updated) as records; the id is the link's, without one they go."""
    key = F.regexp_extract("link", r"[?&]id=(\d+)", 1)
    at = F.coalesce(parse_time("published"), parse_time("updated"))
    return entries.where(key != "").select(F.lit("feed").alias("source"), key.alias("source_id"), clean_text("title").alias("title"), clean_text("summary").alias("summary"), F.col("link").alias("url"), at.alias("published_at"))


def read_feed(spark: SparkSession, path: str, row_tag: str = "entry") -> DataFrame:
    """Entries of landed XML feeds."""
    schema = "title string, link struct<_href:string>, summary string, published string, updated string"
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    return rows.select(F.col("link._href").alias("link"), "title", "summary", "published", "updated")


def latest_snapshots(lines: DataFrame) -> DataFrame:
    """(topic_id, stamp, original) of an archive's listing (value): each topic's newest snapshot; other lines are passed over."""
    row = F.from_json("value", "array<string>")
    rows = lines.select(F.try_element_at(row, F.lit(1)).alias("stamp"), F.try_element_at(row, F.lit(2)).alias("original"))
    key = F.coalesce(F.nullif(F.regexp_extract("original", r"[?&]id=(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract("original", r"/topic/(\d+)", 1), F.lit("")))
    rows = rows.where(F.col("stamp").rlike(r"^\d{14}$")).select(key.cast("long").alias("topic_id"), "stamp", "original").where("topic_id is not null")
    return rows.groupBy("topic_id").agg(F.max(F.struct("stamp", "original")).alias("m")).select("topic_id", "m.stamp", "m.original")


def unfetched_ids(snapshots: DataFrame, items: DataFrame) -> DataFrame:
    held = items.select(F.col("source_id").cast("long").alias("held"))
    return snapshots.select("topic_id").join(held, F.col("topic_id") == F.col("held"), "left_anti").orderBy(F.desc("topic_id"))


def latest_id(ids: DataFrame, column: str = "source_id") -> DataFrame:
    return ids.where(F.col(column).rlike(r"^\d+$")).agg(F.max(F.col(column).cast("long")).alias("latest"))


def lookback_window(items: DataFrame, sources: DataFrame, now: str, default_days: int = 7) -> DataFrame:
    """Items published in the last days that their source looks back, up to now."""
    at = F.to_timestamp(F.lit(now))
    rows = items.join(F.broadcast(sources.select(F.col("source").alias("s"), "days")), F.col("source") == F.col("s"), "left")
    since = at - F.make_dt_interval(F.coalesce("days", F.lit(default_days)))
    return rows.where((F.col("published_at") >= since) & (F.col("published_at") <= at)).drop("s", "days")


def stamp_regulatory(items: DataFrame, sources: DataFrame) -> DataFrame:
    """meta['regulatory'] = 'true' for items of regulatory sources; titles play no part."""
    rows = items.join(F.broadcast(sources.where("regulatory").select(F.col("source").alias("s"), F.lit(True).alias("r"))), F.col("source") == F.col("s"), "left")
    meta = F.coalesce("meta", F.create_map().cast("map<string,string>"))
    stamped = F.map_concat(F.map_filter(meta, lambda k, _: k != "regulatory"), F.create_map(F.lit("regulatory"), F.lit("true")))
    return rows.withColumn("meta", F.when(F.coalesce("r", F.lit(False)), stamped).otherwise(meta)).drop("s", "r")


def enrich_summary(items: DataFrame, details: DataFrame, short: int = 200, least_reason: int = 60, body_cap: int = 1200, cap: int = 1400) -> DataFrame:
    """(id, summary): a short summary is followed by the detail's reason, or by its text where the reason is short."""
    rows = items.join(details.select(F.col("id").alias("detail_id"), "reason", "article"), F.col("id") == F.col("detail_id"), "left")
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))
    body = F.substring(F.when(F.length(flat("reason")) < least_reason, flat("article")).otherwise(flat("reason")), 1, body_cap)
    head = F.trim(F.coalesce("summary", F.lit("")))
    merged = F.when((head != "") & ~F.contains(body, head), F.concat(head, F.lit("\n"), body)).otherwise(body)
    return rows.select("id", F.when((F.length(head) < short) & (body != ""), F.substring(merged, 1, cap)).otherwise(F.col("summary")).alias("summary"))


def corpus_summary(items: DataFrame) -> DataFrame:
    """By source: count, first and last published, and how many are scored, kept, annotated, undated."""
    return items.groupBy("source").agg(F.count("*").alias("n"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"), F.count("cross_score").alias("scored"), F.count_if(F.coalesce("kept", F.lit(False))).alias("kept"), F.count_if(F.coalesce("insight", F.lit("")) != "").alias("annotated"), F.count_if(F.col("published_at").isNull()).alias("undated"))
