"""The same tables from streams of landed records and events."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.functions.components import shared_folder
from crossweave.operators.alerts import alert_state
from crossweave.sources.ingest import append_new, normalize_items, parse_lines

#: Weeks begin on Mondays; the epoch was a Thursday.
WEEK, MONDAY = "7 days", "4 days"


def read_lines(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Lines of landed files as they arrive."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


def stream_ingest(spark: SparkSession, source: str, target: str, checkpoint: str, now: str, rejects: str | None = None) -> None:
    """Landed JSON lines to the items table, each key once, also when a batch is run again.

    A batch is cut to unseen keys against the table before it is appended, and the checkpoint moves
    on only after that. Rejects are a part of their own for each batch."""

    def batch(lines: DataFrame, number: int) -> None:
        records, bad = parse_lines(lines)
        append_new(lines.sparkSession, target, normalize_items(records, now))
        if rejects:
            bad.write.mode("overwrite").text(f"{rejects}/batch={number}")

    run = read_lines(spark, source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()


def bounded_dedup(events: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """First of each key, with state no longer than the delay."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def weekly_counts(events: DataFrame, time: str, by: str, delay: str | None = None) -> DataFrame:
    """(week_start, by, n) by event time; the same on a table and on a stream."""
    rows = events.withWatermark(time, delay) if delay else events
    n = rows.groupBy(F.window(time, WEEK, WEEK, MONDAY).alias("w"), by).agg(F.count("*").alias("n"))
    return n.select(F.col("w.start").alias("week_start"), by, "n")


def sliding_counts(events: DataFrame, time: str, by: str, delay: str | None = None) -> DataFrame:
    """(window_start, window_end, by, n): four weeks, every week."""
    rows = events.withWatermark(time, delay) if delay else events
    n = rows.groupBy(F.window(time, "28 days", WEEK, MONDAY).alias("w"), by).agg(F.count("*").alias("n"))
    return n.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n")


def trailing_counts(events: DataFrame, time: str, by: str, back: int = 4, delay: str | None = None) -> DataFrame:
    """(week_start, by, n, before): rows of a week and of the `back` weeks before it; the same on a table and on a stream.

    A window of back + 1 weeks holds a week and its past, so that a key has one state for each open week and the
    watermark lets go of it with the week. Keys that a week has no row of are left out."""
    rows = events.withWatermark(time, delay) if delay else events
    rows = rows.select(F.window(time, f"{7 * (back + 1)} days", WEEK, MONDAY).alias("w"), F.col(time).alias("at"), by)
    week = F.col("w.end") - F.expr(f"interval {WEEK}")
    n = rows.groupBy("w", by).agg(F.count_if(F.col("at") >= week).alias("n"), F.count_if(F.col("at") < week).alias("before"))
    return n.select(week.alias("week_start"), by, "n", "before")


def compared(counts: DataFrame, by: str, least: int = 1) -> DataFrame:
    """(week_start, by, n, before, share, prev_share, score, is_new) of keys with `least` rows in a week, from trailing_counts.

    Shares are of all rows of the week and of its past, so that a week with more rows of every key lifts none; one row's
    share is added to the past, so that a new key has a score."""
    totals = counts.groupBy("week_start").agg(F.greatest(F.sum("n"), F.lit(1)).alias("now"), F.greatest(F.sum("before"), F.lit(1)).alias("then"))
    rows = counts.where(F.col("n") >= max(least, 1)).join(totals, "week_start")
    share, past = F.col("n") / F.col("now"), F.col("before") / F.col("then")
    return rows.select("week_start", by, "n", "before", share.alias("share"), past.alias("prev_share"), (share / (past + F.lit(1) / F.col("now"))).alias("score"), (F.col("before") == 0).alias("is_new"))


def stream_compare(events: DataFrame, time: str, by: str, delay: str, counts: str, out: str, checkpoint: str, back: int = 4, least: int = 1) -> None:
    """Each week against its past, told once, when no row of it is awaited any more.

    All keys of a week end in one batch, as the watermark is one for all, so that a batch has the whole totals of
    its weeks. It writes its own parts of `counts` and `out`, which a batch that is run again replaces."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{counts}/batch={number}")
        ended = rows.sparkSession.read.schema(rows.schema).parquet(f"{counts}/batch={number}")
        compared(ended, by, least).write.mode("overwrite").parquet(f"{out}/batch={number}")

    n = trailing_counts(events, time, by, back, delay)
    n.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def freshness(events: DataFrame, time: str, by: str, now: str, late_days: int = 3) -> DataFrame:
    """(by, last_at, late): newest event of each; in a stream the state is one row for each."""
    last = events.groupBy(by).agg(F.max(time).alias("last_at"))
    return last.select(by, "last_at", (F.datediff(F.to_timestamp(F.lit(now)), "last_at") > late_days).alias("late"))


def run_to_table(streamed: DataFrame, checkpoint: str, path: str, mode: str = "append") -> None:
    """A stream's result as a Parquet table; in complete and update mode the last batch's rows replace their keys."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = streamed.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    writer.foreachBatch(batch).start().awaitTermination()


def stream_alerts(hits: DataFrame, state_path: str, out: str, checkpoint: str, most: int = 5000, before: DataFrame | None = None) -> None:
    """Each hit (keyword, id) is told once, whatever batch is run again and wherever a run breaks off.

    What a batch tells is a function of its rows and of the ids remembered after the batch before, and
    what it remembers is written apart from what it read: state_path has two slots, a batch reads its
    predecessor's and writes its own, so that its input is whole until the next batch has begun. The
    output of a batch is a part of `out` of its own, written before its state. A batch that is run
    again thus writes the same two parts anew. `before` has ids that are remembered at the start, for a
    checkpoint that is new. The state has `most` ids at most (see alert_state)."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        if number:
            seen = spark.read.schema("id long, after long").parquet(f"{state_path}/slot={(number - 1) % 2}").where(F.col("after") == number - 1).select("id")
        else:
            seen = before.select("id") if before is not None else spark.createDataFrame([], "id long")
        others = [c for c in rows.columns if c not in ("keyword", "id")]
        once = rows.groupBy("keyword", "id").agg(F.min(F.struct(F.lit(0).alias("one"), *others)).alias("r"))
        new = once.join(seen.select(F.col("id").alias("seen")), F.col("id") == F.col("seen"), "left_anti")
        new.select(*[F.col(f"r.`{c}`").alias(c) if c in others else F.col(c) for c in rows.columns]).write.mode("overwrite").parquet(f"{out}/batch={number}")
        told = spark.read.schema(rows.schema).parquet(f"{out}/batch={number}")
        alert_state(seen, told, most).withColumn("after", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{state_path}/slot={number % 2}")

    hits.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def route_late(events: DataFrame, time: str, delay: str, table: str, backfill: str, edges: str, checkpoint: str) -> None:
    """Weekly counts that lose no late row: rows older than the newest event of all batches before, less the delay, are
    kept aside (backfill) for a run that counts their weeks anew; the others are added to their weeks.

    Every batch writes its own part of each table, so that a batch that is run again replaces it; `edges`
    has the newest event of each batch, a row for each."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        newest = rows.agg(F.max(time).alias("newest")).withColumn("batch", F.lit(number))
        before = None
        if number:
            known = spark.read.schema("newest timestamp, batch int").parquet(edges)
            before = known.where(F.col("batch") < number).agg(F.max("newest")).first()[0]
        marked = rows.withColumn("week", F.date_format(F.window(time, WEEK, WEEK, MONDAY)["start"], "yyyy-MM-dd"))
        late = F.col(time) < F.lit(before) - F.expr(f"interval {delay}") if before is not None else F.lit(False)
        late = F.coalesce(late, F.lit(False))
        own = lambda df, path: df.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        own(marked.where(late), backfill)
        own(marked.where(~late).groupBy("week").agg(F.count("*").alias("n")), table)
        own(newest, edges)

    events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def routed_counts(spark: SparkSession, table: str, backfill: str) -> DataFrame:
    """(week, on_time, late, n): the weeks' counts with the rows that were kept aside."""
    on_time = spark.read.schema("week string, n long, batch int").parquet(table).groupBy("week").agg(F.sum("n").alias("on_time"), F.lit(0).cast("long").alias("late"))
    late = spark.read.schema("week string, batch int").parquet(backfill).groupBy("week").agg(F.lit(0).cast("long").alias("on_time"), F.count("*").alias("late"))
    return on_time.union(late).groupBy("week").agg(F.sum("on_time").alias("on_time"), F.sum("late").alias("late"), (F.sum("on_time") + F.sum("late")).alias("n"))


def replay(events: DataFrame, work: Callable[[DataFrame], None], pieces: int = 4, order: str = "ts", then: DataFrame | None = None, files: int = 1) -> None:
    """Writes a table in parts in order of time, and `then` as the last one, and streams them part by part: for
    tests and queries that hold a stream against the table. A part is written by so many tasks,
    which needs several times as many rows in all parts but the last."""
    spark = events.sparkSession
    base = scratch(spark)
    for k, part in enumerate([*split_by_time(events, pieces, order), *([then] if then is not None else [])]):
        part.select(*events.columns).repartition(files).write.parquet(f"{base}/in/part={k}")
    work(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(f"{base}/in"))


def scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/crossweave-{uuid.uuid4().hex}"


def split_by_time(events: DataFrame, pieces: int, order: str = "ts") -> list[DataFrame]:
    marks = events.select(F.percentile_approx(F.unix_micros(order), [k / pieces for k in range(1, pieces)], 10_000)).first()[0] or []
    edges = [None, *marks, None]
    at = F.unix_micros(order)
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        test = F.lit(True)
        if a is not None:
            test = test & (at >= a)
        if b is not None:
            test = test & (at < b)
        out.append(events.where(test))
    return out

