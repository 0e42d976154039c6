"""Places in groups of any size, and the values at given places, by sorted ranges and the sums of their sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossweave.functions.components import settle


def _ranges(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows sorted over all partitions, with the partition (_range) and the place in it (_at, from 0), written so that both stay as they are."""
    rows = rows.sort(*order).withColumn("_i", F.monotonically_increasing_id())
    return settle(rows.withColumn("_range", F.shiftright("_i", 33)).withColumn("_at", F.col("_i").bitwiseAND((1 << 33) - 1)).drop("_i"), "ranges")


def placed(rows: DataFrame, by: str, order: list[Column], name: str = "place") -> DataFrame:
    """Rows with their place (long, from 1) in the group of `by`, a null being a group; the order has no ties.

    A window over the group would put it in one task. Here a group spreads over as many sorted ranges as it fills, and
    what a window sees is a row for each group and range that meet."""
    sorted_rows = _ranges(rows, [F.col(by).asc(), *order])
    sizes = sorted_rows.groupBy("_range", F.col(by).alias("_group")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = F.sum("_n").over(Window.partitionBy("_group").orderBy("_range")) - F.col("_n")
    begins = sizes.select(F.col("_range").alias("_r"), "_group", (earlier - F.col("_first") + 1).alias("_shift"))
    found = sorted_rows.join(begins, (F.col("_range") == F.col("_r")) & F.col(by).eqNullSafe(F.col("_group")))
    return found.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(name))


def quantiles(rows: DataFrame, column: str, marks: list[float]) -> DataFrame:
    """(mark, value): exact quantiles with linear interpolation, nulls left out; no row where there is no value.

    Equal values are counted before they are sorted into ranges; the ranges' sums tell which of them hold the places that
    are asked for, and only those (two at most for each mark) are gone through, each in a task of its own, which spills."""
    values = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    values = _ranges(values, [F.col("_v").asc()])
    sums = values.groupBy("_range").agg(F.sum("_n").alias("_k"))
    begins = sums.select("_range", "_k", (F.sum("_k").over(Window.orderBy("_range")) - F.col("_k")).alias("_begin"))  # a row for each range
    spots = F.explode(F.array(*[F.struct(F.lit(m).alias("mark"), (F.lit(m) * (F.col("_all") - 1)).alias("_spot")) for m in marks]))
    asked = sums.agg(F.sum("_k").alias("_all")).where("_all > 0").select(spots.alias("s")).select("s.*")
    low, high = F.floor("_spot"), F.ceil("_spot")
    ends = F.array(F.struct(low.alias("_place"), F.when(low == high, 1.0).otherwise(high - F.col("_spot")).alias("_w")), F.struct(high.alias("_place"), (F.col("_spot") - low).alias("_w")))
    asked = asked.select("mark", F.explode(ends).alias("e")).select("mark", "e.*").where("_w > 0")
    held = begins.join(F.broadcast(asked), (F.col("_place") >= F.col("_begin")) & (F.col("_place") < F.col("_begin") + F.col("_k")))  # two rows for each mark
    held = settle(held.select("_range", "_begin", "mark", "_place", "_w"), "held")
    stop = F.col("_begin") + F.sum("_n").over(Window.partitionBy("_range").orderBy("_v"))
    run = values.join(F.broadcast(held.select("_range", "_begin").distinct()), "_range").select("_range", "_v", "_n", stop.alias("_stop"))
    got = run.join(F.broadcast(held.drop("_begin")), "_range").where((F.col("_place") < F.col("_stop")) & (F.col("_place") >= F.col("_stop") - F.col("_n")))
    value = F.when(F.min("_v") == F.max("_v"), F.max("_v").cast("double")).otherwise(F.sum(F.col("_v") * F.col("_w")))
    return got.groupBy("mark").agg(value.alias("value"))
