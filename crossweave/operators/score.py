"""Crossing scores: how many axes an item joins, weighted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossweave.functions.numbers import round_half_even
from crossweave.operators.axes import with_axes


def cross_score(items: DataFrame, item_axes: DataFrame, count_weight: dict[int, float], axis_weight: dict[str, float], min_axes: int = 1) -> DataFrame:
    """(id, n_axes, cross_score): weight of the number of axes times the sum of the axes' weights.

    Under min_axes the score is 0, also for items without a tag. A number of axes without a weight, or
    with weight 0, takes the largest weight; an axis without a weight counts 1."""
    weights = F.create_map(*[x for a, w in axis_weight.items() for x in (F.lit(a), F.lit(float(w)))]) if axis_weight else None
    weight = F.coalesce(weights[F.col("axis")], F.lit(1.0)) if weights is not None else F.lit(1.0)
    tagged = item_axes.select("item_id", "axis", weight.alias("w")).groupBy("item_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("w")).alias("ws"))
    most = max(count_weight.values()) if count_weight else 1.0
    by_count = F.lit(float(most))
    for k, w in count_weight.items():
        if w:
            by_count = F.when(F.col("n") == k, F.lit(float(w))).otherwise(by_count)
    total = F.aggregate("ws", F.lit(0.0), lambda a, x: a + x)  # in a fixed order, so that sums do not depend on the plan
    score = F.when(F.coalesce("n", F.lit(0)) < min_axes, F.lit(0.0)).otherwise(round_half_even(by_count * F.coalesce(total, F.lit(0.0)), 4))
    joined = items.select("id").join(tagged, F.col("id") == F.col("item_id"), "left")
    return joined.select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_axes"), score.alias("cross_score"))


def score_distribution(scored: DataFrame) -> DataFrame:
    n = scored.groupBy("cross_score").agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy())).orderBy(F.desc("cross_score"))


def axis_combinations(items: DataFrame, item_axes: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Items by sorted combination of axes' labels, '(none)' for none."""
    tagged = with_axes(items.select("id"), item_axes)
    names = F.col("axes")
    if labels:
        book = F.create_map(*[x for a, n in labels.items() for x in (F.lit(a), F.lit(n))])
        names = F.transform("axes", lambda a: F.coalesce(book[a], a))
    combo = F.when(F.size("axes") == 0, F.lit("(none)")).otherwise(F.array_join(names, "+"))
    return tagged.groupBy(combo.alias("combo")).agg(F.count("*").alias("n"))


def top_by_score(items: DataFrame, scored: DataFrame, item_axes: DataFrame, k: int = 15) -> DataFrame:
    """The k best items; axes are attached to those alone."""
    best = items.select("id", "title", "source").join(scored.select("id", "cross_score"), "id").orderBy(F.desc("cross_score"), "id").limit(k)
    return with_axes(best, item_axes).withColumn("axes", F.array_join("axes", "+"))


def crossing_count(scored: DataFrame, cut: float = 3.0) -> DataFrame:
    return scored.agg(F.count("cross_score").alias("scored"), F.count_if(F.col("cross_score") >= cut).alias("crossing"))
