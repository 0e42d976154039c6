"""Quality of the filter against human labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossweave.functions.ranks import placed


def _draw(seed: int, column: str = "id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string")))


def label_sample(items: DataFrame, item_axes: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n // 2 kept items and the rest of n not kept, drawn by a seeded hash, with their axes."""
    kept = F.coalesce("kept", F.lit(False))
    rows = items.select("id", kept.alias("kept"))
    first = [rows.where(one).orderBy(_draw(seed), "id").limit(k) for one, k in (("kept", n // 2), ("not kept", n - n // 2))]
    rows = first[0].union(first[1])
    axes = item_axes.groupBy("item_id").agg(F.array_join(F.sort_array(F.collect_set("axis")), "+").alias("axes"))
    return rows.join(axes, F.col("id") == F.col("item_id"), "left").select("id", "kept", F.coalesce("axes", F.lit("")).alias("axes"))


def label_refresh(labels: DataFrame, items: DataFrame) -> DataFrame:
    """Labels as they are, the model's decision from the items; changed tells of another decision than before."""
    now = items.select(F.col("id").alias("item"), F.coalesce("kept", F.lit(False)).alias("now"))
    return labels.join(now, F.col("id") == F.col("item"), "left").select("id", "label", F.coalesce("now", "kept").alias("kept"), (F.col("now").isNotNull() & (F.col("now") != F.col("kept"))).alias("changed"))


def _safe(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def measures(label: Column, decision: Column) -> list[Column]:
    """tp, fp, fn, tn, precision, recall and f1 as aggregates, 0 where a divisor is."""
    tp, fp = F.count_if((label == 1) & decision), F.count_if((label == 0) & decision)
    fn, tn = F.count_if((label == 1) & ~decision), F.count_if((label == 0) & ~decision)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), _safe(tp, tp + fp).alias("precision"), _safe(tp, tp + fn).alias("recall"), _safe(2 * tp, 2 * tp + fp + fn).alias("f1")]


def confusion_matrix(labels: DataFrame) -> DataFrame:
    return labels.where("label in (0, 1)").agg(*measures(F.col("label"), F.coalesce("kept", F.lit(False))))


def threshold_pr(labels: DataFrame, scores: DataFrame, grid: list[float]) -> DataFrame:
    """(threshold, passed, precision, recall) over the labelled rows that have a score, in one pass."""
    rows = labels.where("label in (0, 1)").join(scores, "id").where("relevance is not null")
    each = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), (F.col("relevance") >= t).alias("decision")) for t in grid])
    rows = rows.select("label", F.explode(each).alias("g")).select("label", "g.*")
    m = {c: x for c, x in zip(("tp", "fp", "fn", "tn", "precision", "recall", "f1"), measures(F.col("label"), F.col("decision")), strict=True)}
    return rows.groupBy("threshold").agg(F.count_if("decision").alias("passed"), m["precision"], m["recall"])


def error_cases(labels: DataFrame, scores: DataFrame, k: int = 10) -> DataFrame:
    """(kind, place, id): the most relevant false positives and false negatives."""
    kept = F.coalesce("kept", F.lit(False))
    rows = labels.where("label in (0, 1)").where((F.col("label") == 1) != kept).join(scores, "id", "left")
    rows = rows.select("id", F.when(kept, "false positive").otherwise("false negative").alias("kind"), "relevance")
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.col("relevance").desc_nulls_last(), "id"))
    return rows.withColumn("place", place).where(F.col("place") <= k).select("kind", "place", "id")


def stratified_folds(labels: DataFrame, folds: int = 2, seed: int = 0) -> DataFrame:
    """(id, label, fold): each label's rows in a seeded order, dealt in turn; a label of any size spreads over tasks."""
    rows = placed(labels.select("id", "label", _draw(seed).alias("draw")), "label", [F.asc("draw"), F.asc("id")])
    return rows.select("id", "label", F.pmod("place", F.lit(folds)).cast("int").alias("fold"))


def majority_vote(votes: DataFrame) -> DataFrame:
    """(id, votes, runs, decision): decided by more than half of the runs."""
    sums = votes.groupBy("id").agg(F.count_if("vote").alias("votes"), F.count("*").alias("runs"))
    return sums.withColumn("decision", F.col("votes") * 2 > F.col("runs"))


def metric_spread(runs: DataFrame, metrics: tuple[str, ...] = ("precision", "recall")) -> DataFrame:
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    return runs.select(F.explode(each).alias("m")).groupBy("m.metric").agg(F.avg("m.value").alias("mean"), F.min("m.value").alias("least"), F.max("m.value").alias("most"))


def metrics_by_bucket(labels: DataFrame, item_axes: DataFrame) -> DataFrame:
    """Base rate and measures of labelled rows with one axis and with several."""
    n = item_axes.groupBy("item_id").agg(F.count("*").alias("k"))
    rows = labels.where("label in (0, 1)").join(n, F.col("id") == F.col("item_id"), "left")
    rows = rows.withColumn("bucket", F.when(F.col("k") >= 2, "several").when(F.col("k") == 1, "one").otherwise("none"))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.avg(F.col("label").cast("double")).alias("base_rate"), *measures(F.col("label"), F.coalesce("kept", F.lit(False))))


def relevance_by_axes(labels: DataFrame, item_axes: DataFrame) -> DataFrame:
    n = item_axes.groupBy("item_id").agg(F.count("*").alias("k"))
    rows = labels.where("label in (0, 1)").join(n, F.col("id") == F.col("item_id"), "left")
    return rows.groupBy(F.coalesce("k", F.lit(0)).alias("n_axes")).agg(F.count("*").alias("n"), F.avg(F.col("label").cast("double")).alias("rate"))
