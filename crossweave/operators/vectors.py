"""Relevance by embeddings, thresholds, and near-duplicate clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossweave.functions.components import components, star_forest
from crossweave.functions.numbers import dot, norm
from crossweave.functions.ranks import quantiles

#: Vectors of a block are compared in tiles of so many.
TILE = 4096


def missing_embeddings(items: DataFrame, vectors: DataFrame) -> DataFrame:
    return items.select("id").join(vectors.select(F.col("id").alias("v")), F.col("id") == F.col("v"), "left_anti")


def centroid(vectors: DataFrame) -> DataFrame:
    """One row (centroid): the mean vector scaled to length 1. Means are taken by dimension, with map-side combine."""
    means = vectors.select(F.posexplode("embedding").alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = means.agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("mean"))
    return mean.select(F.transform("mean", lambda x: x / norm("mean")).alias("centroid"))


def contrast_relevance(vectors: DataFrame, positive: DataFrame, negative: DataFrame | None = None) -> DataFrame:
    """(id, relevance): cosine with the positive centroid, less that with the negative one."""
    rows = vectors.crossJoin(F.broadcast(centroid(positive).withColumnRenamed("centroid", "pos")))
    score = dot("embedding", "pos") / norm("embedding")
    if negative is not None:
        rows = rows.crossJoin(F.broadcast(centroid(negative).withColumnRenamed("centroid", "neg")))
        score = score - dot("embedding", "neg") / norm("embedding")
    return rows.select("id", score.alias("relevance"))


def similarity_quantiles(scores: DataFrame, column: str = "relevance") -> DataFrame:
    """Exact quantiles with linear interpolation, mean and extremes: one row, of nulls where there is no score."""
    marks = [0.5, 0.75, 0.9, 0.95, 0.99]
    found = quantiles(scores, column, marks).agg(*[F.max(F.when(F.col("mark") == m, F.col("value"))).alias(f"p{round(m * 100)}") for m in marks])
    stats = scores.agg(F.avg(column).alias("mean"), F.min(column).alias("least"), F.max(column).alias("most"))
    return found.crossJoin(stats)  # one row and one row


def threshold_sweep(scores: DataFrame, grid: list[float], column: str = "relevance") -> DataFrame:
    """(threshold, passed, pct): one pass over the scores, one conditional count for each threshold."""
    counts = scores.agg(F.count("*").alias("total"), *[F.count_if(F.col(column) >= t).alias(f"t{k}") for k, t in enumerate(grid)])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{k}").alias("passed")) for k, t in enumerate(grid)])
    return counts.select("total", F.explode(rows).alias("r")).select("r.threshold", "r.passed", (F.lit(100.0) * F.col("r.passed") / F.col("total")).alias("pct"))


def near_pairs(rows: DataFrame, cut: float) -> DataFrame:
    """(a, b): pairs of ids of one block that connect the same ids as all pairs with cosine >= cut, of a table (block, id, embedding).

    A block is dealt into tiles of about TILE vectors, and each pair of tiles is a task's matrix
    product in double precision; of the pairs at the cut or above a spanning forest leaves it, so that
    a group of copies gives as many rows as it has members."""
    clean = rows.where("embedding is not null and size(embedding) > 0")
    n = clean.groupBy("block").agg(F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("tiles"))
    dealt = clean.join(n, "block").withColumn("tile", F.pmod(F.xxhash64("id"), "tiles").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("block", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "tile", "id", "embedding")
    dealt = dealt.repartition("block", "t1", "t2").sortWithinPartitions("block", "t1", "t2", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            tiles, ids = np.array([h[0] for h in held]), np.array([h[1] for h in held], np.int64)
            x = np.stack([h[2] for h in held]).astype(np.float64)
            length = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
            out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in range(0, len(x), 512):
                i, j = np.nonzero(x[k : k + 512] @ x.T >= cut)
                i += k
                fine = ids[i] < ids[j]
                if now[1] != now[2]:
                    fine &= tiles[i] != tiles[j]
                node, root = star_forest(ids[i[fine]], ids[j[fine]])
                out_a.append(root)
                out_b.append(node)
            node, root = star_forest(np.concatenate(out_a), np.concatenate(out_b))
            return pa.record_batch([pa.array(root), pa.array(node)], names=["a", "b"])

        for batch in batches:
            block, t1, t2, tile, ids = (batch.column(k).to_pylist() for k in range(5))
            vectors = batch.column(5).to_numpy(zero_copy_only=False)
            for k in range(batch.num_rows):
                key = (block[k], t1[k], t2[k])
                if key != now:
                    if held:
                        yield done()
                    now, held = key, []
                held.append((tile[k], ids[k], vectors[k]))
        if held:
            yield done()

    return dealt.mapInArrow(run, "a long, b long")


def near_dup_clusters(rows: DataFrame, cut: float) -> DataFrame:
    """(id, survivor) of a table (block, id, embedding, place): each member of a connected group of near
    pairs and the group's member with the lowest place (then id). Chains merge. Singletons have no row."""
    roots = components(near_pairs(rows, cut))
    members = rows.select("id", "place").join(roots, F.col("id") == F.col("node")).select("id", "root", "place")
    best = members.groupBy("root").agg(F.min(F.struct("place", "id")).alias("best"))
    return members.join(best, "root").select("id", F.col("best.id").alias("survivor"))


def weekly_dedup(items: DataFrame, vectors: DataFrame, cut: float) -> DataFrame:
    """Near duplicates within each published week (those without a week together); the survivor has the
    highest cross_score, then the lowest id."""
    rows = items.select("id", F.coalesce("published_week", F.lit("?")).alias("block"), (-F.coalesce("cross_score", F.lit(0.0))).alias("place"))
    return near_dup_clusters(rows.join(vectors, "id"), cut)


def global_dedup(scores: DataFrame, vectors: DataFrame, cut: float, least: float) -> DataFrame:
    """The same over all items of at least some relevance, the most relevant surviving."""
    rows = scores.where(F.col("relevance") >= least).select("id", F.lit("all").alias("block"), (-F.col("relevance")).alias("place"))
    return near_dup_clusters(rows.join(vectors, "id"), cut)


def kept_flag_axes(items: DataFrame, item_axes: DataFrame, clusters: DataFrame) -> DataFrame:
    """(id, kept): has an axis, and survives its group."""
    tagged = item_axes.select("item_id").distinct()
    lost = clusters.where("id <> survivor").select(F.col("id").alias("lost"))
    rows = items.select("id").join(tagged, F.col("id") == F.col("item_id"), "left").join(lost, F.col("id") == F.col("lost"), "left")
    return rows.select("id", (F.col("item_id").isNotNull() & F.col("lost").isNull()).alias("kept"))


def kept_flag_embedding(items: DataFrame, scores: DataFrame, item_axes: DataFrame, clusters: DataFrame, threshold: float) -> DataFrame:
    """(id, kept): at least one axis, relevance at the threshold, and survives its group."""
    rows = kept_flag_axes(items, item_axes, clusters).withColumnRenamed("kept", "fits").join(scores, "id", "left")
    return rows.select("id", (F.col("fits") & F.coalesce(F.col("relevance") >= threshold, F.lit(False))).alias("kept"))


def changed_flags(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, kept) of the rows whose flag is not what it was; null is a state of its own."""
    old = before.select(F.col("id").alias("old_id"), F.col("kept").alias("old"))
    return after.join(old, F.col("id") == F.col("old_id"), "left").where(~F.col("kept").eqNullSafe(F.col("old"))).select("id", "kept")


def source_similarity(items: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    rows = items.select("id", "source").join(scores, "id")
    return rows.groupBy("source").agg(F.count_if(F.col("relevance") >= threshold).alias("passed"), F.count("*").alias("total"), F.avg("relevance").alias("mean"))


def top_similar(items: DataFrame, scores: DataFrame, k: int = 10) -> DataFrame:
    best = scores.orderBy(F.desc("relevance"), "id").limit(k)
    return best.join(items.select("id", "title"), "id").select("id", "title", "relevance")


def borderline_items(scores: DataFrame, threshold: float, width: float = 0.02, most: int = 20) -> DataFrame:
    near = F.abs(F.col("relevance") - F.lit(threshold))
    return scores.where(near <= width).orderBy(near, "id").limit(most).select("id", "relevance")


def similarity_query(items: DataFrame, scores: DataFrame, part: str) -> DataFrame:
    found = items.where(F.col("title").contains(part)).select("id", "title")
    return found.join(scores, "id")


def rank_in(column: str, *order) -> Window:
    return Window.partitionBy(column).orderBy(*order)
