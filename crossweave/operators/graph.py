"""Related-term networks: candidates, edges, axis shares, bridges, ego networks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossweave.functions.components import settle
from crossweave.functions.text import fold_key
from crossweave.operators.index import axis_hits, cooccurrence, listed, pair_strength
from crossweave.operators.trend import fragments


def graph_docs(keywords: DataFrame, items: DataFrame) -> DataFrame:
    """The index (rows or lists) of kept items."""
    return keywords.join(items.where("kept").select(F.col("id").alias("item_id")), "item_id", "left_semi")


def candidates(df: DataFrame, min_df: int, max_nodes: int, stop_words: tuple[str, ...] = (), ratio: float = 0.9) -> DataFrame:
    """(keyword, df): frequent keywords, no stop words, no fragments, the most frequent first."""
    often = df.where(F.col("df") >= min_df).select("keyword", "df")
    if stop_words:
        often = often.where(~F.col("keyword").isin(*stop_words))
    whole = often.join(fragments(often.withColumnRenamed("df", "n"), ratio), "keyword", "left_anti")
    return whole.orderBy(F.desc("df"), "keyword").limit(max_nodes)


def edges(keywords: DataFrame, nodes: DataFrame, df: DataFrame, min_cooc: int, cut: float) -> DataFrame:
    """(a, b, npmi, cooc) among the nodes; pairs in every document have no edge."""
    among = listed(keywords).join(nodes.select("keyword"), "keyword", "left_semi")
    chosen = df.join(nodes.select("keyword"), "keyword", "left_semi")
    strong = pair_strength(cooccurrence(among, chosen, 1), chosen, min_cooc)
    return strong.where((F.col("npmi") >= cut) & (F.col("npmi") != 0)).select("a", "b", "npmi", F.col("n").alias("cooc"))


def axis_shares(keywords: DataFrame, nodes: DataFrame, item_axes: DataFrame) -> DataFrame:
    """(keyword, axis, hits, share, main): a node's items by axis; main marks the dominant one (by name in a tie)."""
    hits = axis_hits(keywords, item_axes).join(nodes.select("keyword"), "keyword", "left_semi").withColumnRenamed("n", "hits")
    by = Window.partitionBy("keyword")
    return hits.select("keyword", "axis", "hits", (F.col("hits") / F.sum("hits").over(by)).alias("share"), (F.row_number().over(by.orderBy(F.desc("hits"), "axis")) == 1).alias("main"))


def bridge_scores(nodes: DataFrame, graph_edges: DataFrame, shares: DataFrame) -> DataFrame:
    """(keyword, df, axis, degree, bridge, spans): bridge is the part of a node's edge weight that leads to
    other axes; spans are the axes that at least two edges lead to."""
    axis = shares.where("main").select("keyword", "axis")
    both = graph_edges.select(F.col("a").alias("keyword"), F.col("b").alias("other"), "npmi").union(graph_edges.select("b", "a", "npmi"))
    ends = both.join(axis, "keyword", "left").join(axis.select(F.col("keyword").alias("other"), F.col("axis").alias("other_axis")), "other", "left")
    out = F.col("other_axis").isNotNull() & ~F.col("other_axis").eqNullSafe(F.col("axis"))
    by_axis = ends.groupBy("keyword", "other_axis").agg(F.count("*").alias("k"), F.sum("npmi").alias("w"), F.sum(F.when(out, F.col("npmi")).otherwise(0.0)).alias("w_out"))
    summed = by_axis.groupBy("keyword").agg(F.sum("k").alias("degree"), F.sum("w").alias("w"), F.sum("w_out").alias("w_out"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("k") >= 2, F.col("other_axis")))), "+").alias("spans"), F.count_if((F.col("k") >= 2) & F.col("other_axis").isNotNull()).alias("n_spans"))
    rows = nodes.join(axis, "keyword", "left").join(summed, "keyword", "left")
    bridge = F.when(F.col("w") > 0, F.col("w_out") / F.col("w")).otherwise(0.0)
    return rows.select("keyword", "df", "axis", F.coalesce("degree", F.lit(0)).alias("degree"), bridge.alias("bridge"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"))


def bridge_top(scores: DataFrame, k: int, min_degree: int = 8) -> DataFrame:
    return scores.where((F.col("n_spans") >= 2) & (F.col("degree") >= min_degree)).orderBy(F.desc(F.round("bridge", 3)), F.desc("degree"), "keyword").limit(k)


def axis_pure_nodes(scores: DataFrame, k: int = 8, min_degree: int = 3, most: float = 0.25) -> DataFrame:
    return scores.where((F.col("degree") >= min_degree) & (F.col("bridge") < most)).orderBy(F.desc("degree"), "keyword").limit(k)


def neighbors_topk(kw_neighbor: DataFrame, frontier: DataFrame, k: int, min_cooc: int = 0) -> DataFrame:
    """The k strongest neighbours of each keyword of the frontier; the count is tested before the cut."""
    rows = kw_neighbor.where(F.col("cooc") >= min_cooc).join(frontier.select("keyword"), "keyword", "left_semi")
    place = F.row_number().over(Window.partitionBy("keyword").orderBy(F.desc("npmi"), F.desc("neighbor")))
    return rows.withColumn("place", place).where(F.col("place") <= k).select("keyword", "neighbor", "npmi", "cooc", "df", "place")


def ego_center(kw_meta: DataFrame, query: str) -> DataFrame:
    """The keyword that a query means: case and spaces do not count, marks do; the most frequent, then the first by name."""
    wanted = fold_key(F.lit(query))
    return kw_meta.where(fold_key(F.col("keyword")) == wanted).orderBy(F.desc("df"), "keyword").limit(1)


def ego_expand(kw_neighbor: DataFrame, center: str, hops: int = 2, per_hop: int = 8, max_nodes: int = 40) -> DataFrame:
    """(keyword, hop): nodes found from the centre, hop by hop.

    Each hop's strongest neighbours are ranked on the cluster; the choice among them, which depends on
    its own order, sees per_hop rows for each of at most max_nodes keywords. Chosen nodes are few and marked as such
    (broadcast), so that the neighbours are not shuffled to meet them. A node that holds, or is
    held by, a chosen one of more than two characters is skipped."""
    hops, per_hop, max_nodes = min(max(hops, 1), 3), min(max(per_hop, 3), 30), min(max(max_nodes, 6), 120)
    spark = kw_neighbor.sparkSession
    chosen, frontier = {center: 0}, [center]
    for hop in range(1, hops + 1):
        room = max_nodes - len(chosen)
        if not frontier or room <= 0:
            break
        budget = max(2, room // len(frontier))
        rows = neighbors_topk(kw_neighbor, F.broadcast(spark.createDataFrame([(k,) for k in frontier], "keyword string")), per_hop)
        found: dict[str, list[str]] = {}
        for r in rows.orderBy("keyword", "place").collect():  # at most per_hop * max_nodes rows
            found.setdefault(r["keyword"], []).append(r["neighbor"])
        following = []
        for k in frontier:
            taken = 0
            for n in found.get(k, []):
                if taken >= budget or len(chosen) >= max_nodes:
                    break
                if n in chosen or any((n in c or c in n) and len(n) > 2 and len(c) > 2 for c in chosen):
                    continue
                chosen[n] = hop
                following.append(n)
                taken += 1
        frontier = following
    return F.broadcast(spark.createDataFrame(list(chosen.items()), "keyword string, hop int"))


def induced_edges(kw_neighbor: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, npmi, cooc): edges between chosen nodes, each once."""
    rows = kw_neighbor.join(nodes.select("keyword"), "keyword", "left_semi").join(nodes.select(F.col("keyword").alias("neighbor")), "neighbor", "left_semi")
    return rows.groupBy(F.least("keyword", "neighbor").alias("a"), F.greatest("keyword", "neighbor").alias("b")).agg(F.max("npmi").alias("npmi"), F.max("cooc").alias("cooc"))


def shortest_hops(nodes: DataFrame, found_edges: DataFrame, center: str, most: int = 6) -> DataFrame:
    """(keyword, hop): steps from the centre over the edges, else the hop at which the node was chosen.

    A join for each step over the few chosen nodes, which are broadcast; the number of steps is bounded by `most`."""
    nodes, found_edges = settle(nodes, "nodes"), settle(found_edges, "edges")
    both = found_edges.select("a", "b").union(found_edges.select("b", "a")).toDF("u", "v")
    reached = nodes.where(F.col("keyword") == center).select("keyword", F.lit(0).alias("d"))
    for step in range(1, most + 1):
        further = reached.where(F.col("d") == step - 1).join(both, F.col("keyword") == F.col("u")).select(F.col("v").alias("keyword"), F.lit(step).alias("d")).distinct()
        reached = reached.union(further).groupBy("keyword").agg(F.min("d").alias("d"))
    return nodes.join(reached, "keyword", "left").select("keyword", F.coalesce("d", "hop").alias("hop"))


def suggest_keywords(kw_meta: DataFrame, part: str, limit: int = 10, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(place, keyword, df): completions of a part, without fragments of longer ones and without
    extensions of chosen ones that are at least half as frequent.

    The most frequent limit * 8 are cut on the cluster; the choice among them depends on its own order."""
    rows = kw_meta.where(F.col("keyword").contains(part)).orderBy(F.desc("df"), "keyword").limit(limit * 8)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        found = pd.concat(parts, ignore_index=True)
        found = found.sort_values(["df", "keyword"], ascending=[False, True])
        words = [(k, n) for k, n in zip(found["keyword"], found["df"], strict=True) if k not in stop_words]
        out: list[tuple[str, int]] = []
        for k, n in words:
            piece = any(k != w and k in w and m >= 0.5 * n for w, m in words)
            longer = any(c in k and n >= 0.5 * m for c, m in out)
            if not piece and not longer and len(out) < limit:
                out.append((k, n))
        yield pd.DataFrame({"place": range(1, len(out) + 1), "keyword": [k for k, _ in out], "df": [n for _, n in out]}).astype({"place": "int32", "keyword": "object", "df": "int64"})

    return rows.select("keyword", "df").coalesce(1).mapInPandas(choose, "place int, keyword string, df long")
