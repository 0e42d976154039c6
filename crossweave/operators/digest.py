"""Weekly digests."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossweave.functions.components import read_files, settle, shared_folder, shuffles_end_here
from crossweave.functions.ranks import placed
from crossweave.functions.text import grams2
from crossweave.operators.axes import with_axes

CUT, LEAST_GRAMS = 0.22, 4
#: Classes of titles in a tile (titles, where all their pairs are told), at most by chance a little more.
TILE = 4096
#: Pairs of characters that a task has a table of at a time, and titles whose pairs it tells at a time.
NAMES, TOLD = 2048, 512


def digest_pool(items: DataFrame, sources: DataFrame) -> DataFrame:
    """(week, place, id, ...): by week the kept items by score and relevance, then its other regulatory items, newest first."""
    reg = F.broadcast(sources.where("regulatory").select(F.col("source").alias("s"), F.lit(True).alias("r")))
    rows = items.where("published_week is not null").join(reg, F.col("source") == F.col("s"), "left").drop("s")
    rows = rows.withColumn("regulatory", F.coalesce("r", F.lit(False))).drop("r").withColumn("kept", F.coalesce("kept", F.lit(False))).where("kept or regulatory")
    kept = F.col("kept")
    order = [kept.desc(), F.when(kept, F.col("cross_score")).desc_nulls_last(), F.when(kept, F.col("relevance")).desc_nulls_last(), F.when(~kept, F.col("published_at")).desc_nulls_last(), F.asc("id")]
    return placed(rows, "published_week", order).withColumnRenamed("published_week", "week")


def digest_regulatory(pool: DataFrame, per_axis: int = 5) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("week").orderBy("place"))
    return pool.where("regulatory").withColumn("rank", place).where(F.col("rank") <= per_axis).select("week", "rank", "id", "title")


def title_classes(titles: DataFrame, cut: float = CUT) -> tuple[DataFrame, DataFrame]:
    """(week, rep, id) and (week, a, b): every title's class, which is that of the titles of its week with the same set
    of pairs of characters (rep is the least id), and the pairs a < b of classes that share enough, by the smaller set.

    Both sets must have four pairs at least. A week's classes lie in tiles of TILE at most, each written once, of which a task
    reads two; what two classes share comes from a product of the tiles' tables, so that only close pairs leave a task."""
    rows = settle(_sets(titles), "grams")
    kinds = settle(rows.groupBy("week", "g").agg(F.min("id").alias("rep")), "kinds")
    members = rows.join(kinds, ["week", "g"]).select("week", "rep", "id")
    path = _tiles(kinds)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for week, t1, t2 in (key for batch in batches for key in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            one = _tile(path, week, t1)
            both = one if t1 == t2 else tuple(np.concatenate(c) for c in zip(one, _tile(path, week, t2), strict=True))
            for x, y in _close(*both, len(one[0]), t1 == t2, cut):
                yield pa.record_batch([pa.array([week] * len(x), pa.string()), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["week", "a", "b"])

    return members, _meetings(kinds).mapInArrow(compare, "week string, a long, b long")


def _sets(titles: DataFrame) -> DataFrame:
    """(week, id, g): the sorted pairs of characters of the titles that have enough of them."""
    number = lambda g: F.ascii(g).cast("long") * (1 << 21) + F.ascii(F.substring(g, 2, 1))  # noqa: E731  a pair's code points as one number
    return titles.select("week", "id", F.sort_array(F.transform(grams2("title"), number)).alias("g")).where(F.size("g") >= LEAST_GRAMS)


def _tiles(kinds: DataFrame, spot: str = "xxhash64(rep)") -> str:
    """The folder to which sets (week, rep, g) are written once, by week and tile, which `spot` tells; what is shuffled grows with the sets."""
    path = f"{shared_folder(kinds.sparkSession)}/crossweave-{uuid.uuid4().hex}/tiles"
    tiles = kinds.groupBy("week").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))  # a row for each week
    dealt = kinds.join(F.broadcast(tiles), "week").select(F.hex("week").alias("w"), F.pmod(F.expr(spot), "tiles").cast("int").alias("tile"), "rep", "g")
    with shuffles_end_here(kinds.sparkSession):
        dealt.hint("rebalance", "w", "tile").write.partitionBy("w", "tile").parquet(path)
    return path


def _meetings(kinds: DataFrame) -> DataFrame:
    """(week, t1, t2): each two tiles of a week, and each with itself, dealt to the tasks."""
    tiles = kinds.where("week is not null").groupBy("week").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    meet = tiles.select("week", "tiles", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("t1"))
    meet = meet.select("week", "t1", F.explode(F.sequence(F.col("t1"), F.col("tiles") - 1)).alias("t2"))
    return meet.repartition(int(kinds.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _tile(path: str, week: str, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tile's ids, the sizes of their sets and the sets one after the other."""
    parts = [(b.column("rep").to_numpy(), b.column("g").value_lengths().to_numpy(), b.column("g").flatten().to_numpy()) for b in read_files(f"{path}/w={week.encode().hex().upper()}/tile={t}", TILE)]
    parts = parts or [(np.zeros(0, np.int64),) * 3]
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _near(size: np.ndarray, grams: np.ndarray, edge: int, alone: bool, cut: float) -> Iterator[tuple[int, np.ndarray]]:
    """(at, table) for some sets at a time, from number `at` on: which others each shares enough with; the first `edge` sets
    meet those after them, or (alone) all meet all."""
    if not alone and edge in (0, len(size)):
        return
    names, column = np.unique(grams, return_inverse=True)
    row, other = np.repeat(np.arange(len(size)), size), 0 if alone else edge
    first = len(size) if alone else edge
    shared = np.zeros((first, len(size) - other), np.float32)  # counts of a few hundred are exact
    for begin in range(0, len(names), NAMES):
        own = np.flatnonzero((column >= begin) & (column < begin + NAMES))
        table = np.zeros((len(size), min(NAMES, len(names) - begin)), np.float32)
        table[row[own], column[own] - begin] = 1
        shared += table[:first] @ table[other:].T
    for at in range(0, first, TOLD):
        to = min(at + TOLD, first)
        yield at, shared[at:to] / np.minimum.outer(size[at:to], size[other:]) >= cut


def _close(rep: np.ndarray, size: np.ndarray, grams: np.ndarray, edge: int, alone: bool, cut: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of classes that share enough: of the first `edge` with the others, or (alone) of all with those after them."""
    for at, table in _near(size, grams, edge, alone, cut):
        x, y = np.nonzero(table)
        x, y = x + at, y + (0 if alone else edge)
        if alone:
            x, y = x[y > x], y[y > x]
        if len(x):
            yield rep[x], rep[y]


def _kinds(size: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each set among the distinct ones, and the sizes and sets of these."""
    ends, seen, place = np.cumsum(size), {}, np.zeros(len(size), np.int64)
    first = np.zeros(len(size), bool)
    for k, (a, b) in enumerate(zip((ends - size).tolist(), ends.tolist(), strict=True)):
        known = len(seen)
        place[k] = seen.setdefault(grams[a:b].tobytes(), known)
        first[k] = len(seen) > known
    return place, size[first], grams[np.repeat(first, size)]


def title_pairs(titles: DataFrame, cut: float = CUT) -> DataFrame:
    """(week, a, b) with a < b: all pairs of close titles of a week, equal ones among them.

    It has as many rows as there are such pairs, which grow with the square of a week's titles; where
    they need not be told one by one read `title_classes`. A week's titles lie in tiles of about TILE,
    equal ones in the same as far as there are not too many. A task reads two tiles, compares their
    classes and tells the titles' pairs some at a time: nothing that grows with the pairs is shuffled,
    broadcast or held."""
    share = max(1, TILE // 8)
    rows = settle(_sets(titles).where("id is not null").select("week", F.col("id").alias("rep"), "g", F.xxhash64("g").alias("h")), "grams")
    large = rows.groupBy("week", "h").agg(F.ceil(F.count("*") / share).alias("parts")).where("parts > 1")  # a share of the rows at most
    path = _tiles(rows.join(F.broadcast(large), ["week", "h"], "left"), "xxhash64(h, pmod(xxhash64(rep), coalesce(parts, 1)))")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for week, t1, t2 in (key for batch in batches for key in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            alone = t1 == t2
            ids, *sets = _tile(path, week, t1)
            kinds, *sets = _kinds(*sets)
            edge, others, other_kinds = len(sets[0]), ids, kinds
            if not alone:
                others, *more = _tile(path, week, t2)
                other_kinds, *more = _kinds(*more)
                sets = [np.concatenate(c) for c in zip(sets, more, strict=True)]
            for at, table in _near(*sets, edge, alone, cut):
                here = np.flatnonzero((kinds >= at) & (kinds < at + len(table)))
                for k in range(0, len(here), TOLD):
                    some = here[k : k + TOLD]
                    x, y = np.nonzero(table[kinds[some] - at][:, other_kinds])
                    x = some[x]
                    if alone:
                        x, y = x[y > x], y[y > x]
                    x, y = ids[x], others[y]
                    if (x == y).any():  # rows that share an id
                        x, y = x[x != y], y[x != y]
                    if len(x):
                        told = pa.record_batch([pa.repeat(pa.scalar(week, pa.string()), len(x)), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["week", "a", "b"])
                        yield from (told.slice(j, 1 << 16) for j in range(0, len(x), 1 << 16))

    return _meetings(rows).mapInArrow(compare, "week string, a long, b long")


def _fresh(candidates: DataFrame, near: DataFrame, told: DataFrame) -> DataFrame:
    """(week, key): candidates (week, rep, key) to which no told class and no candidate with a lesser key is close.

    Whether a candidate is fresh hangs on what was looked at before it, not on what was chosen, so
    that keys of classes tell it: a class's first candidate is fresh if no class near it begins earlier."""
    first = candidates.where("rep is not null").groupBy("week", "rep").agg(F.min("key").alias("key"))
    earlier = near.join(first.toDF("week", "other", "other_key"), ["week", "other"]).groupBy("week", "rep").agg(F.min("other_key").alias("other_key"))
    closed = told.union(near.join(told.toDF("week", "other"), ["week", "other"]).select("week", "rep"))
    open_ones = first.join(closed, ["week", "rep"], "left_anti").join(earlier, ["week", "rep"], "left")
    alone = candidates.where("rep is null").select("week", "key")  # too few pairs of characters to be close to any
    return open_ones.where(F.col("other_key").isNull() | (F.col("key") < F.col("other_key"))).select("week", "key").union(alone)


def digest_sections(pool: DataFrame, item_axes: DataFrame, axes: list[str], top_crossing: int = 5, per_axis: int = 5, cut: float = CUT) -> DataFrame:
    """(week, section, place, id): the crossing section (three axes first, then two), then each of the given axes by relevance.

    An item appears once, regulatory ones nowhere; a title close to one seen before is passed over but
    still counts as seen. What a section sees are its candidates up to its last choice, or all where it is
    not filled. Each section is a few joins by week and class of titles for all weeks at once; a week is never
    one group, and of a week's candidates the window ranks the first few."""
    rows = with_axes(pool.where("not regulatory").select("week", "place", "id", "title", "relevance"), item_axes).where(F.size("axes") > 0)
    members, close = title_classes(rows, cut)
    near = settle(close.toDF("week", "rep", "other").union(close.select("week", "b", "a")), "near")
    by_place = F.struct(F.lit(0.0).alias("r"), "place", "id")
    by_relevance = F.struct((-F.coalesce("relevance", F.lit(0.0))).alias("r"), "place", "id")
    rows = rows.join(members, ["week", "id"], "left").select("week", "rep", "axes", by_place.alias("by_place"), by_relevance.alias("by_relevance"), F.lit(False).alias("seen"))
    rows = settle(rows, "candidates")
    sections = [("crossing", F.size("axes") == n, "by_place", top_crossing) for n in (3, 2)]
    sections += [(axis, F.array_contains("axes", axis), "by_relevance", per_axis) for axis in axes]
    chosen = None
    for section, wanted, key, room in sections:
        told = rows.where("seen and rep is not null").select("week", "rep").distinct()
        before = None
        if chosen is not None:
            before = chosen.where(F.col("section") == section).groupBy("week").agg(F.count("*").alias("before"))
        fresh = _fresh(rows.where(wanted & ~F.col("seen")).select("week", "rep", F.col(key).alias("key")), near, told)
        first = fresh.withColumn("rank", F.row_number().over(Window.partitionBy("week").orderBy("key"))).where(F.col("rank") <= room)
        first = first.join(before, "week", "left").withColumn("before", F.coalesce("before", F.lit(0))) if before is not None else first.withColumn("before", F.lit(0))
        first = first.withColumn("place", (F.col("rank") + F.col("before")).cast("int")).where(F.col("place") <= room)
        own = settle(first.select("week", F.lit(section).alias("section"), "place", F.col("key.id").alias("id"), "key"), "chosen")
        chosen = own if chosen is None else chosen.union(own)
        # a section that is filled saw its candidates up to the last choice, another one all
        filled = chosen.where(F.col("section") == section).groupBy("week").agg((F.count("*") == room).alias("filled"))
        ends = filled.join(own.groupBy("week").agg(F.max("key").alias("end")), "week", "left")
        saw = F.when(F.coalesce("filled", F.lit(False)), F.coalesce(F.col(key) <= F.col("end"), F.lit(False))).otherwise(True)
        rows = settle(rows.join(ends, "week", "left").withColumn("seen", F.col("seen") | (wanted & saw)).drop("filled", "end"), "candidates")
    return chosen.select("week", "section", "place", "id")


def digest_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """(week, lead, body): new body keys over the old ones; lead and keys that others wrote stay."""
    o = old.select(F.col("week").alias("ow"), F.col("lead").alias("old_lead"), F.col("body").alias("old_body"))
    n = new.select(F.col("week").alias("nw"), F.col("body").alias("new_body"))
    rows = o.join(n, F.col("ow") == F.col("nw"), "full_outer")
    empty = F.create_map().cast("map<string,string>")
    before, after = F.coalesce("old_body", empty), F.coalesce("new_body", empty)
    merged = F.map_concat(F.map_filter(before, lambda k, _: ~F.array_contains(F.map_keys(after), k)), after)
    return rows.select(F.coalesce("nw", "ow").alias("week"), F.col("old_lead").alias("lead"), merged.alias("body"))


def humanize_weeks(texts: DataFrame, default_year: int, column: str = "text") -> DataFrame:
    """'W35' and '2026-W35' in a text become readers' names; numbers outside 1 to 53 stay."""
    from datetime import date

    pattern = re.compile(r"(?<![A-Za-z0-9])(?:(\d{4})-)?W(\d{1,2})(?![0-9])")

    def name(m: re.Match) -> str:
        year, number = int(m[1] or default_year), int(m[2])
        try:
            thursday = date.fromisocalendar(year, number, 4)
        except ValueError:
            return m[0]
        return f"{thursday.year}년 {thursday.month}월 {(thursday.day - 1) // 7 + 1}주차"

    def change(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            yield part.map(lambda t: pattern.sub(name, t), na_action="ignore")

    return texts.withColumn(column, F.pandas_udf(change, "string")(F.col(column)))
