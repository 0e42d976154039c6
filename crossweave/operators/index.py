"""The four aggregate tables that answers are read from."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossweave.functions.components import read_files, settle, shared_folder, shuffles_end_here

MIN_DF, MIN_COOC, CUT, TOP_NEIGHBORS, MOST_ITEMS = 10, 2, 0.15, 20, 60
#: Pairs that a task counts at a time, and numbers of documents that a task holds before it writes them.
BLOCK_PAIRS, HELD_PAIRS = 1 << 20, 1 << 21
#: Pairs of keywords of a tile, at most, and numbers of documents that a group of keywords has, about (two bytes each).
DENSE, GROUP_NUMBERS = 1 << 32, 1 << 25
#: Places that a document has in a group, from which on they are copied one document at a time; pairs that leave a task at a time.
LONG_RUNS, TOLD = 48, 1 << 16
#: Two strengths that differ by less are told apart on the JVM alone, whose logarithm is the query's.
EPS = 1e-9


def listed(keywords: DataFrame) -> DataFrame:
    """An index with a row for each keyword of an item, also from one with a list for each item (keywords.keyword_lists).

    What joins by item does so before this, and counts are combined after it where the lists are read."""
    if "keyword" in keywords.columns:
        return keywords
    rest = [c for c in keywords.columns if c not in ("item_id", "keywords")]
    return keywords.select("item_id", F.explode("keywords").alias("keyword"), *rest)


def kw_week(keywords: DataFrame, items: DataFrame) -> DataFrame:
    """(keyword, week, n): kept items by keyword and week; kept is read from the items."""
    kept = items.where("kept and published_week is not null").select(F.col("id").alias("item_id"))
    return listed(keywords.where("week is not null").join(kept, "item_id", "left_semi")).groupBy("keyword", "week").agg(F.count("*").alias("n"))


def documents_of(keywords: DataFrame) -> DataFrame:
    """(keyword, df): documents of each keyword. Of lists, items that come once are counted where they are read; only those
    that come several times meet by item."""
    if "keyword" in keywords.columns:
        return keywords.groupBy("keyword").agg(F.count_distinct("item_id").alias("df"))
    several = settle(keywords.groupBy("item_id").agg(F.count("*").alias("k")).where("k > 1").select("item_id"), "several")
    once, again = (listed(keywords.select("item_id", "keywords").join(several, "item_id", how)) for how in ("left_anti", "left_semi"))
    return once.union(again.distinct()).groupBy("keyword").agg(F.count("*").alias("df"))


def n_docs(keywords: DataFrame) -> DataFrame:
    """(n_docs): documents in the index, a row."""
    some = keywords if "keyword" in keywords.columns else keywords.where(F.size("keywords") > 0)
    return some.agg(F.count_distinct("item_id").alias("n_docs"))


def kw_df(keywords: DataFrame) -> DataFrame:
    """(keyword, df, n_docs): documents of each keyword, and documents in the index."""
    return documents_of(keywords).crossJoin(F.broadcast(n_docs(keywords)))


def axis_hits(keywords: DataFrame, item_axes: DataFrame) -> DataFrame:
    """(keyword, axis, n): a keyword's items by axis, first counted by the axes that an item has together."""
    axes = item_axes.groupBy("item_id").agg(F.sort_array(F.collect_list("axis")).alias("axes"))
    together = listed(keywords.join(axes, "item_id")).groupBy("keyword", "axes").agg(F.count("*").alias("k"))
    return together.select("keyword", F.explode("axes").alias("axis"), "k").groupBy("keyword", "axis").agg(F.sum("k").alias("n"))


def numbered(keywords: DataFrame) -> DataFrame:
    """(keyword, code): the distinct keywords numbered from 0 in their order, by the sorted partitions' sizes."""
    rows = keywords.sort("keyword").select("keyword", F.monotonically_increasing_id().alias("i"))
    rows = settle(rows.select("keyword", F.shiftright("i", 33).alias("part"), F.col("i").bitwiseAND((1 << 33) - 1).alias("at")), "sorted")
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    begins = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("begin"))  # a row for each partition
    return settle(rows.join(F.broadcast(begins), "part").select("keyword", (F.col("begin") + F.col("at")).alias("code")), "codes")


def _coded(keywords: DataFrame, df: DataFrame, min_df: int, most_df: int | None) -> tuple[DataFrame, DataFrame]:
    """(keyword, code, df, n_docs) of the counted keywords, and (ks): each document's numbers, ascending."""
    often = df.where(F.col("df") >= min_df)
    if most_df:
        often = often.where(F.col("df") <= most_df)
    coded = settle(numbered(often.select("keyword")).join(often.select("keyword", "df", "n_docs"), "keyword"), "coded")
    chosen = keywords.select("item_id", "keyword").join(coded.select("keyword", "code"), "keyword").select("item_id", "code")
    return coded, settle(chosen.groupBy("item_id").agg(F.sort_array(F.collect_set("code")).alias("ks")).where(F.size("ks") > 1).select("ks"), "docs")


def _groups(spark: SparkSession, vocabulary: int, numbers: int = 0) -> int:
    """Groups of keywords: so many that a place in one takes two bytes, that a tile of two has DENSE pairs at most, and that
    a group has about GROUP_NUMBERS of the documents' numbers."""
    side = min((1 << 16) - 1, max(1, math.isqrt(DENSE)))
    return max(1, min(vocabulary, max(-(-vocabulary // side), -(-numbers // GROUP_NUMBERS))))


def _dealt(docs: DataFrame, groups: int) -> DataFrame:
    """(g, chunk, a, b): the places that documents have in a group of keywords, and how many each document of the chunk has.

    A number is in one row, in two bytes; the rows of a chunk are about the same documents in the same order."""

    def chunk(number: int, codes: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
        doc = np.repeat(np.arange(len(lengths)), lengths)
        order = np.argsort(codes % groups, kind="stable")
        group, place, doc = (codes % groups)[order], (codes // groups)[order].astype(np.uint16), doc[order]
        edges = np.searchsorted(group, np.arange(groups + 1)).tolist()
        for g in range(groups):
            own = slice(edges[g], edges[g + 1])
            if own.start < own.stop:
                many = np.bincount(doc[own], minlength=len(lengths)).astype(np.uint16)
                row = ([g], [number], [place[own].tobytes()], [many.tobytes()])
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(row, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["g", "chunk", "a", "b"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, number = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            codes, lengths = batch.column(0).flatten().to_numpy(), batch.column(0).value_lengths().to_numpy()
            at = 0
            for length in lengths.tolist():
                held.append(codes[at : at + length])
                at += length
                size += length
                if size >= HELD_PAIRS:
                    yield from chunk(number, np.concatenate(held), np.array([len(h) for h in held]))
                    held, size, number = [], 0, number + 1
        if held:
            yield from chunk(number, np.concatenate(held), np.array([len(h) for h in held]))

    return docs.mapInArrow(deal, "g int, chunk long, a binary, b binary")


def _numbers(raw: pa.Scalar) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), np.uint16)


class _Tiles:
    """Documents' numbers by groups of keywords in the shared folder, of which a task reads what its tiles need.

    Each number is written once, so that what is stored and shuffled grows with the documents and not with the number of
    groups. A task has some keywords of a group and meets the groups in turn; of a group it holds the documents' places, in two
    bytes each, and counts its keywords' pairs some at a time, so that no table of a tile is kept."""

    def __init__(self, docs: DataFrame, coded: DataFrame, named: bool = False) -> None:
        self.spark = docs.sparkSession
        self.vocabulary = coded.count()
        self.groups = _groups(self.spark, self.vocabulary, docs.agg(F.sum(F.size("ks"))).first()[0] or 0)
        self.path = f"{shared_folder(self.spark)}/crossweave-{uuid.uuid4().hex}"
        g = F.pmod("code", F.lit(self.groups)).cast("int").alias("g")
        words = F.array_sort(F.collect_list(F.struct("code", "keyword", "df")))
        with shuffles_end_here(self.spark):
            _dealt(docs, self.groups).hint("rebalance", "g").write.partitionBy("g").parquet(f"{self.path}/docs")
            if named:
                coded.groupBy(g).agg(words.alias("w")).select("g", F.col("w.keyword").alias("names"), F.col("w.df").alias("dfs")).write.partitionBy("g").parquet(f"{self.path}/words")

    def tasks(self) -> DataFrame:
        """(id): a row and a task for each part of a group's keywords; each reads all numbers once, so they are no more than there is work for."""
        most = max(1, self.vocabulary // self.groups // 64)
        parts = min(most, -(-4 * max(4, self.spark.sparkContext.defaultParallelism) // self.groups))
        return self.spark.range(0, self.groups * parts, 1, self.groups * parts)

    def part(self, task: int, tasks: int) -> tuple[int, int, int]:
        """(group, from, to): the places of a task."""
        i, k, parts = task % self.groups, task // self.groups, tasks // self.groups
        height = -(-(self.vocabulary - i) // self.groups)
        return i, k * height // parts, (k + 1) * height // parts

    def words(self, g: int) -> tuple[list[str], np.ndarray]:
        for batch in read_files(f"{self.path}/words/g={g}"):
            if batch.num_rows:
                return batch.column("names")[0].as_py(), np.array(batch.column("dfs")[0].as_py(), np.int64)
        return [], np.zeros(0, np.int64)

    def pairs(self, task: int, tasks: int, once: bool) -> Iterator[tuple[int, int, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
        """(i, j, counts) of a task's keywords with each group in turn, or (once) with so many that each tile is met from one side;
        counts are (x, y, n): places in i, ascending, places in j, and documents that hold both."""
        i, lo, hi = self.part(task, tasks)
        found = []
        for batch in read_files(f"{self.path}/docs/g={i}") if lo < hi else ():
            for number, a, b in zip(batch.column("chunk").to_pylist(), batch.column("a"), batch.column("b"), strict=True):
                place, many = _numbers(a), _numbers(b)
                own = np.flatnonzero((place >= lo) & (place < hi))
                found.append((number, len(many), place[own], np.repeat(np.arange(len(many), dtype=np.int32), many)[own]))
        if not found:
            return
        found.sort(key=lambda f: f[0])
        ends = np.cumsum([f[1] for f in found]).tolist()
        begins = {f[0]: end - f[1] for f, end in zip(found, ends, strict=True)}
        rows, docs = np.concatenate([f[2] for f in found]), np.concatenate([f[3] + begins[f[0]] for f in found])
        order = np.argsort(rows, kind="stable")
        rows, docs = rows[order].astype(np.int64), docs[order]
        del found, order
        for j in range(self.groups):
            if once and i != j and (i < j) != ((i + j) % 2 == 0):
                continue
            lengths, held = np.zeros(ends[-1], np.uint16), {}
            for batch in read_files(f"{self.path}/docs/g={j}"):
                for number, a, b in zip(batch.column("chunk").to_pylist(), batch.column("a"), batch.column("b"), strict=True):
                    if number in begins:
                        many = _numbers(b)
                        lengths[begins[number] : begins[number] + len(many)] = many
                        held[number] = _numbers(a)
            if held:
                places = np.concatenate([held[number] for number in sorted(held)])
                yield i, j, _met(rows, docs, lengths, places, -(-(self.vocabulary - j) // self.groups))


def _met(rows: np.ndarray, docs: np.ndarray, lengths: np.ndarray, places: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, n) for rows (ascending, each with a document) and the places that lie together for each document, of those that occur.

    A row with many places is counted in a table of its own, others are sorted together."""
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    there = np.flatnonzero(lengths[docs])
    rows, docs = rows[there], docs[there]
    if not len(rows):
        return

    def met(at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
        own = docs[at:to]
        runs = lengths[own].astype(np.int64)
        if runs.sum() > LONG_RUNS * len(runs):  # copied run by run
            begins = starts[own]
            return np.concatenate([places[a:b] for a, b in zip(begins.tolist(), (begins + runs).tolist(), strict=True)]), runs
        stops = np.cumsum(runs)
        return places[np.arange(stops[-1]) + np.repeat(starts[own] - (stops - runs), runs)], runs

    heads = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    stops = np.cumsum(lengths[docs], dtype=np.int64)
    ends = np.append(heads[1:], len(rows))
    last = stops[ends - 1]  # pairs up to each row's end
    size = np.diff(last, prepend=0)
    large = size >= max(1, min(BLOCK_PAIRS, width // 8))
    k = 0
    while k < len(heads):
        if large[k]:
            table = np.zeros(width, np.int64)
            at = int(heads[k])
            while at < ends[k]:
                to = min(int(ends[k]), max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + BLOCK_PAIRS, "right"))))
                table += np.bincount(met(at, to)[0], minlength=width)
                at = to
            y = np.flatnonzero(table)
            yield np.full(len(y), rows[heads[k]]), y, table[y]
            k += 1
            continue
        to = max(k + 1, int(np.searchsorted(last, (last[k - 1] if k else 0) + BLOCK_PAIRS, "right")))
        if len(stop := np.flatnonzero(large[k:to])):
            to = k + int(stop[0])
        y, runs = met(int(heads[k]), int(ends[to - 1]))
        key = np.repeat(rows[heads[k] : ends[to - 1]] - rows[heads[k]], runs) * width + y
        key = np.sort(key.astype(np.uint32) if (rows[heads[to - 1]] - rows[heads[k]] + 1) * width < 1 << 32 else key)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n, key = np.diff(first, append=len(key)), key[first].astype(np.int64)
        yield key // width + rows[heads[k]], key % width, n
        k = to


def _together(counts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], least: int, half: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The counts of `least` at least, or (half) those of them with x < y, about TOLD or more at a time."""
    held: list[tuple] = []
    size = 0
    for x, y, n in counts:
        own = np.flatnonzero((n >= least) & ((x < y) if half else True))
        held.append((x[own], y[own], n[own]))
        size += len(own)
        if size >= TOLD:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def pair_counts(keywords: DataFrame, df: DataFrame, min_df: int = MIN_DF, most_df: int | None = None, least: int = 1, named: bool = False) -> tuple[DataFrame, DataFrame]:
    """(x, y, n) with x < y, and (keyword, code, df, n_docs): documents that hold both of two keywords, by their numbers.

    Keywords of min_df documents at least get numbers in their order and are dealt into groups, by which the documents'
    numbers are stored; a task counts some keywords of a group with the others (see _Tiles), and only counted pairs leave it.
    most_df (off by default) leaves out more frequent keywords; pairs of fewer than `least` documents are left out. With `named`
    the pairs are (a, b, n) by their keywords, which a task takes from the two groups that it meets, so that no join looks up each pair."""
    coded, docs = _coded(keywords, df, min_df, most_df)
    tiles = _Tiles(docs, coded, named)
    tasks, groups = tiles.tasks(), tiles.groups
    n_tasks = tasks.rdd.getNumPartitions()
    tiles.spark = None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in (t for b in batches for t in b.column(0).to_pylist()):
            mine = pa.array(tiles.words(tiles.part(task, n_tasks)[0])[0], pa.string()) if named else None
            for i, j, counts in tiles.pairs(task, n_tasks, True):
                both = (pa.concat_arrays([mine, mine if i == j else pa.array(tiles.words(j)[0], pa.string())]), len(mine)) if named else None
                for x, y, n in _together(counts, least, i == j):
                    a, b = x * groups + i, y * groups + j
                    if named:
                        ahead, y = a < b, y + both[1]
                        a, b = np.where(ahead, x, y), np.where(ahead, y, x)
                    else:
                        a, b = np.minimum(a, b), np.maximum(a, b)
                    for k in range(0, len(x), TOLD):
                        to = slice(k, k + TOLD)
                        one, two = (both[0].take(pa.array(c[to])) if named else pa.array(c[to]) for c in (a, b))
                        yield pa.record_batch([one, two, pa.array(n[to])], names=names)

    names = ["a", "b", "n"] if named else ["x", "y", "n"]
    return tasks.mapInArrow(count, "a string, b string, n long" if named else "x long, y long, n long"), coded


def _first(mine: str, score: np.ndarray, code: np.ndarray, kind: np.ndarray, spots: np.ndarray, names: list[str], top: int, whole: bool = False) -> list[int]:
    """Positions among which the `top` strongest are that neither hold `mine` nor are held by it, later codes first in a tie.

    What is within EPS of the last one stays, but of pairs with the same counts (kind) `top` at most."""
    among = np.arange(len(score))
    if len(score) > 8 * top and not whole:  # a few more than are wanted, and all if too many of these go
        least = np.partition(score, len(score) - 4 * top)[len(score) - 4 * top]
        among = np.flatnonzero(score >= least - 2 * EPS)
    order = among[np.lexsort((-code[among], kind[among], -score[among]))]
    ends = np.append(np.flatnonzero(np.diff(kind[order])) + 1, len(order)).tolist()
    out: list[int] = []
    last, at = 0.0, 0
    for end in ends:
        if len(out) >= top and score[order[at]] < last - EPS:
            return out
        told = 0
        for spot in order[at:end]:
            name = names[spots[spot]]
            if name in mine or mine in name:
                continue
            out.append(int(spot))
            told += 1
            if len(out) == top:
                last = score[spot]
            if told == top:
                break
        at = end
    if len(out) < top and len(among) < len(score):
        return _first(mine, score, code, kind, spots, names, top, True)
    return out


def _best(rows: list[np.ndarray], score: np.ndarray, top: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each x (the first of the columns) the rows among which its `top` strongest are."""
    order = np.lexsort((-score, rows[0]))
    x, score = rows[0][order], score[order]
    heads = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    many = np.diff(heads, append=len(x))
    last = score[np.minimum(heads + top, heads + many) - 1]
    fine = score >= np.repeat(last, many) - EPS
    return [c[order][fine] for c in rows], score[fine]


def strongest_neighbors(keywords: DataFrame, df: DataFrame, stop_words: tuple[str, ...] = (), min_df: int = MIN_DF, min_cooc: int = MIN_COOC, cut: float = CUT, top: int = TOP_NEIGHBORS) -> DataFrame:
    """The same as `neighbors` without a table of all pairs: a task meets all groups with its keywords and sends for each of them
    what may be among its strongest, a few more than `top`; strengths are cut and ranked by Spark's own logarithm."""
    coded, docs = _coded(keywords, df, min_df, None)
    n_docs = (coded.select("n_docs").first() or [0])[0]
    tiles = _Tiles(docs, coded, True)
    tasks, groups = tiles.tasks(), tiles.groups
    n_tasks = tasks.rdd.getNumPartitions()
    tiles.spark = None

    def strong(i: int, j: int, counts: Iterator[tuple], mine: tuple, others: tuple) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """([x, y, n, df_a, df_b], score) of pairs that may be chosen."""
        stop_x, stop_y = (np.array([w in stop_words for w in side[0]], bool) if stop_words else None for side in (mine, others))
        for x, y, n in counts:
            own = np.flatnonzero((n >= min_cooc) & ((x != y) if i == j else True))
            x, y, n = x[own], y[own], n[own]
            dx, dy, together = mine[1][x], others[1][y], n / n_docs
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.where(together < 1, np.log(together / (dx / n_docs * (dy / n_docs))) / -np.log(together), 0.0)
            fine = score >= cut - EPS
            if stop_words:
                fine &= ~stop_x[x] & ~stop_y[y]
            x, y, n, dx, dy, score = (c[fine] for c in (x, y, n, dx, dy, score))
            if not len(x):
                continue
            heads = np.flatnonzero(np.append(True, x[1:] != x[:-1])).tolist()
            kind, chosen = n * (n_docs + 1) + dy, []
            for at, to in zip(heads, [*heads[1:], len(x)], strict=True):
                spots = _first(mine[0][x[at]], score[at:to], y[at:to], kind[at:to], y[at:to], others[0], top)
                chosen += [at + s for s in spots]
            yield [x[chosen] * groups + i, y[chosen] * groups + j, n[chosen], dx[chosen], dy[chosen]], score[chosen]

    def strongest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in (t for b in batches for t in b.column(0).to_pylist()):
            best, mine = None, None
            for i, j, counts in tiles.pairs(task, n_tasks, False):
                mine = mine or tiles.words(i)
                found = list(strong(i, j, counts, mine, mine if i == j else tiles.words(j)))
                if best:
                    found.append(best)
                if found:
                    best = _best([np.concatenate(c) for c in zip(*(f[0] for f in found), strict=True)], np.concatenate([f[1] for f in found]), top)
            for k in range(0, len(best[1]) if best else 0, 1 << 16):
                yield pa.record_batch([pa.array(c[k : k + (1 << 16)]) for c in best[0]], names=["x", "y", "n", "df_a", "df_b"])

    rows = tasks.mapInArrow(strongest, "x long, y long, n long, df_a long, df_b long")
    rows = rows.withColumn("npmi", npmi(F.col("n"), F.col("df_a"), F.col("df_b"), F.lit(n_docs))).where(F.col("npmi") >= cut)
    place = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("npmi"), F.desc("y")))  # numbers are in the keywords' order
    best = rows.withColumn("place", place).where(F.col("place") <= top)
    one, two = (F.broadcast(coded.select(F.col("keyword").alias(name), F.col("code").alias(number))) for name, number in (("keyword", "x"), ("neighbor", "y")))
    return best.join(one, "x").join(two, "y").select("keyword", "neighbor", "npmi", F.col("n").alias("cooc"), F.col("df_b").alias("df"))


def named_pairs(counts: DataFrame, coded: DataFrame) -> DataFrame:
    """(a, b, n) with a < b, by the keywords of the numbers."""
    one, two = (coded.select(F.col("keyword").alias(name), F.col("code").alias(number)) for name, number in (("a", "x"), ("b", "y")))
    # the counted keywords are broadcast, as they are few next to their pairs, which are then not shuffled
    return counts.join(F.broadcast(one), "x").join(F.broadcast(two), "y").select("a", "b", "n")


def cooccurrence(keywords: DataFrame, df: DataFrame, min_df: int = MIN_DF, most_df: int | None = None, least: int = 1) -> DataFrame:
    """(a, b, n) with a < b: documents that hold both, among keywords of min_df documents at least (see pair_counts)."""
    return pair_counts(keywords, df, min_df, most_df, least, True)[0]


def npmi(n: Column, df_a: Column, df_b: Column, n_docs: Column) -> Column:
    """Normalised pointwise mutual information; 0 where the pair is in every document."""
    pa, pb, pab = df_a / n_docs, df_b / n_docs, n / n_docs
    return F.when(pab < 1, F.log(pab / (pa * pb)) / -F.log(pab)).otherwise(F.lit(0.0))


def pair_strength(pairs: DataFrame, df: DataFrame, min_cooc: int = MIN_COOC) -> DataFrame:
    """(a, b, n, df_a, df_b, npmi) of pairs of min_cooc documents at least."""
    one = df.select(F.col("keyword").alias("a"), F.col("df").alias("df_a"), "n_docs")
    two = df.select(F.col("keyword").alias("b"), F.col("df").alias("df_b"))
    rows = pairs.where(F.col("n") >= min_cooc).join(one, "a").join(two, "b")
    return rows.select("a", "b", "n", "df_a", "df_b", npmi(F.col("n"), F.col("df_a"), F.col("df_b"), F.col("n_docs")).alias("npmi"))


def neighbors(pairs: DataFrame, df: DataFrame, stop_words: tuple[str, ...] = (), min_cooc: int = MIN_COOC, cut: float = CUT, top: int = TOP_NEIGHBORS) -> DataFrame:
    """(keyword, neighbor, npmi, cooc, df): each keyword's strongest neighbours, in both directions.

    Pairs of which one holds the other, and stop words, go before the rank; ranks are by the unrounded
    npmi, then neighbour, then count, all descending."""
    return _ranked(pair_strength(pairs, df, min_cooc).where(F.col("npmi") >= cut), stop_words, top)


def counted_neighbors(counts: DataFrame, coded: DataFrame, stop_words: tuple[str, ...] = (), min_cooc: int = MIN_COOC, cut: float = CUT, top: int = TOP_NEIGHBORS) -> DataFrame:
    """The same from pair_counts: pairs stay numbers until they are cut, and only strong ones get their names."""
    one = coded.select(F.col("code").alias("x"), F.col("df").alias("df_a"), "n_docs")
    two = coded.select(F.col("code").alias("y"), F.col("df").alias("df_b"))
    rows = counts.where(F.col("n") >= min_cooc).join(one, "x").join(two, "y")
    strong = settle(rows.withColumn("npmi", npmi(F.col("n"), F.col("df_a"), F.col("df_b"), F.col("n_docs"))).where(F.col("npmi") >= cut), "strong")
    a, b = (coded.select(F.col("code").alias(number), F.col("keyword").alias(name)) for number, name in (("x", "a"), ("y", "b")))
    return _ranked(strong.join(a, "x").join(b, "y"), stop_words, top)


def _ranked(strong: DataFrame, stop_words: tuple[str, ...], top: int) -> DataFrame:
    strong = strong.where(~F.col("a").contains(F.col("b")) & ~F.col("b").contains(F.col("a")))
    if stop_words:
        strong = strong.where(~F.col("a").isin(*stop_words) & ~F.col("b").isin(*stop_words))
    both = strong.select(F.col("a").alias("keyword"), F.col("b").alias("neighbor"), "npmi", F.col("n").alias("cooc"), F.col("df_b").alias("df"))
    both = both.union(strong.select("b", "a", "npmi", "n", "df_a"))
    place = F.row_number().over(Window.partitionBy("keyword").orderBy(F.desc("npmi"), F.desc("neighbor"), F.desc("cooc")))
    return both.withColumn("place", place).where(F.col("place") <= top).drop("place")


def kw_meta(keywords: DataFrame, df: DataFrame, item_axes: DataFrame, min_df: int = MIN_DF) -> DataFrame:
    """(keyword, df, axis) of keywords of min_df documents: the axis with most items, by name in a tie, null without any."""
    often = df.where(F.col("df") >= min_df).select("keyword", "df")
    best = axis_hits(keywords, item_axes).groupBy("keyword").agg(F.min(F.struct((-F.col("n")).alias("n"), "axis")).alias("best"))
    return often.join(best, "keyword", "left").select("keyword", "df", F.col("best.axis").alias("axis"))


def kw_item(keywords: DataFrame, df: DataFrame, is_org: Column, weekly_min: int = 5, most: int = MOST_ITEMS, min_df: int = MIN_DF) -> DataFrame:
    """(keyword, item_id): a keyword's newest items (highest ids), as many as `most`; all of an organisation's.

    The newest are picked in each task before a row is dealt, and only then meet the counts."""
    least = min(min_df, max(1, weekly_min))
    rows = listed(keywords).select("keyword", "item_id")
    orgs = rows.where(is_org).join(df.where(is_org).select("keyword"), "keyword")
    place = F.row_number().over(Window.partitionBy("keyword").orderBy(F.desc("item_id")))
    newest = rows.where(~is_org).withColumn("place", place).where(F.col("place") <= most)
    often = df.where((F.col("df") >= least) & ~is_org).select("keyword")
    return orgs.select("keyword", "item_id").union(newest.join(often, "keyword").select("keyword", "item_id"))


def index_status(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n, ready): row counts; the index is ready when no table is empty."""
    counts = None
    for name, table in tables.items():
        n = table.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        counts = n if counts is None else counts.union(n)
    return counts.withColumn("ready", F.min("n").over(Window.partitionBy()) > 0)
