"""Near-duplicate embeddings by a subspace pigeonhole join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossweave.functions.components import star_forest
from crossweave.llm.shared import components, save

CUT = 0.9
#: Blocks that the rotated vector is cut into. Each costs a pass over the pairs that its cells leave and a copy of the rows;
#: fewer have more coordinates each, so that cells leave more pairs and budgets fewer candidates.
BLOCKS = 4
#: Vectors of a cell that a task holds at a time; others stream past them.
TILE = 16_384
#: Rows that the cells' split points are taken from (all rows are then dealt into the cells).
SAMPLE = 16_384
#: Cells of a block at most; a cell with more than TILE vectors is held in parts.
CELLS = 4096
#: A cell's visitors are dealt out to one task for each so many vectors of the table.
VISITORS = 1 << 18
SEED = 11
#: Candidates whose exact cosines are computed at a time.
CHUNK = 32_768
#: Rows and columns of the distances that are computed at a time, 1 MB.
ROWS, COLUMNS = 256, 1024


@cache
def rotation(dimensions: int) -> np.ndarray:
    """A random rotation, the same in every run."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def cuts(dimensions: int, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    edges = [dimensions * k // blocks for k in range(blocks + 1)]
    return [(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


def budget(part: tuple[int, int], dimensions: int, cut: float = CUT) -> float:
    """Squared distance that a block may have: its share, by dimensions, of 2 - 2 * cut, which is that of two unit vectors."""
    return (2.0 - 2.0 * cut) * (part[1] - part[0]) / dimensions


#: Added to budgets, as rotated vectors are kept in single precision; cosines are exact.
SLACK = 1e-5


def turned(v: np.ndarray) -> np.ndarray:
    """Unit vectors after the rotation, in single precision."""
    x = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return (x @ rotation(v.shape[1])).astype(np.float32)


class Cells:
    """A block's space cut in halves at medians of the coordinate with the largest spread, again and again.

    A row belongs to one cell and visits the lower ones whose box may hold a vector within the budget."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.dim = np.zeros(1 << depth, np.int64)
        self.value = np.zeros(1 << depth, np.float32)
        parts = {1: sample}
        for node in range(1, 1 << depth):
            x = parts.pop(node)
            if len(x):
                k = self.dim[node] = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
                self.value[node] = np.median(x[:, k])
            right = x[:, self.dim[node]] >= self.value[node]
            parts[2 * node], parts[2 * node + 1] = x[~right], x[right]

    def home(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (x[np.arange(len(x)), self.dim[node]] >= self.value[node])
        return node - (1 << self.depth)

    def visits(self, x: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells under its own that a row visits."""
        rows, cells = [], []
        for k in range(0, len(x), step := max(16, (1 << 19) >> self.depth)):
            r, c = self._visits(x[k : k + step], limit)
            rows.append(r + k)
            cells.append(c)
        return np.concatenate(rows), np.concatenate(cells)

    def _visits(self, x: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
        home = self.home(x)
        row, node, gaps = np.arange(len(x)), np.ones(len(x), np.int64), np.zeros(x.shape, np.float32)
        for level in range(self.depth):
            dim, at = self.dim[node], np.arange(len(row))
            off = x[row, dim] - self.value[node]
            near = 2 * node + (off >= 0)
            # the half on the other side is as far away in this coordinate as its split point
            far_gaps = gaps.copy()
            far_gaps[at, dim] = np.abs(off)
            inside = (far_gaps**2).sum(axis=1) <= limit
            row, node, gaps = np.concatenate([row, row[inside]]), np.concatenate([near, (near ^ 1)[inside]]), np.concatenate([gaps, far_gaps[inside]])
            # a node whose cells all come after the row's own is not needed
            low = node <= ((home[row] + (1 << self.depth)) >> (self.depth - level - 1))
            row, node, gaps = row[low], node[low], gaps[low]
        cell = node - (1 << self.depth)
        lower = cell < home[row]
        return row[lower], cell[lower]


def fine(v: str) -> Column:
    """Vectors that can link: not null or empty, no null or non-finite component, not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _pairs(one: np.ndarray, two: np.ndarray, parts: list[tuple[int, int]], which: int, limits: list[float], cut: float, exact: tuple[np.ndarray, np.ndarray], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs whose first block within its budget is `which`, and whose cosine reaches the cut."""
    a, b = parts[which]
    x, y = one[:, a:b], two[:, a:b]
    # squared distances, norms and all, are one product
    one_x, one_y = np.ones((len(x), 1), np.float32), np.ones((len(y), 1), np.float32)
    left = np.hstack([-2 * x, (x**2).sum(axis=1, keepdims=True), one_x])
    right = np.ascontiguousarray(np.hstack([y, one_y, (y**2).sum(axis=1, keepdims=True)]).T)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for k in range(0, len(x), ROWS):
        near = [np.zeros((2, 0), np.int64)]
        for at in range(k if same else 0, len(y), COLUMNS):
            distance = left[k : k + ROWS] @ right[:, at : at + COLUMNS]
            i, j = np.divmod(np.flatnonzero(distance <= limits[which] + SLACK), distance.shape[1])
            near.append(np.stack([i + k, j + at]))
        i, j = np.concatenate(near, axis=1)
        if same:
            i, j = i[i < j], j[i < j]
        for c in range(0, len(i), CHUNK):
            p, q = i[c : c + CHUNK], j[c : c + CHUNK]
            close = np.einsum("ij,ij->i", one[p], two[q]) >= cut - SLACK
            p, q = p[close], q[close]
            u, w = exact[0][p], exact[1][q]
            cosine = np.einsum("ij,ij->i", u, w) / (np.sqrt(np.einsum("ij,ij->i", u, u)) * np.sqrt(np.einsum("ij,ij->i", w, w)))
            p, q = p[cosine >= cut], q[cosine >= cut]
            if not len(p):
                continue
            squares = (one[p].astype(np.float64) - two[q].astype(np.float64)) ** 2
            mine = np.ones(len(p), bool)  # a pair counts in its first block within budget alone
            for (s, t), most in zip(parts[: which + 1], limits, strict=False):
                total = np.zeros(len(p))
                for z in range(s, t):
                    total += squares[:, z]
                mine &= (total <= most + SLACK / 2) == ((s, t) == parts[which])
            found.append((p[mine], q[mine]))
    return tuple(np.concatenate([f[k] for f in found]) for k in (0, 1))


def join(embeddings: DataFrame, cut: float = CUT, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding), links being cosines >= cut.

    Unit vectors at cosine c are at squared distance 2 - 2c. After a rotation the vector is cut into
    blocks, each with the share of that distance that its dimensions have: at least one block of a
    linked pair is within its share (pigeonhole). A block's space is cut into cells; a row visits the
    cells whose box comes within the budget (range join over all of the block's coordinates). A pair
    within the block's budget is verified on the given numbers in double precision; a pair found in
    several blocks counts in the first. All links are found; none is made below the cut.

    Equal vectors are joined once and count each other. Vectors that are null, empty, zero, or hold
    null or non-finite components link with nothing, as do vectors of different lengths, of which
    there may be any number. Rows with a null vec_id have n_links 0 and null component_id and kept.
    Rows that repeat a vec_id are vectors of their own under one id. An empty table gives no rows;
    other columns are not read.

    A task holds one part of a cell, `tile` vectors on average, and streams the visitors by. With
    random vectors the cells of a block prune some half to nine tenths of the pairs, the more the
    more rows there are; the rest is compared by matrix products, so work grows a little less than
    with the square of the rows."""
    kind = "float" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "double"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast(kind)).alias("v"))
    good = rows.where("vec_id is not null").where(fine("v"))
    # equal vectors: one stands for all
    distinct = good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    distinct = save(distinct.mapInArrow(_with_turned, f"v array<{kind}>, rep long, copies long, x binary"), "vectors")
    found = save(_links(distinct, "<f4" if kind == "float" else "<f8", cut, blocks, tile), "links")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    members = good.join(distinct.drop("x"), "v").select("vec_id", "rep", "copies")
    members = members.join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    members = members.select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    rest = rows.where(F.col("vec_id").isNull() | ~fine("v"))
    members = members.union(rest.select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return members.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def _with_turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds x: the rotated vector in single precision and after it the given one, as bytes. It is made once and saved,
    as sums may be rounded otherwise on other machines."""
    for batch in batches:
        v = batch.column(0)
        lengths = v.value_lengths().to_numpy(zero_copy_only=False)
        x = np.empty(len(v), object)
        for d in np.unique(lengths).tolist():
            own = np.nonzero(lengths == d)[0]
            given = v.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), d)
            x[own] = [a.tobytes() + b.tobytes() for a, b in zip(turned(given.astype(np.float64)), given, strict=True)]
        yield pa.record_batch([*batch.columns, pa.array(x, pa.binary())], names=["v", "rep", "copies", "x"])


def _rotated(raw: list[bytes], d: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)[:, : 4 * d]).view("<f4")


def _cells(vectors: DataFrame, blocks: int, tile: int) -> dict[int, list[Cells]]:
    """For each length of vectors that the sample holds, the cells of each block."""
    sample = vectors.orderBy(F.xxhash64("rep")).limit(SAMPLE).select(F.size("v").alias("d"), "x").toPandas()
    total = vectors.count()
    made = {}
    for d, part in sample.groupby("d"):
        x = _rotated(part["x"].tolist(), int(d))
        wanted = min(CELLS, max(1, total * len(x) // len(sample) // tile), len(x))
        made[int(d)] = [Cells(x[:, a:b], wanted.bit_length() - 1) for a, b in cuts(int(d), blocks)]
    return made


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(length, rows of (rep, copies, x, d), their rotated vectors)"""
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            batch = whole.slice(at, 2048)
            lengths = batch.column(3).to_numpy()
            for d in np.unique(lengths).tolist():
                own = batch.take(pa.array(np.nonzero(lengths == d)[0]))
                yield d, own, _rotated(own.column(2).to_pylist(), d)


def _links(vectors: DataFrame, kind: str, cut: float, blocks: int, tile: int) -> DataFrame:
    """(rep, n, other): from each cell, for each vector in a link the number of links found there (copies
    counted) and a vector that it is joined to."""
    shared = vectors.sparkSession.sparkContext.broadcast(_cells(vectors, blocks, tile))

    def cells_of(d: int, block: int, part: tuple[int, int]) -> Cells:
        return shared.value[d][block] if d in shared.value else Cells(np.zeros((0, part[1] - part[0]), np.float32), 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, _, x in _by_length(batches):
            for block, part in enumerate(cuts(d, blocks)):
                cell, n = np.unique(cells_of(d, block, part).home(x[:, slice(*part)]), return_counts=True)
                yield pa.record_batch([pa.array(np.full(len(cell), d, np.int32)), pa.array(np.full(len(cell), block, np.int32)), pa.array(cell.astype(np.int32)), pa.array(n)], names=["d", "block", "cell", "n"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of each vector for its own cell in each block (home) and for each cell that it visits."""
        for d, batch, x in _by_length(batches):
            for block, part in enumerate(cuts(d, blocks)):
                cells, own = cells_of(d, block, part), x[:, slice(*part)]
                row, cell = cells.visits(own, budget(part, d, cut) + SLACK)
                row, cell = np.concatenate([np.arange(len(own)), row]), np.concatenate([cells.home(own), cell])
                for k in range(0, len(row), 8192):
                    r = row[k : k + 8192]
                    n = len(r)
                    taken = batch.take(pa.array(r))
                    yield pa.record_batch(
                        [pa.array(np.full(n, d, np.int32)), pa.array(np.full(n, block, np.int32)), pa.array(cell[k : k + n].astype(np.int32)), pa.array(k + np.arange(n) < len(own)), *taken.columns[:3]],
                        names=["d", "block", "cell", "home", "rep", "copies", "x"],
                    )

    rows = vectors.select("rep", "copies", "x", F.size("v").alias("d"))
    homes = rows.mapInArrow(count, "d int, block int, cell int, n long").groupBy("d", "block", "cell").agg(F.sum("n").alias("n"))
    dealt = rows.mapInArrow(deal, "d int, block int, cell int, home boolean, rep long, copies long, x binary")
    # a cell with more than `tile` vectors has parts; a row visits all parts of another cell and the lower ones of its own
    in_block = Window.partitionBy("d", "block")  # CELLS rows at most
    parts = save(homes.select("d", "block", "cell", F.ceil(F.col("n") / tile).cast("int").alias("parts"), F.ceil(F.sum("n").over(in_block) / VISITORS).cast("int").alias("turns")), "cells")
    met = dealt.join(parts, ["d", "block", "cell"])
    own = F.pmod(F.xxhash64("rep"), "parts").cast("int")
    met = met.withColumn("part", F.explode(F.when(F.col("home"), F.sequence(F.lit(0), own)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    met = met.withColumn("visitor", ~F.col("home") | (F.col("part") != own))
    turns = F.when(F.col("visitor"), F.array(F.pmod(F.xxhash64("rep", F.lit(1)), "turns").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("turns") - 1))
    met = met.withColumn("turn", F.explode(turns))
    key = ["d", "block", "cell", "part", "turn"]
    met = met.select(*key, "visitor", "rep", "copies", "x").repartition(*key).sortWithinPartitions(*key, "visitor", "rep")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, sums = None, [], None
        rows: tuple = ()  # of the cell's part: reps, copies, rotated vectors, given vectors

        def linked(p: np.ndarray, q: np.ndarray, reps: np.ndarray) -> pa.RecordBatch:
            """p and q are positions in reps: each vector tied to the least position that it is linked with."""
            node, root = star_forest(p, q)
            return pa.record_batch([pa.array(reps[node]), pa.array(np.zeros(len(node), np.int64)), pa.array(reps[root])], names=["rep", "n", "other"])

        def counted(reps: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(reps[n > 0]), pa.array(n[n > 0]), pa.array(reps[n > 0])], names=["rep", "n", "other"])

        def settle_rows() -> Iterator[pa.RecordBatch]:
            nonlocal rows, held, sums
            rows = tuple(np.concatenate([h[k] for h in held]) for k in range(4))
            held, sums = [], np.zeros(len(rows[0]), np.int64)
            if now[4] == 0:
                d, block = now[:2]
                p, q = _pairs(rows[2], rows[2], cuts(d, blocks), block, [budget(c, d, cut) for c in cuts(d, blocks)], cut, (rows[3], rows[3]), True)
                if len(p):
                    np.add.at(sums, p, rows[1][q])
                    np.add.at(sums, q, rows[1][p])
                    yield linked(p, q, rows[0])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(5)], axis=1)
            visitor = batch.column(5).to_numpy(zero_copy_only=False)
            edges = [0, *(np.nonzero((np.diff(keys, axis=0) != 0).any(axis=1) | (visitor[1:] != visitor[:-1]))[0] + 1).tolist(), len(keys)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if tuple(keys[a]) != now:
                    if held:
                        yield from settle_rows()
                    if sums is not None:
                        yield counted(rows[0], sums)
                    now, held, sums = tuple(keys[a].tolist()), [], None
                d, block = now[:2]
                for k in range(a, b, 1024):
                    to = min(b, k + 1024)
                    raw = np.frombuffer(b"".join(batch.column(8).slice(k, to - k).to_pylist()), np.uint8).reshape(to - k, -1)
                    given = np.ascontiguousarray(raw[:, 4 * d :]).view(kind).astype(np.float64)
                    given /= np.exp2(np.floor(np.log2(np.abs(given).max(axis=1, keepdims=True))))  # exact, so that squares neither overflow nor vanish
                    own = (batch.column(6).slice(k, to - k).to_numpy(), batch.column(7).slice(k, to - k).to_numpy(), np.ascontiguousarray(raw[:, : 4 * d]).view("<f4"), given)
                    if not visitor[a]:
                        held.append(own)
                        continue
                    if held:
                        yield from settle_rows()
                    if sums is None:  # a cell that only rows of other cells come to
                        continue
                    p, q = _pairs(rows[2], own[2], cuts(d, blocks), block, [budget(c, d, cut) for c in cuts(d, blocks)], cut, (rows[3], own[3]), False)
                    if len(p):
                        np.add.at(sums, p, own[1][q])
                        n = np.zeros(len(own[0]), np.int64)
                        np.add.at(n, q, rows[1][p])
                        yield counted(own[0], n)
                        yield linked(p, q + len(rows[0]), np.concatenate([rows[0], own[0]]))
        if held:
            yield from settle_rows()
        if sums is not None:
            yield counted(rows[0], sums)

    return met.mapInArrow(check, "rep long, n long, other long")
