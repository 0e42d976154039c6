"""Search in texts by an inverted index of character trigrams.

Postings (gram, ids) tell which texts have three characters in a row, in any case; a text that is
looked for has all its trigrams in them. What they name is tested on the text itself, so a search reads
the parts of the texts that hold a candidate, and ids alone leave the scan."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trigrams are hashed to so many numbers, which lie in so many folders.
GRAMS, FOLDERS = 1 << 24, 64
#: Texts are stored by ranges of about so many ids; there are PARTS ranges at most.
PART_ROWS, PARTS = 10_000, 1024
#: Characters that a task indexes at a time.
PIECE = 1 << 21
#: Trigrams of a search that are looked up at most, spread over its text; the test on the text needs no more.
LOOKED_UP = 8
#: Candidates up to which a scan is told their ids and not only their parts.
FEW = 1000


@cache
def _folded() -> np.ndarray:
    """Small letters of code points one by one, whatever stands beside them."""
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and len(small := chr(c).lower()) == 1:
            table[c] = ord(small)
    table[ord("ς")] = ord("σ")
    return table


def _grams(text: str) -> np.ndarray:
    """The number of the trigram that begins at each character (shorter by two)."""
    p = _folded()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
    if len(p) < 3:
        return np.zeros(0, np.int64)
    mixed = (p[:-2] << np.uint64(42) ^ p[1:-1] << np.uint64(21) ^ p[2:]) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(40)).astype(np.int64)


def _lists(ids: list[int], grams: list[np.ndarray]) -> pa.RecordBatch:
    """(folder, gram, ids) of some texts."""
    number = np.repeat(np.arange(len(ids)), [len(g) for g in grams])
    pairs = np.unique(np.concatenate(grams) * len(ids) + number)
    gram, row = pairs // len(ids), pairs % len(ids)
    heads = np.nonzero(np.append(True, gram[1:] != gram[:-1]))[0] if len(gram) else np.zeros(0, np.int64)
    held = pa.ListArray.from_arrays(pa.array(np.append(heads, len(gram)).astype(np.int32)), pa.array(np.array(ids, np.int64)[row]))
    named = gram[heads]
    return pa.record_batch([pa.array((named % FOLDERS).astype(np.int32)), pa.array(named.astype(np.int32)), held], names=["folder", "gram", "ids"])


def postings(texts: DataFrame) -> DataFrame:
    """(folder, gram, ids) of (id, title, summary), dealt by folder and sorted for the index table; no row of it is longer than
    a task's piece. Rows without an id are not found. A folder with a frequent trigram is split among tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, grams, size = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole = text.as_py()
                ids.append(i)
                grams.append(np.unique(_grams(whole)))
                size += len(whole)
                if size >= PIECE:
                    yield _lists(ids, grams)
                    ids, grams, size = [], [], 0
        if ids:
            yield _lists(ids, grams)

    whole = texts.where("id is not null").select(F.col("id").cast("long").alias("id"), F.concat_ws(" ", "title", "summary").alias("whole"))
    found = whole.mapInArrow(run, "folder int, gram int, ids array<long>")
    return found.hint("rebalance", "folder").sortWithinPartitions("folder", "gram")


def parted(texts: DataFrame) -> tuple[DataFrame, list[int]]:
    """(part, id, title, summary) sorted by id within ranges of ids, and the least ids of all ranges but the first."""
    parts = min(PARTS, -(-texts.count() // PART_ROWS))
    marks = texts.select(F.percentile_approx("id", [k / parts for k in range(1, parts)], 20 * parts)).first()[0] if parts > 1 else None
    bounds = sorted(set(marks or []))
    rows = texts.select("id", "title", "summary").withColumn("part", part_of("id", bounds))
    return rows.hint("rebalance", "part").sortWithinPartitions("part", "id"), bounds


def part_of(column: str, bounds: list[int]) -> Column:
    """The number of bounds at or under the id: at most PARTS - 1."""
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(int(b)) for b in bounds]), lambda b: b <= F.col(column)))


@dataclass
class TextIndex:
    """Stored postings and texts (see postings and parted)."""

    grams: DataFrame
    texts: DataFrame
    bounds: list[int]

    def candidates(self, text: str) -> DataFrame | None:
        """(id): texts that may hold the text, in any case; None where it is too short for the index."""
        found = np.unique(_grams(text))
        if not len(found):
            return None
        wanted = [int(g) for g in found[np.linspace(0, len(found) - 1, min(LOOKED_UP, len(found))).astype(int)]]
        rows = self.grams.where(F.col("folder").isin(sorted({g % FOLDERS for g in wanted})) & F.col("gram").isin(wanted))
        bit = F.expr("shiftleft(1, " + "case gram " + " ".join(f"when {g} then {k}" for k, g in enumerate(wanted)) + " end)")
        each = rows.select(F.explode("ids").alias("id"), bit.alias("bit"))
        return each.groupBy("id").agg(F.bit_or("bit").alias("bits")).where(F.col("bits") == (1 << len(wanted)) - 1).select("id")

    def rows(self, ids: DataFrame) -> DataFrame:
        """The stored texts of few ids, or of the parts that hold the ids (of which the caller takes those).

        What the driver learns are the ids if they are FEW, else in which of the parts there are any."""
        first = [r["id"] for r in ids.limit(FEW + 1).collect()]
        if len(first) <= FEW:
            return self.named(first)
        if not self.bounds:
            return self.texts
        parts = [r["part"] for r in ids.select(part_of("id", self.bounds).alias("part")).distinct().collect()]
        return self.texts.where(F.col("part").isin(parts))

    def named(self, ids: list[int]) -> DataFrame:
        """The stored texts of some ids: folders are chosen before the scan, row groups by their ids in it."""
        parts = sorted({bisect_right(self.bounds, i) for i in ids if i is not None})
        return self.texts.where(F.col("part").isin(parts) & F.col("id").isin(ids))

    def ids(self, text: str, among: DataFrame | None = None, any_case: bool = False) -> DataFrame:
        """(id): texts whose title or summary holds the text, literally; with `among` texts of ids
        that are not in that table may be left out, so that the caller joins the rows that it asks about.

        The test stands under all joins: no summary leaves its task."""
        found = self.candidates(text)
        if found is not None:
            if among is not None:
                found = found.join(among.select("id"), "id", "left_semi")
            rows = self.rows(found)
        else:
            rows = self.texts
        title, summary = (F.lower("title"), F.lower("summary")) if any_case else (F.col("title"), F.col("summary"))
        wanted = F.lower(F.lit(text)) if any_case else F.lit(text)
        return rows.where(title.contains(wanted) | summary.contains(wanted)).select("id")
