"""Ranked lexical search: a treap over quadtree cells of the grid of terms and documents for each block of documents.

The grid of a block has a row for each term and a column for each document; a cell that is not empty
holds the term's impact in the document. The quadtree keeps four bits for each inner cell (which of
its quarters hold something) and the largest impact of each cell, as its distance from that of the
cell around it. A search follows the rows of all its terms at once: a state is a range of documents
with one cell for each term, its bound the weighted sum of their maxima; states with the highest bounds
are opened first and those under the worst of the k best documents never."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from crossweave.llm.shared import BYTES, PIECE_CHARS, bits_set, dense_table, pieces, rows_alone, save, trim, word_hashes, word_starts

__all__ = ["build_index", "search"]

#: Documents are indexed in blocks of about so many bytes of text (one document at least).
BLOCK_CHARS = 2 * PIECE_CHARS
#: Items are searched together until they have so many terms; more items are further passes over the index.
TERMS_AT_ONCE = 1 << 18
#: Bits of the table of asked terms, whatever their number.
ASKED_BITS = 1 << 24
#: States that are opened in one step.
OPENED = 128
#: A block is a row group of its own: writers and readers of Parquet hold a whole row group, and by default at least a hundred rows.
BLOCKWISE = {"parquet.block.size": str(1 << 20), "parquet.page.size.row.check.min": "1"}
#: Stands for a null doc_id, which comes after all others.
NO_ID = np.iinfo(np.int64).max

#: Numbers of the bytes of terms `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, A-Z as a-z, 0 for all other bytes.
TERM_BYTES = BYTES.copy()
TERM_BYTES[65:91] = BYTES[97:123]
TERM_BYTES[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0

#: Bits set in a number under 16, and for each quarter of a cell with such a mask its place among the quarters there (-1: not there).
_COUNT = np.array([bin(m).count("1") for m in range(16)], np.int32)
_PLACE = np.array([[bin(m & (1 << k) - 1).count("1") if m >> k & 1 else -1 for k in range(4)] for m in range(16)], np.int32)


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A term's impact in a document with n terms, tf of them the term, in integers."""
    m = 50 + 50 * n.astype(np.int64) * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of numbers under 2^31 moved to the even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << np.uint64(shift)) & np.uint64(mask)
    return x


@dataclass
class Treap:
    """Cells from the root down, those of a level in the order of their quarters; the last cell is an empty one."""

    height: int
    masks: np.ndarray
    first: np.ndarray
    maxima: np.ndarray

    @staticmethod
    def pack(row: np.ndarray, col: np.ndarray, value: np.ndarray, height: int) -> tuple[bytes, bytes]:
        """(masks, distances of maxima) of the cells at (row, col), both under 2^height; no cell occurs twice."""
        key = _spread(row) << np.uint64(1) | _spread(col)
        order = np.argsort(key)
        key, high = key[order], value[order].astype(np.uint32)
        masks, drops = [], []
        for _ in range(height):
            around = key >> np.uint64(2)
            heads = np.nonzero(np.append(True, around[1:] != around[:-1]))[0]
            masks.append(np.bitwise_or.reduceat(np.left_shift(1, (key & np.uint64(3)).astype(np.uint8)).astype(np.uint8), heads))
            higher = np.maximum.reduceat(high, heads)
            drops.append(np.repeat(higher, np.diff(np.append(heads, len(key)))) - high)
            key, high = around[heads], higher
        mask = np.concatenate(masks[::-1])
        mask = np.append(mask, np.zeros(len(mask) % 2, np.uint8))
        return (mask[::2] | mask[1::2] << 4).tobytes(), np.concatenate([high, *drops[::-1]]).tobytes()

    @classmethod
    def unpack(cls, masks: bytes, drops: bytes, height: int) -> Treap:
        packed, maxima = np.frombuffer(masks, np.uint8), np.frombuffer(drops, np.uint32).astype(np.int32)
        mask = np.stack([packed & 15, packed >> 4], axis=1).ravel()
        counts = _COUNT[mask]
        ends = (np.cumsum(counts) + 1).astype(np.int32)
        first = ends - counts
        a, b = 0, 1
        for _ in range(height):  # a level's cells are a to b, those inside them c to d
            c, d = first[a], ends[b - 1]
            maxima[c:d] = np.repeat(maxima[a:b], counts[a:b]) - maxima[c:d]
            a, b = c, d
        spare = len(maxima) + 1 - len(mask)
        return cls(height, np.append(mask, np.zeros(spare, np.uint8)), np.append(first, np.zeros(spare, np.int32)), np.append(maxima, np.int32(0)))

    def best(self, rows: np.ndarray, weights: np.ndarray, doc_ids: np.ndarray, k: int, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The k best of the documents found before and those of this block: (scores, ids), by score and then by id.

        Columns ascend by id, so the first column of a range has its least id."""
        scores, ids = found
        cells = np.zeros((1, len(rows)), np.int64)
        level, col = np.array([self.height]), np.zeros(1, np.int64)
        bound = self.maxima[cells] @ weights
        while len(bound):
            if len(scores) >= k:
                good = (bound > scores[-1]) | (bound == scores[-1]) & (doc_ids[col] <= ids[-1])
                if not good.all():
                    cells, level, col, bound = cells[good], level[good], col[good], bound[good]
            if len(bound) > OPENED:
                order = np.argpartition(-bound, OPENED)
                now, later = order[:OPENED], order[OPENED:]
            else:
                now, later = np.arange(len(bound)), np.zeros(0, np.int64)
            leaf = level[now] == 0
            if leaf.any():
                at = now[leaf]
                scores, ids = np.append(scores, bound[at]), np.append(ids, doc_ids[col[at]])
                order = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[order], ids[order]
                now = now[~leaf]
            inner, below = cells[now], level[now] - 1
            lower = rows[None, :] >> below[:, None] & 1
            parts = [(cells[later], level[later], col[later], bound[later])]
            for half in (0, 1):
                place = _PLACE[self.masks[inner], 2 * lower + half]
                there = np.where(place < 0, len(self.maxima) - 1, self.first[inner] + place)
                high = self.maxima[there] @ weights
                some = high > 0
                parts.append((there[some], below[some], (col[now] + (half << below))[some], high[some]))
            cells, level, col, bound = (np.concatenate(x) for x in zip(*parts, strict=True))
        return scores, ids


def _corpus(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, all terms with repeats)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n = np.diff(word_starts(batch.column(0), TERM_BYTES)[2])
            yield pa.record_batch([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["n_docs", "n_terms"])

    row = docs.select("text").mapInArrow(count, "n_docs long, n_terms long").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    return int(row[0] or 0), int(row[1] or 0)


def _postings(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, times) of the terms of each text, and the number of terms of each text."""
    hashes, starts = word_hashes(column, TERM_BYTES)
    lengths = np.diff(starts)
    terms, at = np.unique(hashes, return_inverse=True)
    key, tf = np.unique(np.repeat(np.arange(len(lengths)), lengths) * max(1, len(terms)) + at, return_counts=True)
    return terms[key % max(1, len(terms))], key // max(1, len(terms)), tf, lengths


def _block(parts: list[tuple], doc_ids: np.ndarray, n_docs: int, n_terms: int) -> list[pa.Array] | None:
    """One row of the index from the postings of its documents."""
    shifts = np.cumsum([0, *[len(p[3]) for p in parts[:-1]]])
    term = np.concatenate([p[0] for p in parts])
    doc = np.concatenate([p[1] + s for p, s in zip(parts, shifts, strict=True)])
    tf, n = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
    if not len(term):
        return None
    by_id = np.argsort(doc_ids, kind="stable")
    column = np.empty(len(by_id), np.int64)
    column[by_id] = np.arange(len(by_id))
    col = column[doc]
    terms, at, df = np.unique(term, return_inverse=True, return_counts=True)
    # frequent terms come first and lie close together, rare ones follow by their first document
    least = np.full(len(terms), len(doc_ids), np.int64)
    np.minimum.at(least, at, col)
    row_of = np.empty(len(terms), np.int64)
    row_of[np.lexsort((least, -df))] = np.arange(len(terms))
    height = max(1, int(max(len(terms), len(doc_ids)) - 1).bit_length())
    masks, drops = Treap.pack(row_of[at], col, impacts(tf, n[doc], n_docs, n_terms), height)
    values = [doc_ids[by_id].tobytes(), terms.tobytes(), row_of.astype(np.uint32).tobytes(), df.astype(np.uint32).tobytes(), masks, drops]
    return [pa.array([n_docs]), pa.array([n_terms]), pa.array([height], pa.int32()), *[pa.array([v], pa.binary()) for v in values]]


_INDEX = ("corpus_docs", "corpus_terms", "height", "doc_ids", "terms", "row_of", "dfs", "masks", "drops")
_SEARCHED = ("height", "doc_ids", "terms", "row_of", "masks", "drops")
_INDEX_TYPE = "corpus_docs long, corpus_terms long, height int, doc_ids binary, terms binary, row_of binary, dfs binary, masks binary, drops binary"


def build_index(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The index of every whole text of (doc_id, text): a row for each block of documents, saved in the shared folder.

    A null or empty text has no terms and is in no row; rows that repeat an id are documents of their
    own; other columns are not read. Terms are known by 64-bit hashes of their bytes. Two passes
    over the texts without a shuffle: one counts documents and terms, of which impacts are made, one
    writes the blocks. A task holds one block, also as it writes them, however many it has."""
    n_docs, n_terms = _corpus(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, ids, size = [], [], 0
        for batch in pieces(batches):
            parts.append(_postings(batch.column(0)))
            ids.append(batch.column(1).fill_null(NO_ID).to_numpy(zero_copy_only=False))
            size += batch.column(0).nbytes
            if size >= block_chars:
                if made := _block(parts, np.concatenate(ids), n_docs, n_terms):
                    yield pa.record_batch(made, names=_INDEX)
                parts, ids, size, made = [], [], 0, None
                trim()
        if parts and (made := _block(parts, np.concatenate(ids), n_docs, n_terms)):
            yield pa.record_batch(made, names=_INDEX)
        trim()

    return save(docs.select("text", F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, _INDEX_TYPE), "lexical_index", BLOCKWISE)


def _asked(items: DataFrame) -> DataFrame:
    """(q, item_id, term): the distinct terms of each row of items, which q numbers."""
    rows = items.select("text", "item_id", F.monotonically_increasing_id().alias("q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            term, doc, _, _ = _postings(batch.column(0))
            at = pa.array(doc)
            yield pa.record_batch([batch.column(2).take(at), batch.column(1).take(at), pa.array(term.view(np.int64))], names=["q", "item_id", "term"])

    return save(rows.mapInArrow(run, f"q long, item_id {dict(rows.dtypes)['item_id']}, term long"), "asked_terms")


def _weighted(index: DataFrame, asked: DataFrame, n_docs: int) -> DataFrame:
    """(q, item_id, terms, weights) of each item, from the number of documents with each of its terms.

    Blocks send the counts of asked terms only, and of few others: a broadcast table of ASKED_BITS has the
    bits of asked terms set. What it lets through besides falls out of the join."""
    place = F.col("term").bitwiseAND(ASKED_BITS - 1)
    words = asked.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(term & 63 as int))")).alias("value"))
    bits = index.sparkSession.sparkContext.broadcast(dense_table(words, ASKED_BITS // 64, "uint64").tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                terms, df = (np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in ((0, np.int64), (1, np.uint32)))
                some = bits_set(bits.value, terms & (ASKED_BITS - 1))
                yield pa.record_batch([pa.array(terms[some]), pa.array(df[some].astype(np.int64))], names=["term", "df"])
        trim()

    rows = index.select("terms", "dfs").mapInArrow(run, "term long, df long")
    df = rows.groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1))).cast("long")
    own = asked.join(df, "term").groupBy("q", "item_id").agg(F.sort_array(F.collect_list(F.struct("term", weight.alias("weight")))).alias("t"))
    with rows_alone(index.sparkSession):
        return save(own.select("q", "item_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights")), "weighted_items")


def _passes(items: DataFrame) -> Iterator[list]:
    """Rows of items in lists of at most TERMS_AT_ONCE terms (one item at least)."""
    held, size = [], 0
    for row in items.toLocalIterator():
        if held and size + len(row["terms"]) > TERMS_AT_ONCE:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row["terms"])
    if held:
        yield held


def _search(spark: SparkSession, index: DataFrame, rows: list, k: int, item_type: DataType) -> DataFrame:
    """(q, item_id, doc_id, score): each task's k best documents of each item."""
    asked = [(r["q"], r["item_id"], np.array(r["terms"], np.int64).view(np.uint64), np.array(r["weights"], np.int64)) for r in rows]
    shared, kind = spark.sparkContext.broadcast(asked), to_arrow_type(item_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(asked)
        for batch in batches:
            for at in range(batch.num_rows):
                raw = {name: batch.column(c)[at].as_buffer() for c, name in enumerate(_SEARCHED[1:], 1)}
                tree = Treap.unpack(raw["masks"], raw["drops"], batch.column(0)[at].as_py())
                terms, row_of, doc_ids = (np.frombuffer(raw[c], t) for c, t in (("terms", np.uint64), ("row_of", np.uint32), ("doc_ids", np.int64)))
                for i, (_, _, hashes, weights) in enumerate(asked):
                    spot = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
                    here = (terms[spot] == hashes) & (weights > 0)
                    if here.any():
                        best[i] = tree.best(row_of[spot[here]].astype(np.int64), weights[here], doc_ids, k, best[i])
                del raw, tree, terms, row_of, doc_ids
                trim()
        for (q, item_id, _, _), (scores, ids) in zip(asked, best, strict=True):
            if len(scores):
                found = pa.array(ids, mask=ids == NO_ID)
                yield pa.record_batch([pa.array([q] * len(ids)), pa.array([item_id] * len(ids), kind), found, pa.array(scores)], names=["q", "item_id", "doc_id", "score"])
        trim()

    with rows_alone(spark):
        return save(index.select(*_SEARCHED).mapInArrow(run, f"q long, item_id {item_type.simpleString()}, doc_id long, score long"), "found")


def search(index: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each row of items (item_id, text), by score and then by id.

    A term's weight is floor(1000 ln((2N+2) / (2df+1))); a document's score sums weight times impact
    over the item's distinct terms. Documents with score 0 are not found; an item without terms (null
    or empty text), or with none that the index has, has no rows; rows that repeat an item_id are
    ranked each for itself; a null doc_id comes last among equal scores. Other columns are not read.

    The index is read without a shuffle; a task keeps k documents for each item over all its blocks,
    so that later blocks are opened only where they can beat them. Items go to the tasks in passes
    of a bounded number of terms, each of which is run as this is called; a task holds one block at a time."""
    spark = index.sparkSession
    item_type = items.schema["item_id"].dataType
    corpus = index.select("corpus_docs").first()
    found = None
    if corpus:
        for rows in _passes(_weighted(index, _asked(items), corpus[0])):
            part = _search(spark, index, rows, k, item_type)
            found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], f"item_id {item_type.simpleString()}, rank int, doc_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH own AS (
  SELECT doc_id, row_number() OVER () AS d,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
docs AS (SELECT doc_id, d, terms, len(terms)::bigint AS n FROM own WHERE len(terms) > 0),
corpus AS (SELECT count(*)::bigint AS nd, sum(n)::bigint AS nt FROM docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
held AS (
  SELECT d, doc_id, n, term, count(*)::bigint AS tf FROM (SELECT d, doc_id, n, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY d, doc_id, n, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * nd + 2)::double / (2 * count(*) + 1)))::bigint AS w FROM held, corpus GROUP BY term, nd),
scores AS (
  SELECT item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // nt))))::bigint AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term), corpus GROUP BY item_id, d, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::int AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY rank <= 50
"""
