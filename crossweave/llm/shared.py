"""What several operators of this subpackage use: scratch tables, components, range buckets, shingle hashes."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.functions.components import components, settle, shared_folder, shuffles_end_here

__all__ = ["components", "save", "shuffles_end_here"]

#: Python code gets its texts in pieces of about so many characters, whatever the size of Arrow's batches.
PIECE_CHARS = 2_000_000


def scratch_dir(spark: SparkSession) -> str:
    """A new folder in the one that all executors share (spark.checkpoint.dir); in a local session where that is unset a temporary one."""
    return f"{shared_folder(spark)}/crossweave-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Cut the lineage: write the table to the shared folder and read it back."""
    return settle(df, name, options)


@contextmanager
def rows_alone(spark: SparkSession) -> Iterator[None]:
    """Queries run inside hand Python code one row at a time, for rows of some megabytes; otherwise a batch has up to 64 MB of
    them, which Spark's memory for Arrow and the Python process both hold."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        yield
    finally:
        spark.conf.set(key, before)




def trim() -> None:
    """Gives memory that a task has let go of back to the system, as a worker waits for its next task with what it keeps."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim_heap := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim_heap(0)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes of the text column (one row at least)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        lengths = pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        at = 0
        while at < len(ends):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
        del batch, column
    trim()


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random odd number for each byte.
BYTES = mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
#: The same for words: A-Z as a-z, 0 for the six bytes between words.
_WORD_BYTES = BYTES.copy()
_WORD_BYTES[65:91] = BYTES[97:123]
_WORD_BYTES[[0x20, *range(0x09, 0x0E)]] = 0
#: Bytes that are hashed at a time.
_HASHED = 1 << 16


def _places(seed: int, longest: int) -> np.ndarray:
    return mix64(np.arange(1, longest + 1, dtype=np.uint64) + np.uint64(seed << 40)) | np.uint64(1)


def span_hashes(data: np.ndarray, first: np.ndarray, numbers: np.ndarray = BYTES, seeds: tuple[int, ...] = (1,)) -> list[np.ndarray]:
    """For each seed a hash of each span of bytes from one of the ascending places `first` to the next.

    It is the sum over the bytes of the byte's number times the place's odd number, mixed: two
    different spans have the same one with a probability of about 2**-62. No object is made for a span."""
    hashes = [np.empty(len(first), np.uint64) for _ in seeds]
    ends = np.append(first[1:], len(data))
    longest = int((ends - first).max(initial=0))
    places = [_places(seed, longest) for seed in seeds]
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(ends, first[at] + _HASHED, "right")))
        a, b = int(first[at]), int(ends[to - 1])
        place = np.arange(a, b) - np.repeat(first[at:to], ends[at:to] - first[at:to])
        value = numbers[data[a:b]]
        with np.errstate(over="ignore"):
            for out, own in zip(hashes, places, strict=True):
                out[at:to] = np.add.reduceat(value * own[place], first[at:to] - a)
        at = to
    return [mix64(h) for h in hashes]


def word_starts(texts: list[str | None] | pa.Array, numbers: np.ndarray = _WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first byte of each word, number of the word with which each text begins); bytes whose number is 0 lie between words."""
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    edges = offsets - offsets[0]
    letter = (numbers != 0)[data]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    heads = edges[:-1][edges[:-1] < len(data)]
    begins[heads] = letter[heads]
    first = np.nonzero(begins)[0]
    return data, first, np.searchsorted(first, edges)


def word_hashes(texts: list[str | None] | pa.Array, numbers: np.ndarray = _WORD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in turn and the position where each text's words begin.

    By default words are `[^\\x20\\x09-\\x0D]+` with A-Z taken as a-z."""
    data, first, starts = word_starts(texts, numbers)
    return span_hashes(data, first, numbers)[0], starts


_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """At each position the hash of the `width` words from there on (shorter by width - 1)."""
    total = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            total *= _STEP
            total += hashes[k : k + len(total)]
    return mix64(total)


def sequence_hash(hashes: np.ndarray) -> np.ndarray:
    """One hash of a whole short sequence, its length included."""
    total = np.uint64(len(hashes))
    with np.errstate(over="ignore"):
        for h in hashes:
            total = total * _STEP + h
    return mix64(np.array([total ^ np.uint64(0x5851F42D4C957F2D)], np.uint64))


def shingle_sets(texts: list[str | None] | pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    hashes, starts = word_hashes(texts)
    rolling = shingle_hashes(hashes, width)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(rolling[a : b - width + 1])
        elif b > a:
            yield sequence_hash(hashes[a:b])
        else:
            yield np.zeros(0, np.uint64)


def dense_table(rows: DataFrame, size: int, kind: str) -> np.ndarray:
    """An array of a fixed size on the driver from (at, value) with distinct places; 0 where there is none.

    Executors put it together in chunks of bytes, so that the driver gets no rows of single values."""
    chunk = 1 << 13

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(chunk, kind)
        out[part["at"].to_numpy() % chunk] = part["value"].to_numpy().astype(np.int64).astype(kind)
        return pd.DataFrame({"chunk": [int(part["at"].iloc[0]) // chunk], "raw": [out.tobytes()]})

    made = rows.withColumn("chunk", F.floor(F.col("at") / chunk)).groupBy("chunk").applyInPandas(fill, "chunk long, raw binary")
    table = np.zeros(-(-size // chunk) * chunk, kind)
    for row in made.collect():  # size / chunk rows at most
        table[row["chunk"] * chunk : (row["chunk"] + 1) * chunk] = np.frombuffer(row["raw"], kind)
    return table[:size]


def membership_bits(ids: DataFrame, column: str, bits: int = 1 << 24):
    """A broadcast bit table of fixed size in which the positions of the given ids are set (see bit_position).

    It only spares work: an id may be found that was not given, never the other way round."""
    at = ids.select(bit_position(column, bits).alias("p"))
    words = at.groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("value"))
    return ids.sparkSession.sparkContext.broadcast(dense_table(words, bits // 64, "uint64").tobytes())


def bit_position(column: str, bits: int = 1 << 24):
    return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(bits))


def bits_set(table: bytes, positions: np.ndarray) -> np.ndarray:
    words = np.frombuffer(table, np.uint64)
    p = positions.astype(np.int64)
    return (words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1


def range_bounds(df: DataFrame, column: str, buckets: int) -> list[int]:
    """Ascending split points that deal the rows out evenly; their number is bounded by `buckets`."""
    if buckets < 2:
        return []
    marks = [i / buckets for i in range(1, buckets)]
    found = df.select(F.percentile_approx(column, marks, 20 * buckets)).first()[0] or []
    return sorted(set(found))


def bucket_of(column: str, bounds: list[int]):
    """The number of split points at or under the value; nulls come first."""
    if not bounds:
        return F.lit(0)
    spots = F.array(*[F.lit(int(b)) for b in bounds])
    return F.when(F.col(column).isNull(), F.lit(0)).otherwise(F.size(F.filter(spots, lambda b: b <= F.col(column))))
