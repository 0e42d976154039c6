"""Packing documents into training sequences by power-of-two decomposition."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.llm.shared import pieces
from crossweave.llm.tokens import default_tokenizer, encoder

LONGEST = 1024
END_ID = 0
#: Bits of a sequence's number: bucket | task | sequence within the task.
TASK_BITS, COUNT_BITS = 22, 36


def binary_lengths(total: int, longest: int = LONGEST) -> list[int]:
    """Whole pieces of the longest length, then the powers of two of the rest, longest first."""
    rest = total % longest
    return [longest] * (total // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer: str | None = None, longest: int = LONGEST, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket[, ids]).

    A document is its ids by the tokenizer and then the end id; it is cut into pieces whose lengths
    are powers of two. A piece is a sequence of its own (offset 0): its length is a power of two, so
    there is no padding, and no sequence crosses documents. Sequences of equal length form a bucket
    (the logarithm of the length), which a sequence's number begins with; batches are made of one
    bucket. Null and empty texts are the end id alone; rows with the same id are packed each; columns
    besides doc_id and text are not read; an empty table gives no rows.

    A map without a shuffle: numbers come from the task and a count in it, so that a task that is
    run again gives the same. Memory is bounded by a piece of the input or one very long document."""
    if longest & (longest - 1) or longest < 1:
        raise ValueError("the longest length must be a power of two")
    path = tokenizer or default_tokenizer()
    rows = docs.select("text", "doc_id", F.spark_partition_id().alias("task"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        end = np.array([end_id], np.uint32).tobytes()
        made = 0
        for batch in pieces(batches):
            task = batch.column(2)[0].as_py()
            owner: list[int] = []
            start: list[int] = []
            length: list[int] = []
            crc: list[int] = []
            total: list[int] = []
            ids: list[bytes] = []
            for k, raw in enumerate(encode(batch.column(0).to_pylist())):
                raw += end
                n = len(raw) // 4
                at = 0
                view = memoryview(raw)
                for size in binary_lengths(n, longest):
                    piece = view[at * 4 : (at + size) * 4]
                    owner.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    if with_ids:
                        ids.append(bytes(piece))
                    at += size
            lengths = np.array(length, np.int64)
            bucket = np.log2(lengths).astype(np.int64)
            sequence = (bucket << (TASK_BITS + COUNT_BITS)) | (task << COUNT_BITS) | np.arange(made, made + len(lengths))
            made += len(lengths)
            columns = [batch.column(1).take(pa.array(owner, pa.int32())), pa.array(start, pa.int64()), pa.array(lengths), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(sequence), pa.array(np.zeros(len(lengths), np.int64)), pa.array(bucket.astype(np.int32))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.record_batch(columns, names=names)

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, bucket int" + ", ids binary" * with_ids)


def write_buckets(packed: DataFrame, path: str) -> None:
    """The sequences (packed with ids), one folder for each length."""
    packed.select("sequence_id", "doc_id", "start", "length", "ids", "bucket").write.partitionBy("bucket").parquet(path)
