"""Token ids as binary files, compressed by grammar (Re-Pair) in shards, with random access to documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossweave.llm.shared import PIECE_CHARS, pieces, scratch_dir
from crossweave.llm.tokens import default_tokenizer, encoder

END_ID = 2
#: A pair of neighbours is replaced where it occurs so many times.
LEAST = 8
#: Replacement ends after a round that shortens the sequence by less than this part of it.
GAIN = 0.005
#: Rows of a partition come in shards of about so many characters; each shard has its own grammar.
BLOCK_CHARS = 2 * PIECE_CHARS
FIRST_RULE = 1 << 17
#: Slots of the table in which a round counts pairs, at most.
SLOT_BITS = 20


def repair(ids: np.ndarray, doc_of: np.ndarray, rounds: int | None = None, least: int = LEAST, gain: float = GAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, document of each symbol, rules): frequent pairs of neighbours within a document become nonterminals.

    A round counts the pairs in a table of slots; of overlapping pairs that occur `least` times the
    most frequent is chosen, and a pair that was chosen in two places is replaced there. Pairs that
    share a slot may be taken for more frequent than they are, which only changes the choice. Later
    rounds look at the pairs that were frequent and gave way, and at those beside a new symbol: no
    others can be frequent that were not before. Rounds end when no pair is frequent or a round
    gains little (or after so many `rounds`, if given). Rule k stands for symbol FIRST_RULE + k and
    is a pair of symbols."""
    seq, last = ids.astype(np.int32), np.ones(len(ids), bool)
    last[:-1] = doc_of[1:] != doc_of[:-1]
    docs = doc_of[last]
    rules: list[np.ndarray] = []
    made = 0
    active = np.nonzero(~last[:-1])[0].astype(np.int32)
    while len(active):
        pair = seq[active].astype(np.int64) << 32 | seq[active + 1]
        bits = min(SLOT_BITS, max(10, int(2 * len(active)).bit_length()))
        slot = ((pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32)
        weight = np.bincount(slot, minlength=1 << bits)[slot]
        often = np.nonzero(weight >= least)[0]
        active, pair, slot, weight = active[often], pair[often], slot[often], weight[often]
        # a place is chosen if no overlapping neighbour is more frequent (the left one wins a tie)
        beside = active[1:] == active[:-1] + 1
        chosen = np.ones(len(active), bool)
        chosen[1:] &= ~beside | (weight[1:] > weight[:-1])
        chosen[:-1] &= ~beside | (weight[:-1] >= weight[1:])
        chosen = np.nonzero(chosen)[0]
        # one pair of each slot is replaced in a round
        value = np.zeros(1 << bits, np.int64)
        value[slot[chosen]] = pair[chosen]
        chosen = chosen[pair[chosen] == value[slot[chosen]]]
        good = np.bincount(slot[chosen], minlength=1 << bits) >= 2
        chosen = chosen[good[slot[chosen]]]
        places = active[chosen]
        if not len(places):
            break
        number = (FIRST_RULE + made - 1 + np.cumsum(good)).astype(np.int32)
        rules.append(np.stack([value[good] >> 32, value[good] & 0xFFFFFFFF], axis=1))
        made += int(good.sum())
        keep = np.ones(len(seq), bool)
        keep[places + 1] = False
        todo = np.zeros(len(seq), bool)
        todo[active] = True
        before = places[places > 0] - 1
        todo[np.where(keep[before], before, before - 1)] = True
        seq[places] = number[slot[chosen]]
        last[places] = last[places + 1]
        seq, last, todo = seq[keep], last[keep], todo[keep]
        active = np.nonzero(todo[:-1] & ~last[:-1])[0].astype(np.int32)
        if len(places) < gain * len(seq) or len(rules) == rounds:
            break
    return seq, docs[np.cumsum(last) - last], np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)


def expand(seq: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """The ids that the symbols stand for: each rule is spelled out once, symbols are then copied from there."""
    lengths = expansion_lengths(rules)
    spelled, begins = _spelled(rules), np.cumsum(lengths) - lengths
    high = seq >= FIRST_RULE
    rule = seq[high] - FIRST_RULE
    sizes = np.ones(len(seq), np.int64)
    sizes[high] = lengths[rule]
    ends = np.cumsum(sizes)
    out = np.repeat(seq, sizes)
    inside = np.repeat(high, sizes)
    shift = np.zeros(len(seq), np.int64)
    shift[high] = begins[rule] - (ends[high] - sizes[high])
    at = np.nonzero(inside)[0]
    out[at] = spelled[at + np.repeat(shift, sizes)[at]]
    return out


def _spelled(rules: np.ndarray) -> np.ndarray:
    """The ids of all rules, one after the other."""
    seq = np.arange(FIRST_RULE, FIRST_RULE + len(rules), dtype=np.int64)
    while (high := seq >= FIRST_RULE).any():
        out = np.repeat(seq, 1 + high)
        at = np.nonzero(high)[0]
        first = at + np.arange(len(at))
        pairs = rules[seq[at] - FIRST_RULE]
        out[first], out[first + 1] = pairs[:, 0], pairs[:, 1]
        seq = out
    return seq


def expansion_lengths(rules: np.ndarray) -> np.ndarray:
    """How many ids each rule stands for; a rule's parts come before it."""
    lengths = np.ones(len(rules), np.int64)
    todo = np.ones(len(rules), bool)
    while todo.any():
        a, b = rules[:, 0] - FIRST_RULE, rules[:, 1] - FIRST_RULE
        ready = todo & ((a < 0) | ~todo[np.maximum(a, 0)]) & ((b < 0) | ~todo[np.maximum(b, 0)])
        lengths[ready] = np.where(a < 0, 1, lengths[np.maximum(a, 0)])[ready] + np.where(b < 0, 1, lengths[np.maximum(b, 0)])[ready]
        todo &= ~ready
    return lengths


def _packed(x: np.ndarray) -> bytes:
    """Numbers in as few whole bytes each as the largest needs; the first byte says how many."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros(((len(raw) - 1) // raw[0], 4), np.uint8)
    out[:, : raw[0]] = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, raw[0])
    return out.view("<u4").ravel().astype(np.int64)


SHARD = "shard int, part int, doc_ids binary, has_id binary, symbols_in_doc binary, doc_tokens binary, symbols binary, rules binary, rule_lengths binary, n_tokens long"


def encode_shards(docs: DataFrame, path: str, tokenizer: str | None = None, shards: int | None = None, end_id: int = END_ID) -> None:
    """Writes the ids of all whole texts in ascending order of doc_id, end id after each document.

    Partitions are ranges of doc_id and, where an id repeats or is missing, of a hash of the text, so
    that no id's rows need go to one task. A partition's rows are sorted and written in shards of
    BLOCK_CHARS characters, which bounds a task's memory whatever the size of its range: one Parquet
    row holds a shard's grammar, symbols, and for each of its documents the id, the number of symbols
    and the number of ids. Null ids come first, rows with the same id in order of that hash and of
    their texts; null texts are the end id alone."""
    tokenizer = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    rows = rows.select(F.spark_partition_id().alias("shard"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        end = np.array([end_id], np.uint32).tobytes()
        for part, block in enumerate(pieces(batches, limit=BLOCK_CHARS)):
            raw = [x + end for x in encode(block.column(2).to_pylist())]
            sizes = np.array([len(x) // 4 for x in raw], np.int64)
            owner = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
            symbols, owner, rules = repair(np.frombuffer(b"".join(raw), "<u4"), owner)
            ids = block.column(1)
            values = ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()
            there = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
            row = [block.column(0)[0].as_py(), part, values, there, _packed(np.bincount(owner, minlength=len(raw))), _packed(sizes), _packed(symbols), _packed(rules.ravel()), _packed(expansion_lengths(rules)), int(sizes.sum())]
            yield pa.record_batch([pa.array([v], t) for v, t in zip(row, [pa.int32(), pa.int32(), *[pa.binary()] * 7, pa.int64()], strict=True)], names=["shard", "part", "doc_ids", "has_id", "symbols_in_doc", "doc_tokens", "symbols", "rules", "rule_lengths", "n_tokens"])

    rows.mapInArrow(run, SHARD).write.parquet(path)


def read_shards(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files."""
    stored = spark.read.schema(SHARD).parquet(path)
    # one small row for each shard: where it begins among all ids. Shards are numbered within their
    # partition, so that the window over all sees a row for each partition and the other its shards
    sums = stored.select("shard", "part", "n_tokens")
    by_shard = sums.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    by_shard = by_shard.select(F.col("shard").alias("s"), (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))
    inside = sums.select(F.col("shard").alias("s"), F.col("part").alias("p"), (F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("part")) - F.col("n_tokens")).alias("before"))
    begins = inside.join(by_shard, "s").select("s", "p", (F.col("base") + F.col("before")).alias("begin"))
    rows = stored.join(begins, (F.col("shard") == F.col("s")) & (F.col("part") == F.col("p"))).select("begin", "doc_ids", "has_id", "symbols_in_doc", "doc_tokens", "symbols", "rules")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, doc_ids, has_id, _, doc_tokens, symbols, rules in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                sizes = _unpacked(doc_tokens)
                ids = expand(_unpacked(symbols), _unpacked(rules).reshape(-1, 2)).astype("<u4")
                raw = memoryview(ids.tobytes())
                ends = np.cumsum(sizes)
                starts = ends - sizes
                spans = list(zip((starts * 4).tolist(), (ends * 4).tolist(), strict=True))
                there = np.frombuffer(has_id, np.uint8) == 1
                columns = [pa.array(np.frombuffer(doc_ids, "<i8"), pa.int64(), mask=~there), pa.array(begin + starts), pa.array(sizes), pa.array([zlib.crc32(raw[a:b]) for a, b in spans], pa.int64())]
                if with_ids:
                    columns.append(pa.array([bytes(raw[a:b]) for a, b in spans], pa.binary()))
                yield pa.record_batch(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def document_ids(block: dict, position: int) -> np.ndarray:
    """Random access: one document of a stored block, without decoding the others."""
    in_doc = _unpacked(block["symbols_in_doc"])
    a = int(in_doc[:position].sum())
    return expand(_unpacked(block["symbols"])[a : a + int(in_doc[position])], _unpacked(block["rules"]).reshape(-1, 2))


def token_range(block: dict, start: int, stop: int) -> np.ndarray:
    """Random access by place: ids start to stop of a block, found through the rules' expansion lengths."""
    symbols, lengths = _unpacked(block["symbols"]), _unpacked(block["rule_lengths"])
    sizes = np.ones(len(symbols), np.int64)
    high = symbols >= FIRST_RULE
    sizes[high] = lengths[symbols[high] - FIRST_RULE]
    ends = np.cumsum(sizes)
    a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
    skip = start - int(ends[a] - sizes[a]) if a < len(ends) else 0
    return expand(symbols[a:b], _unpacked(block["rules"]).reshape(-1, 2))[skip : skip + max(0, stop - start)]


def round_trip(docs: DataFrame, tokenizer: str | None = None, shards: int | None = None) -> DataFrame:
    """Encodes to files in the shared folder and reads them back."""
    path = f"{scratch_dir(docs.sparkSession)}/token_store"
    encode_shards(docs, path, tokenizer, shards)
    return read_shards(docs.sparkSession, path)
