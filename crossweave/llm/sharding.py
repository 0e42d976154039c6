"""Sharding by a permutation-filled lookup table (the public Maglev scheme)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARDS = 64
#: A prime over a hundred times the number of shards, so that shares differ by less than one in a hundred.
TABLE_SIZE = 65_537


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard's position for each slot.

    A shard prefers the slots offset, offset + skip, offset + 2 * skip, ... modulo the prime size,
    which is a permutation; in turn each shard claims its next preferred slot that is free."""
    if not shards:
        return []
    if size < len(shards) or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the size must be a prime that is not under the number of shards")
    at = [_number(s, "offset") % size for s in shards]
    skip = [_number(s, "skip") % (size - 1) + 1 for s in shards]
    table = [-1] * size
    free = size
    while free:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            table[at[k]] = k
            free -= 1
            if not free:
                break
    return table


def slot_of(doc_id: str = "doc_id", size: int = TABLE_SIZE):
    """The slot of an id: 60 bits of its MD5 modulo the table's size; a null id hashes as the empty text."""
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size))


def place(docs: DataFrame, shards: int | list[str] = SHARDS, size: int = TABLE_SIZE, doc_id: str = "doc_id") -> DataFrame:
    """The documents with two more columns, `slot` and `shard` (the shard's position in the list).

    Placement depends on the id alone, so that a hot source or group of copies is dealt evenly and
    rows with the same id go together. The table, whose size is the fixed parameter `size` whatever
    the input, is broadcast; nothing is shuffled. Columns of the input named slot or shard are
    replaced. A null id has the slot of the empty text; an empty table stays empty."""
    names = [f"shard-{k:05d}" for k in range(shards)] if isinstance(shards, int) else shards
    table = lookup_table(names, size)
    spark = docs.sparkSession
    slots = spark.createDataFrame(list(enumerate(table)), "slot long, shard int")
    kept = docs.drop("slot", "shard").withColumn("slot", slot_of(doc_id, size))
    return kept.join(F.broadcast(slots), "slot").select(*[c for c in kept.columns if c != "slot"], "slot", "shard")


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder for each shard; a large shard is split by its slots rather than written by one task."""
    placed.repartition("shard", F.pmod("slot", F.lit(16))).write.partitionBy("shard").parquet(path)
