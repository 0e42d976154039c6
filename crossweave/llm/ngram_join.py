"""N-gram Jaccard join by parity sketches.

A document's set of shingles is hashed to 64 bits each. A sketch cuts the hash space into blocks, as
many as suit the document's size band, and XORs each shingle into its block. Two sets that differ
in D shingles differ in at most D blocks, so the number of differing blocks (a Hamming distance)
never exceeds the symmetric difference; the same holds bit by bit for the short sketch, of about as
many bits as the set has shingles, in which a shingle flips one bit.

At 100 * |A & B| >= 80 * |A | B| the symmetric difference is at most (|A| + |B|) / 9. A set therefore
shares one of its first D + 1 non-empty blocks, in any order that all sets keep, with every partner
(pigeonhole); blocks are joined on equality, candidates pass the short sketch, and what is left is
verified on the sets themselves. No step is a guess: no link is lost, and none is made below the bound.

Groups of copies: equal sets are one set from the start. Blocks are taken in order of how many sets
have them, so that passages which many documents share come last and drop out. A block's key shared
by more than HOT sets is not paired up; sets that meet in a hot block are compared by their short sketches in tiles, which emit a spanning forest of the pairs that
pass; what hangs together then is compared exactly, in tiles that emit a spanning forest of true links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossweave.llm.shared import bit_position, bits_set, components, membership_bits, mix64, pieces, save, shingle_sets, shuffles_end_here

WIDTH = 5
#: Links are 100 * |A & B| >= PERCENT * |A | B|.
PERCENT = 80
SKETCH_BITS = 1024
#: A block's key shared by more sets than this is hot.
HOT = 16
#: Sets of a group are compared in tiles of so many at most, and of about so many bytes; short sketches of a hot key likewise.
TILE, TILE_BYTES = 4096, 8_000_000
#: Postings that a task makes before it sends them.
SENT = 1 << 19
#: Slots of the table that orders blocks by frequency, whatever the size of the input.
SLOTS = 1 << 21
#: Shingles to a block: a band's number of blocks is its least size divided by this.
LOAD = 1.75


def bands(size: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """(band, most differing shingles) under which a set of this size is filed.

    Band o holds sizes from 2**o to 2**(o+1) - 1. A set also joins the next band if a partner may be
    there; bands in which only equal sets could link are left out."""
    most_partner = size * 100 // percent
    o = size.bit_length() - 1
    # |A ^ B| <= (|A| + |B|) * (100 - percent) / (100 + percent)
    limit = lambda partner: (size + partner) * (100 - percent) // (100 + percent)
    out = [(o, limit(min(most_partner, (2 << o) - 1)))]
    if most_partner >= 2 << o:
        out.append((o + 1, limit(most_partner)))
    return [(band, most) for band, most in out if most > 0]


def block_keys(found: np.ndarray, band: int) -> np.ndarray:
    """A positive 63-bit key for each non-empty block of a sorted set of hashes: the XOR of its shingles."""
    count = np.uint64(max(2, int((1 << band) / LOAD)))
    block = ((found >> np.uint64(32)) * count) >> np.uint64(32)
    first = np.concatenate([[0], np.nonzero(np.diff(block))[0] + 1])
    with np.errstate(over="ignore"):
        mixed = np.bitwise_xor.reduceat(mix64(found), first)
        key = mix64(mixed + (block[first] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band) * np.uint64(0xD1342543DE82EF95))
    return (key >> np.uint64(1)).astype(np.int64)


def all_keys(found: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[int, np.ndarray]]:
    """For each band of the set (most differing shingles, keys). A set with too few blocks for the
    pigeonhole also files every shingle, under keys that only such sets have."""
    for band, most in bands(len(found), percent):
        keys = block_keys(found, band)
        if len(keys) <= most:
            single = (mix64(found + np.uint64(band + 1)) >> np.uint64(1)).astype(np.int64)
            yield len(keys) + len(single), np.concatenate([keys, single])
        else:
            yield most, keys


def set_id(found: np.ndarray) -> int:
    """One number for a set; equal sets have the same, two others with a probability of 2**-64, about one pair in the
    sets of six billion documents."""
    if not len(found):
        return 0
    with np.errstate(over="ignore"):
        total = mix64(found).sum(dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(found))
    return int(mix64(np.array([total], np.uint64)).view(np.int64)[0])


def sketch(found: np.ndarray) -> bytes:
    """Parities of shingles by bit, as many bits as the next power of two to the set's size, SKETCH_BITS at least."""
    bits = max(SKETCH_BITS, 1 << (len(found) - 1).bit_length())
    parity = np.bincount((mix64(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def folded(raw: bytes, size: int) -> np.ndarray:
    """A sketch in `size` bytes: a bit is the parity of those that fall on it, so that it is the shorter sketch of the same set."""
    x = np.frombuffer(raw, np.uint64)
    while 8 * len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


class Sketches:
    """Sketches of several lengths; two are compared at the shorter one's."""

    def __init__(self, raw: list[bytes]) -> None:
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.at, self.rows = {}, {}
        for size in np.unique(self.sizes).tolist():
            there = np.nonzero(self.sizes >= size)[0]
            self.at[size] = np.full(len(raw), -1)
            self.at[size][there] = np.arange(len(there))
            self.rows[size] = np.stack([folded(raw[k], size) for k in there.tolist()])

    def apart(self, i: int, others: np.ndarray) -> np.ndarray:
        """Bits in which sketch i and each of the others differ."""
        out = np.zeros(len(others), np.int64)
        common = np.minimum(self.sizes[others], self.sizes[i])
        for size in np.unique(common).tolist():
            mine = common == size
            rows, at = self.rows[size], self.at[size]
            out[mine] = np.bitwise_count(rows[at[others[mine]]] ^ rows[at[i]]).sum(axis=-1, dtype=np.int64)
        return out


def described(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, sid, sketch) of each row; sid is null for an empty set."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sizes, sids, sketches = [], [], []
            for found in shingle_sets(batch.column(1), width):
                sizes.append(len(found))
                sids.append(set_id(found) if len(found) else None)
                sketches.append(sketch(found) if len(found) else None)
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sids, pa.int64()), pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "sid", "sketch"])

    return rows.mapInArrow(run, "doc_id long, n_shingles long, sid long, sketch binary")


def _local(keys: np.ndarray, sids: np.ndarray, members: bool) -> pa.RecordBatch:
    """Postings of a batch, each (key, sid) once. A key with more than HOT sets here sends HOT + 1 of
    them; of the others it sends that they are hot, so that no key gathers its rows in one task.

    Rows: key >= 0 is a posting; key < 0 says that sid is hot (members: in the key that is `other`)."""
    order = np.lexsort((sids, keys))
    keys, sids = keys[order], sids[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (sids[1:] != sids[:-1])
    keys, sids = keys[new], sids[new]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    start = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
    over = np.arange(len(keys)) - start > HOT
    told = -1 - (mix64(sids[over].view(np.uint64)) >> np.uint64(1)).astype(np.int64)
    columns = [pa.array(np.concatenate([keys[~over], told])), pa.array(np.concatenate([sids[~over], sids[over]]))]
    if members:
        columns.append(pa.array(np.concatenate([np.zeros((~over).sum(), np.int64), keys[over]])))
    return pa.record_batch(columns, names=["key", "sid", "other"][: len(columns)])


def _meet(batches: Iterator[pa.RecordBatch], members: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> (a, b, hot): pairs of sets of a key that is not hot; (sid, null) for a set of a
    hot one (members: (sid, key)). Keeps HOT + 1 rows between batches."""
    left = tuple(np.zeros(0, np.int64) for _ in range(2 + members))
    hot_key = None

    def told(a: np.ndarray, b: np.ndarray | None, hot: bool) -> pa.RecordBatch:
        return pa.record_batch([pa.array(a), pa.array(b) if b is not None else pa.nulls(len(a), pa.int64()), pa.array(np.full(len(a), hot))], names=["a", "b", "hot"])

    def hot_rows(keys: np.ndarray, sids: np.ndarray) -> pa.RecordBatch:
        return told(sids, keys, True) if members else told(np.unique(sids), None, True)

    def work(keys: np.ndarray, sids: np.ndarray, others: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        nonlocal hot_key
        aside = keys < 0
        if aside.any():
            yield hot_rows(others[aside] if members else keys[aside], sids[aside])
            keys, sids = keys[~aside], sids[~aside]
        if not len(keys):
            return
        if hot_key is not None and keys[0] == hot_key:  # more of a key that was found hot before
            more = int(np.searchsorted(keys, hot_key, "right"))
            yield hot_rows(keys[:more], sids[:more])
            keys, sids = keys[more:], sids[more:]
        order = np.lexsort((sids, keys))
        keys, sids = keys[order], sids[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (sids[1:] != sids[:-1])
        keys, sids = keys[new], sids[new]
        if not len(keys):
            return
        start = np.concatenate([[0], np.nonzero(np.diff(keys))[0] + 1])
        length = np.diff(np.concatenate([start, [len(keys)]]))
        hot = length > HOT
        if hot.any():
            inside = np.repeat(hot, length)
            yield hot_rows(keys[inside], sids[inside])
            if hot[-1]:
                hot_key = keys[-1]
        run = np.repeat((length > 1) & ~hot, length)
        keys, sids = keys[run], sids[run]
        for k in range(1, HOT):
            if k >= len(keys):
                break
            same = keys[k:] == keys[:-k]
            if not same.any():
                break
            yield told(sids[:-k][same], sids[k:][same], False)

    for batch in batches:
        now = tuple(np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate(left))
        if not len(now[0]):
            continue
        # the last key may go on in the next batch; once it is known to be hot it need not wait
        tail = int(np.searchsorted(now[0], now[0][-1], "left"))
        waiting, at = np.unique(now[1][tail:], return_index=True)
        if now[0][-1] >= 0 and len(waiting) <= HOT:
            left = tuple(x[tail:][at] for x in now)
            now = tuple(x[:tail] for x in now)
        else:
            left = tuple(x[:0] for x in now)
        yield from work(*now)
    yield from work(*left)


def meet(postings: DataFrame, members: bool = False) -> DataFrame:
    """The distinct (a, b, hot) of `_meet` for a table (key, sid; members: other), one shuffle of the postings."""
    sorted_rows = postings.repartition("key").sortWithinPartitions("key")
    found = sorted_rows.mapInArrow(lambda batches: _meet(batches, members), "a long, b long, hot boolean")
    low, high = F.when(F.col("hot"), F.col("a")).otherwise(F.least("a", "b")), F.when(F.col("hot"), F.col("b")).otherwise(F.greatest("a", "b"))
    return found.select(low.alias("a"), high.alias("b"), "hot").distinct()


def _posted(rows: DataFrame, width: int, percent: int, order) -> DataFrame:
    """(key, sid, other): the D + 1 rarest keys of each set; `order` has the blocks' frequencies by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(order.value, np.int32)
        keys: list[np.ndarray] = []
        sids: list[np.ndarray] = []
        made = 0
        for batch in pieces(batches):
            seen: set[int] = set()
            for found in shingle_sets(batch.column(1), width):
                if not len(found) or (sid := set_id(found)) in seen:
                    continue
                seen.add(sid)
                for most, own in all_keys(found, percent):
                    own = own[np.lexsort((own, counts[own % SLOTS]))][: most + 1]
                    keys.append(own)
                    sids.append(np.full(len(own), sid, np.int64))
                    made += len(own)
            if made >= SENT:
                yield _local(np.concatenate(keys), np.concatenate(sids), True)
                keys, sids, made = [], [], 0
        if made:
            yield _local(np.concatenate(keys), np.concatenate(sids), True)

    return rows.mapInArrow(run, "key long, sid long, other long")


def _members(batch: pa.RecordBatch, member) -> pa.Array:
    """The batch's texts, without those that the bit table rules out."""
    if member is None:
        return batch.column(1)
    return batch.column(1).filter(pa.array(bits_set(member.value, batch.column(0).to_numpy(zero_copy_only=False))))


def _frequencies(rows: DataFrame, width: int, percent: int):
    """A broadcast table of SLOTS counters: how many sets have a block that falls in the slot.

    A task counts all its rows in one table and sends that in chunks; chunks are added up as they come."""
    chunk = 1 << 13

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SLOTS, np.int64)
        for batch in pieces(batches):
            keys = [np.zeros(0, np.int64)]
            seen: set[int] = set()
            for found in shingle_sets(batch.column(1), width):
                if len(found) and (sid := set_id(found)) not in seen:
                    seen.add(sid)
                    keys += [own for _, own in all_keys(found, percent)]
            np.add.at(table, np.concatenate(keys) % SLOTS, 1)
        table = np.minimum(table, 2**31 - 1).astype(np.int32)
        for k in range(0, SLOTS, chunk):
            if table[k : k + chunk].any():
                yield pa.record_batch([pa.array([k // chunk], pa.int32()), pa.array([table[k : k + chunk].tobytes()], pa.binary())], names=["chunk", "raw"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw, np.int32).astype(np.int64)
        for k, total in sums.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())], names=["chunk", "raw"])

    found = rows.mapInArrow(count, "chunk int, raw binary").repartition("chunk").mapInArrow(add, "chunk int, raw binary")
    table = np.zeros(SLOTS, np.int32)
    with shuffles_end_here(rows.sparkSession):
        told = found.collect()  # SLOTS / chunk rows at most
    for row in told:
        table[row["chunk"] * chunk : (row["chunk"] + 1) * chunk] = np.frombuffer(row["raw"], np.int32)
    return rows.sparkSession.sparkContext.broadcast(table.tobytes())


def sketch_filter(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs whose sizes and short sketches allow a link."""
    one = sets.select(F.col("sid").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    two = sets.select(F.col("sid").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    rows = pairs.join(one, "a").join(two, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            apart = [int(np.bitwise_count(folded(x, min(len(x), len(y))) ^ folded(y, min(len(x), len(y)))).sum()) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            fits = np.array(apart) * (100 + percent) <= total * (100 - percent)
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(fits))

    return rows.mapInArrow(run, "a long, b long")


def _close_forest(sids: np.ndarray, tile: np.ndarray, sizes: np.ndarray, sketches: Sketches, same_tile: bool, percent: int) -> tuple[list[int], list[int]]:
    """Pairs that sizes and sketches allow, as many as join up what hangs together."""
    n = len(sids)
    comp = np.arange(n)
    out_a, out_b = [], []
    for i in range(n - 1):
        rest = slice(i + 1, n)
        may = (comp[rest] != comp[i]) & (100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i]))
        if not same_tile:
            may &= tile[rest] != tile[i]
        spots = np.nonzero(may)[0] + i + 1
        if not len(spots):
            continue
        spots = spots[sketches.apart(i, spots) * (100 + percent) <= (sizes[spots] + sizes[i]) * (100 - percent)]
        groups, first = np.unique(comp[spots], return_index=True)
        if len(groups):
            out_a += [int(sids[i])] * len(groups)
            out_b += sids[spots[first]].tolist()
            comp[np.isin(comp, groups)] = comp[i]
    return out_a, out_b


def _tiles(size: Column) -> Column:
    """Tiles of a group of that many bytes."""
    return F.ceil(F.greatest(F.count("*") / F.lit(TILE), size / F.lit(TILE_BYTES))).cast("int")


def hot_pairs(members: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): of the sets of each hot key (sid, key) a spanning forest of the pairs that the short sketches allow.

    A key with more sets, or longer sketches, than a tile holds is dealt into tiles that meet pair by pair."""
    own = members.join(sets.select("sid", "n_shingles", "sketch"), "sid")
    n = own.groupBy("key").agg(_tiles(F.sum(F.length("sketch"))).alias("tiles"))
    rows = own.join(n, "key").withColumn("tile", F.pmod(F.xxhash64("sid"), "tiles").cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("key", F.least("tile", "with").alias("t1"), F.greatest("tile", "with").alias("t2"), "tile", "sid", "n_shingles", "sketch")
    rows = rows.repartition("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2", "sid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            tile, sids, sizes = (np.array([h[k] for h in held], np.int64) for k in range(3))
            a, b = _close_forest(sids, tile, sizes, Sketches([h[3] for h in held]), now[1] == now[2], percent)
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for key, t1, t2, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (key, t1, t2) != now:
                    if now is not None:
                        yield done()
                    now, held = (key, t1, t2), []
                held.append(row)
        if now is not None:
            yield done()

    return rows.mapInArrow(run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verify_tile(sids: np.ndarray, tile: np.ndarray, sets: list[np.ndarray], sketches: Sketches, same_tile: bool, percent: int) -> list[tuple[int, int]]:
    """True links between a tile's sets that join what was not joined yet."""
    n = len(sids)
    sizes = np.array([len(s) for s in sets], np.int64)
    comp = np.arange(n)
    out = []
    for i in range(n - 1):
        rest = slice(i + 1, n)
        may = (comp[rest] != comp[i]) & (100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i]))
        if not same_tile:
            may &= tile[rest] != tile[i]
        spots = np.nonzero(may)[0] + i + 1
        if not len(spots):
            continue
        for j in spots[sketches.apart(i, spots) * (100 + percent) <= (sizes[spots] + sizes[i]) * (100 - percent)].tolist():
            if comp[j] == comp[i]:
                continue
            a, b = (sets[i], sets[j]) if sizes[i] <= sizes[j] else (sets[j], sets[i])
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            shared = int((b[at] == a).sum())
            if 100 * shared >= percent * (len(a) + len(b) - shared):
                out.append((int(sids[i]), int(sids[j])))
                comp[comp == comp[j]] = comp[i]
    return out


def verified_links(docs: DataFrame, groups: DataFrame, sets: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(a, b): a spanning forest of the true links among the sets of each group (node, root).

    The sets are made again from the texts of one document for each, found by a bit table of fixed
    size and an exact join. A group with more than a tile holds is dealt into tiles that meet pair by
    pair, so that no task holds more than two tiles."""
    chosen = sets.join(groups.withColumnRenamed("node", "sid"), "sid").select("sid", "first_doc", "root", "n_shingles")
    n = chosen.groupBy("root").agg(_tiles(F.sum("n_shingles") * 8).alias("tiles"))
    chosen = save(chosen.drop("n_shingles").join(n, "root"), "groups")
    member = membership_bits(chosen, "first_doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sids, raw, short = [], [], []
            seen: set[int] = set()
            for found in shingle_sets(_members(batch, member), width):
                if len(found) and (sid := set_id(found)) not in seen:
                    seen.add(sid)
                    sids.append(sid)
                    raw.append(found.tobytes())
                    short.append(sketch(found))
            yield pa.record_batch([pa.array(sids, pa.int64()), pa.array(raw, pa.binary()), pa.array(short, pa.binary())], names=["sid", "found", "sketch"])

    rows = docs.select(bit_position("doc_id").alias("p"), "text")
    made = rows.mapInArrow(run, "sid long, found binary, sketch binary")
    dealt = made.join(chosen.select("sid", "root", "tiles"), "sid").withColumn("tile", F.pmod(F.xxhash64("sid"), "tiles").cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("root", F.least("tile", "with").alias("t1"), F.greatest("tile", "with").alias("t2"), "tile", "sid", "found", "sketch")
    dealt = dealt.repartition("root", "t1", "t2").sortWithinPartitions("root", "t1", "t2", "sid")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            once = {h[1]: h for h in held}
            if len(once) > 1:
                sids = np.array(list(once), np.int64)
                found = [np.frombuffer(h[2], np.uint64) for h in once.values()]
                short = Sketches([h[3] for h in once.values()])
                links = _verify_tile(sids, np.array([h[0] for h in once.values()]), found, short, now[1] == now[2], percent)
                if links:
                    yield pa.record_batch([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            for root, t1, t2, tile, sid, found, short in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (root, t1, t2) != now:
                    if now is not None:
                        yield from done()
                    now, held = (root, t1, t2), []
                held.append((tile, sid, found, short))
        if now is not None:
            yield from done()

    return dealt.mapInArrow(check, "a long, b long")


def _labelled(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, sid, sketch) of each row, and (sid, root, component) of each set: the least set that it is
    connected with, and the least id of a document there."""
    known = save(described(docs, width), "described")
    rows = docs.where("doc_id is not null").select(bit_position("doc_id").alias("p"), "text")
    sets = known.where("sid is not null and doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("first_doc"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    sets = save(sets, "sets")

    order = _frequencies(rows, width, percent)
    met = save(meet(_posted(rows, width, percent, order), members=True), "met")
    order.unpersist()
    close = sketch_filter(met.where("not hot").select("a", "b"), sets, percent)
    hot = met.where("hot").select(F.col("a").alias("sid"), F.col("b").alias("key"))
    if not hot.isEmpty():
        close = close.union(hot_pairs(hot, sets, percent))
    groups = components(close)
    links = verified_links(docs.where("doc_id is not null"), groups, sets, width, percent)
    roots = components(links).select(F.col("node").alias("sid"), "root")
    label = sets.select("sid", "first_doc").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = label.groupBy("root").agg(F.min("first_doc").alias("component"))
    return known, label.join(least, "root").select("sid", "root", "component")


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of (doc_id, text).

    Texts are lower-cased (A-Z) and cut at ASCII white space; a text of fewer words than `width` is one
    shingle, and one without words (or null) has the empty set, which links with nothing: its
    component is its own id, as is that of a document without partner. Documents with equal sets
    are in one component. Rows with a null id are linked with nothing and have a null component.
    Rows are the nodes: rows that repeat an id each get a row. Columns besides doc_id and text are
    not read; an empty table gives no rows."""
    known, label = _labelled(docs, width, percent)
    return known.join(label, "sid", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay where doc_id is a key: of each component the row with its smallest id, and every row
    without an id. Of rows that repeat an id one stays; where that may happen use `without_copies`."""
    kept = join(docs, **options).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    stay = docs.join(kept, docs["doc_id"] == kept["kept_id"], "left_semi").dropDuplicates(["doc_id"])
    return stay.unionByName(docs.where("doc_id is null"))


def without_copies(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of each group of linked rows, with all its columns; rows whose set is empty and rows without an id all stay.

    Of a group the rows with the smallest id stay, of these the ones with the smallest set's number, of these the first
    by text and then by a hash of the whole row, so that reruns keep the same row. Rows that share an id but not their
    text are different documents: none goes but for a linked one that stays. An empty table gives no rows."""
    known, label = _labelled(docs, width, percent)
    numbered = known.where("doc_id is not null").select("doc_id", "sid")
    best = numbered.where("sid is not null").distinct().join(label, "sid").groupBy("root").agg(F.min(F.struct("doc_id", "sid")).alias("kept")).select("kept.*")
    kept = save(best.union(numbered.where("sid is null")), "kept").toDF("kept_id", "kept_sid")
    repeated = numbered.groupBy(F.col("doc_id").alias("repeated_id")).agg(F.count("*").alias("n")).where("n > 1").select("repeated_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("id_of_row"), F.col("text").alias("text_of_row"), F.struct(*docs.columns).alias("row"))
    unnamed = rows.where("id_of_row is null").select("row.*")
    of_id = lambda part: part.join(kept.select(F.col("kept_id").alias("id_of_row")), "id_of_row", "left_semi")
    if repeated.isEmpty():
        return of_id(rows).select("row.*").unionByName(unnamed)
    repeated = save(repeated, "repeated").withColumnRenamed("repeated_id", "id_of_row")
    alone = of_id(rows.join(repeated, "id_of_row", "left_anti"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text_of_row"):
            sids = [set_id(found) if len(found) else None for found in shingle_sets(batch.column(1), width)]
            yield pa.record_batch([*batch.columns, pa.array(sids, pa.int64())], names=["id_of_row", "text_of_row", "row", "kept_sid"])

    several = rows.join(repeated, "id_of_row", "left_semi")
    several = several.mapInArrow(number, f"id_of_row long, text_of_row string, row {several.schema['row'].dataType.simpleString()}, kept_sid long")
    first = F.row_number().over(Window.partitionBy("id_of_row", "kept_sid").orderBy("text_of_row", F.xxhash64("row")))
    linked = several.where("kept_sid is not null").withColumn("kept_id", F.col("id_of_row")).join(kept, ["kept_id", "kept_sid"], "left_semi").withColumn("place", first).where("place = 1")
    return alone.select("row.*").unionByName(linked.select("row.*")).unionByName(several.where("kept_sid is null").select("row.*")).unionByName(unnamed)
