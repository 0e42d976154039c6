"""Document fingerprints by MinHash over word shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossweave.llm import ngram_join
from crossweave.llm.shared import bucket_of, components, mix64, pieces, range_bounds, save, shingle_sets

PERMUTATIONS = 128
#: A near-duplicate search cuts a signature into bands of so many values; one equal band makes a candidate.
BAND_ROWS = 4
SEED = 7_001
WIDTH = 5


def _universal(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiply-add hashes modulo 2**64 with odd factors: permutations of the 64-bit numbers."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**63, permutations, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, permutations, np.uint64)


def signature(found: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """Least value of the set under each permutation, 16 bits of it; all ones for the empty set."""
    if not len(found):
        return np.full(permutations, 0xFFFF, np.uint16)
    a, b = _universal(permutations)
    least = np.full(permutations, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(found), 2048):
            values = a[:, None] * found[None, k : k + 2048]
            values += b[:, None]
            np.minimum(least, values.min(axis=1), out=least)
    return (mix64(least) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal values: an estimate of the Jaccard similarity of the two sets."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points give way to the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint(docs: DataFrame, permutations: int = PERMUTATIONS, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The next document is that of the next higher doc_id, the first after the last; rows with the same
    id follow each other in order of their texts. Rows with a null id come before all others. Null
    text counts as empty. Texts without words have the fingerprint of the empty set, and two of them
    have likeness 1. Columns besides doc_id and text are not read; an empty table gives no rows.

    Rows are dealt by ranges of doc_id, with one shuffle of the texts. Each range also gets the rows
    with the least id of the next range, so that no range waits for another; a range streams through
    its task, two rows at a time."""
    return _shown(_rows(docs, permutations, width))


def fingerprint_components(docs: DataFrame, percent: int = 80, permutations: int = PERMUTATIONS, rows_in_band: int = BAND_ROWS, width: int = WIDTH) -> DataFrame:
    """The rows of `fingerprint`, each with the component_id that `near_duplicates` gives its text.

    Signatures are made once and saved; bands come from the saved ones. A row gets its component by its
    set of shingles, of which there is one in the table of components, so rows that repeat an id neither
    multiply nor share a component by the id alone. Null ids have a null component."""
    known = save(_rows(docs, permutations, width), "fingerprints")
    label = save(_components(docs, known, percent, rows_in_band, width), "components")
    return _shown(known.join(label, "sid", "left"), _component_id())


def _component_id() -> Column:
    return F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")


def _shown(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("sign")).alias("fingerprint"), F.lower(F.hex("edited_sign")).alias("edited_fingerprint"), "near_edited", "near_next", *more)


def _rows(docs: DataFrame, permutations: int, width: int) -> DataFrame:
    """The rows of `fingerprint` with signatures as bytes, and n_shingles, sid and sketch of each text."""
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # null ids take the place right before all others
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = range_bounds(rows, "doc_id", ranges)
    rows = rows.withColumn("range", bucket_of("doc_id", bounds))
    # one row for each range: its least id, and whether ids are missing
    least = rows.groupBy("range").agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("gaps")).orderBy("range").collect()
    firsts = [(None if r["gaps"] else r["least"], r["range"]) for r in least]
    guests = [(first, firsts[k - 1][1]) for k, (first, _) in enumerate(firsts)]
    hosts = spark.createDataFrame([(g, r) for g, r in guests], "first long, host int")
    rows = rows.join(F.broadcast(hosts), F.col("doc_id").eqNullSafe(F.col("first")), "left")
    own, guest = F.struct(F.col("range").alias("r"), F.lit(0).alias("guest")), F.struct(F.col("host").alias("r"), F.lit(1).alias("guest"))
    rows = rows.withColumn("at", F.explode(F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, guest)))).select("at.r", "at.guest", "doc_id", "text")
    rows = rows.repartitionById(max(1, len(bounds) + 1), F.col("r")).sortWithinPartitions("r", "guest", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # range, id, text, signature and set of the last row of its own, until its next row is known
        for batch in pieces(batches):
            ranges, guest, ids, texts = (c.to_pylist() for c in batch.columns)
            pairs = []
            for r, g, i, text, found in zip(ranges, guest, ids, texts, shingle_sets(texts, width), strict=True):
                sign = signature(found, permutations)
                if before is not None and before[0] == r:
                    pairs.append((*before[1:], text, sign))
                    before = None
                if not g:
                    before = (r, i, text, sign, _described(found))
            changed = [edited(text, following) for _, text, _, _, following, _ in pairs]
            other = [signature(s, permutations) for s in shingle_sets(changed, width)]
            yield pa.record_batch(
                [
                    pa.array([p[0] for p in pairs], pa.int64()),
                    pa.array([len(p[1]) for p in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
                    pa.array([p[2].tobytes() for p in pairs], pa.binary()),
                    pa.array([o.tobytes() for o in other], pa.binary()),
                    pa.array([likeness(p[2], o) for p, o in zip(pairs, other, strict=True)], pa.float64()),
                    pa.array([likeness(p[2], p[5]) for p in pairs], pa.float64()),
                    pa.array([p[3][0] for p in pairs], pa.int64()),
                    pa.array([p[3][1] for p in pairs], pa.int64()),
                    pa.array([p[3][2] for p in pairs], pa.binary()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "sign", "edited_sign", "near_edited", "near_next", "n_shingles", "sid", "sketch"],
            )

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, sign binary, edited_sign binary, near_edited double, near_next double, n_shingles long, sid long, sketch binary")


def _described(found: np.ndarray) -> tuple[int, int | None, bytes | None]:
    """Size, id and sketch of a set; no id and no sketch for the empty set."""
    return len(found), ngram_join.set_id(found) if len(found) else None, ngram_join.sketch(found) if len(found) else None


def near_duplicates(docs: DataFrame, percent: int = 80, permutations: int = PERMUTATIONS, rows_in_band: int = BAND_ROWS, width: int = WIDTH) -> DataFrame:
    """(doc_id, component_id): documents whose signatures agree in a band and whose Jaccard similarity is high enough.

    Bands are joined in Spark; candidates are verified on the whole sets. Bands that many sets share
    form groups, whose pairs are compared in tiles with an exact check. A link whose signatures agree
    in no band is missed (at similarity 0.8 and 32 bands of four less than one in ten million)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = list(shingle_sets(batch.column(1), width))
            sizes, sids, sketches = zip(*map(_described, found), strict=True) if found else ((), (), ())
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sids, pa.int64()), pa.array(sketches, pa.binary()), pa.array([signature(x, permutations).tobytes() for x in found], pa.binary())], names=["doc_id", "n_shingles", "sid", "sketch", "sign"])

    known = save(rows.mapInArrow(run, "doc_id long, n_shingles long, sid long, sketch binary, sign binary"), "described")
    return known.join(_components(docs, known, percent, rows_in_band, width), "sid", "left").select("doc_id", _component_id())


def _components(docs: DataFrame, known: DataFrame, percent: int, rows_in_band: int, width: int) -> DataFrame:
    """(sid, component) of every set in a table (doc_id, n_shingles, sid, sketch, sign): the least id of its near duplicates."""
    sets = known.where("sid is not null and doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("first_doc"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("sign").alias("sign"))
    sets = save(sets, "sets")
    rows = docs.where("doc_id is not null").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bands = np.stack([np.frombuffer(x, np.uint16) for x in batch.column(1).to_pylist()]).astype(np.uint64).reshape(batch.num_rows, -1, rows_in_band)
            keys = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64), bands.shape[:2]).copy()
            with np.errstate(over="ignore"):
                for k in range(rows_in_band):
                    keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, k])
                sids = np.repeat(batch.column(0).to_numpy(), bands.shape[1])
                yield ngram_join._local((keys >> np.uint64(1)).astype(np.int64).ravel(), sids, True)

    met = save(ngram_join.meet(sets.select("sid", "sign").mapInArrow(run, "key long, sid long, other long"), members=True), "met")
    sets = sets.drop("sign")
    hot = met.where("hot").select(F.col("a").alias("sid"), F.col("b").alias("key"))
    close = ngram_join.sketch_filter(met.where("not hot").select("a", "b"), sets, percent).union(ngram_join.hot_pairs(hot, sets, percent))
    groups = components(close)
    links = ngram_join.verified_links(rows, groups, sets, width, percent)
    roots = components(links).select(F.col("node").alias("sid"), "root")
    label = sets.select("sid", "first_doc").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = label.groupBy("root").agg(F.min("first_doc").alias("component"))
    return label.join(least, "root").select("sid", "component")
