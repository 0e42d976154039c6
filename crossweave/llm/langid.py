"""Language identification by hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.llm.shared import pieces

DIMENSIONS = 2048
#: Symbols: the gap between words, a-z, the small letters of Latin-1, and 36 classes that all other letters are hashed to.
SYMBOLS, OTHERS = 96, 60
SEED = 20_240_101
#: Texts and trigrams that are bundled at once, and trigrams whose vectors are held at once.
BLOCK_TEXTS, BLOCK_GRAMS, VECTORS = 256, 1 << 19, 2048
#: Values of lang, at most: with 16 KB each, 64 MB are broadcast.
MOST_LANGUAGES = 4096


@cache
def symbol_table() -> np.ndarray:
    """The symbol of each code point: 0 for all that are no letters."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000 or not chr(c).isalpha():
            continue
        small = ord(chr(c).lower()[0])
        if 97 <= small <= 122:
            table[c] = small - 96
        elif 0xDF <= small <= 0xFF:
            table[c] = small - 0xDF + 27
        else:
            table[c] = OTHERS + (small * 0x9E3779B1 >> 7) % (SYMBOLS - OTHERS)
    return table


def letter_vectors(dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, dimensions))


def gram_vectors(grams: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A trigram's vector binds (multiplies) its letters' vectors, permuted (rotated) by their places."""
    v = letter_vectors(dimensions)
    first, second = np.roll(v, 2, axis=1), np.roll(v, 1, axis=1)
    return first[grams // SYMBOLS**2] * second[grams // SYMBOLS % SYMBOLS] * v[grams % SYMBOLS]


def trigrams(text: str | None) -> np.ndarray:
    """Trigram numbers of the letters, gaps between words as one symbol; empty for a text without letters."""
    if not text:
        return np.zeros(0, np.int64)
    s = symbol_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    s = np.concatenate([np.zeros(1, np.uint8), s, np.zeros(1, np.uint8)])
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    s = s[keep].astype(np.int64)
    if len(s) < 3:
        return np.zeros(0, np.int64)
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text modulo 3 is 1; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def bundled(grams: list[np.ndarray], dimensions: int = DIMENSIONS) -> np.ndarray:
    """A row for each list of trigrams: the sum of their vectors, made for all lists at once as counts times vectors.

    Sums are whole numbers, which single precision holds exactly for lists under 2^24 trigrams; longer ones take
    double. VECTORS trigrams' vectors are held at a time."""
    every, owner = np.concatenate([np.zeros(0, np.int64), *grams]), np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    kind = np.float32 if max(map(len, grams), default=0) < 1 << 24 else np.float64
    there = np.flatnonzero(np.bincount(every, minlength=SYMBOLS**3))
    column = np.zeros(SYMBOLS**3, np.int64)
    column[there] = np.arange(len(there))
    at, out = column[every], np.zeros((len(grams), dimensions), kind)
    for k in range(0, len(there), VECTORS):
        part = there[k : k + VECTORS]
        mine = (at >= k) & (at < k + len(part))
        counts = np.bincount(owner[mine] * len(part) + at[mine] - k, minlength=len(grams) * len(part)).reshape(len(grams), len(part))
        out += counts.astype(kind) @ gram_vectors(part, dimensions).astype(kind)
    return out


def blocks(texts: list[str | None]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first, trigrams of each text): consecutive texts that are bundled together, at most BLOCK_TEXTS with about BLOCK_GRAMS trigrams."""
    first, held, size = 0, [], 0
    for k, text in enumerate(texts):
        held.append(trigrams(text))
        size += len(held[-1])
        if size >= BLOCK_GRAMS or len(held) == BLOCK_TEXTS:
            yield first, held
            first, held, size = k + 1, [], 0
    if held:
        yield first, held


def prototypes(train: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(lang, dim, value): each language's bundle (sum) of all trigram vectors of all training texts.

    A task bundles its rows by language and sends one vector for each, which are summed with map-side combine."""
    rows = train.select("lang", "text").where("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in pieces(batches):
            named = batch.column(0).to_pylist()
            for first, grams in blocks(batch.column(1).to_pylist()):
                own: dict[str, list[np.ndarray]] = {}
                for k, g in enumerate(grams):
                    own.setdefault(named[first + k], []).append(g)
                for lang, bundle in zip(own, bundled([np.concatenate(g) for g in own.values()], dimensions), strict=True):
                    sums[lang] = sums.get(lang, np.zeros(dimensions)) + bundle
        for lang, bundle in sums.items():
            yield pa.record_batch([pa.array([lang] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(bundle)], names=["lang", "dim", "value"])

    return rows.mapInArrow(run, "lang string, dim int, value double").groupBy("lang", "dim").agg(F.sum("value").alias("value"))


def learn(docs: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """The languages and a row of length 1 for each: their bundles over the text and lang of all rows that are not held out.

    The driver gets, and sends, `dimensions` numbers a language (16 KB); more than MOST_LANGUAGES values of lang raise."""
    rows = prototypes(docs.where(~held_out()), dimensions).where("value <> 0")
    n = docs.where("lang is not null").select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if n > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of lang; they are no languages")
    found: dict[str, np.ndarray] = {}
    for lang, part in rows.toPandas().groupby("lang"):
        v = found.setdefault(lang, np.zeros(dimensions))
        v[part["dim"].to_numpy()] = part["value"].to_numpy()
    langs = sorted(found)
    return langs, np.array([found[k] / np.linalg.norm(found[k]) for k in langs]).reshape(len(langs), dimensions)


def known_languages(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """The documents, all columns as they are, without those that have no language (und): null texts and texts without a letter."""
    spare = {c: f"kept_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    named = docs.select("doc_id", "text", "lang", *[F.col(c).alias(n) for c, n in spare.items()])
    judged = identify(named, dimensions, ("text", *spare.values()))
    return judged.where("lang_pred <> 'und'").select(*[F.col(spare.get(c, c)).alias(c) for c in docs.columns])


def identify(docs: DataFrame, dimensions: int = DIMENSIONS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, [keep], held_out, lang_pred, score) for every whole text.

    The prediction is the language whose prototype has the highest cosine with the bundle of the
    text's trigrams, the first by name in a tie; the score is that cosine, to twelve decimals (0 at
    least). Null texts and texts without a letter are und with score 0, as are all where nothing could
    be learned. lang, source and doc_id are no inputs of a prediction. Each row is judged by itself,
    repeated rows alike; other columns are not read.

    One pass to learn (a vector for each language and task is shuffled) and one map to predict. What is
    broadcast is a vector for each language, of which there are MOST_LANGUAGES at most."""
    langs, profiles = learn(docs, dimensions)
    shared = docs.sparkSession.sparkContext.broadcast((langs, profiles))
    kept = [k for k in keep if k != "doc_id"]
    others = [k for k in keep if k not in ("text", "doc_id")]
    rows = docs.select("text", "doc_id", held_out().alias("held_out"), *others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, profiles = shared.value
        for batch in pieces(batches):
            names, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            for first, grams in blocks(batch.column(0).to_pylist() if langs else []):
                some = [k for k, g in enumerate(grams) if len(g)]
                b = bundled([grams[k] for k in some], dimensions).astype(np.float64)
                cosines = np.round(b @ profiles.T / np.maximum(np.linalg.norm(b, axis=1), 1)[:, None], 12)
                for k, row in zip(some, cosines, strict=True):
                    best = int(np.argmax(row))
                    names[first + k], scores[first + k] = langs[best], min(1.0, max(0.0, row[best]))
            yield pa.record_batch([batch.column(1), *[batch.column(0 if k == "text" else 3 + others.index(k)) for k in kept], batch.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", *kept, "held_out", "lang_pred", "score"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([f"doc_id {kinds['doc_id']}", *[f"`{k}` {kinds[k]}" for k in kept], "held_out boolean, lang_pred string, score double"]))
