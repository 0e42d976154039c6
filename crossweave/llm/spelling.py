"""Spelling variants of words: pairs one letter apart, found with a bit-sliced index of positions.

For each position and letter the index has a bitset of the words with that letter there. One pass
over a word's letters keeps three sets for the whole index at once: words that agree so far (zero
errors), words with one other letter so far, and words with one letter more so far, whose letters
are read one position further on. Words meet in the index only if they share their first or their last half."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.llm.shared import pieces, save

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
#: One occurrence in so many loses a letter, chosen by the checksum of its document's id and itself.
DAMAGED = 31
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A word's form occurs so many times as often as the word.
TIMES = 10
#: Rows of one index, about; a key with more of them is dealt out in squares of tiles.
TILE = 1 << 14
#: Sets of words that are followed at a time, in 64-bit numbers.
AT_ONCE = 1 << 17


def occurrences(docs: DataFrame) -> DataFrame:
    """(word, n): all runs of letters of LEAST_LENGTH code points and more, damaged as stated, that occur LEAST_COUNT times.

    A null text has none, a null doc_id counts as empty text. Rows that repeat an id count each. A
    run occurs in a document always damaged or never, so that a task sums up equal runs of a text
    before, and its counts are summed with map-side combine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            counts: Counter[str] = Counter()
            for text, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{name}:".encode())
                for word, n in Counter(LETTERS.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
                    if len(word) < LEAST_LENGTH:
                        continue
                    mark = zlib.crc32(word.encode(), start)
                    if mark % DAMAGED == 0:
                        at = mark % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= LEAST_LENGTH:
                        counts[word] += n
            yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    found = docs.select("text", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _bits(flags: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit sets."""
    packed = np.packbits(flags, axis=-1, bitorder="little")
    spare = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, spare)])).view(np.uint64)


def one_apart(asked: np.ndarray, held: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of asked, row of held) of words that one replaced or added letter makes equal.

    `asked` has words of L letters (letter numbers, L columns); `held` has words of L or, where `longer`, of L + 1
    letters (L + 1 columns). Pairs are those with one letter replaced, and those with one more in the held word."""
    length, places = asked.shape[1], []
    letters = np.unique(asked)
    asked = np.searchsorted(letters, asked)

    def index(p: int) -> np.ndarray:
        return _bits(held[None, :, p] == letters[:, None])

    same_length, one_more = _bits(~longer[None, :]), _bits(longer[None, :])
    width = same_length.shape[1]
    step = max(1, AT_ONCE // width)
    for a in range(0, len(asked), step):
        part = asked[a : a + step]
        agree = np.broadcast_to(same_length | one_more, (len(part), width)).copy()
        other, added = np.zeros_like(agree), np.zeros_like(agree)
        here = index(0)
        for i in range(length):
            after = index(i + 1)
            now, shifted = here[part[:, i]], after[part[:, i]]
            added |= agree
            added &= shifted
            other &= now
            other |= agree & ~now
            agree &= now
            here = after
        ends = other & same_length | (agree | added) & one_more
        q, w = np.nonzero(ends)
        bits = np.unpackbits(ends[q, w].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        k, bit = np.nonzero(bits)
        places.append((a + q[k], w[k] * 64 + bit))
    return tuple(np.concatenate(x) for x in zip(*places, strict=True)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _codes(words: list[str], columns: int) -> np.ndarray:
    """Code points of the words, 0 behind their ends."""
    out = np.zeros((len(words), columns), np.uint32)
    for length in {len(w) for w in words}:
        rows = [k for k, w in enumerate(words) if len(w) == length]
        out[rows, :length] = np.frombuffer("".join(words[k] for k in rows).encode("utf-32-le"), np.uint32).reshape(-1, length)
    return out


def _near_in_tile(part: pa.Table) -> pa.Table:
    """Of each word of a tile the number of its near words in it, and the most frequent of them (the least of equal ones)."""
    part = part.combine_chunks()
    words = part["word"].to_pylist()
    names = sorted(set(words))
    number = {w: k for k, w in enumerate(names)}
    word = np.array([number[w] for w in words], np.int64)
    size = np.array([len(w) for w in names], np.int64)[word]
    n, short, key, front, is_asked, is_held = (part[c].to_numpy() for c in ("n", "short", "key", "front", "asked", "held"))
    pairs = []
    for length in np.unique(short).tolist():
        asked = np.nonzero((short == length) & is_asked & (size == length))[0]
        held = np.nonzero((short == length) & is_held)[0]
        if not len(asked) or not len(held):
            continue
        codes, other = _codes([words[k] for k in asked], length + 1), _codes([words[k] for k in held], length + 1)
        i, j = one_apart(codes[:, :length], other, size[held] > length)
        a, b = asked[i], held[j]
        # a pair counts in one place: under its first half if it is shared, else under its last half
        good = key[a] == key[b]
        good &= front[a] | (codes[i, : length // 2] != other[j, : length // 2]).any(axis=1)
        a, b = a[good], b[good]
        # pairs of equal length are met in both orders, others in one
        back = size[b] > length
        pairs += [(word[a], word[b], n[b]), (word[b[back]], word[a[back]], n[a[back]])]
    own, near, count = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((near, -count, own))
    own, near, count = own[order], near[order], count[order]
    heads = np.nonzero(np.append(True, own[1:] != own[:-1]))[0] if len(own) else np.zeros(0, np.int64)
    columns = [pa.array([names[k] for k in own[heads]], pa.string()), pa.array(np.diff(np.append(heads, len(own)))), pa.array(count[heads]), pa.array([names[k] for k in near[heads]], pa.string())]
    return pa.table(columns, names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, n, n_near, best_n, best) for all of (word, n): the number of words one letter apart and the most frequent of them.

    A pair one letter apart, the shorter word of L letters, shares the first L div 2 letters or the
    last L - L div 2. So each word gets four keys: both halves for its own length, and for a letter less.
    Rows with one key that exceed a tile are dealt to squares of two tiles, all others by their key to
    tiles of about that size; what a square finds is summed up before it leaves."""
    total = words.count()
    length = F.char_length("word")
    ends = [F.struct((length - F.lit(d)).alias("short"), F.lit(front).alias("front")) for d in (0, 1) for front in (True, False)]
    rows = words.select("word", "n", F.explode(F.array(*ends)).alias("e")).select("word", "n", "e.*").where(F.col("short") >= LEAST_LENGTH)
    half = F.expr("if(front, left(word, short div 2), right(word, short - short div 2))")
    keyed = save(rows.withColumn("key", F.xxhash64("short", "front", half)), "keys")
    hot = save(keyed.groupBy("key").count().where(F.col("count") > tile).select("key", F.ceil(F.col("count") / tile).alias("tiles")), "hot_keys")
    tiles = max(1, -(-4 * total // tile))
    cool = keyed.join(hot, "key", "left_anti").select(*keyed.columns, F.lit(True).alias("asked"), F.lit(True).alias("held"), F.pmod("key", F.lit(tiles)).alias("x"), F.lit(-1).cast("long").alias("y"))
    dealt = keyed.join(hot, "key").withColumn("own", F.pmod(F.xxhash64("word"), F.col("tiles")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    # the square of a word with itself has it once, as asked and as held
    as_asked = dealt.where(F.char_length("word") == F.col("short")).select(*keyed.columns, F.lit(True).alias("asked"), (F.col("own") == F.col("other")).alias("held"), F.xxhash64("key", "own").alias("x"), F.col("other").alias("y"))
    as_held = dealt.where((F.char_length("word") > F.col("short")) | (F.col("own") != F.col("other"))).select(*keyed.columns, F.lit(False).alias("asked"), F.lit(True).alias("held"), F.xxhash64("key", "other").alias("x"), F.col("own").alias("y"))
    found = cool.union(as_asked).union(as_held).groupBy("x", "y").applyInArrow(_near_in_tile, "word string, n_near long, best_n long, best string")
    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<less:bigint,best:string>").alias("top"))
    some = found.select("word", F.lit(None).cast("long").alias("n"), "n_near", F.struct((-F.col("best_n")).alias("less"), "best").alias("top"))
    grouped = none.union(some).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("top").alias("top"))
    return grouped.select("word", "n", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms of (word, form) lead to; each round doubles the steps taken.

    A form is TIMES as frequent as its word, so there are no circles and few rounds."""
    now = save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = save(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words of every whole text of (doc_id, text).

    Two words are near if one inserted, deleted or replaced code point makes them equal. A word's form
    is its most frequent near word (the first in code-point order of equal ones) if that occurs TIMES as
    often as the word, else null; its root is the last of the chain of forms, itself without one. An
    empty table has no words. Other columns are not read.

    Counts, keys and results are shuffled by word or key; a task holds a square of two tiles."""
    words = save(occurrences(docs), "words")
    counted = near_words(words, tile)
    form = F.col("best_n") >= TIMES * F.col("n")
    judged = save(counted.select("word", "n", "n_near", F.when(form, F.col("best")).alias("form"), F.when(form, F.col("best_n")).alias("form_n")), "forms")
    roots = _roots(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
