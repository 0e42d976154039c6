"""Quality classifier: hashed vectors of words and of character n-grams, averaged for each document, softmax output."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.llm.shared import BYTES, mix64, pieces, save, trim, word_hashes

__all__ = ["Model", "score", "train"]

#: Vectors of the table that words and n-grams are hashed to, and their length.
BUCKETS, DIMENSIONS = 1 << 15, 16
GRAMS = (3, 4)
#: Labelled rows that are learned from, at most: those with the least hashes of their ids.
LABELLED_ROWS = 6000
EPOCHS, RATE = 6, 0.4
THRESHOLD = 0.7
SEED = 20_240_313
#: Characters that are hashed at a time.
_AT_ONCE = 1 << 18

_WORDS = BYTES.copy()
_WORDS[[0x20, *range(0x09, 0x0E)]] = 0
_PLACES = mix64(np.arange(1, 1 + max(GRAMS), dtype=np.uint64) + np.uint64(SEED)) | np.uint64(1)
#: The bucket of words that repeat the one before, and how often such a word counts there.
_AGAIN, WEIGHT = 0, 8
_SHIFT = np.uint64(64 - (BUCKETS - 1).bit_length())


def _buckets(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all words and character n-grams of a text, in parts.

    Case and punctuation count; a run of white space is one space, and so are both ends. A word that
    repeats the one before it counts as that, too, whatever word it is."""
    words = word_hashes([text], _WORDS)[0]
    yield (words >> _SHIFT).astype(np.int64)
    yield np.full(WEIGHT * int((words[1:] == words[:-1]).sum()), _AGAIN)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (points == 0x20) | (points >= 0x09) & (points <= 0x0D)
    points = np.concatenate([[0x20], np.where(blank, 0x20, points), [0x20]]).astype(np.uint64)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 0x20) | (points[:-1] != 0x20)
    points = points[keep] + np.uint64(1)
    for a in range(0, len(points), _AT_ONCE):
        for size in GRAMS:
            part = points[a : a + _AT_ONCE + size - 1]
            if len(part) < size:
                continue
            total = np.full(len(part) - size + 1, size, np.uint64)
            with np.errstate(over="ignore"):
                for k in range(size):
                    total += part[k : k + len(total)] * _PLACES[k]
                    total ^= total >> np.uint64(29)
                total *= _PLACES[-1]
            yield (total >> _SHIFT).astype(np.int64)


def features(text: str | None) -> np.ndarray:
    """How often each bucket occurs in the whole text; none for a text that is null, empty or white space."""
    counts = np.zeros(BUCKETS, np.int64)
    if text and text.strip(" \t\n\v\f\r"):
        for part in _buckets(text):
            counts += np.bincount(part, minlength=BUCKETS)
    return counts


@dataclass
class Model:
    """What is learned: a vector for each bucket, and a weight vector and a bias for each class."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def table(self) -> tuple[np.ndarray, float]:
        """Each bucket's part of the log-odds of class 1, and the bias: the mean of a document's vectors times
        the weights is the mean of these numbers."""
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float64), float(self.bias[1] - self.bias[0])


def learn(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """Stochastic gradient descent over (buckets, counts) of documents and their labels; the same rows give the same model."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    share = np.bincount(labels, minlength=2) / max(1, len(labels))
    bias[:] = np.log(np.maximum(share, 1e-3))
    weights[:] = rng.uniform(-0.5, 0.5, weights.shape)
    squares = np.full(BUCKETS, 1e-8, np.float32)
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            spots, counts = rows[k]
            part = (counts / max(1.0, float(counts.sum()))).astype(np.float32)
            mean = part @ vectors[spots]
            logit = mean @ weights + bias
            odds = np.exp(logit - logit.max())
            error = odds / odds.sum()
            error[labels[k]] -= 1
            rate = RATE * (1 - done / steps)
            done += 1
            back = weights @ error
            # a vector's steps shrink with the gradients that it has had
            squares[spots] += part**2 * float(back @ back)
            vectors[spots] -= (rate * part / np.sqrt(squares[spots]))[:, None] * back
            weights -= 0.1 * rate * np.outer(mean, error)
            bias -= 0.02 * rate * error
    return Model(vectors, weights, bias)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text modulo 4 is 2; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, label, buckets, counts): whole texts of at most `rows` labelled documents that are not held out.

    Labels other than 0 and 1, and ids that are null, teach nothing. The ids are chosen by their
    hashes, so that the choice is the same in every run; only ids and labels are sorted for it."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").where(~held_out()).distinct()
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("doc_id").cast("long").alias("doc_id"), "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            buckets, counts = [], []
            for text in batch.column(0).to_pylist():
                n = features(text)
                there = np.nonzero(n)[0]
                buckets.append(there.astype(np.uint16).tobytes())
                counts.append(n[there].astype(np.float32).tobytes())
            yield pa.record_batch([batch.column(1), batch.column(2), pa.array(buckets, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "label", "buckets", "counts"])

    return texts.mapInArrow(run, "doc_id long, label int, buckets binary, counts binary")


def train(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Model | None:
    """Learns from at most `rows` labelled documents (see sample); None where nothing is labelled with both classes.

    One task learns, as the rows are bounded: about 30 KB each at most; the driver gets the model, 2 MB."""
    shown = save(sample(docs, labels, rows), "labelled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for doc_id, label, buckets, counts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                held.append((doc_id, label, np.frombuffer(buckets, np.uint16).astype(np.int32), np.frombuffer(counts, np.float32)))
        held.sort(key=lambda r: (r[0], r[1], r[2].tobytes(), r[3].tobytes()))
        target = np.array([r[1] for r in held], np.int64)
        if len(np.unique(target)) == 2:
            model = learn([(r[2], r[3]) for r in held], target)
            yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in (model.vectors, model.weights, model.bias)], names=["vectors", "weights", "bias"])
        trim()

    made = shown.coalesce(1).mapInArrow(run, "vectors binary, weights binary, bias binary").collect()
    if not made:
        return None
    vectors, weights, bias = (np.frombuffer(x, np.float32) for x in made[0])
    return Model(vectors.reshape(BUCKETS, DIMENSIONS), weights.reshape(DIMENSIONS, 2), bias)


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs by its whole text alone.

    The score is the softmax probability of label 1; a text that is null, empty or white space has no
    vectors and the score of the biases; without a model all scores are 0.5. Repeated rows are judged alike; other
    columns are not read. One map; the model that is broadcast has a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model.table() if model else (np.zeros(BUCKETS), 0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = shared.value
        for batch in pieces(batches):
            scores = np.empty(batch.num_rows)
            for k, text in enumerate(batch.column(0).to_pylist()):
                total, n = 0.0, 0
                if text and text.strip(" \t\n\v\f\r"):
                    for part in _buckets(text):
                        total += float(table[part].sum())
                        n += len(part)
                scores[k] = 1 / (1 + np.exp(-(total / max(1, n) + bias)))
            yield pa.record_batch([batch.column(1), batch.column(2), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("text", "doc_id", held_out().alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def judge(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """Trains on the labelled rows that are not held out and scores all documents (see train and score)."""
    return score(docs, train(docs, labels, rows))
