"""Operator 8: a quality classifier on random-indexing word vectors.

Pieces of a text are its words and its runs of marks, as they are written. They are hashed into a fixed number of
buckets. Each bucket has a sparse random index vector; a bucket's word vector is the sum of the index vectors that stand
right before it and right after it anywhere in the corpus, turned by one place to the one side and to the other, so that
order counts. It is gathered from all documents, in partial sums that are added by bucket. A document is pooled from its
pieces' unit vectors alone: their mean, their variance, and the mean product of neighbours. A two-layer network learns
labels from a bounded sample of labelled documents, and a temperature fitted on a part kept back makes its scores
probabilities.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import giving_back, hash_share, held_by_worker, partitions, whole_row

BUCKETS, WIDTH, NONZERO, GROUPS = 1 << 15, 64, 4, 64
POOLED = 3 * WIDTH
MOST_WORDS = 200_000
PIECE = re.compile(r"\w+|[^\w\s]+")


class _Words(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) % BUCKETS
        if len(self) < MOST_WORDS:
            self[word] = value
        return value


def _words() -> _Words:
    return held_by_worker("quality words", _Words)


def numbers(text: str | None) -> np.ndarray:
    """Buckets of the pieces of a whole text, in order."""
    words = PIECE.findall(text or "")
    return np.fromiter(map(_words().__getitem__, words), np.int64, len(words))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the places and signs of its index vector's non-zero elements."""
    rng = np.random.default_rng(3)
    return rng.integers(0, WIDTH, (BUCKETS, NONZERO)), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums: for each group of buckets their word vectors, as one row of 32-bit floats."""
    place, sign = index_vectors()
    total, held = np.zeros(BUCKETS * WIDTH), []

    def added() -> None:
        nonlocal total
        left = np.concatenate([x[:-1] for x in held])
        right = np.concatenate([x[1:] for x in held])
        for word, beside, turn in ((left, right, 1), (right, left, WIDTH - 1)):
            for k in range(NONZERO):
                total += np.bincount(word * WIDTH + (place[beside, k] + turn) % WIDTH, sign[beside, k], BUCKETS * WIDTH)
        held.clear()

    some = 0
    for batch in batches:
        for text in batch.column("text"):
            held.append(numbers(text.as_py()))
            some += len(held[-1])
            if some > 1_000_000:
                added()
                some = 0
    if held:
        added()
    rows = total.astype(np.float32).reshape(GROUPS, -1)
    full = np.flatnonzero(rows.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([rows[g].tobytes() for g in full], pa.binary())], ["part", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for g, data in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            sums[g] = sums.get(g, 0.0) + np.frombuffer(data, np.float32).astype(np.float64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in sums.values()], pa.binary())], ["part", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all buckets, zero for those without neighbours, from the whole of docs (text).

    Partial sums meet by group of buckets. The result has BUCKETS x WIDTH elements whatever the corpus.
    """
    parts = docs.select("text").mapInArrow(giving_back(_gather), "part int, sums binary").repartition(min(GROUPS, partitions(docs.sparkSession)), "part")
    found = parts.mapInArrow(_added, "part int, sums binary").toArrow()
    rows = np.zeros((GROUPS, BUCKETS // GROUPS, WIDTH), np.float32)
    for g, data in zip(found.column("part").to_pylist(), found.column("sums").to_pylist(), strict=True):
        rows[g] = np.frombuffer(data, np.float32).reshape(-1, WIDTH)
    rows = rows.reshape(BUCKETS, WIDTH)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-6)


def features(text: str | None, vectors: np.ndarray, at_once: int = 1 << 15) -> np.ndarray:
    """Mean and variance of the vectors of a document's pieces, and the mean product of neighbours; zeros without pieces."""
    bucket = numbers(text)
    n = len(bucket)
    if not n:
        return np.zeros(POOLED, np.float32)
    total = np.zeros((3, WIDTH))
    for at in range(0, n, at_once):
        x = vectors[bucket[at : at + at_once + 1]]
        own = x[:at_once]
        total[0] += own.sum(0)
        total[1] += np.einsum("ij,ij->j", own, own)
        total[2] += np.einsum("ij,ij->j", x[1:], x[:-1])
    mean, square, beside = total / n
    return np.concatenate([mean, square - mean * mean, beside]).astype(np.float32)


@dataclass
class Network:
    """One hidden layer of tanh units and a logistic output, at a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _trained(x: np.ndarray, y: np.ndarray, hidden: int, rounds: int, decay: float) -> Network:
    rng = np.random.default_rng(1)
    net = Network(x.mean(0), x.std(0) + 1e-3, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    z = (x - net.mean) / net.scale
    names = ("w1", "b1", "w2", "b2")
    first, second, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for _ in range(rounds):
        for rows in np.array_split(rng.permutation(len(z)), max(1, len(z) // 256)):
            h = np.tanh(z[rows] @ net.w1 + net.b1)
            error = (1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -30, 30))) - y[rows]) / len(rows)
            back = error[:, None] * net.w2 * (1 - h * h)
            slope = {"w1": z[rows].T @ back + decay * net.w1, "b1": back.sum(0), "w2": h.T @ error + decay * net.w2, "b2": error.sum()}
            step += 1
            for k, g in slope.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                setattr(net, k, getattr(net, k) - 0.003 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))
    return net


def fitted(x: np.ndarray, y: np.ndarray, hidden: int = 64, rounds: int = 30, decay: float = 1e-4, least_steps: int = 1500) -> Network:
    """The network for features x and labels y; the temperature is the best of a grid on every fifth row, kept back.

    With labels of one kind only, or none, the score is (n_ones + 1) / (n + 2) for every document.
    """
    x, y = x.astype(np.float64), y.astype(np.float64)
    if len(set(y.tolist())) < 2 or len(y) < 10:
        share = (y.sum() + 1) / (len(y) + 2)
        width = x.shape[1]
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    kept = np.arange(len(y)) % 5 == 4
    rounds = max(rounds, math.ceil(least_steps / max(1, (~kept).sum() // 256)))
    net = _trained(x[~kept], y[~kept], hidden, rounds, decay)
    logits, truth = net.logits(x[kept]), y[kept]
    grid = np.geomspace(0.25, 8, 41)
    loss = [np.mean(np.logaddexp(0, logits / t) - truth * logits / t) for t in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


def _score(vectors: np.ndarray, net: Network) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([features(t.as_py(), vectors) for t in batch.column("text")])
                keep = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(net.scores(x.astype(np.float64)))], [*keep, "score"])

    return run


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def training_labels(labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, y) of about `most` labelled ids at most, of the folds that are not held out.

    A null label is none. An id with several labels has their mean; ids are chosen by a hash.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(fold(F.col("doc_id")) != 0)
    known = known.groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    return known.where(hash_share(known.count(), most, "doc_id", seed="train"))


def _featured(vectors: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py(), vectors).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(x, pa.binary())], ["doc_id", "y", "x"])

    return run


def quality_model(docs: DataFrame, labels: DataFrame, most_labels: int = 20_000) -> tuple[np.ndarray, Network]:
    """Word vectors from all of docs, and a network from about most_labels labelled documents at most.

    The labels chosen are at most about most_labels rows of two numbers, so they are broadcast and no text is shuffled.
    An id that stands on several rows gives one training row, the least of their features.
    """
    vectors = word_vectors(docs)
    known = F.broadcast(training_labels(labels, most_labels))
    rows = docs.select("doc_id", "text").where("doc_id IS NOT NULL").join(known, "doc_id").select("doc_id", "text", "y")
    rows = rows.mapInArrow(giving_back(_featured(vectors)), "doc_id bigint, y double, x binary")
    found = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).toArrow()
    x = np.array([np.frombuffer(b, np.float32) for b in found.column("x").to_pylist()]).reshape(-1, POOLED)
    order = np.argsort(found.column("doc_id").to_numpy())
    return vectors, fitted(x[order], found.column("y").to_numpy()[order])


def scored(docs: DataFrame, labels: DataFrame, most_labels: int = 20_000) -> DataFrame:
    """docs' rows as (row, score): the whole row and how likely its text is of good quality, by its text alone.

    A null or empty text has the score of no words. Rows that repeat a doc_id are scored each for itself. An empty table
    gives an empty result; an empty or missing set of labels gives every document the same score.
    """
    vectors, net = quality_model(docs, labels, most_labels)
    own = docs.select(whole_row(docs))
    with_text = own.select("row", F.col("row.text").alias("text"))
    schema = StructType([own.schema["row"], StructField("score", DoubleType())])
    return with_text.mapInArrow(giving_back(_score(vectors, net)), schema)
