"""Quality classifier: random-indexing word vectors, pooled, under a two-layer network.

Random indexing: every word has a fixed sparse random vector (two entries of +1
or -1 at places given by its hash). A word's vector is the sum of the random
vectors of its neighbours, two on each side, over all documents. Words are kept
in a fixed number of hash buckets, once by the whole word and once by its last
three bytes, so that rare words count through their endings. The sums are whole
numbers: they do not depend on the order of tasks.

A document is the mean and the mean square of its words' unit vectors, frequent
words weighing less. A network of two layers is trained in numpy on at most
``rows`` labelled rows; its probabilities are calibrated by a temperature on rows
left out of training. Only the text is an input of a score.

Edge cases: a null text counts as empty; a text without words has a zero vector
and the score that the network gives it. Ids labelled both ways and null labels
are not learned from. Without rows of both labels every document gets the share
of good rows (0.5 without any). Every input row gives one output row; repeated
rows get equal scores; a null id counts as held out for none of the folds.
Columns other than id and text are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotledger.llm.words import Words, as_bytes, chunks, mix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD_BUCKETS, ENDING_BUCKETS = 1 << 14, 1 << 12
DIMENSIONS = 48
ROWS = WORD_BUCKETS + ENDING_BUCKETS
BLOCK = 512  # buckets that are summed together
CHUNK = 1 << 20
WIDTH = 4 * DIMENSIONS  # of a pooled document


def _units(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, bucket of its ending, and the word's hash."""
    hashes = words.hashes()
    if not len(hashes):
        return np.empty(0, np.int64), np.empty(0, np.int64), hashes
    tails = np.frombuffer(np.array([w[-3:] for w in words.flat], "S4").tobytes(), "<u4").astype(np.uint64)
    whole = (mix(hashes) % np.uint64(WORD_BUCKETS)).astype(np.int64)
    ending = (mix(tails) % np.uint64(ENDING_BUCKETS)).astype(np.int64) + WORD_BUCKETS
    return whole, ending, hashes


def add_contexts(words: Words, sums: np.ndarray) -> None:
    """Add the random vectors of every word's neighbours to its buckets; the last column counts."""
    whole, ending, hashes = _units(words)
    n = len(hashes)
    width = DIMENSIONS + 1
    document = words.documents()
    flat = sums.reshape(-1)
    for units in (whole, ending):
        flat += np.bincount(units * width + DIMENSIONS, minlength=len(flat)).astype(np.int64)
    salted = [mix(hashes + np.uint64(s)) for s in (11, 23)]
    places = [(x % np.uint64(DIMENSIONS)).astype(np.int64) for x in salted]
    signs = [np.where(x >> np.uint64(63), 1.0, -1.0) for x in salted]
    for distance in (1, 2):
        if n <= distance:
            break
        same = document[distance:] == document[:-distance]
        first, second = np.flatnonzero(same), np.flatnonzero(same) + distance
        for at, other in ((first, second), (second, first)):
            for units in (whole, ending):
                base = units[at] * width
                for place, sign in zip(places, signs, strict=True):
                    flat += np.bincount(base + place[other], sign[other], len(flat)).astype(np.int64)


def _context_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums, used = np.zeros((ROWS, DIMENSIONS + 1), np.int64), False
    for batch in batches:
        blobs = as_bytes(batch["text"])
        for start, end in chunks(blobs):
            add_contexts(Words(blobs[start:end]), sums)
            used = True
    if used:
        blocks = sums.astype("<i8").reshape(ROWS // BLOCK, -1)
        yield pa.RecordBatch.from_pydict(
            {
                "block": pa.array(np.arange(len(blocks), dtype=np.int32)),
                "sums": pa.array([b.tobytes() for b in blocks], pa.binary()),
            }
        )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, block = np.zeros(BLOCK * (DIMENSIONS + 1), np.int64), 0
    for batch in batches:
        block = batch["block"][0].as_py()
        for blob in batch["sums"].to_pylist():
            total += np.frombuffer(blob, "<i8")
    yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "sums": [total.tobytes()]})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Weighted unit vector of each bucket, from all documents; a table of fixed size."""
    text = docs.select(F.col("text").cast("string").alias("text"))
    added = (
        text.mapInArrow(_context_blocks, "block int, sums binary")
        .groupBy("block")
        .applyInArrow(_added, "block int, sums binary")
    )
    sums = np.zeros((ROWS // BLOCK, BLOCK * (DIMENSIONS + 1)), np.int64)
    for row in added.collect():  # ROWS x (DIMENSIONS + 1) numbers, whatever the input
        sums[row["block"]] = np.frombuffer(row["sums"], "<i8")
    sums = sums.reshape(ROWS, DIMENSIONS + 1)
    counts, vectors = sums[:, DIMENSIONS].astype(np.float64), sums[:, :DIMENSIONS].astype(np.float64)
    # What all contexts have in common says nothing about a word.
    for part in (slice(0, WORD_BUCKETS), slice(WORD_BUCKETS, ROWS)):
        share = counts[part] / max(counts[part].sum(), 1)
        vectors[part] -= np.outer(counts[part], vectors[part].sum(axis=0) / max(counts[part].sum(), 1))
        size = np.linalg.norm(vectors[part], axis=1, keepdims=True)
        vectors[part] /= np.maximum(size, 1e-9)
        vectors[part] *= (1e-3 / (1e-3 + share))[:, None]
    return vectors.astype(np.float32)


def pooled(blobs: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Mean and mean square of the words' vectors of each text."""
    out = np.zeros((len(blobs), WIDTH), np.float32)
    for start, end in chunks(blobs, CHUNK):
        words = Words(blobs[start:end])
        full = np.flatnonzero(words.counts)
        if not len(full):
            continue
        whole, ending, _ = _units(words)
        n = words.counts[full, None]
        for i, units in enumerate((whole, ending)):
            taken = vectors[units]
            left = 2 * i * DIMENSIONS
            rows = start + full
            begin = words.starts[full]
            out[rows, left : left + DIMENSIONS] = np.add.reduceat(taken, begin, axis=0) / n
            np.square(taken, out=taken)
            out[rows, left + DIMENSIONS : left + 2 * DIMENSIONS] = np.add.reduceat(taken, begin, axis=0) / n
    return out


@dataclass
class Network:
    """Two layers over standardised inputs; ``temperature`` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def constant(share: float, width: int = WIDTH) -> Network:
    logit = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), logit)


def train(
    x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-3, seed: int = 5
) -> Network:
    """Adam on the cross entropy of four fifths of the rows; the temperature on the rest."""
    if len(y) < 10 or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5, x.shape[1] if x.ndim == 2 else WIDTH)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, own = order[: len(y) // 5], order[len(y) // 5 :]
    x = x.astype(np.float64)
    mean, scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-6
    z = (x - mean) / scale
    w = [
        rng.normal(0, np.sqrt(2 / z.shape[1]), (z.shape[1], hidden)),
        np.zeros(hidden),
        rng.normal(0, np.sqrt(1 / hidden), hidden),
        np.zeros(1),
    ]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(own), max(1, len(own) // 256)):
            a = np.maximum(z[batch] @ w[0] + w[1], 0)
            p = 1 / (1 + np.exp(-np.clip(a @ w[2] + w[3], -30, 30)))
            d = (p - y[batch]) / len(batch)
            back = np.outer(d, w[2]) * (a > 0)
            slopes = [z[batch].T @ back + decay * w[0], back.sum(axis=0), a.T @ d + decay * w[2], np.array([d.sum()])]
            t += 1
            for i, g in enumerate(slopes):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, scale, w[0], w[1], w[2], float(w[3][0]))
    logits, truth = net.logits(x[held]), y[held]

    def loss(temperature: float) -> float:
        s = np.clip(logits / temperature, -30, 30)
        return float(np.mean(np.logaddexp(0, s) - truth * s))

    net.temperature = min(np.geomspace(0.25, 8, 61), key=loss)
    return net


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether the row is kept from learning: crc32 of the id as text is 0 by the number of folds."""
    rest = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))
    return F.coalesce(rest == 0, F.lit(False))


def fit_network(
    docs: DataFrame, labels: DataFrame, vectors: np.ndarray, rows: int = 20_000, seed: int = 5
) -> Network:
    """Network from at most ``rows`` labelled ids (those with the least hashes) that are not held out."""
    marks = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
        .where("low = high")
        .select("doc_id", F.col("low").alias("quality"))
    )
    ids = marks.orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)), "doc_id").limit(rows)
    pool = F.arrow_udf(_pooled(vectors), "array<float>")
    found = (
        docs.select("doc_id", F.col("text").cast("string").alias("text"))
        .join(F.broadcast(ids), "doc_id")  # at most ``rows`` ids
        .select("doc_id", "quality", F.xxhash64("text").alias("h"), pool("text").alias("x"))
        .orderBy("doc_id", "h")
        .limit(2 * rows)
        .toArrow()
    )
    if not found.num_rows:
        return constant(0.5)
    x = found["x"].combine_chunks().flatten().to_numpy().reshape(found.num_rows, -1)
    return train(x, found["quality"].to_numpy().astype(np.float64))


def _pooled(vectors: np.ndarray) -> Callable:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(list(pooled(as_bytes(texts), vectors)), pa.list_(pa.float32()))

    return run


def score(text: Column, vectors: np.ndarray, network: Network) -> Column:
    """Probability that a text is good."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(network.scores(pooled(as_bytes(texts), vectors)), pa.float64())

    return F.arrow_udf(run, "double")(text)


def score_documents(
    docs: DataFrame, labels: DataFrame, rows: int = 20_000, threshold: float = 0.3
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    vectors = word_vectors(docs)
    network = fit_network(docs, labels, vectors, rows)
    scored = docs.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        score(F.col("text").cast("string"), vectors, network).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
