"""Quality classifier: random-indexing word vectors, pooled, under a two-layer network.

Every token bucket has a sparse ternary index vector from a seeded generator;
a bucket's word vector is the sum of the index vectors of its neighbours up to
``REACH`` tokens away, over a bounded sample of labelled rows, scaled to unit
length.  A document is the mean of its tokens' vectors, the mean of its distinct
tokens' vectors, and four scalars about how often tokens repeat and how long the
text is.  A two-layer network (numpy) turns that into a logit, and a temperature
fitted on rows kept back from training turns the logit into a probability.

The sample is bounded by ``fit_rows``; what it sends to the driver is a fixed
number of partial sums and one short vector per row.  The model has a fixed
size, so it can be broadcast, and every document is scored on its whole text.

Edge cases: a null or empty text has zero vectors and gets the score that the
network gives these; bytes that are not UTF-8 count as U+FFFD.  Labels that are null are left out; without labels of both
classes every score is the share of label 1 (0.5 without any), and
``keep_quality`` keeps every row, as such a score tells no document from
another.  Repeated rows
repeat; in the labelled sample an identifier counts once.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import in_slices, labelled_texts, partial_sums, settle, summed, text_or_empty, texts_of

BUCKETS, WIDTH, NONZERO, REACH = 1 << 16, 32, 4, 2
HIDDEN, EPOCHS, BATCH = 32, 80, 256
#: Tasks that sum over the labelled sample; each sends one partial sum, however many partitions the sample has.
FIT_TASKS = 8
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|\n+|_+")
_CACHE_LIMIT = 200_000


class _Buckets(dict):
    """Token to bucket, remembered up to a limit."""

    def __missing__(self, token: str) -> int:
        if len(self) > _CACHE_LIMIT:
            self.clear()
        # Length and case are what an unseen word of an upper-case text shares with others like it.
        name = "\x01caps" if len(token) > 2 and token.isupper() else token.lower()
        bucket = self[token] = zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS
        return bucket


def _buckets(text: str, cache: _Buckets) -> np.ndarray:
    tokens = _TOKEN.findall(text)
    return np.fromiter(map(cache.__getitem__, tokens), dtype=np.int64, count=len(tokens))


def _index_vectors(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the non-zero entries of every bucket's index vector."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, WIDTH, (BUCKETS, NONZERO)), rng.choice((-1.0, 1.0), (BUCKETS, NONZERO))


def _context_sums(seed: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions, signs = _index_vectors(seed)
        total, cache = np.zeros(BUCKETS * WIDTH, dtype=np.float64), _Buckets()
        for batch in in_slices(batches):
            for text in batch.column("text").to_pylist():
                ids = _buckets(text, cache)
                for k in range(1, REACH + 1):
                    for a, b in ((ids[:-k], ids[k:]), (ids[k:], ids[:-k])):
                        if len(a):
                            np.add.at(total, (a[:, None] * WIDTH + positions[b]).ravel(), signs[b].ravel())
        yield from partial_sums(total.astype(np.float32))

    return sums


def pooled(text: str, vectors: np.ndarray, cache: _Buckets) -> np.ndarray:
    ids = _buckets(text, cache)
    out = np.zeros(2 * WIDTH + 4, dtype=np.float32)
    if len(ids):
        once = np.unique(ids)
        out[:WIDTH] = vectors[ids].mean(axis=0)
        out[WIDTH : 2 * WIDTH] = vectors[once].mean(axis=0)
        out[2 * WIDTH :] = (np.log(len(ids)), np.log(len(once)), len(once) / len(ids), np.linalg.norm(out[:WIDTH]))
    return out


@dataclass
class QualityModel:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float

    def logits(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.mean) / self.scale
        return np.tanh(x @ self.first + self.first_bias) @ self.second + self.second_bias

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(features.astype(np.float64)) / self.temperature, -500, 500)))


def train_network(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, seed: int) -> QualityModel:
    """Adam on the logistic loss over four fifths of the rows; the temperature on the last fifth."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5 :]
    mean, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-6
    z = ((x - mean) / scale).astype(np.float64)
    params = [
        rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)),
        np.zeros(HIDDEN),
        rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
        np.zeros(1),
    ]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(EPOCHS):
        rng.shuffle(used)
        for at in range(0, len(used), BATCH):
            rows = used[at : at + BATCH]
            hidden = np.tanh(z[rows] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -500, 500)))
            error = (p - y[rows]) / len(rows)
            back = np.outer(error, params[2]) * (1 - hidden**2)
            grads = [z[rows].T @ back + 1e-4 * params[0], back.sum(axis=0), hidden.T @ error + 1e-4 * params[2], np.array([error.sum()])]
            step += 1
            for param, grad, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad**2 - v)
                param -= 0.005 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = QualityModel(vectors, mean, scale, params[0], params[1], params[2], float(params[3][0]), 1.0)
    if len(held):
        logits, truth = model.logits(x[held]), y[held]
        ones = truth.sum()
        # Smoothed targets keep the temperature away from zero where the kept-back rows are told apart without error.
        soft = np.where(truth == 1, (ones + 1) / (ones + 2), 1 / (len(truth) - ones + 2))
        loss = lambda t: (soft * np.logaddexp(0, -logits / t) + (1 - soft) * np.logaddexp(0, logits / t)).sum()
        model.temperature = float(min(np.geomspace(0.05, 20.0, 121), key=loss))
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, fold: Column, fit_rows: int = 8000, seed: int = 5) -> QualityModel | float:
    """The model, or a constant score where the labelled rows hold one class at most."""
    chosen = labelled_texts(docs, labels, "quality", fold, fit_rows)
    sample = settle(chosen.select("doc_id", "text", "label").repartition(FIT_TASKS, "doc_id"))
    partials = sample.select("text").coalesce(FIT_TASKS).mapInArrow(_context_sums(seed), "slice int, part binary")
    vectors = summed(partials, np.float32).astype(np.float64)
    vectors = vectors if len(vectors) else np.zeros(BUCKETS * WIDTH)
    vectors = vectors.reshape(BUCKETS, WIDTH)
    vectors = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Buckets()
        for batch in in_slices(batches):
            made = [pooled(t, shared.value, cache).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(made, pa.binary())], ["doc_id", "label", "x"])

    made = sample.select("doc_id", "label", "text").mapInArrow(features, "doc_id long, label int, x binary").collect()
    shared.destroy()
    made.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))  # the same order on every run
    y = np.array([r["label"] for r in made], dtype=np.float64)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    x = np.stack([np.frombuffer(r["x"], dtype=np.float32) for r in made]).astype(np.float64)
    return train_network(x, y, vectors, seed)


def score_quality(docs: DataFrame, model: QualityModel | float) -> DataFrame:
    """(doc_id, score) of every row."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    if isinstance(model, float):
        return source.select("doc_id", F.lit(model).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, m = _Buckets(), shared.value
        for batch in in_slices(batches):
            if batch.num_rows:
                x = np.stack([pooled(t, m.vectors, cache) for t in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(m.scores(x))], ["doc_id", "score"])

    return source.mapInArrow(score, "doc_id long, score double")


def keep_quality(docs: DataFrame, model: QualityModel | float, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with all their columns, without a shuffle; all of them under a constant score."""
    if isinstance(model, float):
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, m = _Buckets(), shared.value
        for batch in in_slices(batches):
            if batch.num_rows:
                x = np.stack([pooled(t, m.vectors, cache) for t in texts_of(batch.column("text"))])
                yield batch.filter(pa.array(m.scores(x) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
