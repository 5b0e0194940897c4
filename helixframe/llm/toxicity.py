"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

The features are the distinct 4- to 7-grams of the lower-cased text's
characters, with one space at either end and for each run of white space, so
that a gram can be tied to a word's start; they are hashed to ``BUCKETS``
buckets.  Over a bounded sample of labelled
rows, each bucket's smoothed share of the toxic and of the other documents
gives a log-count ratio; the ``FEATURES`` buckets whose shares differ most
significantly stay, a document holds the ratios of those it has, and logistic
regression weighs them.

The sample is bounded by ``fit_rows``; the driver receives a fixed number of
count tables and ``FEATURES`` bits per row.  The model has a fixed size, so it
can be broadcast, and every document is scored on its whole text.

Edge cases: bytes that are not UTF-8 count as U+FFFD.  A null or empty text has no features and gets the score of the
intercept.  Labels that are null are left out; without labels of both classes
every score is the share of label 1 (0 without any).  Repeated rows repeat; in the
labelled sample an identifier counts once.  An
empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import in_slices, labelled_texts, partial_sums, settle, summed, text_or_empty

BITS = 20
BUCKETS = 1 << BITS
ORDERS = (4, 5, 6, 7)
FEATURES = 2048
SMOOTHING = 0.5
#: Tasks that count over the labelled sample; each sends one table, however many partitions the sample has.
FIT_TASKS = 8
_CHUNK = 1 << 20


def gram_buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of the text's n-grams, repeats included, in arrays of bounded length."""
    line = " ".join(text.lower().split())
    points = np.frombuffer(f" {line} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    longest = max(ORDERS)
    for at in range(0, len(points), _CHUNK):
        part = points[at : at + _CHUNK + longest - 1]
        h = part.copy()
        for n in range(2, longest + 1):
            if len(part) < n:
                break
            h = h[:-1] * np.uint32(0x01000193) + part[n - 1 :]
            if n in ORDERS:
                mixed = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
                yield ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS))[:_CHUNK]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either class that have each bucket."""
    table, seen = np.zeros((2, BUCKETS), dtype=np.int32), np.zeros(BUCKETS, dtype=bool)
    for batch in in_slices(batches):
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            for grams in gram_buckets(text):
                seen[grams] = True
            has = np.flatnonzero(seen)
            table[label, has] += 1
            seen[has] = False
    yield from partial_sums(table)


@dataclass
class ToxicityModel:
    places: np.ndarray  # bucket -> feature number + 1, or 0
    weights: np.ndarray  # coefficient times ratio, by feature
    intercept: float

    def features(self, text: str) -> np.ndarray:
        parts = []
        for grams in gram_buckets(text):
            hits = self.places[grams]
            parts.append(hits[hits > 0])
        return np.unique(np.concatenate(parts)).astype(np.int64) - 1 if parts else np.empty(0, dtype=np.int64)

    def score(self, text: str) -> float:
        logit = self.intercept + float(self.weights[self.features(text)].sum())
        return float(1 / (1 + np.exp(-min(500.0, max(-500.0, logit)))))


def choose_features(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets whose shares differ most significantly, and their log-count ratios."""
    share = (clean + toxic) / (n_clean + n_toxic)
    sd = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_clean + 1 / n_toxic))
    z = np.abs(toxic / n_toxic - clean / n_clean) / sd
    best = np.argsort(-z, kind="stable")[:FEATURES]
    best = np.sort(best[z[best] > 0])
    p, q = (toxic[best] + SMOOTHING) / (n_toxic + 2 * SMOOTHING), (clean[best] + SMOOTHING) / (n_clean + 2 * SMOOTHING)
    return best, np.log(p / q)


def logistic(x: np.ndarray, ratios: np.ndarray, y: np.ndarray, rounds: int = 300, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights (coefficient times ratio) and intercept; accelerated gradient steps on 0/1 rows times ratios."""
    n = len(y)
    scaled = x.astype(np.float32)
    scaled *= ratios.astype(np.float32)
    vector = np.ones(scaled.shape[1], dtype=np.float32)
    for _ in range(20):  # power iteration: the curvature sets the step
        vector = scaled.T @ (scaled @ vector)
        vector /= max(float(np.linalg.norm(vector)), 1e-12)
    curvature = 0.25 * (float(np.linalg.norm(scaled @ vector)) ** 2 / n + 1.0) * 1.2 + ridge
    w = np.zeros(scaled.shape[1] + 1)
    w[-1] = np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6))
    ahead, previous, t = w.copy(), w.copy(), 1.0
    for _ in range(rounds):
        logit = scaled @ ahead[:-1].astype(np.float32) + ahead[-1]
        error = (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - y) / n
        grad = np.append(scaled.T @ error.astype(np.float32) + ridge * ahead[:-1], error.sum())
        w = ahead - grad / curvature
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, previous = w + (before - 1) / t * (w - previous), w
    return w[:-1] * ratios, float(w[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, fold: Column, fit_rows: int = 16000) -> ToxicityModel | float:
    """The model, or a constant score where the labelled rows hold one class at most."""
    chosen = labelled_texts(docs, labels, "toxic", fold, fit_rows)
    sample = settle(chosen.select("doc_id", "text", "label").repartition(FIT_TASKS, "doc_id"))
    by_label = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_clean, n_toxic = by_label.get(0, 0), by_label.get(1, 0)
    if not n_clean or not n_toxic:
        return 1.0 if n_toxic else 0.0
    partials = sample.select("text", "label").coalesce(FIT_TASKS).mapInArrow(_counts, "slice int, part binary")
    counts = summed(partials, np.int32).reshape(2, BUCKETS)
    best, ratios = choose_features(counts[0], counts[1], n_clean, n_toxic)
    places = np.zeros(BUCKETS, dtype=np.uint16)
    places[best] = np.arange(1, len(best) + 1)
    shared = docs.sparkSession.sparkContext.broadcast(ToxicityModel(places, np.zeros(len(best)), 0.0))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(shared.value.weights)
        for batch in in_slices(batches):
            made = []
            for text in batch.column("text").to_pylist():
                row = np.zeros(size, dtype=bool)
                row[shared.value.features(text)] = True
                made.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(made, pa.binary())], ["doc_id", "label", "x"])

    made = sample.select("doc_id", "label", "text").mapInArrow(bits, "doc_id long, label int, x binary").collect()
    shared.destroy()
    made.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))  # the same order on every run
    x = np.unpackbits(np.stack([np.frombuffer(r["x"], dtype=np.uint8) for r in made]), axis=1, count=len(best))
    weights, intercept = logistic(x, ratios, np.array([r["label"] for r in made], dtype=np.float64))
    return ToxicityModel(places, weights, intercept)


def score_toxicity(docs: DataFrame, model: ToxicityModel | float) -> DataFrame:
    """(doc_id, score) of every row."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    if isinstance(model, float):
        return source.select("doc_id", F.lit(model).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            made = [shared.value.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.float64())], ["doc_id", "score"])

    return source.mapInArrow(score, "doc_id long, score double")
