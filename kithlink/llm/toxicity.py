"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of hashed n-grams of lower-cased code points, of several lengths. On a bounded labelled sample, each
feature gets its log-count ratio r = log of (its share in toxic texts / its share in others), smoothed; features with
a small ratio are set aside. A logistic regression is trained on the presence values times r, and the product of
weight and ratio is what a feature adds to a text's score.

``fit`` and ``score`` are the operator. Executors count the features of the sample, one vector of counts a task, and then give the driver
only those that are kept. Null or empty texts have no feature and score by the intercept alone; an empty or
one-sided sample gives a constant score; repeated rows are scored each and equal texts alike; texts, however long, stay whole; empty tables give empty
results; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithlink.llm import labelled, tokens

LENGTHS = (3, 4, 5, 6)
BITS = 20
THRESHOLD = 0.5
#: Tasks that count the sample's features: so many vectors of 2**BITS counts come to the driver.
COUNTERS = 8


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of lower-cased texts."""
    lower = [(t or "").lower() for t in texts]
    at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, lower), np.int64, len(lower)))))
    return np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32), at


def grams(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the distinct hashed n-grams of each row, ascending; with ``keep``, only of features it marks."""
    rows = len(offsets) - 1
    found = []
    h = np.zeros(len(data), np.uint32)
    for n in range(1, max(LENGTHS) + 1):
        if len(data) < n:
            break
        h = h[: len(data) - n + 1] * np.uint32(0x9E3779B1) + data[n - 1 :] + np.uint32(1)
        if n in LENGTHS:
            f = h ^ (h >> np.uint32(15))
            f = (f * np.uint32(0x85EBCA77) + np.uint32(n)) >> np.uint32(32 - BITS)
            at = np.arange(len(f)) if keep is None else np.flatnonzero(keep[f])
            row = np.searchsorted(offsets, at, "right") - 1
            inside = at + n <= offsets[row + 1]
            found.append(row[inside].astype(np.int64) << BITS | f[at[inside]])
    key = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return key >> BITS, key & (1 << BITS) - 1 if rows else key


def portions(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, code points, offsets) of runs of rows of about ``most`` characters; a longer row stands alone, whole."""
    for i, j, texts in tokens.portions(batch.column("text"), most):
        yield i, j, *code_points(texts)


@dataclass
class Linear:
    weight: np.ndarray  # of each feature, its ratio included
    keep: np.ndarray
    intercept: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, feature = grams(data, offsets, self.keep)
        z = np.bincount(row, self.weight[feature], len(offsets) - 1) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def ratios(seen: np.ndarray, toxic: np.ndarray, n: int, n_toxic: int, alpha: float = 1.0, least_ratio: float = 1.0, least_docs: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(log-count ratio, whether it is kept) of every feature, of how many texts and toxic texts it is in."""
    p, q = (toxic + alpha) / (n_toxic + alpha), (seen - toxic + alpha) / (n - n_toxic + alpha)
    ratio = np.log(p / q)
    return ratio, (seen >= least_docs) & (np.abs(ratio) >= least_ratio)


def train(at: np.ndarray, features: np.ndarray, labels: np.ndarray, ratio: np.ndarray, keep: np.ndarray, penalty: float = 2e-4, rounds: int = 150) -> Linear:
    """Row i has features[at[i]:at[i + 1]], all kept ones. Logistic regression by accelerated gradient steps; classes count alike."""
    y, sizes = np.asarray(labels, np.float64), np.diff(at)
    number = np.full(len(keep), -1, np.int32)
    number[keep] = np.arange(int(keep.sum()))
    column, r = number[features], ratio[keep]
    weight_of = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())

    def row_sums(values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0.0], np.cumsum(values[column])))[at])

    w, b, ahead, ahead_b, t = np.zeros(len(r)), 0.0, np.zeros(len(r)), 0.0, 1.0
    step = 4 / (np.sum(weight_of * (row_sums(r * r) + 1)) + penalty)
    for _ in range(rounds):
        z = row_sums(ahead * r) + ahead_b
        g = weight_of * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        slope = np.bincount(column, np.repeat(g, sizes), len(r)) * r
        new, new_b = ahead - step * (slope + penalty * ahead), ahead_b - step * g.sum()
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, ahead_b = new + (before - 1) / t * (new - w), new_b + (before - 1) / t * (new_b - b)
        w, b = new, new_b
    out = np.zeros(len(keep), np.float32)
    out[keep] = w * r
    return Linear(out, keep, float(b))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 8000) -> Linear:
    """Fit on at most ``most`` labelled documents (and the bytes that ``labelled.sample`` allows)."""
    size = 1 << BITS
    sampled = labelled.sample(docs, labels, label, most).repartition(COUNTERS)

    def count(batches):
        seen, totals = np.zeros((2, size), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            y = batch.column("label").to_numpy()
            for i, j, data, at in portions(batch):
                row, feature = grams(data, at)
                for k in (0, 1):
                    seen[k] += np.bincount(feature[y[i:j][row] == k], minlength=size).astype(np.int32)
            totals += np.bincount(y, minlength=2)
        yield pa.RecordBatch.from_pydict({"seen": pa.array([zlib.compress(seen.tobytes(), 1)], pa.binary()), "totals": pa.array([totals.tobytes()], pa.binary())})

    seen, totals = np.zeros((2, size), np.int64), np.zeros(2, np.int64)
    for r in sampled.mapInArrow(count, "seen binary, totals binary").collect():  # a row a counter
        seen += np.frombuffer(zlib.decompress(r.seen), np.int32).reshape(2, size)
        totals += np.frombuffer(r.totals, np.int64)
    if not totals.all():
        return Linear(np.zeros(size, np.float32), np.zeros(size, bool), 0.0 if not totals.any() else (4.0 if totals[1] else -4.0))
    ratio, keep = ratios(seen.sum(axis=0).astype(np.float64), seen[1].astype(np.float64), int(totals.sum()), int(totals[1]))
    held = docs.sparkSession.sparkContext.broadcast(np.packbits(keep))

    def features(batches):
        mine = np.unpackbits(held.value).astype(bool)
        for batch in batches:
            for i, j, data, at in portions(batch):
                row, feature = grams(data, at, mine)
                cut = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"label": batch.column("label").slice(i, j - i), "feature": pa.ListArray.from_arrays(cut, feature.astype(np.int32))})

    table = sampled.mapInArrow(features, "label int, feature array<int>").toArrow()
    lengths = np.concatenate([c.value_lengths().to_numpy() for c in table.column("feature").chunks])
    flat = np.concatenate([c.flatten().to_numpy() for c in table.column("feature").chunks])
    return train(np.concatenate(([0], np.cumsum(lengths))), flat, table.column("label").to_numpy(), ratio, keep)


def score(docs: DataFrame, model: Linear) -> DataFrame:
    """doc_id and score of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in batches:
            out = [held.value.scores(data, at) for _, _, data, at in portions(batch)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(np.concatenate(out) if out else np.empty(0))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(docs, labels)).select("doc_id", labelled.held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
