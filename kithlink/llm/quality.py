"""Quality by nearest neighbours in a latent semantic space.

Features of a text are its hashed byte trigrams, damped and weighted by inverse document frequency, and the levels of
three measures of shape that trigrams cannot show: words that repeat the word before, capitals, and symbols. A truncated
singular value decomposition of a labelled sample gives the latent space. The sample's vectors (at most
``neighbours`` rows of ``rank`` floats, the size bound of what is broadcast) are compared with every document's by
exact blocked cosine products; the ``k`` nearest vote with weights that grow with their similarity. A document of the
sample has no vote on itself; its copies have.

``fit`` and ``score`` are the operator. Null or empty texts have a zero vector and get the share of label 1 in the sample,
as does every text if the sample is empty (0.5 then); repeated rows are scored each; documents, however long, stay whole; of
neighbours tied for the k-th place any may vote; empty tables give empty results; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithlink.llm import labelled
from kithlink.llm.textvec import Words, slices, utf8

BITS = 12
THRESHOLD = 0.3


def trigram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x 2**BITS counts of hashed byte trigrams; none spans two rows."""
    rows = len(offsets) - 1
    out = np.zeros((rows, 1 << BITS), np.float32)
    if len(data) >= 3:
        d = data.astype(np.uint32)
        h = (d[:-2] * np.uint32(0x9E3779B1) + d[1:-1] * np.uint32(0x85EBCA77) + d[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(32 - BITS)
        for i in range(rows):
            a, b = offsets[i], offsets[i + 1] - 2
            if b > a:
                out[i] = np.bincount(h[a:b], minlength=1 << BITS)
    return out


#: Lower bounds of the levels of each measure, and how much a level weighs against the trigrams.
LEVELS = (0.02, 0.08, 0.2, 0.4)
SHAPES = 3 * (len(LEVELS) + 1)
SHAPE_WEIGHT = 0.6
WIDTH = (1 << BITS) + SHAPES
_capital = np.zeros(256, bool)
_capital[65:91] = True
_symbol = np.array([32 < b < 127 and not chr(b).isalnum() and chr(b) not in ".,'-" for b in range(256)])


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x WIDTH: trigram counts, then 1 at the level of each measure."""
    rows = len(offsets) - 1
    out = np.concatenate((trigram_counts(data, offsets), np.zeros((rows, SHAPES), np.float32)), axis=1)
    words = Words(data, offsets)
    again = np.zeros(len(words.hash), bool)
    again[1:] = words.hash[1:] == words.hash[:-1]
    size, n = np.diff(offsets), np.diff(words.at)

    def share(marks, at, of):
        return np.diff(np.concatenate(([0], np.cumsum(marks)))[at]) / np.maximum(of, 1)

    for k, measure in enumerate((share(again, words.at, n), share(_capital[data], offsets, size), share(_symbol[data], offsets, size))):
        level = np.searchsorted(LEVELS, measure, "right")
        out[np.arange(rows), (1 << BITS) + k * (len(LEVELS) + 1) + level] = n > 0
    return out


@dataclass
class Space:
    """The fitted space: feature weights, projection, labelled vectors and labels."""

    weight: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    ids: np.ndarray  # of the sample's documents, ascending
    share: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors of counts, which are used up."""
        return unit(scaled(counts, self.weight) @ self.projection)

    def vote(self, vectors: np.ndarray, ids: np.ndarray, k: int, power: float) -> np.ndarray:
        """Scores of a block of vectors of the documents ``ids``."""
        if not len(self.vectors):
            return np.full(len(vectors), self.share)
        near = vectors @ self.vectors.T
        own = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        itself = np.flatnonzero(self.ids[own] == ids)
        near[itself, own[itself]] = -1
        k = min(k, near.shape[1])
        at = np.argpartition(near, near.shape[1] - k, axis=1)[:, -k:]
        weight = np.maximum(np.take_along_axis(near, at, 1), 0).astype(np.float64) ** power
        total = weight.sum(axis=1)
        return np.where(total > 0, (weight * self.labels[at]).sum(axis=1) / np.where(total > 0, total, 1), self.share)


def scaled(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Trigram weights as a unit vector beside the weighted levels; ``counts`` is used up."""
    shape = slice(1 << BITS, None)
    levels = counts[:, shape] * np.float32(SHAPE_WEIGHT)
    np.log1p(counts, out=counts)
    counts *= weight
    head = counts[:, : 1 << BITS]
    head /= np.maximum(np.sqrt(np.einsum("ij,ij->i", head, head)), 1e-9)[:, None]
    counts[:, shape] = levels
    return counts


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def fit_space(counts: np.ndarray, labels: np.ndarray, ids: np.ndarray, rank: int = 48, rounds: int = 4) -> Space:
    """Weights and truncated decomposition by randomised subspace iteration with a fixed seed; ``counts`` is used up, so the driver holds one matrix."""
    n = len(counts)
    if not n:
        return Space(np.ones(WIDTH, np.float32), np.zeros((WIDTH, rank), np.float32), np.empty((0, rank), np.float32), np.empty(0), np.empty(0, np.int64), 0.5)
    seen = np.count_nonzero(counts, axis=0)
    weight = np.log((1 + n) / (1 + seen)).astype(np.float32) + np.float32(1)
    x = scaled(counts, weight)
    q = np.random.default_rng(1).standard_normal((x.shape[1], min(rank + 16, n))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    projection = np.ascontiguousarray((q @ vt.T)[:, :rank], np.float32)
    return Space(weight, projection, unit(x @ projection).astype(np.float32), np.asarray(labels, np.float64), ids, float(np.mean(labels)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", neighbours: int = 6000, rank: int = 48) -> Space:
    """Fit on at most ``neighbours`` labelled documents (and the bytes that ``labelled.sample`` allows)."""

    def vectors(batches):
        for batch in batches:
            for i, j, data, at in slices(*utf8(batch.column("text"))):
                counts = features(data, at)
                row, feature = np.nonzero(counts)
                cut = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(i, j - i), "label": batch.column("label").slice(i, j - i),
                    "feature": pa.ListArray.from_arrays(cut, feature.astype(np.int16)), "n": pa.ListArray.from_arrays(cut, counts[row, feature].astype(np.int32)),
                })

    # at most ``neighbours`` rows of WIDTH features
    table = labelled.sample(docs, labels, label, neighbours).mapInArrow(vectors, "doc_id long, label int, feature array<smallint>, n array<int>").toArrow()
    counts, done = np.zeros((table.num_rows, WIDTH), np.float32), 0
    order = np.argsort(table.column("doc_id").to_numpy())
    rank_of = np.argsort(order)
    y, ids = table.column("label").to_numpy()[order], table.column("doc_id").to_numpy()[order]
    for batch in table.to_batches():
        lists = batch.column("feature")
        row = rank_of[done + np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())]
        counts[row, lists.flatten().to_numpy()] = batch.column("n").flatten().to_numpy()
        done += batch.num_rows
    del table
    pa.default_memory_pool().release_unused()
    return fit_space(counts, y, ids, rank)


def batch_scores(batch: pa.RecordBatch, space: Space, k: int, power: float) -> np.ndarray:
    """Scores of a batch's texts; a null doc_id is in no sample."""
    out = []
    null = np.array(batch.column("doc_id").is_null())
    ids = np.array(batch.column("doc_id").fill_null(0)).astype(np.int64)
    for first, _, data, at in slices(*utf8(batch.column("text"))):
        for i in range(0, len(at) - 1, 256):
            part = at[i : i + 257]
            counts = features(data[part[0] : part[-1]], part - part[0])
            bare = ~counts.any(axis=1)
            own = slice(first + i, first + i + len(part) - 1)
            known = ids[own]
            if null[own].any():  # no id of the sample
                known = np.where(null[own], space.ids.max(initial=0) + 1, known)
            found = space.vote(space.embed(counts), known, k, power)
            found[bare] = space.share
            out.append(found)
    return np.clip(np.concatenate(out), 0, 1) if out else np.empty(0)


def score(docs: DataFrame, space: Space, k: int = 25, power: float = 8.0) -> DataFrame:
    """doc_id and score of every document."""
    held = docs.sparkSession.sparkContext.broadcast(space)

    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(batch_scores(batch, held.value, k, power))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, score double")


def keep_good(docs: DataFrame, space: Space, threshold: float = THRESHOLD, k: int = 25, power: float = 8.0) -> DataFrame:
    """``docs`` without the rows that score below the threshold."""
    held = docs.sparkSession.sparkContext.broadcast(space)
    place = {name: i for i, name in enumerate(docs.columns)}
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # whatever the columns are called

    def work(batches):
        for batch in batches:
            asked = pa.RecordBatch.from_arrays([batch.column(place["doc_id"]).cast(pa.int64()), batch.column(place["text"])], ["doc_id", "text"])
            yield batch.filter(pa.array(batch_scores(asked, held.value, k, power) >= threshold))

    return plain.mapInArrow(work, plain.schema).toDF(*docs.columns)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(docs, labels)).select("doc_id", labelled.held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
