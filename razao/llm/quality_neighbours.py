"""Operator 7: text quality by nearest-neighbour voting in a latent semantic space.

A text is the log-damped counts of its hashed character trigrams, weighted by
inverse document frequency, projected on the leading singular vectors of the
labelled sample and scaled to unit length. The labelled vectors (``SAMPLE_ROWS``
at most, ``DIMENSIONS`` numbers each) go to every task; every document's cosine
with every one of them is computed in blocks, and its nearest ``NEIGHBOURS``
vote, weighted by a power of the cosine.

The sample is what the classifier is fitted on and the only bound here: the
labelled rows that may be learned from with the smallest hashes of their id.
Every document is scored from its whole text.

Defined results: a null or empty text, and any text when nothing is labelled,
scores the sample's share of label 1 (0.5 without a sample); a document with
several labels counts with the largest; ties between neighbours go to either; repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import lowest, slices

#: Labelled documents fitted on at most, and the longest text that takes part as one.
SAMPLE_ROWS, SAMPLE_BYTES = 4096, 60_000
BUCKET_BITS, DIMENSIONS, NEIGHBOURS, POWER = 12, 64, 31, 4.0
#: Documents whose products are held at a time.
BLOCK = 256


def trigram_counts(texts: list[str | None]) -> np.ndarray:
    """Damped counts of hashed trigrams, a row a text."""
    width = 1 << BUCKET_BITS
    joined = [(" " + (t or "") + " ").encode("utf-32-le", "surrogatepass") for t in texts]
    size = np.array([len(j) // 4 for j in joined], np.int64)
    c = np.frombuffer(b"".join(joined), np.uint32).astype(np.uint64)
    h = c * np.uint64(0x9E3779B97F4A7C15)
    h[1:] += c[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
    h[2:] += c[:-2] * np.uint64(0x165667B19E3779F9)
    h = ((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BUCKET_BITS)
    doc = np.repeat(np.arange(len(texts)), size)
    keep = np.ones(len(c), bool)
    start = np.cumsum(size) - size
    keep[start] = keep[np.minimum(start + 1, len(c) - 1)] = False  # the first two characters of a text end no trigram
    at = doc[keep] * width + h[keep].astype(np.int64)
    return np.log1p(np.bincount(at, minlength=len(texts) * width).reshape(len(texts), width)).astype(np.float32)


class Space:
    """The fitted latent space with the labelled vectors in it."""

    def __init__(self, texts: list[str], labels: list[int]):
        self.labels = np.array(labels, np.float32)
        self.prior = float(self.labels.mean()) if len(labels) else 0.5
        self.vectors = None
        if not len(labels):
            return
        x = np.concatenate([trigram_counts(texts[i:i + BLOCK]) for i in range(0, len(texts), BLOCK)])
        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
        x *= self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        k = min(DIMENSIONS, *x.shape)
        basis = np.random.default_rng(7).standard_normal((x.shape[1], min(k + 16, x.shape[1])), np.float32)
        for _ in range(4):  # subspace iteration for the leading right singular vectors
            basis, _ = np.linalg.qr(x.T @ (x @ basis))
        _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
        self.project = (basis @ turn[:k].T).astype(np.float32)
        self.vectors = self.unit(x @ self.project)

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if self.vectors is None:
            return out
        for i in range(0, len(texts), BLOCK):
            part = texts[i:i + BLOCK]
            latent = self.unit((trigram_counts(part) * self.idf) @ self.project)
            near = latent @ self.vectors.T
            k = min(NEIGHBOURS, near.shape[1])
            at = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, at, 1), 0) ** POWER
            total = weight.sum(1)
            vote = (weight * self.labels[at]).sum(1)
            has = (total > 0) & np.array([bool(t) for t in part])
            out[i:i + BLOCK][has] = np.clip(vote[has] / total[has], 0, 1)
        return out


def learn(docs: DataFrame, labels: DataFrame, learned: Column, label_col: str = "quality") -> Space:
    """The space from the rows of ``labels`` (doc_id, label) for which ``learned`` (over doc_id) holds."""
    known = labels.where(learned & F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    sample = F.broadcast(lowest(known, F.xxhash64("doc_id"), SAMPLE_ROWS, known.count()))  # SAMPLE_ROWS of two numbers
    usable = docs.where(learned & (F.octet_length("text") <= SAMPLE_BYTES)).select("doc_id", "text")
    rows = usable.join(sample, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    return Space([r["text"] for r in rows], [r["label"] for r in rows])


def classify(docs: DataFrame, space: Space) -> DataFrame:
    """(doc_id, score, predicted) of every row. No shuffle."""
    src = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            score = space.scores(b.column(1).to_pylist())
            yield pa.record_batch([b.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, score double, predicted int")


def keep_good(docs: DataFrame, space: Space, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns."""
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            yield b.filter(pa.array(space.scores(b.column(at).to_pylist()) >= least))

    return docs.mapInArrow(run, docs.schema)
