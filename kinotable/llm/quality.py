"""Quality classifier: regularised quadratic discriminant analysis.

Each text becomes a row of transformed statistics (log counts, log shares of
kinds of bytes, repetition).  A fit takes, over all labelled documents, the
count, means and second moments of both classes, shrinks each covariance
towards the pooled one and towards its own diagonal, and keeps the Cholesky
factor.  A score is the logistic of the difference of the two Gaussian log
densities (Mahalanobis distances through the cached factors, log determinants
and priors), divided by the number of statistics so that it does not saturate.

Defined cases: null and empty texts have the statistics of no words; repeated
rows are scored each; labels that are null are not used; if a class has no
labelled document every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinotable.llm.hashing import buffers, chunks, lowered, running_sum, span_hashes, words

#: Shrinkage towards the pooled covariance and towards the diagonal.
POOLED, DIAGONAL = 0.1, 0.1
#: Most labels that are broadcast, so that only labelled documents are measured; beyond it all are.
BROADCAST_ROWS = 500_000
#: A document is kept from this score on.
THRESHOLD = 0.3

#: Kinds of bytes whose shares are statistics.
_KINDS = [np.array([chr(b) in s for b in range(256)]) for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#$%&*@~^", "!?", "|<>{}[]\\/=_", ".,;:", "\n")]
NAMES = ["words", "word_bytes", "capitals", "digits", "symbols", "cries", "marks", "stops", "lines", "distinct", "runs", "top_line"]


def statistics(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics for each text of a flat buffer."""
    n = np.diff(offsets)
    start, end, first = words(buf, offsets)
    count = np.diff(first)
    hashed = span_hashes(running_sum(lowered(buf)), start, end) if len(start) else np.zeros(0, np.uint64)
    share = lambda part, whole: np.log((part + 0.02) / (whole + 2.0))
    size = np.concatenate(([0], np.cumsum(end - start)))
    out = [np.log1p(count), np.log1p((size[first[1:]] - size[first[:-1]]) / np.maximum(count, 1))]
    for kind in _KINDS:
        held = np.concatenate(([0], np.cumsum(kind[buf])))
        out.append(share(held[offsets[1:]] - held[offsets[:-1]], n))
    owner = np.repeat(np.arange(len(n)), count)
    again = np.zeros(len(hashed), np.int64)
    if len(hashed) > 1:
        again[1:] = (hashed[1:] == hashed[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((hashed, owner))
    fresh = np.ones(len(hashed), bool)
    if len(hashed) > 1:
        fresh[1:] = (hashed[order][1:] != hashed[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order], fresh, len(n))
    runs = np.bincount(owner, again, len(n))
    edge = np.append(np.flatnonzero(fresh), len(hashed))
    top = np.zeros(len(n))
    if len(hashed):
        np.maximum.at(top, owner[order][edge[:-1]], np.diff(edge))
    out += [np.log((distinct + 1) / (np.sqrt(count) + 1)), share(runs, count), share(top, count)]
    return np.stack(out, 1)


@dataclass
class Model:
    """Means, inverse Cholesky factors and log weights of classes 0 and 1."""

    mean: np.ndarray | None = None
    factor: np.ndarray | None = None
    weight: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.full(len(x), 0.5)
        dense = [self.weight[c] - 0.5 * (((x - self.mean[c]) @ self.factor[c].T) ** 2).sum(1) for c in (0, 1)]
        return 1 / (1 + np.exp(-np.clip((dense[1] - dense[0]) / x.shape[1], -500, 500)))


def solve(moments: dict[int, np.ndarray], pooled: float = POOLED, diagonal: float = DIAGONAL) -> Model:
    """Model from the summed outer products of (1, statistics) of each class."""
    if any(c not in moments or moments[c][0, 0] < 2 for c in (0, 1)):
        return Model()
    n = np.array([moments[c][0, 0] for c in (0, 1)])
    mean = np.stack([moments[c][0, 1:] / n[c] for c in (0, 1)])
    cov = [moments[c][1:, 1:] / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)]
    shared = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    factors, weights = [], []
    for c in (0, 1):
        own = (1 - pooled) * cov[c] + pooled * shared
        own = (1 - diagonal) * own + diagonal * np.diag(np.diag(own)) + 1e-4 * np.eye(len(own))
        low = np.linalg.cholesky(own)
        factors.append(np.linalg.inv(low))
        weights.append(np.log(n[c] / n.sum()) - np.log(np.diag(low)).sum())
    return Model(mean, np.stack(factors), np.array(weights))


def _each(batch: pa.RecordBatch) -> np.ndarray:
    buf, offsets = buffers(batch.column(1))
    rows = [statistics(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets)]
    return np.concatenate(rows) if rows else np.zeros((0, len(NAMES)))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``x``, the statistics in the order of NAMES; no shuffle."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(list(_each(batch)), pa.list_(pa.float64()))], ["doc_id", "x"])

    return _plain(docs).mapInArrow(measure, "doc_id long, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", pooled: float = POOLED, diagonal: float = DIAGONAL) -> Model:
    """Fit to all documents that ``labels`` names; leave held-out rows out first.

    Only statistics are joined with labels, and each task sends one sum of
    outer products for each class.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(NAMES) + 1
        held = np.zeros((2, width, width))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.array(batch.column(1).flatten()).reshape(len(y), -1)
            x = np.column_stack([np.ones(len(y)), x]) if len(y) else np.zeros((0, width))
            for c in (0, 1):
                held[c] += x[y == c].T @ x[y == c]
        c, i, j = np.indices(held.shape).reshape(3, -1)
        yield pa.record_batch([pa.array(x) for x in (c, i, j)] + [pa.array(held.ravel())], ["c", "i", "j", "v"])

    known = known.filter("y in (0, 1)")
    wanted = docs.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi") if known.count() <= BROADCAST_ROWS else docs
    rows = document_statistics(wanted).join(known, "doc_id").select("y", "x")
    summed = rows.mapInArrow(sums, "c long, i long, j long, v double").groupBy("c", "i", "j").agg(F.sum("v").alias("v")).collect()
    moments = {c: np.zeros((len(NAMES) + 1,) * 2) for c in (0, 1)}
    for r in summed:
        moments[r.c][r.i, r.j] = r.v
    return solve(moments, pooled, diagonal)


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document; no shuffle."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(model.scores(_each(batch)))], ["doc_id", "score"])

    return _plain(docs).mapInArrow(score, "doc_id long, score double")
