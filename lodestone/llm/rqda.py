"""Operator 7: quality scores by regularised quadratic discriminant analysis over transformed document statistics.

Each class has its mean and a covariance shrunk towards the pooled diagonal, S_c = (1 - a) S_c + a diag(S). A score is the logistic of
the difference of the classes' Gaussian log-densities (Mahalanobis distances from cached Cholesky factors, log-determinants) plus the
log prior odds, divided by a temperature (a parameter, 2 by default; the statistics depend on one another, for words, characters and lines
all grow with a text's length, so the densities count the same evidence more than once and raw odds are too sure of themselves; it changes
no order of scores). All labelled learning rows are used; only sums of features and of their products reach the driver.

Defined results: null text counts as empty and gets a score; null or missing labels aren't learned from; with fewer than two rows of a
class every score is the share of class 1 with one row added to each class (0.5 without rows); null doc_id counts as an empty one, so it
is held out; a doc_id that repeats gets a row each; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, textnp

NAMES = ["chars", "words", "word_length", "upper", "digit", "symbol", "bang", "bar", "punct", "foreign", "lines", "line_length", "distinct", "repeat", "deviation", "short"]


def features(column: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text."""
    data, offsets = textnp.utf8(column)
    n = np.diff(offsets)

    def share(mask: np.ndarray, of: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(1, of)

    def among(chars: bytes) -> np.ndarray:
        lut = np.zeros(256, bool)
        lut[np.frombuffer(chars, np.uint8)] = True
        return lut[data]

    starts, ends, rows = textnp.words(data, offsets, textnp.table("nonspace"))
    counts = np.bincount(rows, minlength=len(n))
    lengths = (ends - starts).astype(float)
    mean = np.bincount(rows, lengths, len(n)) / np.maximum(1, counts)
    square = np.bincount(rows, lengths**2, len(n)) / np.maximum(1, counts)
    keys = textnp.word_hashes(textnp.LOWER[data], starts, ends) if len(data) else np.zeros(0, np.uint64)
    order = np.lexsort((keys, rows))
    k, r = keys[order], rows[order]
    first = np.ones(len(k), bool)
    first[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    distinct = np.bincount(r[first], minlength=len(n))
    same = np.zeros(len(keys), bool)
    same[1:] = (keys[1:] == keys[:-1]) & (rows[1:] == rows[:-1])
    lines = share(data == 10, np.ones(len(n))) + 1
    lead = share((data & 0xC0) != 0x80, np.ones(len(n)))
    root = lambda x: np.sqrt(np.maximum(0, x))
    return np.column_stack([
        np.log1p(lead), np.log1p(counts), np.log1p(mean), root(share(among(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), n)), root(share(among(b"0123456789"), n)), root(share(among(b"#*$%&<>"), n)),
        root(share(among(b"!?"), n)), root(share(among(b"|"), n)), root(share(among(b".,;:"), n)), root(share(data >= 0x80, n)), np.log1p(lines), np.log1p(lead / lines),
        np.log(np.maximum(1, distinct) / np.maximum(1, counts)), root(np.bincount(rows, same, len(n)) / np.maximum(1, counts)), np.log1p(root(square - mean**2)), root(np.bincount(rows, lengths <= 3, len(n)) / np.maximum(1, counts)),
    ])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in textnp.slices(batch, "text"):
            x = features(part.column("text"))
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), values], ["doc_id", "x"])


def measured(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    scratch.ship(docs.sparkSession)
    return scratch.saved(docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(_measure, "doc_id long, x array<double>"), "features")


def _stack(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    p = len(NAMES)
    total = np.zeros((2, 1 + p + p * p))
    for batch in batches:
        x, y = _stack(batch), batch.column("y").to_numpy(zero_copy_only=False)
        for c in (0, 1):
            own = x[y == c]
            total[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
    yield pa.RecordBatch.from_arrays([pa.array(total.tolist(), pa.list_(pa.float64())), pa.array([0, 1], pa.int32())], ["s", "y"])


class Model:
    def __init__(self, sums: np.ndarray, shrinkage: float, temperature: float = 1.0):
        p = len(NAMES)
        self.n = sums[:, 0]
        self.temperature = temperature
        self.factors = []
        if min(self.n) < 2:
            return
        means = sums[:, 1 : 1 + p] / self.n[:, None]
        covariances = [sums[c, 1 + p :].reshape(p, p) / self.n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
        pooled = np.diag(sum(self.n[c] * np.diag(covariances[c]) for c in (0, 1)) / self.n.sum()) + 1e-6 * np.eye(p)
        for c in (0, 1):
            chol = np.linalg.cholesky((1 - shrinkage) * covariances[c] + shrinkage * pooled)
            self.factors.append((means[c], np.linalg.inv(chol), 2 * np.log(np.diag(chol)).sum()))

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1 before the temperature."""
        prior = np.log((self.n[1] + 1) / (self.n[0] + 1))
        density = [-0.5 * ((((x - m) @ inverse.T) ** 2).sum(1) + logdet) for m, inverse, logdet in self.factors]
        return density[1] - density[0] + prior

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.factors:
            return np.full(len(x), (self.n[1] + 1) / (self.n.sum() + 2))
        return 1 / (1 + np.exp(-np.clip(self.odds(x) / self.temperature, -500, 500)))


def learning(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 != 0


def fit(rows: DataFrame, labels: DataFrame, shrinkage: float = 0.1, temperature: float = 2.0) -> Model:
    known = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("y")).where(learning())
    parts = rows.join(known, "doc_id").select("x", "y").mapInArrow(_sums, "s array<double>, y int")
    # two rows of sums for each partition, added up in the engine
    whole = parts.select("y", F.posexplode("s").alias("i", "v")).groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros((2, 1 + len(NAMES) + len(NAMES) ** 2))
    for r in whole:
        sums[r.y, r.i] = r.v
    return Model(sums, shrinkage, temperature)


def apply(docs: DataFrame, labels: DataFrame, shrinkage: float = 0.1, temperature: float = 2.0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = measured(docs)
    model = fit(rows, labels, shrinkage, temperature)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_stack(batch)))], ["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (~learning()).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
