"""Quality classifier: a regularised quadratic discriminant over document
statistics.

Every text becomes a vector of transformed statistics (logarithms of sizes,
arcsine roots of shares, see ``STATS``).  Each class gets a mean and a shrinkage covariance::

    S_c' = (1 - pooled) * S_c + pooled * S_all         (towards the pooled one)
    S_c''= (1 - ridge) * S_c' + ridge * diag(S_c') + floor * I

whose Cholesky factors are cached in the model.  The score is the logistic of
the difference of the two log densities (half squared Mahalanobis distances
and half log determinants) plus the log prior ratio.

Training reads every labelled row (no sample): tasks send per-class sums and
cross products, Spark adds them up, and only these few hundred numbers reach
the driver.  Scoring is one pass without a shuffle.

Defined cases: a null text counts as empty; an empty text has defined
statistics and gets a normal score; a row without a label, or whose labels
are null, is not learned from; an id labelled both 0 and 1 is learned as both;
a class seen fewer than two times cannot be modelled, then every score is the
share of label 1 (0.5 without any label).  Repeated rows are scored alike.
"""

from __future__ import annotations

import math
import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, id_bucket, map_text, sliced, table, written

STATS = ("words", "word bytes", "upper case", "digits", "sentence marks", "symbols", "exclamations", "bars",
         "line ends", "repeats of the word before", "words seen before", "longest word")
THRESHOLD = 0.3
POOLED, RIDGE, FLOOR = 0.3, 0.1, 1e-3

_UPPER, _LOWER, _DIGIT, _MARK, _EXCL, _BAR, _SYMBOL, _LINE, _SPACE, _OTHER = range(10)


def _classes() -> np.ndarray:
    lut = np.full(256, _OTHER, dtype=np.uint8)      # bytes over 127 and controls
    for c in range(33, 127):
        lut[c] = _SYMBOL
    lut[ord("A"):ord("Z") + 1] = _UPPER
    lut[ord("a"):ord("z") + 1] = _LOWER
    lut[ord("0"):ord("9") + 1] = _DIGIT
    for c in ".,;:?'\"()-":
        lut[ord(c)] = _MARK
    lut[ord("!")], lut[ord("|")] = _EXCL, _BAR
    lut[10] = _LINE
    for c in (9, 11, 12, 13, 32):
        lut[c] = _SPACE
    return lut


_LUT = _classes()


def _share(part: float, whole: float) -> float:
    """Arcsine of the root of a share, drawn to zero for tiny wholes (a count
    over the whole, as three symbols after one word, is capped at 1)."""
    return math.asin(math.sqrt(min(1.0, part / (whole + 5.0))))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text, in ``STATS`` order."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    w, n = len(words), np.zeros(10)
    for at in range(0, len(raw), 1 << 24):
        n += np.bincount(_LUT[np.frombuffer(raw, np.uint8, min(1 << 24, len(raw) - at), at)], minlength=10)
    letters = n[_UPPER] + n[_LOWER]
    filled = len(raw) - n[_LINE] - n[_SPACE]
    repeats = sum(map(operator.eq, words, words[1:]))
    return [
        math.log(w + 1), math.log((filled + 1) / (w + 1)), _share(n[_UPPER], letters), _share(n[_DIGIT], filled),
        _share(n[_MARK], w), _share(n[_SYMBOL], w), _share(n[_EXCL], w), _share(n[_BAR], w), _share(n[_LINE], w),
        _share(repeats, w), _share(w - len(set(words)), w), math.log(1 + max(map(len, words), default=0)),
    ]


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.array([statistics(t) for t in batch.column(column).to_pylist()], dtype=float).reshape(-1, len(STATS))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, stats array<double>) for every row of ``docs``."""
    d = docs.select(id_col, text_col)
    schema = d.select(id_col, F.array(F.lit(0.0)).alias("stats")).schema

    def run(batches):
        for b in sliced(batches, text_col):
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(list(_matrix(b, text_col)),
                                                                         pa.list_(pa.float64()))],
                                             names=[id_col, "stats"])
    return map_text(d, run, schema)


@dataclass(frozen=True)
class Discriminant:
    """Fitted model; ``factors`` are inverses of the Cholesky factors."""
    share: float
    means: np.ndarray | None = None       # (2, p)
    factors: np.ndarray | None = None     # (2, p, p)
    offsets: np.ndarray | None = None     # (2,) log prior minus half log determinant

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.share)
        logs = [self.offsets[c] - 0.5 * np.square((x - self.means[c]) @ self.factors[c].T).sum(axis=1)
                for c in (0, 1)]
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def discriminant(n: np.ndarray, sums: np.ndarray, cross: np.ndarray, pooled: float = POOLED,
                 ridge: float = RIDGE, floor: float = FLOOR) -> Discriminant:
    """Model from per-class counts (2,), sums (2, p) and cross products (2, p, p)."""
    total = n.sum()
    share = float(n[1] / total) if total else 0.5
    if (n < 2).any():
        return Discriminant(share)
    means = sums / n[:, None]
    scatter = cross - n[:, None, None] * means[:, :, None] * means[:, None, :]
    both = scatter.sum(axis=0) / total
    factors, offsets = [], []
    for c in (0, 1):
        s = (1 - pooled) * scatter[c] / n[c] + pooled * both
        d = np.clip(np.diag(s), 0, None)
        s = (1 - ridge) * (s + s.T) / 2 + np.diag(ridge * d + floor)
        chol = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(chol))
        offsets.append(math.log(n[c] / total) - np.log(np.diag(chol)).sum())
    return Discriminant(share, means, np.array(factors), np.array(offsets))


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
        pooled: float = POOLED, ridge: float = RIDGE, floor: float = FLOOR) -> Discriminant:
    """Learn from every row of ``stats`` (see :func:`document_statistics`) that has a 0/1 label."""
    p = len(STATS)
    y = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(
        id_col, F.col(label_col).cast("int").alias("y")).distinct()

    def moments(batches):
        n, sums, cross = np.zeros(2), np.zeros((2, p)), np.zeros((2, p, p))
        for b in batches:
            if not b.num_rows:
                continue
            x, cls = np.array(b.column("stats").to_pylist(), dtype=float).reshape(-1, p), b.column("y").to_numpy()
            for c in (0, 1):
                xc = x[cls == c]
                n[c] += len(xc)
                sums[c] += xc.sum(axis=0)
                cross[c] += xc.T @ xc
        if n.any():
            flat = np.concatenate([n[:, None], sums, cross.reshape(2, -1)], axis=1).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(flat.size, dtype=np.int32)), pa.array(flat)],
                                             names=["i", "v"])

    rows = (stats.join(y, id_col).select("stats", "y").mapInArrow(moments, "i int, v double")
            .groupBy("i").agg(F.sum("v").alias("v")).collect())          # 2 * (1 + p + p * p) numbers
    flat = np.zeros(2 * (1 + p + p * p))
    for r in rows:
        flat[r["i"]] = r["v"]
    flat = flat.reshape(2, -1)
    return discriminant(flat[:, 0], flat[:, 1:1 + p], flat[:, 1 + p:].reshape(2, p, p), pooled, ridge, floor)


def score_statistics(stats: DataFrame, model: Discriminant, id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, score) from the written statistics."""
    schema = stats.select(id_col, F.lit(0.0).alias("score")).schema

    def run(b):
        x = np.array(b.column("stats").to_pylist(), dtype=float).reshape(-1, len(STATS))
        return pa.RecordBatch.from_arrays([b.column(id_col), pa.array(model.score(x))], names=[id_col, "score"])
    return stats.mapInArrow(arrow_rows(run), schema)


def keep_good(docs: DataFrame, model: Discriminant, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` scoring ``threshold`` or more, columns unchanged, in one pass."""
    def run(batches):
        for b in sliced(batches, text_col):
            yield b.filter(pa.array(model.score(_matrix(b, text_col)) >= threshold))
    return map_text(docs, run, docs.schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """Label rows outside the held-out fold (crc32 of the id, modulo 5, is 0)."""
    return labels.where(id_bucket("doc_id", 5) != 0)


def op7_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from ``labels.quality``."""
    stats = written(document_statistics(table(spark, sf_dir, "documents")), "quality-stats")
    model = fit(stats, training_labels(table(spark, sf_dir, "labels")))
    return score_statistics(stats, model).select(
        "doc_id", F.coalesce(id_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
