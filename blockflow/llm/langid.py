"""Language identification: sparse multinomial logistic regression over
TF-IDF character n-grams, trained with follow-the-regularised-leader.

Features.  The whole text, lowered, every run of non-letters read as one
blank; its 1- to 3-grams hashed into ``FEATURES`` places, log counts times
inverse document frequency, unit length.  Document frequencies are counted
over all training documents (Spark adds up per-task counts; the table of
``FEATURES`` numbers is bounded).

Training.  About ``sample`` labelled documents, an equal quota for each
language (all of a rarer one), chosen by id hash below the language's share,
are collected as sparse counts; never more than twice ``sample``, a
documented bound.
FTRL-proximal with elastic net (L1, L2) goes over four fifths ``EPOCHS``
times in hash order; the last fifth sets one temperature by least log loss.
The score is the calibrated probability of the best language.

Defined cases: null texts and texts without a letter are ``und`` with score
0; without any training document every text is ``und``; a language is any
non-null value of the label column; one language alone is always predicted,
with score 1; ties go to the language first in order; repeated rows are
predicted alike and count in training each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_bucket, map_text, sliced, table

FEATURES, SAMPLE, EPOCHS = 1 << 15, 4000, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
_WORDLIKE = re.compile(r"[^\W\d_]")
_TABLES: tuple[np.ndarray, np.ndarray] | None = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(lower-case code point, is a letter) of the basic plane."""
    global _TABLES
    if _TABLES is None:
        low = np.arange(0x10000, dtype=np.uint32)
        letter = np.zeros(0x10000, dtype=bool)
        for c in range(0x10000):
            ch = chr(c)
            letter[c] = ch.isalpha()
            if len(ch.lower()) == 1:
                low[c] = ord(ch.lower())
        _TABLES = low, letter
    return _TABLES


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def counts(text: str, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """(feature, count) of a text's hashed 1- to 3-grams."""
    low, letter = _tables()
    total = np.zeros(features, dtype=np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    plane = np.minimum(points, 0xFFFF)
    is_letter = letter[plane] | (points > 0xFFFF)
    c = np.where(points > 0xFFFF, points, low[plane])
    c = np.where(is_letter, c, 32).astype(np.uint32)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]                        # the first blank after a letter stays
    blank = np.array([32], dtype=np.uint32)
    c = c[keep]
    c = np.concatenate([blank, c, blank[:int(len(c) and c[-1] != 32)]])
    shift = np.uint32(32 - int(features).bit_length() + 1)
    for at in range(0, len(c), 1 << 20):
        p = c[at:at + (1 << 20) + 2]
        h1 = p * np.uint32(0x9E3779B1)
        h2 = (h1[:-1] ^ np.uint32(0x5BD1E995)) + p[1:] * np.uint32(0x85EBCA6B)
        h3 = (h2[:-1] * np.uint32(0xC2B2AE35)) + p[2:] * np.uint32(0x27D4EB2F)
        m = min(len(p), 1 << 20)
        for h in (h1[:m], h2[:m], h3[:m]):
            h = h ^ (h >> np.uint32(15))
            total += np.bincount((h * np.uint32(2654435761)) >> shift, minlength=features)[:features]
    some = np.flatnonzero(total)
    return some, total[some]


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray                 # (features,)
    weights: np.ndarray             # (features + 1, languages): the last row is the intercept
    temperature: float = 1.0

    def vector(self, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = np.log1p(count) * self.idf[at]
        v = v / max(np.linalg.norm(v), 1e-12)
        return np.append(at, len(self.idf)), np.append(v, 1.0)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return "und", 0.0
        at, v = self.vector(*counts(text, len(self.idf)))
        z = v @ self.weights[at] / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        return self.languages[int(p.argmax())], float(p.max())


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, features: int,
         epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """Weights (features + 1, classes) by FTRL-proximal with elastic net; the intercept is not penalised by L1."""
    z, n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))

    def weights(at):
        zi, ni = z[at], n[at]
        lasso = np.where(at == features, 0.0, l1)[:, None]
        w = -(zi - np.sign(zi) * lasso) / ((beta + np.sqrt(ni)) / alpha + l2)
        return np.where(np.abs(zi) <= lasso, 0.0, w)

    for _ in range(epochs):
        for (at, v), y in zip(rows, labels):
            w = weights(at)
            p = v @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1.0
            g = v[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(features + 1))


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, between a quarter
    and 20, by golden-section search (on separable data the loss alone would
    push it to zero)."""
    def loss(t):
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]).mean())

    a, b, g = np.log(0.25), np.log(20.0), (5 ** 0.5 - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(np.exp(c)) < loss(np.exp(d)) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
        features: int = FEATURES, sample: int = SAMPLE) -> LanguageModel:
    """Model from the rows of ``docs`` with a text and a label."""
    docs = docs.select(id_col, text_col, label_col).where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull())

    def frequencies(batches):
        df, n = np.zeros(features, dtype=np.int64), 0
        for b in sliced(batches, text_col):
            for t in b.column(text_col).to_pylist():
                if has_letter(t):
                    df[counts(t, features)[0]] += 1
                    n += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, features).astype(np.int32)), pa.array(np.append(df[some], n))], names=["i", "n"])

    seen = map_text(docs.select(text_col), frequencies, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(features + 1)
    for r in seen:                                       # features + 1 numbers at most
        df[r["i"]] = r["n"]
    idf = np.log((1.0 + df[-1]) / (1.0 + df[:-1])) + 1.0

    sizes = docs.groupBy(label_col).agg(F.count("*").alias("n"))
    sizes = sizes.orderBy(F.col("n").desc(), label_col).limit(sample).collect()          # languages, bounded by the sample
    quota = max(1.0, sample / max(1, len(sizes)))
    shares = docs.sparkSession.createDataFrame([(r[label_col], min(1.0, quota / r["n"])) for r in sizes], "lang_ string, share double")

    def sparse(batches):
        for b in sliced(batches, text_col):
            rows = [counts(t, features) if has_letter(t) else None for t in b.column(text_col).to_pylist()]
            ok = [i for i, r in enumerate(rows) if r is not None]
            if ok:
                yield pa.RecordBatch.from_arrays(
                    [b.column(label_col).take(pa.array(ok)), b.column("mark").take(pa.array(ok)),
                     pa.array([rows[i][0].astype("<u4").tobytes() for i in ok], pa.binary()),
                     pa.array([np.minimum(rows[i][1], 0xFFFFFFFF).astype("<u4").tobytes() for i in ok], pa.binary())],
                    names=["label", "mark", "at", "n"])

    marked = docs.select(F.col(text_col), F.col(label_col), F.xxhash64(F.col(id_col)).alias("mark"))
    below = F.pmod(F.col("mark"), F.lit(1 << 32)) < F.col("share") * F.lit(float(1 << 32))
    chosen = marked.join(F.broadcast(shares), (F.col(label_col) == F.col("lang_")) & below).select(text_col, label_col, "mark")
    got = map_text(chosen, sparse, "label string, mark long, at binary, n binary").orderBy("mark", "label", "at").limit(2 * sample).collect()
    got.sort(key=lambda r: (r["mark"], r["label"], r["at"]))
    languages = tuple(sorted({r["label"] for r in got}))
    model = LanguageModel(languages, idf, np.zeros((features + 1, len(languages))))
    if len(languages) < 2:
        return model
    rows = [model.vector(np.frombuffer(r["at"], "<u4").astype(np.int64), np.frombuffer(r["n"], "<u4")) for r in got]
    labels = np.array([languages.index(r["label"]) for r in got])
    held = np.arange(len(rows)) % 5 == 4
    learn = np.flatnonzero(~held)
    weights = ftrl([rows[i] for i in learn], labels[learn], len(languages), features)
    heat = 1.0
    if held.any():
        logits = np.array([v @ weights[at] for (at, v), h in zip(rows, held) if h])
        heat = temperature(logits, labels[held])
    return LanguageModel(languages, idf, weights, heat)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, lang_pred, score) per row; one pass, no shuffle."""
    d = docs.select(id_col, text_col)
    schema = d.select(id_col, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in sliced(batches, text_col):
            out = [shared.value.predict(t) for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array([x for x, _ in out], pa.string()),
                                              pa.array([s for _, s in out], pa.float64())], names=schema.names)
    return map_text(d, run, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(id_bucket("doc_id", 4) != 2))
    return identify(docs, model).select(
        "doc_id", F.coalesce(id_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
