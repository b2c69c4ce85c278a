"""Quality by regularised quadratic discriminant analysis over transformed document statistics."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import is_held_out, materialise, slices, table

#: Labelled documents that the discriminant is fitted on, those with the lowest hashes of their keys.
FIT_DOCS = 20_000
#: Share of the pooled covariance in a class's, and of the mean variance in that.
TO_POOLED, TO_SPHERE = 0.2, 0.02
NAMES = ["chars", "words", "word_len", "word_sd", "alpha", "digit", "upper", "symbol", "space", "distinct", "top_word", "repeats", "line_copies", "line_len", "entropy", "ends"]

_KIND = np.zeros((256, 6), dtype=np.float64)
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = [_b >= 128 or _c.isalpha(), _b < 128 and _c.isdigit(), _b < 128 and _c.isupper(), 33 <= _b < 127 and not _c.isalnum() and _c not in ".,;:'\"-?", _c in " \t\n\r\v\f", _c in ".,;:?"]


def _logit(share: float, of: float) -> float:
    return float(np.log((share + 0.5) / (of - share + 0.5)))


def statistics(text: str) -> list[float]:
    """Statistics of a whole text, logarithms for sizes and smoothed logits for shares. An empty text has a vector too."""
    data = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256).astype(np.float64)
    alpha, digit, upper, symbol, space, ends = counts @ _KIND
    n = max(len(data), 1)
    words = data.split()
    k = len(words)
    lens = np.fromiter(map(len, words), dtype=np.float64, count=k)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in data.split(b"\n") if x.strip()]
    p = counts[counts > 0] / n
    return [
        float(np.log1p(len(data))), float(np.log1p(k)), float(np.log1p(lens.mean())) if k else 0.0, float(np.log1p(lens.std())) if k else 0.0,
        _logit(alpha, n), _logit(digit, n), _logit(upper, n), _logit(symbol, n), _logit(space, n),
        _logit(len(seen), k), _logit(max(seen.values(), default=0), k), _logit(repeats, max(k, 1)),
        _logit(len(lines) - len(set(lines)), max(len(lines), 1)), float(np.log1p(len(data) / max(len(lines), 1))), float(-(p * np.log(p)).sum()), _logit(ends, n),
    ]


@dataclass
class Discriminant:
    """Per class: log prior, mean, inverse Cholesky factor of the covariance and half its log determinant."""

    centre: np.ndarray
    scale: np.ndarray
    classes: list[tuple[float, np.ndarray, np.ndarray, float]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 by the difference of the log densities."""
        z = (x - self.centre) / self.scale
        logs = []
        for prior, mean, inverse, half in self.classes:
            d = (z - mean) @ inverse.T
            logs.append(prior - half - 0.5 * (d * d).sum(1))
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -50, 50)))


def train(x: np.ndarray, y: np.ndarray) -> Discriminant | None:
    """None if there aren't rows of both classes."""
    if len(x) == 0 or y.min() == y.max():
        return None
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - centre) / scale
    groups = [z[y == c] for c in (0, 1)]
    spread = [np.cov(g.T, bias=True) if len(g) > 1 else np.zeros((x.shape[1],) * 2) for g in groups]
    pooled = sum(len(g) * s for g, s in zip(groups, spread, strict=True)) / len(z)
    sphere = np.eye(x.shape[1]) * max(np.trace(pooled) / x.shape[1], 1e-3)
    classes = []
    for g, s in zip(groups, spread, strict=True):
        to_pooled = max(TO_POOLED, x.shape[1] / (x.shape[1] + len(g)))  # a small class can't tell its own covariance
        cov = (1 - to_pooled) * s + to_pooled * pooled
        cov = (1 - TO_SPHERE) * cov + TO_SPHERE * sphere
        factor = np.linalg.cholesky(cov)
        classes.append((float(np.log(len(g) / len(z))), g.mean(0), np.linalg.inv(factor), float(np.log(np.diag(factor)).sum())))
    return Discriminant(centre, scale, classes)


def measured(df: DataFrame, text: str = "text", into: str = "features") -> DataFrame:
    """Add array<double> ``into``, in the order of ``NAMES``; null texts count as empty."""

    @arrow_udf("array<double>")
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([statistics(t or "") for a, b in slices(len(batch), 256) for t in batch.slice(a, b - a).to_pylist()], pa.list_(pa.float64()))

    return df.withColumn(into, measure(F.col(text)))


def fit(features: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Discriminant | None:
    """Fit on ``FIT_DOCS`` labelled keys at most outside the test fold. Of a key with two labels the higher counts, of one with several texts the least statistics."""
    known = labels.where(F.col(label).isin(0, 1) & ~is_held_out(F.col(key), 4, 2)).groupBy(F.col(key).alias("_k")).agg(F.max(label).alias("_y"))
    picked = known.orderBy(F.xxhash64("_k"), "_k").limit(FIT_DOCS)
    rows = features.select(F.col(key).alias("_k"), F.col("features").alias("_f")).join(F.broadcast(picked), "_k").groupBy("_k").agg(F.min("_f").alias("_f"), F.max("_y").alias("_y")).collect()
    rows.sort(key=lambda r: r["_k"])
    return train(np.array([r["_f"] for r in rows], dtype=np.float64).reshape(len(rows), len(NAMES)), np.array([r["_y"] for r in rows], dtype=np.int64))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score and predicted (1 if score >= 0.7).

    Texts are read once: their statistics are kept in the shared folder, where
    fitting and scoring find them. Null texts score as empty ones; a null key is
    held out; repeated rows score alike; without labels of both classes every
    score is 0; an empty table gives no rows.
    """
    features = materialise(measured(docs.select("doc_id", "text")).select("doc_id", "features"), "quality")
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(fit(features, labels)))

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = pickle.loads(sent.value)
        for batch in batches:
            x = np.array(batch.flatten(), dtype=np.float64).reshape(len(batch), len(NAMES))
            yield pa.array(model.score(x) if model else np.zeros(len(batch)), pa.float64())

    return features.withColumn("score", score("features")).select("doc_id", is_held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
