"""Quality classifier: cumulative-link ordinal regression on graded ratings, over hashed text features."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_UPPER, _LETTERS, _DIGITS = re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"[^\W\dA_]+"), re.compile(r"\d+")


@dataclass(frozen=True)
class Settings:
    """rows_per_grade bounds the fitted sample: of each grade the rows with the smallest hash of their id."""

    rows_per_grade: int = 3000
    bits: int = 16
    steps: int = 150
    rate: float = 0.05
    decay: float = 1e-4


@dataclass
class Model:
    """P(grade > k) = 1 / (1 + exp(thresholds[k] - weights . x)); grades are the sorted rating values."""

    grades: list[float]
    weights: np.ndarray
    thresholds: np.ndarray


def features(text: str, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a whole text: shares of token shapes, distinct words, and steps of a few ratios."""
    words = text.split()
    n = len(words)
    found: dict[str, float] = {"bias of length %d" % int(np.log2(n + 1)): 0.5}
    if n:
        shapes = Counter(_DIGITS.sub("0", _LETTERS.sub("a", _UPPER.sub("A", text))).split())
        for shape, k in shapes.items():
            found["s" + shape] = float(np.sqrt(k / n))
        counts = Counter(words)
        each = 1 / np.sqrt(len(counts))
        for w in counts:
            found["w" + w.lower()] = each
        for name, ratio in (("distinct", len(counts) / n), ("top", max(counts.values()) / n), ("upper", sum(map(str.isupper, words)) / n), ("size", min(1.0, len(text) / n / 20)), ("lines", min(1.0, 8 * text.count("\n") / n))):
            found[f"{name} {int(ratio * 10)}"] = 1.0
    idx = np.array([zlib.crc32(k.encode("utf-8", "surrogatepass")) >> (32 - s.bits) for k in found], np.int32)
    return idx, np.array(list(found.values()), np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], ratings: list[float], s: Settings) -> Model:
    """Maximum likelihood with a ridge penalty, by Adam; thresholds stay ordered as a first one and exponentiated steps.

    Without ratings the one grade is 0; with one grade everything has that grade.
    """
    grades = sorted(set(ratings)) or [0.0]
    k = len(grades) - 1
    if not k:
        return Model(grades, np.zeros(1 << s.bits), np.zeros(0))
    y = np.searchsorted(grades, ratings)
    weight = (1 / np.bincount(y))[y] / len(grades)  # each grade counts alike
    row = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    idx, val = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows])
    params = [np.zeros(1 << s.bits), np.zeros(1), np.zeros(k - 1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, s.steps + 1):
        w, base, steps = params
        theta = np.concatenate([[-np.inf], base[0] + np.concatenate([[0.0], np.cumsum(np.exp(steps))]), [np.inf]])
        z = np.bincount(row, weights=val * w[idx], minlength=len(y))
        hi, lo = _sigmoid(theta[y + 1] - z), _sigmoid(theta[y] - z)
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        dz = weight * (d_hi - d_lo)  # of minus the log likelihood, by the score
        d_theta = np.zeros(k + 2)
        np.add.at(d_theta, y + 1, -weight * d_hi)
        np.add.at(d_theta, y, weight * d_lo)
        tail = np.cumsum(d_theta[1:-1][::-1])[::-1]
        grads = [np.bincount(idx, weights=val * dz[row], minlength=1 << s.bits) + s.decay * w, tail[:1], tail[1:] * np.exp(steps)]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            params[i] = params[i] - s.rate * (1 - (t - 1) / s.steps) * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.99**t)) + 1e-9)
    w, base, steps = params
    return Model(grades, w, base[0] + np.concatenate([[0.0], np.cumsum(np.exp(steps))]))


def tails(model: Model, idx: np.ndarray, val: np.ndarray) -> np.ndarray:
    """P(grade > grades[k]) for each k but the last."""
    return _sigmoid(float(model.weights[idx] @ val) - model.thresholds)


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", rating_col: str = "quality") -> Model:
    """Fits the ratings of a bounded sample (see Settings) in one task; the driver gets the model.

    Rows without id or rating are left out. Of several ratings of an id the median counts, of two middle ones the lower,
    so every grade is a rating that occurs. Of rows of docs that repeat an id one counts, that with the least features.
    """
    rated = labels.where(F.col(id_col).isNotNull() & F.col(rating_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.expr(f"percentile_disc(0.5) within group (order by cast(`{rating_col}` as double))").alias("rating"))
    grades = sorted(r.rating for r in rated.select("rating").distinct().limit(101).collect())
    if len(grades) > 100:
        raise ValueError("ratings are to have at most 100 grades")
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = None
    for g in grades:
        part = rated.where(F.col("rating") == g).orderBy(*order).limit(s.rows_per_grade)
        picked = part if picked is None else picked.unionAll(part)
    if picked is None:
        return fit([], [], s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [features(t, s) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("rating"), pa.array([i.tobytes() for i, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())], ["doc_id", "rating", "idx", "val"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(picked), "doc_id").mapInArrow(run, "doc_id long, rating double, idx binary, val binary")
    rows = rows.groupBy("doc_id", "rating").agg(F.min(F.struct("idx", "val")).alias("x")).select("doc_id", "rating", "x.*")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[0])
        m = fit([(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for _, _, i, v in got], [r[1] for r in got], s)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((list(m.grades), pa.list_(pa.float64())), (m.weights.tobytes(), pa.binary()), (list(m.thresholds), pa.list_(pa.float64())))], ["grades", "weights", "thresholds"])

    made = rows.repartition(1).mapInArrow(fitted, "grades array<double>, weights binary, thresholds array<double>").first()
    return fit([], [], s) if made is None else Model(list(made.grades), np.frombuffer(made.weights, np.float64), np.array(made.thresholds))


def score(docs: DataFrame, model: Model, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade and tail_probability (of the highest grade) for each row of docs.

    Null texts count as empty, which has features of its own; null ids, repeated rows and ties are rows like any other;
    other columns of docs are not carried. An empty docs gives an empty result. The model's size is fixed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        gaps = np.diff(m.grades)
        for b in batches:
            out = [tails(m, *features(t.as_py() or "", s)) for t in b.column(1)]
            grade = [m.grades[0] + float(gaps @ p) for p in out]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(grade, pa.float64()), pa.array([float(p[-1]) if len(p) else 1.0 for p in out], pa.float64())], ["doc_id", "expected_grade", "tail_probability"])

    return picked.mapInArrow(run, picked.select("doc_id").schema.add("expected_grade", "double").add("tail_probability", "double"))
