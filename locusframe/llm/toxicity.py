"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Settings:
    """max_positive and max_negative bound the labelled sample that is fitted: of each class the rows with the smallest hash of their id."""

    max_positive: int = 2500
    max_negative: int = 5000
    bits: int = 18
    grams: tuple[int, ...] = (4, 5)
    dims: int = 4
    steps: int = 120
    rate: float = 0.2
    decay: float = 1e-6
    seed: int = 7


def words_of(text: str) -> list[str]:
    """The distinct words of a whole text, in lower case and in order."""
    return sorted(set(_WORD.findall(text.lower())))


def subword_bag(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of <word> for each word, and their weights in the average over words of the average over n-grams.

    The weights carry the factor sqrt(number of words): an average shrinks one word's signal by their number, while the
    noise of the others' average shrinks by its root only.
    """
    data = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    word = np.cumsum(data == 60, dtype=np.int32) - 1
    closed = np.concatenate([[0], np.cumsum(data == 62, dtype=np.int32)])
    buckets, of = [], []
    h = data
    for n in range(2, max(s.grams) + 1):
        h = h[:-1] * np.uint32(16777619) + data[n - 1 :]
        if n in s.grams and len(h):
            at = np.flatnonzero(closed[n - 1 : n - 1 + len(h)] == closed[: len(h)])
            x = (h[at] ^ np.uint32(n * 2654435761 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0xC2B2AE35)
            buckets.append((x >> np.uint32(32 - s.bits)).astype(np.int32))
            of.append(word[at])
    of_all = np.concatenate(of) if of else np.zeros(0, np.int32)
    if not len(of_all):
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    counts = np.bincount(of_all, minlength=len(words))
    return np.concatenate(buckets), (1 / (counts[of_all] * np.sqrt(len(words)))).astype(np.float32)


def _merged(buckets: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(buckets):
        return buckets, weights
    order = np.argsort(buckets, kind="stable")
    buckets, weights = buckets[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
    return buckets[first], np.add.reduceat(weights, first)


Bag = tuple[np.ndarray, np.ndarray]


def bag(words: list[str], s: Settings) -> Bag:
    """A document's buckets, each once, and their weights."""
    return _merged(*subword_bag(words, s)) if words else (np.zeros(0, np.int32), np.zeros(0, np.float32))


def fit(documents: list[list[str]], labels: list[int], s: Settings) -> tuple[np.ndarray, float]:
    """Trains on the words of documents; see fit_bags()."""
    return fit_bags([bag(d, s) for d in documents], labels, s)


def fit_bags(bags: list[Bag], labels: list[int], s: Settings) -> tuple[np.ndarray, float]:
    """Trains embeddings and softmax together; returns each bucket's share of the logit of label 1, and the bias.

    Everything before the softmax is linear, so a bucket's embedding times (softmax column 1 - column 0) is one number,
    and with two labels the gradient of the embeddings is the outer product of one number a bucket with that difference.
    With one class or no rows the buckets are 0 and the bias gives that class (label 0 without rows). bags is emptied.
    """
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return np.zeros(1 << s.bits, np.float32), 4.0 if len(y) and y[0] > 0 else -4.0
    data = _Sample(bags, y)
    bags.clear()
    rng = np.random.default_rng(s.seed)
    params = [rng.normal(0, 0.05, (1 << s.bits, s.dims)).astype(np.float32), rng.normal(0, 0.5, (s.dims, 2)), np.zeros(2)]
    first, second = [np.zeros_like(p) for p in params], [0.0] * 3
    for t in range(1, s.steps + 1):
        rate = s.rate * (1 - (t - 1) / s.steps)
        for k, d in enumerate(data.gradients(params, s.decay)):
            first[k] = (0.9 * first[k] + 0.1 * d).astype(params[k].dtype)
            second[k] = 0.98 * second[k] + 0.02 * float((d * d).mean())
            params[k] = (params[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.98**t)) + 1e-9)).astype(params[k].dtype)
    e, w, b = params
    return (e @ (w[:, 1] - w[:, 0])).astype(np.float32), float(b[1] - b[0])


class _Sample:
    """Bags in one array, labels, and weights by which both labels count alike."""

    def __init__(self, bags: list[Bag], y: np.ndarray):
        self.y, self.sizes = y, np.array([len(b) for b, _ in bags])
        self.idx, self.weight = np.concatenate([b for b, _ in bags]), np.concatenate([w for _, w in bags])
        self.ends = np.concatenate([[0], np.cumsum(self.sizes)])
        self.balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)

    def gradients(self, params: list[np.ndarray], decay: float) -> list[np.ndarray]:
        """Of the weighted cross-entropy plus decay / 2 of the squares of embeddings and softmax, in parts of rows so that a pass needs little room."""
        e, w, _ = params
        u = w[:, 1] - w[:, 0]
        g, total = np.zeros(len(e)), 0.0
        shares = e @ u
        for i in range(0, len(self.y), 256):
            j = min(i + 256, len(self.y))
            at = slice(self.ends[i], self.ends[j])
            row = np.repeat(np.arange(j - i), self.sizes[i:j])
            z = np.bincount(row, weights=self.weight[at] * shares[self.idx[at]], minlength=j - i) + params[2][1] - params[2][0]
            r = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - self.y[i:j]) * self.balance[i:j]
            g += np.bincount(self.idx[at], weights=self.weight[at] * r[row], minlength=len(e))
            total += float(r.sum())
        dw = e.T @ g
        return [np.outer(g, u) + decay * e, np.stack([-dw, dw], 1) + decay * w, np.array([-total, total])]


def probability(words: list[str], model: tuple[np.ndarray, float], s: Settings) -> float:
    z = model[1]
    if words:
        buckets, weights = subword_bag(words, s)
        z += float(model[0][buckets] @ weights)
    return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def sample(docs: DataFrame, labels: DataFrame, s: Settings, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """(doc_id, label, words) of the fitted sample: per class the ids of smallest hash, each with one text, the least in words if an id repeats in docs.

    Rows without id or label are left out; of several labels of an id the largest counts.
    """
    rated = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    order = (F.xxhash64(F.col("doc_id")), F.col("doc_id"))
    picked = rated.where("label <= 0").orderBy(*order).limit(s.max_negative).unionAll(rated.where("label > 0").orderBy(*order).limit(s.max_positive))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").mapInArrow(_distinct_words, "doc_id long, label int, words string")
    return rows.groupBy("doc_id", "label").agg(F.min("words").alias("words"))


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = [" ".join(words_of(t)) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("label").cast(pa.int32()), pa.array(words, pa.string())], ["doc_id", "label", "words"])


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", label_col: str = "toxic") -> tuple[np.ndarray, float]:
    """The model of a sample of at most max_positive + max_negative documents, fitted in one task; it has 2^bits numbers and a bias."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, y = [], []
        for b in batches:
            bags += [bag(w.split(" ") if w else [], s) for w in b.column("words").to_pylist()]
            y += [int(x > 0) for x in b.column("label").to_pylist()]
        shares, bias = fit_bags(bags, y, s)
        yield pa.RecordBatch.from_arrays([pa.array([shares.tobytes()], pa.binary()), pa.array([bias], pa.float64())], ["shares", "bias"])

    rows = sample(docs, labels, s, id_col, label_col).repartition(1).sortWithinPartitions("doc_id")
    made = rows.mapInArrow(run, "shares binary, bias double").collect()
    return (np.frombuffer(made[0].shares, np.float32), made[0].bias) if made else fit_bags([], [], s)


def score(docs: DataFrame, model: tuple[np.ndarray, float], s: Settings = Settings(), keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (default: doc_id) of every document, and score (0 to 1).

    Null and empty texts score the bias alone. Null ids, repeated rows and ties are scored like any row; columns
    named score in keep are replaced by this one; an empty df gives an empty result. The model has a fixed size.
    """
    keep = [c for c in keep or ["doc_id"] if c != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = docs.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1)
            scores = [probability(words_of(t.as_py() or ""), shared.value, s) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], [*keep, "score"])

    return docs.select(*keep, F.col("text").alias("__scored_text")).mapInArrow(run, fields.add("score", "double"))
