"""Nearest neighbours by multi-index hashing: learned rotated binary codes, an index for each substring, pigeonhole probing, exact rerank."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of the sample that codes and radius are learned on; rows of an index shard and of a query block, about.
SAMPLE, SHARD, BLOCK = 8192, 16_384, 4096
#: The share of true neighbours in the sample that the radius is to hold.
AIM = 0.95
_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


@dataclass
class Codes:
    """Centre and rotation of the binary codes, the bits of each substring, and the Hamming radius."""

    centre: np.ndarray
    rotation: np.ndarray
    widths: list[int]
    radius: int

    def substrings(self, x: np.ndarray) -> list[np.ndarray]:
        bits = (x - self.centre) @ self.rotation > 0
        out, at = [], 0
        for w in self.widths:
            out.append(bits[:, at : at + w] @ (1 << np.arange(w)))
            at += w
        return out

    def radii(self) -> list[int]:
        """Radius of each substring: a code within the whole radius is within it in one substring at least; -1 where none is needed."""
        m = len(self.widths)
        a, r = divmod(self.radius, m)
        return [a if j <= r else a - 1 for j in range(m)]


def learn(sample: np.ndarray, k: int = 5, max_bits: int = 64, rounds: int = 25, seed: int = 5) -> Codes:
    """Principal axes, turned so that signs lose least (iterative quantisation); the radius holds AIM of the sample's own nearest pairs."""
    x = scaled(sample)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    bits = min(max_bits, x.shape[1])
    centre = x.mean(axis=0)
    _, _, axes = np.linalg.svd(x - centre, full_matrices=False)
    basis = np.eye(x.shape[1])[:, :bits]
    basis[:, : min(bits, len(axes))] = axes[:bits].T
    z = (x - centre) @ basis
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(z @ turn > 0, 1.0, -1.0).T @ z)
        turn = (u @ v).T
    m = max(1, bits // 8)
    widths = [len(p) for p in np.array_split(np.arange(bits), m)]
    signs = z @ turn > 0
    step = max(1, len(x) // 256)
    far = []
    for i in range(0, len(x), step):
        near = x @ x[i]
        near[i] = -np.inf
        top = np.argsort(-near)[:k]
        far.append((signs[top] != signs[i]).sum(axis=1))
    distances = np.sort(np.concatenate(far)) if len(x) > 1 else np.zeros(1)
    return Codes(centre, basis @ turn, widths, int(distances[min(len(distances) - 1, int(ceil(AIM * len(distances))))]))


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component to 0.5 or more and below 1: cosines stay as they are, and no square overflows or vanishes."""
    _, exponent = np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0.0))
    return np.ldexp(x, -exponent)


def _vectors(t: pa.Table, dims: int) -> np.ndarray:
    return scaled(t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))


class Index:
    """One shard: for each substring the rows sorted by its value, and the whole codes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: Codes):
        self.ids, self.x, self.codes = ids, x, codes
        self.norms = np.sqrt((x * x).sum(axis=1))
        self.subs = codes.substrings(x / self.norms[:, None])
        self.order = [np.argsort(s, kind="stable") for s in self.subs]
        self.starts = [np.searchsorted(s[o], np.arange((1 << w) + 1)) for s, o, w in zip(self.subs, self.order, codes.widths, strict=True)]

    def probe(self, query: list[int]) -> np.ndarray:
        """All rows whose code is within the radius of the query's."""
        seen = np.zeros(len(self.ids), bool)
        for j, r in enumerate(self.codes.radii()):
            if r < 0:
                continue
            values = np.flatnonzero(np.bitwise_count(np.arange(1 << self.codes.widths[j]) ^ query[j]) <= r)
            a, n = self.starts[j][values], self.starts[j][values + 1] - self.starts[j][values]
            at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            seen[self.order[j][at]] = True
        rows = np.flatnonzero(seen)
        far = sum(np.bitwise_count(s[rows] ^ q).astype(np.int64) for s, q in zip(self.subs, query, strict=True))
        return rows[far <= self.codes.radius]

    def nearest(self, qid: int, q: np.ndarray, code: list[int], k: int) -> list[tuple[int, int, float]]:
        """The k nearest of the probed rows; of all rows of the shard if the radius holds fewer."""
        rows = self.probe(code)
        rows = rows[self.ids[rows] != qid]
        if len(rows) < k:
            rows = np.flatnonzero(self.ids != qid)
        scores = (self.x[rows] * q).sum(axis=1) / (self.norms[rows] * np.sqrt((q * q).sum()))
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return [(qid, int(self.ids[rows[b]]), float(scores[b])) for b in best]


def _searcher(codes, dims: int, k: int) -> Callable:
    def run(key: tuple, shard: pa.Table, queries: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if len(shard) and len(queries):
            index = Index(shard.column("id").to_numpy(), _vectors(shard, dims), codes.value)
            q = _vectors(queries, dims)
            norms = np.sqrt((q * q).sum(axis=1))
            subs = codes.value.substrings(q / norms[:, None])
            for i, qid in enumerate(queries.column("id").to_pylist()):
                rows += index.nearest(qid, q[i], [int(s[i]) for s in subs], k)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 3, _OUT, strict=True)], schema=_OUT)

    return run


def search(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score (cosine, double precision) of each query's k nearest rows of df found, ties to the smaller id.

    Rows without id, with null or empty vectors, null or non-finite components or length 0, and rows whose vectors have
    another number of components than most of the sample take no part. Rows with a query's own id aren't its
    neighbours. A repeated id is one query (with its least vector), but as many neighbours as rows. Other columns are
    not carried. Empty tables give an empty result; fewer rows than k give all of them.

    Codes and radius are learned on the SAMPLE rows of smallest hash. Shards of the index hold about SHARD rows by hash
    of the id, query blocks about BLOCK queries; each pair is one task's work and leaves k rows a query.
    """

    def clean(d: DataFrame) -> DataFrame:
        v = F.col("vector")
        bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
        return d.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(~bad & F.exists(v, lambda e: e != 0))

    rows, asked = clean(df), clean(queries)
    spark = df.sparkSession
    taken = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    sizes = [len(r.vector) for r in taken]
    dims = max(set(sizes), key=lambda n: (sizes.count(n), n)) if sizes else 1
    sample = np.array([r.vector for r in sorted(taken) if len(r.vector) == dims]) if sizes else np.ones((1, 1))
    codes = spark.sparkContext.broadcast(learn(sample, k))
    rows, asked = rows.where(F.size("vector") == dims), asked.where(F.size("vector") == dims).groupBy("id").agg(F.min("vector").alias("vector"))
    n, q = rows.count(), asked.count()
    shards, blocks = max(1, ceil(n / SHARD)), max(1, ceil(q / BLOCK))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("part", each(blocks))
    right = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("shard", each(shards))
    found = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(_searcher(codes, dims, k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
