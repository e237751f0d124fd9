"""Vector codes by a codebook for each part, learned by filtering Lloyd: k-d trees with cached sums are built once over blocks of rows and filtered in each round."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm import kd_filter
from locusframe.llm.common import final_table, materialise

#: Rows of a block, at most; its components, about; rows of label sums that are broadcast.
BLOCK_ROWS, BLOCK_VALUES, BROADCAST_LABELS = 4096, 1 << 18, 500_000


def finite(c: str) -> Column:
    """Whether a vector is there and has finite components only."""
    return F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole(values: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(values.astype(np.float64) * scale).astype(np.int64)


def _builder(dims: int, parts: int, scale: float) -> Callable:
    rows = max(1, min(BLOCK_ROWS, BLOCK_VALUES // dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                some = b.slice(at, rows)
                n = some.num_rows
                ints = whole(some.column(2).flatten().to_numpy(zero_copy_only=False), scale).reshape(n, parts, -1)
                packed = kd_filter.pack([kd_filter.build(ints[:, k]) for k in range(parts)])
                lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), some.column(i)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*lists, *[pa.array([x], pa.binary()) for x in packed]], ["ids", "labels", "points", "order", "boxes"])

    return run


def _trees(b: pa.RecordBatch, parts: int) -> Iterator[tuple[int, int, list[kd_filter.Tree]]]:
    """Row, number of vectors and trees of each block of a batch."""
    for i in range(b.num_rows):
        n, points, order, boxes = (b.column(k)[i].as_py() for k in range(4))
        yield i, n, kd_filter.unpack(n, parts, points, order, boxes)


def _summer(books: np.ndarray) -> Callable:
    parts, entries, dims = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            for _, _, trees in _trees(b, parts):
                for k, tree in enumerate(trees):
                    s, c, _, _ = kd_filter.assign(tree, books[k], False)
                    sums[k] += s
                    counts[k] += c
        part, entry = np.nonzero(counts)
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x, dims).astype(np.int32)) for x in (part, entry)] + [pa.array(np.tile(np.arange(dims, dtype=np.int32), len(part))), pa.array(sums[part, entry].ravel()), pa.array(np.repeat(counts[part, entry], dims))], ["part", "entry", "dim", "s", "n"])

    return run


def _coder(books: np.ndarray) -> Callable:
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, n, trees in _trees(b, parts):
                codes, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
                for k, tree in enumerate(trees):
                    codes[:, k] = kd_filter.assign(tree, books[k], True)[2]
                    away = tree.points.astype(np.int64) - books[k][codes[tree.order, k]]
                    error[tree.order] += (away * away).sum(1)
                text = codes.tobytes().hex()
                ids, labels = b.column(4)[i].values, b.column(5)[i].values
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([text[2 * parts * j : 2 * parts * (j + 1)] for j in range(n)]), pa.array(error)], ["id", "label", "code", "error"])

    return run


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256) of each vector: what its parts' nearest codebook entries are.

    Components become floor(scale * x). Each of the equal consecutive parts has a codebook, at first that part of the
    vectors with the least ids (equal ids by vector, null ids last). A round replaces each entry by the floor of the
    mean of the parts that are nearest to it; nearest is by squared Euclidean distance, ties to the lower entry, and
    unused entries stay. code has two hex digits a part, error the squared distances, label_error its sum over equal
    labels (null is one). All is exact, as numbers are whole.

    Vectors that are null or have null or non-finite components are left out. Those of another length than the first
    that the parts divide, or so large that error could leave 64 bits, stay with null code and error. Repeated rows stay.
    An empty df gives an empty result.

    Trees of a block and part, with boxes, sums and counts, are a table in the shared folder, which each round reads.
    Tasks give back a sum an entry; the driver sees as many numbers as the codebooks have.
    """
    return final_table(lambda: materialise(_compressed(vectors, parts, entries, rounds, scale, id_col, vector_col, label_col), "codes"))


def _compressed(vectors: DataFrame, parts: int, entries: int, rounds: int, scale: float, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).where(finite("v"))
    first = rows.where((F.size("v") > 0) & (F.size("v") % parts == 0)).orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v").alias("n")).first()
    dims = first.n if first else parts
    most = int(((2**63 - 1) / (4 * dims)) ** 0.5) - 1
    usable = (F.size("v") == dims) & (F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))) * scale < most)
    good = rows.where(usable)
    start = good.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()  # the size of the codebooks
    books = whole(np.array([r.v for r in start], np.float64).reshape(len(start), dims), scale).reshape(len(start), parts, dims // parts).transpose(1, 0, 2)
    label = vectors.schema[label_col].dataType.simpleString()
    kind = vectors.schema[id_col].dataType.simpleString()
    blocks = materialise(good.mapInArrow(_builder(dims, parts, scale), f"ids array<{kind}>, labels array<{label}>, points binary, order binary, boxes binary"), "blocks")
    trees = [F.size("ids").alias("n"), "points", "order", "boxes"]
    for _ in range(rounds if start else 0):
        sums = blocks.select(*trees).mapInArrow(_summer(books), "part int, entry int, dim int, s long, n long")
        books = books.copy()
        for r in sums.groupBy("part", "entry", "dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).toLocalIterator():  # a row a number of the codebooks
            books[r.part, r.entry, r.dim] = int(r.s) // r.n
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = blocks.select(*trees, "ids", "labels").mapInArrow(_coder(books), f"id {kind}, label {label}, code string, error long")
    coded = materialise(coded.unionAll(rows.where(~usable | usable.isNull()).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))), "coded")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    few = sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    out = coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
