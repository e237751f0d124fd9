import hashlib
import math
import random

import numpy as np
import pytest

from locusframe.llm import kd_filter, vector_codes


def brute(rows, parts=16, entries=64, rounds=2):
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = np.array([[math.floor(256 * float(np.float32(x))) for x in r[1]] for r in kept]).reshape(len(kept), parts, -1)
    books = ints[:entries].transpose(1, 0, 2).copy()
    nearest = lambda: np.stack([((ints[:, k, None] - books[k][None]) ** 2).sum(2).argmin(1) for k in range(parts)], 1)
    for _ in range(rounds):
        code = nearest()
        for k in range(parts):
            for e in range(books.shape[1]):
                if (code[:, k] == e).any():
                    mine = ints[code[:, k] == e, k]
                    books[k, e] = [int(s) // len(mine) for s in mine.sum(0)]
    code = nearest()
    error = [int(sum(((ints[i, k] - books[k, code[i, k]]) ** 2).sum() for k in range(parts))) for i in range(len(kept))]
    by_label = {}
    for r, e in zip(kept, error):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    return sorted((str(r[0]), "".join(f"{c:02x}" for c in code[i]), error[i], by_label[r[2]], digest) for i, r in enumerate(kept))


def compare(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(parts)
    got = sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compress(df).collect())
    assert got == brute(rows)
    return got


def test_codes_equal_plain_lloyd(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 200)
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 0.13) for _ in range(32)], r.choice([0, 1, 2, None])) for i in range(900)]
    rows += [(900, None, 1), (901, [float("nan")] * 32, 1), (902, [None] * 32, 1), (903, [float("inf")] * 32, 1), (None, [0.5] * 32, 7)]
    rows += [rows[3], rows[70]] + [(2000 + i, rows[80][1], 3) for i in range(300)]  # repeated rows, and one vector for a third of all
    compare(spark, rows)
    compare(spark, rows, 9)


def test_ties_and_few_vectors(spark):
    r = random.Random(2)
    compare(spark, [(i, [float(r.randint(-1, 1)) / 128 for _ in range(16)], i % 2) for i in range(400)])
    compare(spark, [(i, [float(i)] * 16, None) for i in range(5)])


def test_other_lengths_empty_table_and_extra_columns(spark):
    schema = "vec_id long, embedding array<double>, label int, code string, part int"
    rows = [(1, [1.0] * 16, 0, "x", 1), (2, [1.0] * 48, 0, "x", 1), (3, [], 0, "x", 1), (4, [1e300] * 16, 0, "x", 1), (0, [1.0] * 7, 0, "x", 1)]
    got = {r.vec_id: r for r in vector_codes.compress(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].code == "00" * 16 and got[1].error == 0 and all(got[i].code is None and got[i].error is None for i in (0, 2, 3, 4))
    assert vector_codes.compress(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 16, 17, 33, 40, 500, 4096])
@pytest.mark.parametrize("dims", [1, 4])
def test_filtering_assigns_as_brute_force(n, dims):
    r = np.random.default_rng(n)
    for points in (np.floor(r.normal(0, 32, (n, dims))), r.integers(-2, 3, (n, dims)), np.full((n, dims), 7)):
        points = points.astype(np.int64)
        entries = points[r.permutation(n)[:64]]
        tree = kd_filter.unpack(n, 1, *kd_filter.pack([kd_filter.build(points)]))[0]
        sums, counts, codes, _ = kd_filter.assign(tree, entries, True)
        want = ((points[:, None] - entries[None]) ** 2).sum(2).argmin(1)
        assert (codes == want).all() and (counts == np.bincount(want, minlength=len(entries))).all()
        assert all((sums[e] == points[want == e].sum(0)).all() for e in range(len(entries)))
    spread = np.repeat(1000 * np.arange(32), 128)[:, None] + r.integers(0, 9, (4096, dims))
    assert kd_filter.assign(kd_filter.build(spread), spread[::128], False)[3] == 0  # clear clusters go as whole subtrees
