import numpy as np
import pytest

from locusframe.llm import hash_search as hs


def brute(ids, x, qid, k=5):
    q = x[ids.index(qid)]
    s = [(-float((v * q).sum() / (np.sqrt((v * v).sum()) * np.sqrt((q * q).sum()))), i) for i, v in zip(ids, x) if i != qid]
    return [(i, -s_) for s_, i in sorted(s)[:k]]


@pytest.mark.parametrize("dims,shard,block", [(64, 16_384, 4096), (64, 300, 7), (12, 500, 4096)])
def test_recall(spark, dims, shard, block, monkeypatch):
    monkeypatch.setattr(hs, "SHARD", shard)
    monkeypatch.setattr(hs, "BLOCK", block)
    r = np.random.default_rng(1)
    x = r.normal(size=(1500, dims)).astype(np.float32)
    x[100:160] = x[100]
    ids = list(range(1500))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, rank int")
    got = {}
    for g in hs.search(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(g.query_id, []).append((g.rank, g.vec_id, g.score))
    hit = 0
    for q in range(0, 1500, 50):
        rows = sorted(got[q])
        assert [k for k, _, _ in rows] == [1, 2, 3, 4, 5]
        want = brute(ids, x.astype(float), q)
        hit += len({i for i, _ in want} & {i for _, i, _ in rows})
    assert hit / 150 >= 0.9
    assert [i for _, i, _ in sorted(got[100])] == [101, 102, 103, 104, 105]


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0, float("inf")]), (0, [0.0, 1.0]), (8, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = hs.search(df, df.where("vec_id % 50 = 0")).collect()
    assert [(g.query_id, g.rank, g.vec_id) for g in got] == [(0, 1, 1)]
    assert hs.search(df.limit(0), df.limit(0)).count() == 0


def test_very_large_and_very_small_components(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1e199]), (2, [1.0, 1.0]), (50, [1e-200, 0.0]), (3, [1e-320, 1e-320])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(g.query_id, g.rank): (g.vec_id, g.score) for g in hs.search(df, df.where("vec_id % 50 = 0")).collect()}
    near = 1 / np.hypot(1, 0.1)
    assert [got[0, k][0] for k in (1, 2, 3, 4)] == [50, 1, 2, 3] and [got[50, k][0] for k in (1, 2, 3, 4)] == [0, 1, 2, 3]
    for q in (0, 50):
        assert np.allclose([got[q, k][1] for k in (1, 2, 3, 4)], [1, near, np.sqrt(0.5), np.sqrt(0.5)], rtol=1e-12)
