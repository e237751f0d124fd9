import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from locusframe.kernels.numeric import tail_q_values
from locusframe.operators import accessibility, mapping
from locusframe.plans.files import ORACLES, QUERIES
from locusframe.testbed import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df, columns):
    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(float(v), 7) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return sorted((tuple(cell(v) for v in r) for r in df[columns].itertuples(index=False)), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) or name in ORACLES
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        a, b = rows(got, sorted(got.columns)), rows(want, sorted(got.columns))
        assert len(a) == len(b)
        for x, y in zip(a, b):
            assert all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-6 * max(1, abs(p))) for p, q in zip(x, y)), (x, y)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_mapping_and_fit_take_the_whole_job(spark, monkeypatch):
    asked = []
    validate = mapping.cross_validate
    monkeypatch.setattr(mapping, "cross_validate", lambda p, m, f, grid, folds, *a: asked.append((grid, folds)) or validate(p, m, f, grid[:1], folds, *a))
    for name in ("mapping_cross_validation", "sample_mapping"):
        assert QUERIES[name](spark, SF).count() > 0
    assert asked == [(mapping.grid(), 8)] * 2 and len(mapping.grid()) == 66
    size = len(spark.read.parquet(f"{SF}/embeddings.parquet").first()["embedding"])
    assert [r.term for r in QUERIES["l1_fit"](spark, SF).collect()] == [*(f"x{i}" for i in range(size)), "intercept"] and size > 8


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    calls = e.entry(spark)
    assert calls.columns == ["motif_id", "cut_count", "score", "accessible"]
    assert {r[0] for r in calls.select("accessible").distinct().collect()} == {0, 1}


def test_mappable_rows_are_those_above_the_threshold(spark):
    r = np.random.default_rng(3)
    values = np.concatenate([r.random(300), r.random(200) ** 6, np.zeros(5)])
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)] + [(999, None)], "id long, m double")
    distinct, n = np.unique(values, return_counts=True)
    q = dict(zip(distinct, tail_q_values(distinct, n)))
    for threshold in (0.0, 0.3, 0.6, 2.0):
        assert {x.id for x in accessibility.mappable(d, "m", threshold).collect()} == {i for i, v in enumerate(values) if q[v] > threshold}
    assert len({t: 1 for t in q.values()}) > 10
