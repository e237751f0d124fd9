import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import curves, matrix, pairs
from locusframe.operators.scan import in_ranges, running


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_running_values_over_keys_that_fill_ranges(spark, many_ranges):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 20 + ["a", "b", None]), i, r.choice([None, *range(-9, 9)])) for i in r.sample(range(9999), 700)]
    df = spark.createDataFrame(rows, "k string, at int, v long")
    got = running(df, ["k"], ["at"], {"n": ("sum", F.lit(1)), "s": ("sum", F.col("v")), "x": ("xor", F.col("v")), "most": ("max", F.col("v")), "least": ("min", F.col("v"))}).collect()
    want, state = {}, {}
    for k, at, v in sorted(rows, key=lambda x: x[1]):
        n, s, x, most, least = state.get(k, (0, None, None, None, None))
        n += 1
        if v is not None:
            s, x, most, least = (v, v, v, v) if s is None else (s + v, x ^ v, max(most, v), min(least, v))
        state[k] = want[k, at] = (n, s, x, most, least)
    assert {(g.k, g["at"]): (g.n, g.s, g.x, g.most, g.least) for g in got} == want
    assert in_ranges(df, ["k", "at"]).select("__part").distinct().count() > 8
    assert running(df.limit(0), ["k"], ["at"], {"n": ("sum", F.lit(1))}).count() == 0


def plain(rows):
    """(aupr, rec10, auroc, fpr1) of (id, score, gs)."""
    rows = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    total, points, hits = sum(g for *_, g in rows), [], 0
    for rank, (_, _, g) in enumerate(rows, 1):
        hits += g
        points.append((hits / rank, hits / total if total else None, (rank - hits) / (len(rows) - total) if len(rows) > total else None))
    full = [(points[0][0], 0.0, 0.0), *points]
    area = lambda x, y: None if any(p[x] is None or p[y] is None for p in points) else sum((b[x] - a[x]) * (a[y] + b[y]) / 2 for a, b in zip(full, full[1:]))
    mean = lambda v: sum(v) / len(v) if v else None
    return area(1, 0), mean([p for p, r, _ in points if r is not None and 0.05 <= r < 0.15]), area(2, 1), mean([r for _, r, f in points if f is not None and 0.005 <= f < 0.015])


def test_curves_of_many_keys(spark, many_ranges):
    r = random.Random(2)
    rows = [(r.choice([1] * 9 + [2, 3, None]), f"id{i}", r.choice([0.5] * 5 + [r.random(), None]), int(r.random() < 0.2)) for i in range(3000)]  # ids are text; one score has most rows
    rows += [(4, "x", 0.1, 1), (5, "x", 0.1, 0), (5, "y", 0.2, 0)]
    got = {g.k: tuple(g)[1:] for g in curves.metrics(spark.createDataFrame(rows, "k int, id string, score double, gs int"), ["k"]).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None}
    for k, values in got.items():
        for a, b in zip(values, plain([x[1:] for x in rows if x[0] == k])):
            assert a == pytest.approx(b) if b is not None else a is None, k
    steps = curves.curve(spark.createDataFrame(rows, "k int, id string, score double, gs int"), keys=["k"]).where("k = 1").collect()
    assert sorted(s["rank"] for s in steps) == list(range(1, sum(x[0] == 1 for x in rows) + 1))


def test_the_input_of_a_curve_is_evaluated_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    d = spark.range(500).select("id", (F.col("id") % 7).cast("double").alias("score"), (F.col("id") % 2).cast("int").alias("gs"))
    curves.metrics(d.mapInArrow(count, d.schema)).collect()
    assert seen.value == 500


def test_area_over_ranges(spark, many_ranges):
    r = np.random.default_rng(3)
    points = [(k, i, float(x), float(y)) for k in ("a", "b") for i, (x, y) in enumerate(r.random((400, 2)))]
    got = {g.k: g.area for g in curves.area(spark.createDataFrame(points, "k string, rank int, x double, y double"), "x", "y", keys=["k"]).collect()}
    for k in "ab":
        p = [(x, y) for kk, _, x, y in points if kk == k]
        assert got[k] == pytest.approx(sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(p, p[1:])))
    whole = curves.area(spark.createDataFrame(points[:400], "k string, rank int, x double, y double"), "x", "y").first().area
    assert whole == pytest.approx(got["a"])


def test_all_pairs_equal_one_pair_at_a_time(spark):
    r = np.random.default_rng(4)
    names, data = ["m0", "m1", "m2"], []
    for s in names:
        data += [(s, i, float(a), float(b), 1.0, float(c), int(r.integers(0, 2)), int(a + r.normal() > 0.7)) for i, (a, b, c) in enumerate(r.normal(size=(80, 3)))]
    df = spark.createDataFrame(data, "sample string, id long, a double, b double, same double, acces_score double, acces int, gs int")
    models = {s: pairs.LinearModel({"a": 1.0 - k, "b": 0.3 * k, "same": 2.0, "a x b": 0.5}, 0.1, True) for k, s in enumerate(names)}
    table = spark.createDataFrame([(s, t, w) for s, m in models.items() for t, w in [*m.weights.items(), (pairs.INTERCEPT, m.intercept), ("unknown", 9.0)]], "model string, term string, weight double")
    asked = spark.createDataFrame([(a, b) for a in names for b in names[:2]] + [("m0", "m0"), ("m0", "nobody"), ("nomodel", "m1")], "model string, target string")
    got = {(g.model, g.target, g.metric): g.value for g in pairs.performance(df, table, asked, ["a", "b", "same"], True).collect()}
    assert len(got) == 8 * 12
    for a in names:
        for b in names[:2]:
            for g in pairs.performance_rows(a, b, df.where(f"sample = '{b}'"), models[b], models[a]).collect():
                assert got[a, b, g.metric] == pytest.approx(g.value), (a, b, g.metric)
    assert all(got["m0", "nobody", k] is None for k in range(1, 13)) and got["nomodel", "m1", 5] is None and got["nomodel", "m1", 1] == got["m0", "m1", 1]


def test_samples_equal_the_sorted_rule(spark, many_ranges):
    r = random.Random(6)
    rows = [(i, r.random()) for i in range(900)] + [(5, 0.5)] * 400 + [(None, 0.25)] * 3  # one id for a third of all
    df = spark.createDataFrame(rows, "motif_id long, x double")
    in_order = sorted(rows, key=lambda x: (hashlib.md5(f"3:{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[0] or 0))
    for n in (0, 1, 17, 640, len(rows) - 1, len(rows), 5000):
        got = matrix.take_sample(df, n, 3).collect()
        assert sorted(str(g.motif_id) for g in got) == sorted(str(x[0]) for x in in_order[:n])
    assert matrix.take_share(df, 4, 3).count() == int(len(rows) / 4 + 0.5) and matrix.take_sample(df.limit(0), 5).count() == 0
