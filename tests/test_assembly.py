"""Likelihoods, repaired grids, samples, feature tables, pairs of samples and mapping, against plain versions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from locusframe.kernels import mixture, numeric
from locusframe.kernels.mixture import Mixture
from locusframe.operators import accessibility as acc
from locusframe.operators import curves, mapping, matrix, pairs, sequence, training

M = Mixture(5.0, 2.0, 40.0, 3.0, 0.1, 0.7)


def nb(k, mu, theta):
    return math.exp(math.lgamma(k + theta) - math.lgamma(theta) - math.lgamma(k + 1) + theta * math.log(theta / (theta + mu)) + k * math.log(mu / (mu + theta)))


def test_log_gamma():
    x = np.concatenate([np.geomspace(1e-6, 1e6, 400), np.arange(1, 20)])
    want = np.array([math.lgamma(v) for v in x])
    assert np.allclose(numeric.log_gamma(x), want, rtol=1e-12, atol=1e-12)


def test_both_values_of_the_likelihood():
    count, n = np.array([0, 1, 30]), np.array([4.0, 2.0, 1.0])
    z = mixture.posteriors(count, M)
    got, ratio = mixture.expected_log_likelihood(count, n, M, z[0], z[1])
    want = 0.0
    for i, (c, k) in enumerate(zip(count, n)):
        p = [M.prob0 * (c == 0), (1 - M.prob0) * M.prob1 * nb(c, M.mu1, M.theta1), (1 - M.prob0) * (1 - M.prob1) * nb(c, M.mu2, M.theta2)]
        share = [x / sum(p) for x in p]
        want -= k * sum(s * math.log(x / s) for x, s in zip(p, share) if x > 0)
        assert abs(ratio[i] + 2 * (math.log(p[2] / share[2]) - math.log(p[1] / share[1]))) < 1e-6
    assert abs(got - want) < 1e-6
    assert abs(mixture.log_likelihood(count, n, M) + got) < 1e-6  # at the posteriors they are the same
    assert np.isfinite(mixture.expected_log_likelihood(count, n, Mixture(5, 2, 40, 3, 0.0, 1.0), np.zeros(3), np.ones(3))[0])


@pytest.mark.parametrize("block", [1 << 16, 7])
def test_grid_in_blocks_and_repair(spark, block):
    top = spark.createDataFrame([(50,)], "top long")
    grid = acc.score_grid(top, M, block=block).orderBy("count").collect()
    assert [r["count"] for r in grid] == list(range(51))
    for r in grid:
        k = r["count"]
        assert abs(r.l1 - math.log(nb(k, M.mu1, M.theta1))) < 1e-9 and abs(r.l2 - math.log(nb(k, M.mu2, M.theta2))) < 1e-9
    scores = [r.score for r in grid]
    cut = min(k for k in range(1, 51) if scores[k] > math.log(2) and scores[k] > scores[k - 1])
    assert acc.cutoff(acc.score_grid(top, M, block=block)).first().cutoff == cut
    low = int(np.argmin(scores))
    fixed = [r.score for r in acc.repaired(acc.score_grid(top, M, block=block), M).orderBy("count").collect()]
    assert np.allclose(fixed, [scores[low] - low + k if k < low else s for k, s in enumerate(scores)])
    counts = spark.createDataFrame([(1, 0.0), (2, float(cut)), (3, 49.6)], "motif_id long, cut_count double")
    calls = {r.motif_id: (r.score, r.accessible) for r in acc.call_sites(counts, M, legacy=True).collect()}
    assert calls[2][1] == 1 and calls[1][1] == 0 and abs(calls[3][0] - scores[50]) < 1e-9


def test_samples_and_finished_tables(spark):
    d = spark.createDataFrame([(i, float(i) if i % 5 else None, "c") for i in range(100)], "motif_id long, x double, chrom string")
    some = spark.range(60).withColumnRenamed("id", "motif_id")
    rows = matrix.finish(d, some, 20, drop=("chrom",)).collect()
    assert len(rows) == 20 and all(r.motif_id < 60 and r.motif_id % 5 for r in rows) and rows[0].asDict().keys() == {"motif_id", "x"}
    assert sorted(map(tuple, rows)) == sorted(map(tuple, matrix.finish(d.repartition(7), some, 20, drop=("chrom",)).collect()))
    assert matrix.take_sample(d, 0).count() == 0 and matrix.take_sample(d, 500).count() == 100
    assert matrix.cut_counts(d, some, 4).count() == 15 and matrix.cut_counts(d, some).count() == 60


def test_sequence_around_sites(spark):
    genome = {"a": "".join(np.random.default_rng(1).choice(list("ACGTacgtN"), 900)), "b": "ACG"}
    chunks = [("a", s + 1, genome["a"][s : s + n]) for s, n in ((0, 10), (10, 500), (510, 0), (510, 390))] + [("b", 1, "ACG")]
    sites = [(0, "a", 1, 5), (1, "a", 440, 450), (2, "a", 890, 899), (3, "a", 5000, 5010), (4, "b", 2, 2), (5, "none", 1, 9)]
    s = spark.createDataFrame(sites, "id long, chrom string, lo long, hi long")
    for piece in (16, 4096):
        got = {r.id: r for r in sequence.with_sequence(s, spark.createDataFrame(chunks, "chrom string, start long, seq string"), 50, piece).collect()}
        for i, c, lo, hi in sites:
            first = max(1, lo - 50)
            assert got[i].seq == genome.get(c, "")[first - 1 : hi + 50] and (got[i].lo, got[i].hi) == (lo - first + 1, hi - first + 1)


def test_evaluation_and_twelve_numbers(spark):
    r = np.random.default_rng(2)
    x = pd.DataFrame({"id": range(400), "a": r.normal(size=400), "b": r.normal(size=400), "same": 1.0})
    x["gs"] = (x.a + 0.3 * r.normal(size=400) > 0.8).astype(int)
    x["acces_score"], x["acces"] = r.random(400), r.integers(1, 3, 400)
    d = spark.createDataFrame(x)
    good = curves.evaluate(d, {"a": 1.0, "b": 0.0, "same": 5.0}, 0.0).first()
    assert good.aupr > 0.8 and good.auroc > 0.9
    z = lambda v: (v - v.mean()) / v.std(ddof=1)
    by_hand = pd.DataFrame({"id": x.id, "score": 0.5 * z(x.a) - z(x.a * x.b), "gs": x.gs})
    assert np.allclose(list(curves.metrics(spark.createDataFrame(by_hand)).first()), list(curves.evaluate(d, {"a": 0.5, "b": 0.0, "a x b": -1.0}, 0.0, products=True).first()))
    rows = pairs.performance_rows("m", "t", d, pairs.LinearModel({"a": 1.0}), pairs.LinearModel({"b": 1.0})).collect()
    assert [(r.model, r.target, r.metric) for r in sorted(rows, key=lambda r: r.metric)] == [("m", "t", k) for k in range(1, 13)]
    alone = curves.metrics(d.select("id", (F.col("acces_score") * F.col("acces")).alias("score"), "gs")).first()
    assert {r.metric: r.value for r in rows}[11] == pytest.approx(alone.auroc)
    assert pairs.similarity_rows("a", "b", d, d, ["a"]) is None
    same = pairs.similarity_rows("b", "a", d, d, ["a"], 20, 50).collect()
    assert [(r.model, r.target, r.feature) for r in same] == [("b", "a", "a")] and same[0].pvalue > 0.05


def test_transferred_weights_and_fitted_values():
    r = np.random.default_rng(3)
    d = pd.DataFrame({"high": [f"h{i}" for i in range(60)], "low": "l", "f": r.integers(0, 2, 60), "g": r.integers(0, 2, 60)})
    d["y"] = d.f - 0.5 * d.g + r.normal(0, 0.1, 60)
    d.loc[:4, "y"], d.loc[5, "y"] = np.nan, -300.0
    out = mapping.fitted_pairs(d, ["f", "g"], 4.685)
    known = d[6:]
    beta, w = mapping.bisquare_fit(known[["f", "g"]].to_numpy(float), known["y"].to_numpy(float), 4.685)
    assert np.allclose(out["weight"][6:], w)
    for i in range(6):  # the weights of pairs with the same two features, by their density's mode
        near = w[((known.f == d.f[i]) & (known.g == d.g[i])).to_numpy()]
        assert out["weight"][i] == pytest.approx(mapping.density_mode(near))
    assert np.allclose(out["fitted"], beta[0] + out["weight"] * (d[["f", "g"]].to_numpy(float) @ beta[1:]))


def pair_inputs(spark, n=12, seed=4):
    r = np.random.default_rng(seed)
    names = [f"s{i:02}" for i in range(n)]
    kind = {s: i % 3 for i, s in enumerate(names)}
    y = [(a, b, m, float(np.clip(0.9 - 0.35 * (kind[a] != kind[b]) + r.normal(0, 0.03), 0.05, 1)) if m == 5 else float(r.uniform(0.4, 0.6)) if m == 9 else 0.9) for a in names for b in names for m in (5, 9, 11)]
    table = [(a, b, int(kind[a] == kind[b]), int(r.integers(0, 2))) for a in names for b in names if a > b]
    return names, kind, spark.createDataFrame(y, "model string, target string, metric int, value double"), spark.createDataFrame(table, "high string, low string, f int, g int")


def test_mapping_of_held_out_samples(spark):
    names, kind, y, table = pair_inputs(spark)
    logs = mapping.weighted(mapping.log_matrix(y), mapping.row_weights(y, 0.95))
    p = table.join(mapping.symmetric(mapping.selected_matrix(y, 0.95)).withColumnRenamed("value", "y"), ["high", "low"], "left")
    cells = mapping.centred(mapping.log_matrix(y))
    held = names[:2]
    c, out = mapping.map_samples(p, cells, ["f", "g"], [8.0, 5.0], 3, 1.0, logs, held)
    rows = {r.target: r for r in out.collect()}
    value = {(r.model, r.target): r.value for r in cells.collect()}
    assert set(rows) == set(names) and c in (8.0, 5.0)
    for t, r in rows.items():
        chosen = r.model.split(",")
        assert r.held_out == (t in held) and not set(chosen) & {*held, t}
        assert all(m == "default" or kind[m] == kind[t] for m in chosen)  # models of the target's own kind are best
        assert r.value == pytest.approx(np.mean([value[m, t] for m in chosen]))
        assert (r.own, r.base) == (pytest.approx(value[t, t]), pytest.approx(value["default", t]))
        known = [m for m in names if m not in held and m != t]
        assert r.best == pytest.approx(max(value[m, t] for m in [*known, "default"])) and any(r.random == pytest.approx(value[m, t]) for m in known)
    # A large gamma makes models fall short of the score alone, a small one never does.
    base = {s: 0.1 for s in names}
    fitted = pd.DataFrame({"high": ["b", "c"], "low": ["a", "a"], "fitted": [0.2, 0.2]})
    assert mapping._chosen(fitted, ["a"], {"b", "c"}, base | {"b": 0.1, "c": 0.15}, 1.0) == [("a", ["c"], 0.2)]
    assert mapping._chosen(fitted, ["a"], {"b", "c"}, {"b": 0.1, "c": 0.15}, 2.0) == [("a", ["default"], 0.2)]
    assert mapping._chosen(fitted, ["a"], {"b", "c"}, {"b": 0.1, "c": 0.1}, 1.0) == [("a", ["b", "c"], 0.2)]
    assert mapping._chosen(fitted, ["z"], {"b"}, {}, 1.0)[0][1] == []


def test_fold_values_are_those_of_the_matrix_without_the_fold(spark):
    names, _, y, _ = pair_inputs(spark)
    logs = mapping.weighted(mapping.log_matrix(y), mapping.row_weights(y, 0.95))
    out = {"s03", "s07"}
    got, base = mapping._training(logs.toPandas(), out)
    rest = logs.where(~F.col("model").isin(*out) & ~F.col("target").isin(*out))
    want = {(r.high, r.low): r.value for r in mapping.symmetric(mapping.thresholded(mapping.centred(rest))).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert base.keys() == set(names) - out


def test_gamma_runs(spark):
    out = mapping.gamma_runs(lambda g: spark.createDataFrame([("t", g * 2)], "target string, v double"), [0.8, 0.9, 1.0])
    assert sorted((r.gamma, r.v) for r in out.collect()) == [(0.8, 1.6), (0.9, 1.8), (1.0, 2.0)]


def test_command_line(spark, capsys):
    from locusframe.__main__ import main

    assert main([]) == 0 and "nearest_gene" in capsys.readouterr().out
    assert main(["no_such_query", "a", "b"]) == 2


def test_sparse_training(spark):
    r = np.random.default_rng(7)
    x = pd.DataFrame({"a": r.normal(3, 2, 800), "b": r.normal(size=800), "c": r.normal(size=800)})
    x["gs"] = ((x.a - 3) / 2 + 0.3 * r.normal(size=800) > 0).astype(int)
    x["id"] = range(800)
    d = spark.createDataFrame(x).union(spark.createDataFrame([(None, 1.0, 1.0, 1, 900)], "a double, b double, c double, gs long, id long"))
    m = training.l1_logistic(d, ["a", "b", "c"], penalty=0.1)
    assert m.weights["a"] > 0.5 and m.weights["b"] == m.weights["c"] == 0
    assert curves.evaluate(d.na.drop(), m.weights, m.intercept).first().auroc > 0.95
    assert set(training.l1_logistic(d, ["a", "b"], products=True).weights) == {"a", "b", "a x a", "a x b", "b x b"}
