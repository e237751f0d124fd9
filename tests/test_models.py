import math
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from locusframe.kernels import mixture, numeric
from locusframe.kernels.mixture import Mixture
from locusframe.operators import accessibility as acc
from locusframe.operators import footprint, mapping, pairs, similarity

TRUE = Mixture(10, 3, 98, 5, 0.01, 0.89)


def test_fit_recovers_simulated_parameters(spark):
    hist = acc.histogram(acc.simulate_counts(spark, 10_000, TRUE, seed=3))
    rows = hist.collect()
    c, n = np.array([r["count"] for r in rows], float), np.array([r["n"] for r in rows], float)
    m, seen = mixture.fit(c, n, Mixture(2, 1, 60, 1, 0.1, 0.5))
    assert all(b >= a - 1e-6 for a, b in zip(seen, seen[1:]))
    assert abs(m.mu1 - 10) < 0.6 and abs(m.mu2 - 98) < 6 and abs(m.prob1 - 0.89) < 0.02 and abs(m.theta1 - 3) < 0.4
    fits = acc.fit_bootstraps(hist, 3, 4000, Mixture(2, 1, 60, 1, 0.1, 0.5), tolerance=1e-6)
    assert fits.count() == 3 and abs(acc.mean_parameters(fits).first().mu1 - 10) < 1


def test_grid_agrees_with_gamma_functions(spark):
    top = spark.createDataFrame([(300,)], "top long")
    got = np.array([r.score for r in acc.score_grid(top, TRUE).orderBy("count").collect()])
    assert np.abs(got - mixture.score_grid(300, TRUE)).max() < 1e-8


def test_no_count_above_the_cutoff(spark):
    counts = spark.createDataFrame([(1, 0.0), (2, 1.0)], "motif_id long, cut_count double")
    assert {r.accessible for r in acc.call_sites(counts, TRUE).collect()} == {None}


def test_simulation_is_the_same_on_any_partitioning(spark):
    a = acc.simulate_counts(spark, 5000, TRUE, chunk=1000).repartition(3).orderBy("id").collect()
    assert a == acc.simulate_counts(spark, 5000, TRUE, chunk=1000).orderBy("id").collect() and sum(r["count"] == 0 for r in a) >= 50


def test_distributions():
    k = np.arange(12)
    exact = np.cumsum([1, 10, 45, 120, 210, 252, 210, 120, 45, 10, 1]) / 1024
    assert np.allclose(numeric.binomial_cdf(k[:11], 10, 0.5), exact) and numeric.binomial_cdf(-1, 10, 0.5) == 0 and numeric.binomial_cdf(11, 10, 0.5) == 1
    assert abs(numeric.gamma_q(0.5, 3.841458820694124 / 2) - 0.05) < 1e-9 and abs(numeric.gamma_q(5, 2.0) - 0.947346982656289) < 1e-9
    assert numeric.ks_statistic(np.array([1, 2, 3]), np.array([4, 5])) == 1.0 and numeric.kolmogorov_p(0.0, 5, 5) == 1.0
    assert numeric.chi_square(np.array([[10, 20], [20, 10]]))[0] == pytest.approx(20 / 3)


def test_bisquare_ignores_outliers():
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 2))
    y = 1 + x @ [2, -1] + r.normal(0, 0.1, 200)
    y[:20] += 50
    beta, w = numeric.bisquare_fit(x, y)
    assert np.abs(beta - [1, 2, -1]).max() < 0.1 and (w[:20] == 0).all()


def test_density_mode_and_q_values():
    assert abs(numeric.density_mode(np.array([0, 5, 5.1, 4.9, 5.0, 9])) - 5) < 0.3 and numeric.density_mode([3.0]) == 3.0
    q = numeric.tail_q_values(np.array([0.001, 0.01, 0.5, 0.9]), np.array([50, 20, 15, 15]))
    assert (np.diff(q) >= 0).all() and (q <= 1).all()


def test_footprints(spark):
    pos = [(p, 5.0) for p in range(60, 100)] + [(p, 0.0) for p in range(100, 110)] + [(p, 5.0) for p in range(110, 150)]
    signal = spark.createDataFrame([("a", p, v) for p, v in pos], "chrom string, pos long, val double")
    sites = spark.createDataFrame([(1, "a", 100, 109), (2, "a", 5000, 5010)], "id long, chrom string, lo long, hi long")
    first = {r.id: r for r in footprint.footprints(sites, signal, signal, 10.0).collect()}
    again = {r.id: r for r in footprint.footprints(sites.repartition(2), signal.repartition(3), signal, 10.0).collect()}
    assert first == again
    assert first[1]["count"] == 400.0 and first[1].acces == 1.0 and first[1].fps == 1.0
    assert (first[2]["count"], first[2].acces, first[2].fos, first[2].fos_cutoff, first[2].fps) == (0.0, 0.0, 2.0, -1.0, -1.0)


def test_footprints_of_many_shapes(spark, monkeypatch):
    """Sites of mixed lengths, also at the chromosome's start: scores equal plain sums, and tests don't depend on partitions, batches or blocks."""
    r = np.random.default_rng(5)
    val = {int(p): int(v) for p, v in zip(r.permutation(900)[:600], r.integers(1, 9, 600))}
    sites = [(i, "a", lo, lo + int(r.integers(4, 12))) for i, lo in enumerate([0, 3, 9, *r.integers(20, 860, 40).tolist()])]
    signal = spark.createDataFrame([("a", p, float(v)) for p, v in val.items()], "chrom string, pos long, val double")
    d = spark.createDataFrame(sites, "id long, chrom string, lo long, hi long")
    for stranded, factor in ((False, footprint.FLANK), (True, footprint.STRANDED_FLANK)):
        plus, minus = (signal.where("pos % 2 = 0"), signal.where("pos % 2 = 1")) if stranded else (signal, signal)
        make = lambda k, s=stranded, f=factor, a=plus, b=minus: {x.id: x for x in footprint.footprints(d.repartition(k), a, b, 1.0, f, stranded=s).collect()}
        got = make(1)
        assert got == make(4) and len(got) == len(sites)
        for i, _, lo, hi in sites:
            flank = int(np.floor(factor * (hi - lo + 1) + 0.5))
            fl, fr, fos = max(0, lo - flank), hi + flank, 1.0
            for odd, a, b in ((0, fl, hi), (1, lo, fr)):
                v = lambda p, odd=odd: val.get(p, 0) if not stranded or p % 2 == odd else 0
                n, k, q = sum(v(p) + v(p + 1) for p in range(a, b)), sum(v(p) for p in range(lo, hi + 1)), (hi - lo + 1) / (b - a + 1)
                fos *= min(1.0, sum(math.comb(n, j) * q**j * (1 - q) ** (n - j) for j in range(min(k, n) + 1)))
            assert got[i].acces == 1.0 and abs(got[i].fos - fos) < 1e-9 and got[i].fps == float(got[i].fos <= got[i].fos_cutoff)
    b = pd.DataFrame({"id": [1, 2, 3], "lo": [50, 150, 250], "hi": [59, 159, 259], "fl": [32, 132, 232], "fr": [77, 177, 277], "cent": 9.0, "cent_r": 9.0, "count": 50.0})
    for c in ("p", "n"):
        b[f"{c}_at"], b[c] = [np.arange(30, 80), None, np.arange(240, 260)], [r.integers(0, 5, 50).astype(float), None, np.ones(20)]
    one = footprint._tests(b, 9, 18, 18, True, 1)
    monkeypatch.setattr(footprint, "BLOCK", 100)
    for part in (b, b.iloc[[2, 1, 0]]):
        assert footprint._tests(part, 9, 18, 18, True, 1).sort_values("id").reset_index(drop=True).equals(one)
    assert footprint._tests(b.iloc[[1]], 9, 18, 18, True, 1).iloc[0].tolist() == one.iloc[1].tolist()


def test_binomial_probabilities_of_many_cuts():
    """Probabilities that don't walk through all counts are those that do, for few and many cuts, at and beyond both ends."""
    for n in (0, 1, 7, 300, 40_000):
        for p in (0.0, 0.05, 0.31, 0.9, 1.0):
            k = np.unique(np.clip(np.concatenate([[-1, 0, 1, n - 1, n, n + 3], n * p + np.sqrt(n + 1) * np.arange(-9, 9)]), -1, n + 3))
            assert np.allclose(numeric.binomial_cdfs(k, np.full(len(k), n), p), numeric.binomial_cdf(k, n, p), rtol=1e-7, atol=1e-11)
    assert 0.49 < float(numeric.binomial_cdfs(np.array([3e8]), np.array([1e9]), 0.3)[0]) < 0.51


def test_footprint_limit_is_that_of_all_shuffles():
    """Leaving out shuffles that others undercut on both sides keeps the fifth smallest product, with ties and without cuts too."""
    r = np.random.default_rng(8)
    a, b = r.integers(0, 30, (40, 500)).astype(float), r.integers(0, 60, (40, 500)).astype(float)
    a[0], b[0], a[1], b[2] = 0.0, 0.0, 4.0, 7.0
    n, m = a.max(axis=1) * 2, b.max(axis=1) * 2
    every = np.stack([numeric.binomial_cdfs(x, u, 0.3) * numeric.binomial_cdfs(y, v, 0.4) for x, y, u, v in zip(a, b, n, m)])
    assert np.allclose(footprint._smallest((a, b), (n, m), (0.3, 0.4)), np.sort(every, axis=1)[:, 4], rtol=1e-12)


def test_footprints_test_a_place_once(spark, monkeypatch):
    """Sites of one place are one test, however many they are, and each gets its row; windows may be wider than a bin."""
    signal = spark.createDataFrame([("a", p, float(p % 7)) for p in range(1, 9000)], "chrom string, pos long, val double")
    sites = spark.createDataFrame([(i, "a", lo, lo + size) for i, (lo, size) in enumerate([(3000, 9), (3000, 9), (2040, 9), (2047, 9), (3000, 3000), (0, 9)] * 2)], "id long, chrom string, lo long, hi long")
    got = {x.id: x for x in footprint.footprints(sites, signal, signal, 1.0).collect()}
    assert sorted(got) == list(range(12)) and all(got[i][1:] == got[i + 6][1:] for i in range(6)) and got[0][1:] == got[1][1:]
    monkeypatch.setattr(footprint, "BIN", 64)
    assert {x.id: x for x in footprint.footprints(sites, signal, signal, 1.0).collect()} == got
    seen = spark.sparkContext.accumulator(0)
    draws = footprint._draws
    monkeypatch.setattr(footprint, "_draws", lambda b, *a: seen.add(len(b)) or draws(b, *a))
    assert footprint.footprints(sites, signal, signal, 1.0).count() == 12 and seen.value <= 6


def test_similarity(spark):
    r = np.random.default_rng(1)
    table = lambda shift: spark.createDataFrame([(float(r.normal(shift)), int(r.integers(0, 3))) for _ in range(300)], "x double, k int")
    same = {p.feature: p for p in similarity.permutation_p(table(0), table(0), ["x", "k", "no"], 100, 100).collect()}
    far = {p.feature: p.pvalue for p in similarity.permutation_p(table(0), table(3), ["x"], 100, 100).collect()}
    assert same["x"].kind == "ks" and same["k"].kind == "chi2" and same["x"].pvalue > 0.1 > far["x"]


def test_similarity_draws_from_all_rows(spark, monkeypatch):
    def table(n, shift=0.0):
        return spark.range(n).select(F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(n) + shift).alias("x"))  # a third of the rows have one value

    got = [similarity.permutation_p(table(30_000), table(2_400), ["x"], 100, 200).first()]
    assert got[0].pvalue > 0.2
    monkeypatch.setattr(similarity, "BUCKET_VALUES", 1_000)
    monkeypatch.setattr(similarity, "GROUP_DRAWS", 1_000)
    got.append(similarity.permutation_p(table(30_000), table(2_400), ["x"], 100, 200).first())
    assert all(p.kind == "ks" and p.pvalue > 0.2 for p in got)
    assert similarity.permutation_p(table(30_000), table(2_400, 0.5), ["x"], 100, 200).first().pvalue < 0.1
    whole = similarity.permutation_p(table(3_000), table(3_000), ["x"], 3_000, 20).first()  # both samples are the whole tables, which are equal
    assert whole.pvalue == 1.0
    empty = similarity.permutation_p(table(30), table(0), ["x"], 10, 10).first()
    assert empty.kind == "ks" and empty.pvalue is None


def test_draws_are_looked_up_in_arrow():
    """A draw costs what its row and value need, not Python objects; a bucket that nothing is drawn from gives nothing."""
    r = np.random.default_rng(4)
    value, n, row = r.permutation(3_000) / 7, r.integers(1, 4, 3_000), [r.integers(0, 3_000, 40_000) for _ in range(10)]
    held = pa.table({"value": value, "n": n})
    drawn = pa.table({"feature": ["x"] * 10, "block": range(10), "sample": ["a"] * 10, "side": [0] * 10, "at": [[0]] * 10, "row": pa.array(row, pa.list_(pa.int64()))})
    drawn = pa.concat_tables([drawn[:3], drawn[3:]])
    tracemalloc.start()
    got = similarity._look_up(drawn, held)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    rows = np.repeat(np.sort(value), n[np.argsort(value)])
    assert all((rows[x] == y).all() for x, y in zip(row, got["value"].to_numpy(), strict=True)) and got.column_names == ["feature", "block", "sample", "side", "at", "value"]
    assert peak < 30 * 400_000
    assert similarity._look_up(drawn[:0], held).num_rows == 0


def test_similarity_of_all_pairs_is_that_of_each(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = [(s, float(np.round(r.normal(i / 3), 1)), int(r.integers(0, 3 + i)), None if s == "c" else float(r.integers(0, 2))) for i, s in enumerate("abcd") for _ in range(200 + 50 * i)]
    data = spark.createDataFrame([*rows, (None, 1.0, 1, 1.0), ("e", 9.0, 9, 9.0)], "sample string, x double, k int, few double")
    asked = spark.createDataFrame([(m, t) for m in "abcd" for t in "abcd" if m >= t] + [("d", "a"), (None, "a"), ("d", "z")], "model string, target string")
    call = lambda: {(p.model, p.target, p.feature): (p.kind, p.n, p.pvalue) for p in similarity.pair_tests(data, asked, ["x", "k", "few"], 60, 150, 1, 90).collect()}
    got = call()
    assert len(got) == 10 * 3 - 1 + 3  # c has no values of few: no row for the pair with itself; z has no rows
    assert got["d", "z", "x"] == ("ks", 0, None) and got["c", "a", "few"] == ("chi2", 0, None) and got["d", "a", "few"][:2] == ("chi2", 90)
    assert [got[m, m, "k"][0] for m in "abcd"] == ["chi2"] * 4 and got["d", "a", "k"][0] == "chi2"
    assert got["d", "a", "x"][2] < 0.1 < min(got[m, m, "x"][2] for m in "abcd") and got["b", "a", "x"][1] == 60
    for m, t in (("b", "a"), ("d", "c"), ("c", "a")):
        one, two = (data.where(F.col("sample") == s).drop("sample") for s in (m, t))
        for p in similarity.permutation_p(one, two, ["x", "k", "few"], 60, 150, 1, 90, names=(m, t)).collect():
            assert (p.kind, p.pvalue) == (got[m, t, p.feature][0], got[m, t, p.feature][2])
    monkeypatch.setattr(similarity, "BLOCK_DRAWS", 4_000)
    monkeypatch.setattr(similarity, "GROUP_DRAWS", 3_000)
    assert call() == got
    with monkeypatch.context() as m:
        m.setattr(similarity, "MAX_PAIRS", 3)
        with pytest.raises(ValueError, match="pairs"):
            call()
    none = similarity.pair_tests(data.limit(0), asked, ["x"], 60, 150)
    assert none.count() == 0 and similarity.pair_tests(data, asked.limit(0), ["x"], 60, 150).count() == 0


def test_statistics_of_all_pairs_are_those_of_each(spark):
    r = np.random.default_rng(8)
    rows = [(s, float(np.round(r.normal(i / 3), 1)), int(r.integers(0, 3 + i)), None if s == "c" else 1.0) for i, s in enumerate("abc") for _ in range(90 + 50 * i)]
    data = spark.createDataFrame([*rows, (None, 1.0, 1, 1.0)], "sample string, x double, k int, few double").repartition(7)
    asked = [("b", "a"), ("c", "a"), ("a", "a"), ("b", "a"), ("c", "z")]
    out = pairs.statistics(data, spark.createDataFrame(asked, "model string, target string"), ["x", "k", "few"])
    got = {(p.model, p.target, p.feature): (p.kind, p.statistic, p.df) for p in out.collect()}
    assert len(got) == out.count() == 11 and got["c", "z", "x"] == ("ks", None, None) and got["c", "a", "few"] == ("chi2", None, None) and got["b", "a", "few"] == ("chi2", 0.0, 0)
    side = lambda m, t, c: data.where(F.col("sample") == m).select(F.col(c).alias("value"), F.lit(0).alias("side")).unionAll(data.where(F.col("sample") == t).select(c, F.lit(1)))
    for m, t in asked[:3]:
        assert got[m, t, "x"][1] == pytest.approx(similarity.ks(side(m, t, "x")).first().ks, abs=1e-12)
        one = similarity.chi2(side(m, t, "k")).first()
        assert got[m, t, "k"] == ("chi2", pytest.approx(one.chi2, abs=1e-9), one.df)
    assert got["a", "a", "x"][1] == 0.0
    assert pairs.statistics(data.limit(0), spark.createDataFrame(asked, "model string, target string"), ["x"]).count() == 0


def test_p_values_of_many_tables_and_samples():
    r = np.random.default_rng(6)
    for levels in range(1, 7):
        a, b = r.integers(0, 5, (200, levels)), r.integers(0, 5, (200, levels))
        a[0], b[1], a[2], b[2] = 0, 0, 0, 0
        want = [numeric.chi_square_p(np.stack(t)) for t in zip(a, b)]
        assert np.allclose(numeric.chi_square_ps(a, b), want, atol=1e-10)
    a, b = np.round(r.normal(size=(300, 40)), 1), np.round(r.normal(0.5, 1, (300, 40)), 1)
    a[:5, 3], b[:3, 7] = np.nan, np.nan
    want = [numeric.kolmogorov_p(numeric.ks_statistic(x, y), 40, 40) for x, y in zip(a, b)]
    assert np.allclose(similarity._ks_ps(a, b), want, atol=1e-12)


def test_cross_validation_has_all_cells_of_its_pairs(spark, monkeypatch):
    r = np.random.default_rng(3)
    names = [f"s{i}" for i in range(6)]
    rows = [(a, b, int(r.integers(0, 2)), float(r.normal())) for a in names for b in names if a > b]
    pairs = spark.createDataFrame(rows, "high string, low string, f int, y double")
    more = [*names, *(f"other{i}" for i in range(20))]
    matrix = spark.createDataFrame([(a, b, 1.0) for a in [*reversed(more), mapping.DEFAULT] for b in reversed(more)], "model string, target string, value double")
    monkeypatch.setattr(mapping, "MAX_PAIRS", len(rows))
    got = mapping.cross_validate(pairs, matrix, ["f"], [8.0], 3).collect()
    assert sorted(x.target for x in got) == names and all(x.value == 1.0 and x.base == 1.0 for x in got)


def test_best_model_ties_and_default(spark):
    # Of equal models the one whose own default is larger; 'default' if that beats the model's value over gamma.
    cells = [("a", "t", 1.0), ("b", "t", 1.0), ("default", "a", 0.95), ("default", "b", 0.5), ("a", "u", 0.1), ("b", "u", 0.05), ("default", "u", -9.0), ("u", "u", 5.0), ("b", "v", 0.6), ("c", "v", 0.6)]
    table = spark.createDataFrame(cells, "model string, target string, value double")
    assert sorted(map(tuple, mapping.best_models(table).collect())) == [("t", "a"), ("u", "default"), ("v", "b")]
    assert sorted(map(tuple, mapping.best_models(table, 1.3).collect())) == [("t", "default"), ("u", "default"), ("v", "default")]
    assert len(mapping.grid()) == 66
