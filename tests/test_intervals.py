import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import curves, intervals, matrix, reads, sequence


@pytest.mark.parametrize("block", [7, 64, 1 << 18])
def test_range_sum_and_nearest_on_any_block_size(spark, block):
    r = random.Random(block)
    points = [(c, p, r.randint(1, 5)) for c in "ab" for p in r.sample(range(1, 300), 60)]
    windows = [(i, r.choice("abc"), lo, lo + r.randint(0, 80)) for i, lo in enumerate(r.randint(-50, 340) for _ in range(120))]
    got = {x.id: x.total for x in intervals.range_sum(spark.createDataFrame(windows, "id long, chrom string, lo long, hi long"), spark.createDataFrame([(c, p, float(v)) for c, p, v in points], "chrom string, pos long, val double"), block).collect()}
    assert got == {i: float(sum(v for c2, p, v in points if c2 == c and lo <= p <= hi)) for i, c, lo, hi in windows}

    mids = spark.createDataFrame([(i, c, lo) for i, c, lo, _ in windows], "id long, chrom string, mid long")
    targets = spark.createDataFrame([(c, p, f"{c}{p}") for c, p, _ in points], "chrom string, ts long, info string")
    for x in intervals.nearest(mids, targets, block).collect():
        near = sorted((abs(p - x.mid), -p) for c, p, _ in points if c == x.chrom)
        assert (x.info, x.distance) == ((f"{x.chrom}{-near[0][1]}", near[0][0]) if near else (None, None))


@pytest.mark.parametrize("block", [3, 1 << 18])
def test_runs_across_blocks(spark, block):
    values = [1, 1, 1, 1, 2, 2, None, None, 1, 1, 3]
    d = spark.createDataFrame([("a", p, v) for p, v in enumerate(values, 10)] + [("a", 30, 3), ("b", 21, 3)], "chrom string, pos long, val int")
    got = sorted((r.chrom, r.run_start, r.run_end, r.val) for r in intervals.signal_runs(d, block).collect())
    assert got == [("a", 10, 13, 1), ("a", 14, 15, 2), ("a", 16, 17, None), ("a", 18, 19, 1), ("a", 20, 20, 3), ("a", 30, 30, 3), ("b", 21, 21, 3)]


@pytest.mark.parametrize("bins", [3, 50, 10_000])
def test_overlaps_once_each(spark, bins):
    r = random.Random(bins)
    make = lambda n: [(i, r.choice("ab"), lo, lo + r.randint(0, 30)) for i, lo in enumerate(r.randint(-20, 200) for _ in range(n))]
    a, b = make(50), [*make(50), (90, "a", 5, 4)]
    left = spark.createDataFrame(a, "id long, chrom string, lo long, hi long")
    right = spark.createDataFrame([(c, lo, hi, i) for i, c, lo, hi in b], "r_chrom string, r_lo long, r_hi long, r_id long")
    want = sorted((i, j) for i, c, lo, hi in a for j, d, l2, h2 in b if c == d and lo <= h2 and l2 <= hi)
    assert sorted((x.id, x.r_id) for x in intervals.overlaps(left, right, bins).collect()) == want
    assert sorted(x.id for x in intervals.without_overlap(left, right, None, bins).collect()) == sorted({x[0] for x in a} - {i for i, _ in want})


def test_overlaps_of_mixed_lengths(spark):
    r = random.Random(4)
    make = lambda n: [(i, r.choice("ab"), lo, lo + int(10 ** r.uniform(0, 8)) - 1) for i, lo in enumerate(r.randint(1, 200_000_000) if r.random() < 0.5 else r.randint(1, 9000) for _ in range(n))]
    a, b = make(150), [*make(150), (900, "a", 1, 250_000_000), (901, "a", 77, 76)]
    left = spark.createDataFrame(a, "id long, chrom string, lo long, hi long")
    right = spark.createDataFrame([(c, lo, hi, i) for i, c, lo, hi in b], "r_chrom string, r_lo long, r_hi long, r_id long")
    for size in (10, 1024):
        got = intervals.overlaps(left, right, size)
        assert sorted((x.id, x.r_id) for x in got.collect()) == sorted((i, j) for i, c, lo, hi in a for j, d, l2, h2 in b if c == d and lo <= h2 and l2 <= hi)
    assert intervals.overlaps(left.limit(0), right).count() == 0 and intervals.overlaps(left, right.limit(0)).count() == 0


def test_a_long_interval_is_few_rows(spark):
    # Two a level at most, on each side of the join.
    left = spark.createDataFrame([(1, "a", 1, 200_000_000), (2, "a", 5000, 5010)], "id long, chrom string, lo long, hi long")
    right = left.toDF("r_id", "r_chrom", "r_lo", "r_hi")
    levels = {1: 6, 2: 0}
    for row in left.withColumn("level", intervals._level("lo", "hi", 1024)).collect():
        assert row.level == levels[row.id]
    placed = left.select("id", F.size(intervals._placed("lo", "hi", F.array(F.lit(6)), 1024)).alias("n"))
    assert max(x.n for x in placed.collect()) <= 2
    assert sorted((x.id, x.r_id) for x in intervals.overlaps(left, right).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]


@pytest.mark.parametrize("block", [4, 64, 1 << 18])
def test_interval_query_equals_bases_one_by_one(spark, block):
    r = random.Random(block)
    track, base = [], {}
    for c in "ab":
        at = r.randint(0, 30)
        for _ in range(25):
            at += r.choice([0, 0, r.randint(1, 20)])
            end, v = at + r.randint(1, 30), r.choice([r.random(), -1.5, None])
            track.append((c, at, end, v))
            base |= {(c, x): v for x in range(at + 1, end + 1) if v is not None}
            at = end
    windows = [(i, r.choice("abz"), lo, lo + r.randint(-2, 90)) for i, lo in enumerate(r.randint(-20, 700) for _ in range(120))]
    w = spark.createDataFrame(windows, "id long, chrom string, lo long, hi long")
    t = spark.createDataFrame([*track, ("a", 9, 9, 5.0)], "chrom string, start0 long, end0 long, val double")
    for clamp in (True, False):
        got = {x.id: x for x in intervals.interval_query(w, t, clamp, block).collect()}
        assert len(got) == len(windows)
        for i, c, lo, hi in windows:
            covered = [p for d, p in base if d == c]
            if clamp and covered:
                lo, hi = max(lo, min(covered)), min(hi, max(covered) + 1)
            total, size = sum(base.get((c, x), 0.0) for x in range(lo, hi + 1)), max(hi - lo + 1, 0)
            assert got[i].size == size and got[i].total == pytest.approx(total, abs=1e-9) and got[i].average == pytest.approx(total / size if size else 0.0, abs=1e-9)


def test_end_at_start_is_no_overlap(spark):
    # an annotation that ends at a site's start is no hit: its last base is left out
    left = spark.createDataFrame([(1, "a", 10, 20)], "id long, chrom string, lo long, hi long")
    right = lambda start0, end0: spark.createDataFrame([("a", start0 + 1, end0 - 1)], "r_chrom string, r_lo long, r_hi long")
    assert intervals.overlaps(left, right(5, 10)).count() == 0 and intervals.overlaps(left, right(5, 11)).count() == 1
    assert intervals.overlaps(left, right(19, 30)).count() == 1 and intervals.overlaps(left, right(20, 30)).count() == 0


def test_block_mean_gap_is_null_and_before_first_is_zero(spark):
    w = spark.createDataFrame([(1, "a", 1, 5), (2, "a", 10, 13), (3, "a", 30, 33), (4, "a", 12, 21), (5, "z", 1, 2)], "id long, chrom string, lo long, hi long")
    b = spark.createDataFrame([("a", p, 1.0) for p in (*range(10, 15), *range(20, 25))], "chrom string, pos long, val double")
    assert {x.id: x.mean for x in intervals.block_mean(w, b).collect()} == {1: 0.0, 2: 1.0, 3: None, 4: 0.5, 5: 0.0}


def test_interval_mean_clamps_both_ends(spark):
    w = spark.createDataFrame([(1, "a", 1, 12), (2, "a", 15, 40), (3, "a", 500, 600), (4, "z", 1, 2)], "id long, chrom string, lo long, hi long")
    t = spark.createDataFrame([("a", 9, 20, 0.5)], "chrom string, start0 long, end0 long, val double")
    got = {x.id: x.mean for x in intervals.interval_mean(w, t).collect()}
    assert got == {1: 0.5, 2: 0.5 * 6 / 7, 3: 0.0, 4: 0.0}


def test_transcripts_shrinking_then_growing(spark):
    rows = [(1, "t1", "a", "+", 0, 100, "g"), (2, "t2", "a", "+", 5, 50, "g"), (3, "t3", "a", "-", 0, 200, "g"), (4, "t4", "b", "+", 0, 200, "g"), (5, "t5", "a", "+", 0, 10, "h")]
    got = intervals.transcript_starts(spark.createDataFrame(rows, "file_row long, tx string, chrom string, strand string, tx_start long, tx_end long, gene string")).collect()
    assert sorted((x.tx, x.ts, x.te) for x in got) == [("t3", 200, 0), ("t5", 0, 10)]


def test_fiftieth_read_is_the_last(spark):
    rows = [(i, "a", 99, 100, 40, 36, 0) for i in range(51)] + [(60, "a", 83, 100, 40, 36, 0), (61, "a", 83, 100, 29, 36, 0), (62, "a", 99, 200, 40, 36, 1)]
    d = spark.createDataFrame(rows, "file_row long, rname string, flag int, pos int, mapq int, rlen int, is_dup int")
    got = reads.paired_cuts(d).collect()
    assert len(got) == 51 and {(x.flag, x.cut, x.strand) for x in got} == {(99, 104, "+"), (83, 131, "-")}


def test_sequence_classes(spark):
    seqs = {1: "NNNN", 2: "ANNT", 3: "acgt", 4: "ACGTCG", 5: "ACgtcg", 6: "", 7: "AATT", 8: "CgcGcg"}
    d = spark.createDataFrame([(i, 1, max(1, len(s)), s) for i, s in seqs.items()], "id long, lo int, hi int, seq string")
    got = {x.id: (x.cpg_0, x.ratio_0, x.gc_0, x.class_0) for x in sequence.sequence_features(d, (0,)).collect()}
    assert got[1] == (None, None, None, 5) and got[2] == (None, None, None, 4) and got[3] == (0.0, 0.0, 0.5, 3)
    assert got[4] == (2.0, 2.0 * 6 / 4, 4 / 6, 1) and got[5][0] == 1.0 and got[5][3] == 2 and got[7] == (0.0, -1.0, 0.0, 1) and got[8][0] == 2.0


def test_constant_level_and_constant_column(spark):
    d = spark.createDataFrame([(i, 0.1 * (i + 1), 5, 0, 1, 0.7, 0.6) for i in range(3)], "motif_id long, score double, dtss int, acces int, footprint int, cpg_wr4 double, gc_w4 double")
    got = matrix.derive(d).collect()
    assert {(x.tss, x.acces, x.footprint, x.cpg_island) for x in got} == {(1, 1, 2, 2)}
    assert {x.acces for x in matrix.standardise(d, ["acces"], ["motif_id"]).collect()} == {None}


def test_tied_predictions_and_no_step_in_range(spark):
    d = spark.createDataFrame([(i, 1.0, i % 2) for i in range(10)], "id long, score double, gs int")
    assert [x["rank"] for x in curves.curve(d).orderBy("rank").collect()] == list(range(1, 11))
    m = curves.metrics(d).first()
    assert m.rec10 is None and m.fpr1 is None and 0 <= m.auroc <= 1
    monotone = curves.metrics(d.withColumn("score", F.exp("score") * 3)).first()
    assert monotone == m


def test_curve_of_scores_that_many_rows_share(spark):
    r = random.Random(8)
    rows = [(i, r.choice([0.5, 0.5, 0.5, r.random()]), int(r.random() < 0.3)) for i in r.sample(range(10_000), 900)]
    got = sorted(map(tuple, curves.curve(spark.createDataFrame(rows, "id long, score double, gs int"), 16).collect()))
    hits, want, total = 0, [], sum(g for _, _, g in rows)
    for k, (_, _, g) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])), 1):
        hits += g
        want.append((k, hits / k, hits / total, (k - hits) / (len(rows) - total)))
    assert np.allclose(got, want)


def test_places_are_worked_on_once(spark):
    """Sites of one place, also of none, are one row of the work, and each gets the result; blocks are small enough to deal a short chromosome to many tasks."""
    sites = spark.createDataFrame([(i, "a" if i % 3 else None, 5 * (i % 2), 9) for i in range(30)], "id long, chrom string, lo long, hi long")
    seen = []
    got = intervals.per_place(sites, ["chrom", "lo", "hi"], lambda p: seen.append(p.count()) or p.selectExpr("id", "hi - lo as size")).collect()
    assert seen == [4] and {r.id: r.size for r in got} == {i: 9 - 5 * (i % 2) for i in range(30)}
    assert intervals.BLOCK <= 50_021 // 40
