import struct
import zlib

import numpy as np
import pytest

from locusframe.sources import bigwig


def track(n, chroms=("chr1", "chr10", "chr2"), seed=1):
    r, rows = np.random.default_rng(seed), []
    for c in chroms:
        at = 0
        for _ in range(n):
            at += int(r.integers(0, 4))
            end = at + int(r.integers(1, 30))
            rows.append((c, at, end, float(np.float32(r.normal()))))
            at = end
    return rows


def write(spark, rows, path, parts=3):
    d = spark.createDataFrame(rows, "chrom string, start0 long, end0 long, val double").repartition(parts)
    bigwig.write_big_wig(d, str(path), [("chr1", 1 << 30), ("chr2", 1 << 30), ("chr10", 1 << 30), ("chrM", 9)])
    return f"{path}/*.bw"


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("node, items, run", [(256, 1024, 1 << 20), (3, 16, 500)])
def test_tracks_come_back(spark, tmp_path, node, items, run):
    rows = track(700)
    part = bigwig._Part([("chr1", 1 << 30), ("chr10", 1 << 30), ("chr2", 1 << 30)])
    before = bigwig.NODE, bigwig.ITEMS, bigwig.RUN
    bigwig.NODE, bigwig.ITEMS, bigwig.RUN = node, items, run
    try:
        for k, c in enumerate(("chr1", "chr10", "chr2")):
            x = [r for r in rows if r[0] == c]
            for i in range(0, len(x), 90):
                part.add(k, *(np.array([r[j] for r in x[i : i + 90]]) for j in (1, 2, 3)))
        (tmp_path / "a.bw").write_bytes(b"".join(part.file()))
        path = str(tmp_path / "a.bw")
        assert got(bigwig.big_wig(spark, path)) == sorted(rows)
        for chrom, start, end in (("chr1", 0, 1), ("chr10", 500, 700), ("chr2", 3000, 1 << 32), ("chr2", 900, 900), ("none", 0, 99)):
            assert got(bigwig.big_wig(spark, path, chrom, start, end)) == sorted(r for r in rows if r[0] == chrom and r[1] < end and r[2] > start)
        opened = lambda *a: sum(len(r.sizes) for r in bigwig.block_runs(spark, path, *a).collect())
        whole, blocks = opened(), [b for b in part.blocks if b[0] == 1 and b[1] < 700 and b[2] > 500]
        assert opened("chr10", 500, 700) == len(blocks) < whole == len(part.blocks)
        assert bigwig.block_runs(spark, path).count() >= (3 if run > 500 else 30)
    finally:
        bigwig.NODE, bigwig.ITEMS, bigwig.RUN = before


def test_folders_of_parts(spark, tmp_path):
    rows = track(3000, seed=4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would make one part of so few rows
    try:
        files = write(spark, rows, tmp_path / "t")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got(bigwig.big_wig(spark, files)) == sorted(rows)
    assert len(list((tmp_path / "t").glob("*.bw"))) > 1 and not list((tmp_path / "t").glob("_trial*"))
    assert got(bigwig.big_wig(spark, files, "chr1", 10_000, 10_100)) == sorted(r for r in rows if r[0] == "chr1" and r[1] < 10_100 and r[2] > 10_000)


def test_nulls_and_bad_intervals(spark, tmp_path):
    files = write(spark, [("chr1", 5, 9, 1.0), (None, 1, 2, 1.0), ("chr1", 9, None, 1.0), ("chr1", 7, 7, 2.0), ("chr2", 1, 2, None)], tmp_path / "n")
    assert got(bigwig.big_wig(spark, files)) == [("chr1", 5, 9, 1.0)]
    for k, bad in enumerate(([("chr1", 1, 5, 1.0), ("chr1", 4, 6, 1.0)], [("chr7", 1, 2, 1.0)], [("chrM", 1, 20, 1.0)])):
        with pytest.raises(Exception, match="overlap|no reference"):
            write(spark, bad, tmp_path / f"bad{k}", 1)


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("packed", [True, False])
def test_other_writers(spark, tmp_path, order, packed):
    """Blocks of places with one width and of even steps, either byte order, with or without compression."""
    head = lambda start, end, step, span, kind, n: struct.pack(f"{order}IIIIIBBH", 7, start, end, step, span, kind, 0, n)
    blocks = [(10, 32, head(10, 32, 0, 2, 2, 2) + struct.pack(f"{order}IfIf", 10, 1.5, 30, 2.5)), (40, 63, head(40, 63, 10, 3, 3, 3) + struct.pack(f"{order}fff", 1, 2, 3))]
    blocks = [(s, e, zlib.compress(b) if packed else b) for s, e, b in blocks]
    names = struct.pack(f"{order}IIIIQQ", bigwig.NAMES, 1, 4, 8, 1, 0) + struct.pack(f"{order}BBH4sII", 1, 0, 1, b"chrX", 7, 1000)
    at = 64 + len(names)
    places = [at, at + len(blocks[0][2])]
    ranges_at = places[1] + len(blocks[1][2])
    leaf = struct.pack(f"{order}BBH", 1, 0, 2) + b"".join(struct.pack(f"{order}IIIIQQ", 7, s, 7, e, p, len(b)) for (s, e, b), p in zip(blocks, places))
    index = struct.pack(f"{order}IIQIIIIQII", bigwig.RANGES, 2, 2, 7, 10, 7, 63, ranges_at, 3, 0) + leaf
    data = struct.pack(f"{order}IHHQQQHHQQIQ", bigwig.FILE, 4, 0, 64, at, ranges_at, 0, 0, 0, 0, 1000 if packed else 0, 0)
    (tmp_path / "x.bw").write_bytes(data + names + b"".join(b for *_, b in blocks) + index)
    want = [("chrX", 10, 12, 1.5), ("chrX", 30, 32, 2.5), ("chrX", 40, 43, 1.0), ("chrX", 50, 53, 2.0), ("chrX", 60, 63, 3.0)]
    assert got(bigwig.big_wig(spark, str(tmp_path / "x.bw"))) == want
    assert got(bigwig.big_wig(spark, str(tmp_path / "x.bw"), "chrX", 31, 45)) == want[1:3]
