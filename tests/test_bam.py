import io
import random
import struct

import numpy as np
import pytest

from locusframe.sources import bam
from locusframe.sources.bam import BASES, EOF_BLOCK, bam_region, deflate, encode, encode_header, parse, write_bam

REFS = [("chr1", 1 << 20), ("chr2", 5000), ("chrX", 300)]


def records(n, seed, longest=60):
    r = random.Random(seed)
    out = []
    for i in range(n):
        ref = r.choice([0, 0, 0, 1, 2, -1])
        size = r.randint(0, longest)
        out.append((f"read{r.randint(0, 10**r.randint(1, 9))}", r.choice([83, 99, 163, 147, 1107, 4]), ref, r.randint(0, REFS[ref][1]) if ref >= 0 else -1, r.randint(0, 60), "".join(map(chr, r.choices(BASES, k=size))), "".join(r.choices("!5?I~", k=size)), r.randint(-1, 300), r.randint(-500, 500)))
    return out


def in_blocks(data, r, most):
    out = []
    while data:
        n = r.randint(1, most)
        out.append(deflate(data[:n]))
        data = data[n:]
    return b"".join(out) + EOF_BLOCK


@pytest.fixture
def splits(spark):
    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield of
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("size", [997, 20_011, 1 << 27])
def test_every_split_size_gives_all_records(spark, tmp_path, splits, size):
    r = random.Random(size)
    want = []
    for k, (n, longest, most) in enumerate([(150, 60, 900), (16, 3000, 700), (3, 5, 60_000)]):  # blocks cut records; some records fill several splits
        data = encode_header(REFS) + b"".join(encode(*x) for x in records(n, k, longest))
        (tmp_path / f"f{k}.bam").write_bytes(in_blocks(data, r, most))
        want += list(parse(data))
    splits(size)
    got = bam.bam(spark, str(tmp_path))
    assert rows(got) == sorted(want, key=str)
    if size < 3000:
        assert bam._blocks(spark, str(tmp_path)).rdd.getNumPartitions() > 20


def test_wrong_guesses_are_found_and_mended(spark, tmp_path, splits, monkeypatch):
    # Records whose qualities look like whole records themselves.
    inner = encode("inner", 99, 0, 7, 9, "ACGTACGT", "IIIIIIII", -1, 0)
    fake = inner * 40
    body = [struct.pack("<iiBBHHHiiii", 0, 10 + i, 3, 9, 0, 0, 99, len(fake), -1, -1, 0) + b"ab\0" + b"\x11" * ((len(fake) + 1) // 2) + fake for i in range(12)]
    data = encode_header(REFS) + b"".join(struct.pack("<i", len(b)) + b for b in body)
    (tmp_path / "f.bam").write_bytes(in_blocks(data, random.Random(1), 900))
    splits(700)
    passes = []
    scan = bam._scanner
    monkeypatch.setattr(bam, "_scanner", lambda forced: passes.append(len(forced)) or scan(forced))
    assert rows(bam.bam(spark, str(tmp_path))) == sorted(parse(data), key=str)
    assert len(passes) > 1


def test_empty_cut_off_and_foreign_files(spark, tmp_path):
    head = encode_header(REFS)
    (tmp_path / "empty.bam").write_bytes(deflate(head) + EOF_BLOCK)
    assert bam.bam(spark, str(tmp_path / "empty.bam")).count() == 0
    (tmp_path / "cut.bam").write_bytes(deflate(head + encode(*records(1, 1)[0])[:-3]) + EOF_BLOCK)
    with pytest.raises(ValueError, match="cut off"):
        bam.bam(spark, str(tmp_path / "cut.bam"))
    whole = deflate(head + b"".join(encode(*x) for x in records(50, 2)))
    (tmp_path / "block.bam").write_bytes(whole[:-40])
    with pytest.raises(Exception, match="cut off|holds a block"):
        bam.bam(spark, str(tmp_path / "block.bam")).count()
    (tmp_path / "text.bam").write_text("not an alignment\n")
    with pytest.raises(Exception):
        bam.bam(spark, str(tmp_path / "text.bam")).count()


def test_separator_inside_of_a_block():
    data = bytes(range(256)) + bam.MAGIC * 3
    stored = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(data) + 5 + 25) + b"\x01" + struct.pack("<HH", len(data), len(data) ^ 0xFFFF) + data + b"\0" * 8
    blocks = (stored + deflate(b"x")).split(bam.MAGIC)
    assert list(bam.inflated(iter(blocks), True)) == [data, b"x"]


def test_written_folder_is_sorted_indexed_and_read_by_region(spark, tmp_path):
    found = records(6000, 3, 200)
    names = [n for n, _ in REFS]
    df = spark.createDataFrame([(q, f, names[ref] if ref >= 0 else None, p, m, s, qu, pn, t) for q, f, ref, p, m, s, qu, pn, t in found], "qname string, flag int, rname string, pos int, mapq int, seq string, qual string, pnext int, tlen int").repartition(3)
    path = str(tmp_path / "out")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    write_bam(df, path, REFS)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert sum(p.endswith(".bai") for p in parts) > 1 and not any(p.startswith("_trial") for p in parts)
    back = bam.bam(spark, f"{path}/*.bam")
    pick = ["qname", "flag", "rname", "pos", "mapq", "seq", "qual", "pnext", "tlen"]
    assert rows(back.select(pick)) == rows(df.select(pick))
    order = []
    for p in parts:
        if p.endswith(".bam"):
            order += [(names.index(r.rname) if r.rname else 9, r.pos) for r in bam.bam(spark, f"{path}/{p}").orderBy("file_row").collect()]
    assert order == sorted(order) and len(order) == len(found)
    for rname, a, b in (("chr1", 0, 40), ("chr1", 300_000, 340_000), ("chr1", 16_384, 16_385), ("chr2", 0, 5000), ("chr1", 1 << 20, 1 << 21), ("nope", 0, 9)):
        got = bam_region(spark, path, rname, a, b)
        want = df.where(f"rname = '{rname}' and pos < {b} and pos + greatest(length(seq), 1) > {a}")
        cols = ["qname", "flag", "rname", "pos", "mapq", "seq"]
        assert rows(got.select(cols)) == rows(want.select(cols))


def test_a_region_opens_few_blocks(tmp_path):
    refs = [("chr1", 1 << 24)]
    with open(tmp_path / "a.bam", "wb") as out:
        part = bam._Part(out, refs)
        for pos in range(0, 1 << 23, 64):
            part.add(0, pos, 50, encode(f"r{pos}", 99, 0, pos, 30, "ACGTA" * 10, None, -1, 0))
        index = part.close()
    blocks = (tmp_path / "a.bam").read_bytes().count(bam.MAGIC)
    with open(tmp_path / "a.bam", "rb") as data:
        got, opened = bam.region_records(data, bam.chunks_over(index, 0, 5_000_000, 5_001_000), 0, 5_000_000, 5_001_000)
    assert len(got) == len([p for p in range(0, 1 << 23, 64) if p < 5_001_000 and p + 50 > 5_000_000])
    assert opened <= 4 < blocks / 20
    assert np.frombuffer(got[0], "<i4")[2] >= 4_999_950


def test_many_records_of_one_position_are_in_many_parts_and_read_in_batches(spark, tmp_path, monkeypatch):
    """Neither a part nor what a task holds grows with the reads of one position."""
    rows = spark.range(20_000).selectExpr("concat('r', id) as qname", "99 as flag", "'chr1' as rname", "100 as pos", "40 as mapq", "repeat('ACGT', 9) as seq", "repeat('I', 36) as qual", "-1 as pnext", "0 as tlen")
    path = str(tmp_path / "deep")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        bam.write_bam(rows, path, [("chr1", 1000)])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(tmp_path.glob("deep/*.bam"))
    assert len(parts) > 1
    monkeypatch.setattr(bam, "REGION_BATCH", 10_000)
    got = bam.bam_region(spark, path, "chr1", 90, 110)
    assert got.select("qname").distinct().count() == got.count() == 20_000
    data = parts[0].read_bytes()
    index = (tmp_path / "deep" / f"{parts[0].name}.bai").read_bytes()
    sizes = [len(b) for b, _ in bam.region_batches(io.BytesIO(data), bam.chunks_over(index, 0, 90, 110), 0, 90, 110, 10_000)]
    assert len(sizes) > 2 and max(sizes) < 2000 and sum(sizes) == len(bam.region_records(io.BytesIO(data), bam.chunks_over(index, 0, 90, 110), 0, 90, 110)[0])
