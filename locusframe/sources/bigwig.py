"""Binary tracks of intervals with values (bigWig): read by the blocks that a range needs, and written in sorted parts.

A file holds a tree of chromosome names, compressed blocks of up to some thousand intervals, and a tree over the blocks by
range. Reading walks both trees first, which gives a small table of runs of neighbouring blocks; the runs are then dealt to
tasks, so a large file is not one task's work and blocks outside the range asked for are never opened.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from locusframe.sources.parts import PartsWriter, Written, open_at

#: First numbers of a file, of its tree of names and of its tree of ranges; the head of a block.
FILE, NAMES, RANGES = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
HEAD = "IIIIIBBH"
#: Intervals of a block and entries of a node, as written; bytes of a run of blocks; compressed bytes a task reads, and of a part.
ITEMS, NODE, RUN, SHARE, PART = 1024, 256, 1 << 20, 16 << 20, 64 << 20


# Reading


def _order(head: bytes) -> str:
    for order in "<>":
        if struct.unpack_from(f"{order}I", head)[0] == FILE:
            return order
    raise ValueError("not a bigWig file")


def _node(data, order: str, at: int, width: Callable[[bool], int]) -> tuple[bool, int, bytes]:
    """Whether a node is a leaf, how many entries it has, and their bytes."""
    data.seek(at)
    leaf, _, n = struct.unpack(f"{order}BBH", data.read(4))
    return bool(leaf), n, data.read(n * width(bool(leaf)))


def chromosomes(data, order: str, at: int) -> dict[int, str]:
    data.seek(at)
    magic, _, key, value, *_ = struct.unpack(f"{order}IIIIQQ", data.read(32))
    if magic != NAMES:
        raise ValueError("the tree of names is damaged")
    found, todo = {}, [at + 32]
    while todo:
        leaf, n, entries = _node(data, order, todo.pop(), lambda is_leaf: key + (value if is_leaf else 8))
        for i in range(n):
            if leaf:
                number = struct.unpack_from(f"{order}I", entries, i * (key + value) + key)[0]
                found[number] = entries[i * (key + value) :][:key].rstrip(b"\0").decode()
            else:
                todo.append(struct.unpack_from(f"{order}Q", entries, i * (key + 8) + key)[0])
    return found


def block_places(data, order: str, at: int, chrom: int | None, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(chromosome, place, size) of the blocks that meet [start, end) of a chromosome, or of all blocks, in the file's order."""
    data.seek(at)
    if struct.unpack(f"{order}I", data.read(4))[0] != RANGES:
        raise ValueError("the tree of ranges is damaged")
    todo = [at + 48]
    while todo:
        leaf, n, entries = _node(data, order, todo.pop(), lambda is_leaf: 32 if is_leaf else 24)
        inner = []
        for i in range(n):
            c0, s, c1, e, place = struct.unpack_from(f"{order}IIIIQ", entries, i * (32 if leaf else 24))
            if chrom is not None and ((c1, e) <= (chrom, start) or (c0, s) >= (chrom, end)):
                continue
            if leaf:
                yield c0, place, struct.unpack_from(f"{order}Q", entries, i * 32 + 24)[0]
            else:
                inner.append(place)
        todo += inner[::-1]


def block_runs(spark: SparkSession, path: str | list[str], chrom: str | None = None, start: int = 0, end: int = 1 << 32) -> DataFrame:
    """(path, chrom, at, sizes, order, packed): runs of neighbouring blocks of one chromosome that meet the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, file = open_at(path)
                with fs.open_input_file(file) as data:
                    head = data.read(64)
                    order = _order(head)
                    _, _, _, names_at, _, ranges_at, _, _, _, _, packed, _ = struct.unpack(f"{order}IHHQQQHHQQIQ", head)
                    names = chromosomes(data, order, names_at)
                    asked = None
                    if chrom is not None:
                        asked = next((k for k, n in names.items() if n == chrom), None)
                        if asked is None:
                            continue
                    runs: list[tuple[str, int, list[int]]] = []
                    upto = -1
                    for c, at, size in block_places(data, order, ranges_at, asked, start, end):
                        if runs and runs[-1][0] == names[c] and at == upto and at - runs[-1][1] < RUN:
                            runs[-1][2].append(size)
                        else:
                            runs.append((names[c], at, [size]))
                        upto = at + size
                chroms, ats, sizes = zip(*runs, strict=True) if runs else ((), (), ())
                k = len(runs)
                yield pa.RecordBatch.from_arrays([pa.array([path] * k, pa.string()), pa.array(chroms, pa.string()), pa.array(ats, pa.int64()), pa.array(sizes, pa.list_(pa.int32())), pa.array([order] * k, pa.string()), pa.array([packed > 0] * k, pa.bool_())], names=["path", "chrom", "at", "sizes", "order", "packed"])

    files = spark.read.format("binaryFile").load(path).select("path")  # contents aren't read
    return files.mapInArrow(run, "path string, chrom string, at long, sizes array<int>, order string, packed boolean")


def intervals_of(block: bytes, order: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and values of a block's intervals; its rows are intervals, places with one width, or values at even steps."""
    _, start, _, step, span, kind, _, n = struct.unpack_from(f"{order}{HEAD}", block)
    u, f = f"{order}u4", f"{order}f4"
    layout = {1: [("start", u), ("end", u), ("val", f)], 2: [("start", u), ("val", f)], 3: [("val", f)]}.get(kind)
    if layout is None:
        raise ValueError(f"a block of kind {kind}")
    rows = np.frombuffer(block, np.dtype(layout), n, struct.calcsize(f"<{HEAD}"))
    starts = start + np.arange(n, dtype=np.int64) * step if kind == 3 else rows["start"].astype(np.int64)
    return starts, rows["end"].astype(np.int64) if kind == 1 else starts + span, rows["val"].astype(np.float64)


def big_wig(spark: SparkSession, path: str | list[str], chrom: str | None = None, start: int = 0, end: int = 1 << 32) -> DataFrame:
    """(chrom, start0, end0, val): the intervals of bigWig files, 0-based; with chrom only those that meet [start, end) of it, for which only the blocks named by the files' index are opened. A chromosome that a file lacks gives no rows.

    Executors open the files, so the folder has to be one that they share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fs, file = open_at(r["path"])
                with fs.open_input_file(file) as data:
                    data.seek(r["at"])
                    for size in r["sizes"]:
                        block = data.read(size)
                        s, e, v = intervals_of(zlib.decompress(block) if r["packed"] else block, r["order"])
                        if chrom is not None:
                            keep = (s < end) & (e > start)
                            s, e, v = s[keep], e[keep], v[keep]
                        yield pa.RecordBatch.from_arrays([pa.array([r["chrom"]] * len(s), pa.string()), pa.array(s), pa.array(e), pa.array(v)], names=["chrom", "start0", "end0", "val"])

    listed = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    runs = block_runs(spark, path, chrom, start, end).repartition(max(1, -(-listed // SHARE)), "path", "at")
    return runs.mapInArrow(run, "chrom string, start0 long, end0 long, val double")


# Writing


def _tree(items: list[tuple[tuple, bytes]], inner: Callable[[tuple], bytes], merged: Callable[[list[tuple]], tuple], at: int) -> bytes:
    """The nodes of a tree from `at`, from the root down; items are keys and leaf entries, and an inner entry is inner(key) and its child's place."""
    cut = lambda entries: [entries[i : i + NODE] for i in range(0, len(entries), NODE)] or [[]]
    levels = [cut(items)]
    while len(levels[-1]) > 1:
        levels.append(cut([(merged([k for k, _ in node]), b"") for node in levels[-1]]))
    out = []
    for depth, level in enumerate(reversed(levels)):
        leaf = depth == len(levels) - 1
        entries = [[e if leaf else inner(k) for k, e in node] for node in level]
        at += sum(4 + sum(len(e) + (0 if leaf else 8) for e in node) for node in entries)
        below = levels[-depth - 2] if not leaf else []
        sizes = [4 + sum(len(e) if depth == len(levels) - 2 else len(inner(k)) + 8 for k, e in node) for node in below]
        places = iter([at + sum_before for sum_before in np.cumsum([0, *sizes[:-1]]).tolist()] if sizes else [])
        for node in entries:
            out.append(struct.pack("<BBH", leaf, 0, len(node)) + b"".join(e if leaf else e + struct.pack("<Q", next(places)) for e in node))
    return b"".join(out)


class _Part:
    """One sorted part: compressed blocks as they fill, held until the file's trees can be written."""

    def __init__(self, refs: list[tuple[str, int]]):
        self.refs, self.blocks, self.size = refs, [], 0
        self.chrom, self.waiting, self.upto = -1, [], 0
        self.covered, self.least, self.most, self.sum, self.squares = 0, np.inf, -np.inf, 0.0, 0.0

    def add(self, chrom: int, start: np.ndarray, end: np.ndarray, val: np.ndarray) -> None:
        if chrom != self.chrom:
            self.flush(1)
            self.chrom, self.upto = chrom, 0
        if start[0] < self.upto or (start[1:] < end[:-1]).any() or end[-1] > self.refs[chrom][1]:
            raise ValueError(f"intervals of {self.refs[chrom][0]} overlap, or reach beyond its end")
        rows = np.zeros(len(start), np.dtype([("start", "<u4"), ("end", "<u4"), ("val", "<f4")]))
        rows["start"], rows["end"], rows["val"], self.upto = start, end, val, end[-1]
        v, bases = rows["val"].astype(float), end - start
        self.covered, self.sum, self.squares = self.covered + int(bases.sum()), self.sum + float(v @ bases), self.squares + float(v * v @ bases)
        self.least, self.most = min(self.least, v.min()), max(self.most, v.max())
        self.waiting.append(rows)
        self.flush(ITEMS)

    def flush(self, least: int) -> None:
        """Blocks of the waiting rows, as long as there are `least` of them."""
        rows = np.concatenate(self.waiting) if self.waiting else ()
        at = 0
        while len(rows) - at >= least:
            x = rows[at : at + ITEMS]
            at += len(x)
            start, end = int(x["start"][0]), int(x["end"][-1])
            block = zlib.compress(struct.pack(f"<{HEAD}", self.chrom, start, end, 0, 0, 1, 0, len(x)) + x.tobytes())
            self.blocks.append((self.chrom, start, end, block))
            self.size += len(block)
        self.waiting = [rows[at:]] if len(rows) > at else []

    def file(self) -> Iterator[bytes]:
        self.flush(1)
        key = max(len(n.encode()) for n, _ in self.refs)
        names = [((n.encode(),), n.encode().ljust(key, b"\0") + struct.pack("<II", i, size)) for i, (n, size) in enumerate(self.refs)]
        names_at = 64 + 40
        tree = struct.pack("<IIIIQQ", NAMES, NODE, key, 8, len(names), 0) + _tree(names, lambda k: k[0].ljust(key, b"\0"), lambda ks: ks[0], names_at + 32)
        data_at = names_at + len(tree)
        places = (data_at + 8 + np.cumsum([0, *(len(b) for *_, b in self.blocks)])).tolist()
        items = [((c, s, c, e), struct.pack("<IIIIQQ", c, s, c, e, at, len(b))) for (c, s, e, b), at in zip(self.blocks, places, strict=False)]
        whole = lambda ks: (*ks[0][:2], *max(k[2:] for k in ks))
        ranges_at = places[-1]
        yield struct.pack("<IHHQQQHHQQIQ", FILE, 4, 0, names_at, data_at, ranges_at, 0, 0, 0, 64, struct.calcsize(f"<{HEAD}") + 12 * ITEMS, 0)
        yield struct.pack("<Qdddd", self.covered, *((self.least, self.most) if self.covered else (0.0, 0.0)), self.sum, self.squares)
        yield tree + struct.pack("<Q", len(self.blocks))
        for *_, b in self.blocks:
            yield b
        span = whole([k for k, _ in items]) if items else (0, 0, 0, 0)
        yield struct.pack("<IIQIIIIQII", RANGES, NODE, len(items), *span, ranges_at, ITEMS, 0) + _tree(items, lambda k: struct.pack("<IIII", *k), whole, ranges_at + 48)


class _Writer(PartsWriter):
    def __init__(self, path: str, refs: list[tuple[str, int]]):
        super().__init__(path)
        self.refs = refs

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, folder, name = self.trial()
        names, part = [], _Part(self.refs)

        def close() -> None:
            names.append(f"{name}-{len(names)}.bw")
            with fs.open_output_stream(f"{folder}/{names[-1]}") as out:
                for piece in part.file():
                    out.write(piece)

        for b in iterator:
            ref, start, end, val = (b.column(c).to_numpy(zero_copy_only=False) for c in ("ref", "start0", "end0", "val"))
            cuts = [0, *(np.flatnonzero(np.diff(ref)) + 1).tolist(), len(ref)]
            for i, j in zip(cuts, cuts[1:]):
                if i < j:
                    part.add(int(ref[i]), start[i:j], end[i:j], val[i:j])
            if part.size >= PART:
                close()
                part = _Part(self.refs)
        if part.blocks or part.waiting:
            close()
        return Written(names)


class BigWigSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        refs = [(r.rpartition(":")[0], int(r.rpartition(":")[2])) for r in self.options["references"].split(",")]
        return _Writer(self.options["path"], refs)


def write_big_wig(track: DataFrame, path: str, references: list[tuple[str, int]]) -> None:
    """A track (chrom, start0, end0, val) as a folder of bigWig files in coordinate order over all, none above some 64 MB; values are stored as floats.

    Rows with a null and empty intervals are left out. Intervals must not overlap nor reach beyond their chromosome, which has to be among the references.
    """
    spark = track.sparkSession
    spark.dataSource.register(BigWigSource)
    references = sorted(references, key=lambda r: r[0].encode())
    number = F.array_position(F.array(*[F.lit(n) for n, _ in references]), F.col("chrom")).cast("int") - 1
    rows = track.where("chrom is not null and end0 > start0 and val is not null").select(F.when(number < 0, F.raise_error(F.concat(F.lit("no reference "), "chrom"))).otherwise(number).cast("int").alias("ref"), F.col("start0").cast("long").alias("start0"), F.col("end0").cast("long").alias("end0"), F.col("val").cast("double").alias("val"))
    rows.repartitionByRange("ref", "start0").sortWithinPartitions("ref", "start0").write.format("bigwig").mode("append").option("references", ",".join(f"{n}:{size}" for n, size in references)).save(path)
