"""Alignments in the binary format: read by splits at block headers, written in coordinate order with an index, and read by region.

A file is a run of compressed blocks (BGZF) that hold a header and a run of records; neither splits nor blocks end where
records do. Files are read through Spark's text source with the blocks' first bytes as line separator, so Spark splits
them and any store will do. A first pass finds where records begin in each split, and what of records hangs over its ends.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from locusframe.scratch import materialise
from locusframe.sources.parts import PartsWriter, Written, open_at

SCHEMA = "file_row long, qname string, flag int, rname string, pos int, mapq int, rlen int, seq string, qual string, pnext int, tlen int, is_dup boolean"
#: First bytes of a block, base codes, and the empty block at the end of a file.
#: Bytes of records of a region that are decoded at once.
REGION_BATCH = 1 << 20
MAGIC = b"\x1f\x8b\x08\x04"
BASES = b"=ACMGRSVTWYHKDBN"
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: The layout of a record's first 36 bytes.
FIXED = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("pnext_ref", "<i4"), ("pnext", "<i4"), ("tlen", "<i4")])
_HEAD = struct.Struct("<iiiBBHHHiiii")
#: Bytes that are decoded at once, and that a block holds; records a guess is tried on; rows of split or reference tables that are broadcast.
CHUNK, BLOCK, CHAIN, BROADCAST = 1 << 20, 65_280, 10, 500_000


def block_size(data: bytes) -> int | None:
    """The size of the block whose bytes after MAGIC begin with data, MAGIC left out; None if data is too short to tell."""
    if len(data) < 8:
        return None
    extra = struct.unpack_from("<H", data, 6)[0]
    if len(data) < 8 + extra:
        return None
    at = 8
    while at + 4 <= 8 + extra:
        length = struct.unpack_from("<H", data, at + 2)[0]
        if data[at : at + 2] == b"BC" and length == 2:
            return struct.unpack_from("<H", data, at + 4)[0] + 1 - len(MAGIC)
        at += 4 + length
    raise ValueError("a gzip member without block size: not a BAM file")


def inflate(data: bytes) -> bytes:
    """What a block holds, given its bytes after MAGIC."""
    return zlib.decompress(data[8 + struct.unpack_from("<H", data, 6)[0] : -8], -15)


def inflated(pieces: Iterator[bytes], first: bool) -> Iterator[bytes]:
    """What the blocks hold whose bytes stand between separators. A separator inside of a block's data is put back. first: it is a file's first split."""
    held = None
    for i, piece in enumerate(pieces):
        if first and not i:
            if piece:  # not in blocks: one stream, which one task has to read
                yield gzip.decompress(MAGIC.join([piece, *pieces]))
                return
            continue
        held = piece if held is None else held + MAGIC + piece
        size = block_size(held)
        if size is not None and size <= len(held):
            if size != len(held):
                raise ValueError("bytes between blocks: not a BAM file")
            yield inflate(held)
            held = None
    if held is not None:
        raise ValueError("a block is cut off, or holds a block's first bytes right where a split ends: read it with another spark.sql.files.maxPartitionBytes")


def header(data: bytes) -> tuple[list[tuple[str, int]], int] | None:
    """References (name, length) and where the header ends; None if data ends before it."""
    try:
        if data[:4] != b"BAM\1"[: len(data)]:
            raise ValueError("not a BAM file")
        at = 8 + struct.unpack_from("<i", data, 4)[0]
        n = struct.unpack_from("<i", data, at)[0]
        at, refs = at + 4, []
        for _ in range(n):
            size = struct.unpack_from("<i", data, at)[0]
            refs.append((bytes(data[at + 4 : at + 3 + size]).decode(), struct.unpack_from("<i", data, at + 4 + size)[0]))
            at += 8 + size
        return refs, at
    except struct.error:
        return None


def starts_of(data: bytes, at: int) -> tuple[list[int], int]:
    """Where whole records begin from `at` on, and where the last of them ends, or where something stands that is none."""
    out, n, unpack = [], len(data), struct.Struct("<i").unpack_from
    while at + 4 <= n:
        size = unpack(data, at)[0]
        if size < 32 or at + 4 + size > n:
            break
        out.append(at)
        at += 4 + size
    return out, at


def broken(data: bytes, at: int) -> bool:
    """Whether what stands after whole records can't be the beginning of one."""
    return len(data) - at >= 4 and struct.unpack_from("<i", data, at)[0] < 32


def _plausible(data: bytes, at: int) -> int:
    """The size of what looks like a record at `at`, or 0; its first 36 bytes are there."""
    size, ref, pos, l_name, _, _, n_cigar, _, l_seq, next_ref, pnext, _ = _HEAD.unpack_from(data, at)
    if not (ref >= -1 and pos >= -1 and next_ref >= -1 and pnext >= -1 and l_name and l_seq >= 0 and 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq <= size < 1 << 28):
        return 0
    name = data[at + 36 : at + 36 + l_name]
    if any(not 33 <= c <= 126 for c in name[: l_name - 1]) or len(name) == l_name and name[-1]:
        return 0
    return 4 + size


def guess(data: bytes) -> int | None:
    """The first place where records seem to begin, each at the end of the one before, as far as data goes or CHAIN of them."""
    for start in range(len(data) - 35):
        at = start
        for _ in range(CHAIN):
            if at + 36 > len(data):
                return start
            size = _plausible(data, at)
            if not size:
                break
            at += size
        else:
            return start
    return None


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows of each split, in order; data is the last column."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return groupby(rows, key=lambda r: r[:-1])


def _scanner(forced: dict[tuple[str, int], int]) -> Callable:
    def scan_split(file: str, split: int, pieces: Iterator[bytes]) -> tuple:
        data, start, head, n, refs = b"", forced.get((file, split)), b"", 0, None
        known = split == 0 or start is not None
        found = False
        for block in inflated(pieces, split == 0):
            data += block
            if split == 0 and refs is None:
                read = header(data)
                if read is None:
                    continue
                refs, start = read
                data, start = data[start:], 0
            if not found and known and len(data) >= start:
                head, data, found = data[:start], data[start:], True
            elif not found and not known and len(data) >= CHUNK:
                at = guess(data)
                if at is not None:
                    head, data, found = data[:at], data[at:], True
            if found and len(data) >= CHUNK:
                got, end = starts_of(data, 0)
                n, data = n + len(got), data[end:]
                if broken(data, 0):  # the guess was wrong, or the file is damaged
                    return file, split, True, n, head, data[:36], [r for r, _ in refs] if refs is not None else None
        if split == 0 and refs is None:
            raise ValueError("the header doesn't end in the file's first split: read it with a larger spark.sql.files.maxPartitionBytes")
        if not found and not known and (at := guess(data)) is not None:
            head, data, found = data[:at], data[at:], True
        if not found:
            return file, split, False, 0, data, b"", None
        got, end = starts_of(data, 0)
        return file, split, True, n + len(got), head, data[end:], [r for r, _ in refs] if refs is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, split), rows in _splits(batches):
            row = scan_split(file, split, (r[-1] for r in rows))
            yield pa.RecordBatch.from_pylist([dict(zip(_SCAN.names, row, strict=True))], schema=_SCAN)

    return run


_SCAN = pa.schema([("file", pa.string()), ("split", pa.int64()), ("found", pa.bool_()), ("n", pa.int64()), ("head", pa.binary()), ("tail", pa.binary()), ("refs", pa.list_(pa.string()))])
_SCAN_SQL = "file string, split long, found boolean, n long, head binary, tail binary, refs array<string>"


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run of overhanging bytes: how many records they hold, and how many bytes are lacking at the end."""
    for b in batches:
        out = []
        for file, tail_of, head_of, parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            data = b"".join(p["bytes"] for p in parts)
            got, end = starts_of(data, 0)
            over = len(data) - end
            lacking = -1 if broken(data, end) else 0 if not over else 4 - over if over < 4 else 4 + struct.unpack_from("<i", data, end)[0] - over
            out.append((file, tail_of, head_of, len(got), lacking, len(parts[-1]["bytes"]), data))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 7, _STITCHED, strict=True)], schema=_STITCHED)


_STITCHED = pa.schema([("file", pa.string()), ("split", pa.int64()), ("head_of", pa.int64()), ("n", pa.int64()), ("lacking", pa.int64()), ("last", pa.int64()), ("data", pa.binary())])


def _blocks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, split, data): blocks without MAGIC, as they stand in the split."""
    text = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("data"))


def _resolved(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a first pass finds in each split, and the records that hang over splits' ends, (file, split, n, data) by the split they begin in.

    A guess is right if the bytes from the last split's last whole record up to it are whole records too. Where they
    aren't, the place is known better, and the pass is made again.
    """
    forced: dict[tuple[str, int], int] = {}
    while True:
        scan = materialise(blocks.mapInArrow(_scanner(forced), _SCAN_SQL), "splits")
        line = W.partitionBy("file").orderBy("split")  # a row a split
        before = F.coalesce(F.sum(F.col("found").cast("long")).over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        runs = scan.withColumn("run", before)
        parts = runs.select("file", "run", "split", "found", F.lit(0).alias("kind"), F.col("head").alias("bytes")).unionAll(runs.where("found").select("file", F.col("run") + 1, "split", "found", F.lit(1), "tail"))
        whole = parts.groupBy("file", "run").agg(F.max(F.when(F.col("kind") == 1, F.col("split"))).alias("split"), F.max(F.when((F.col("kind") == 0) & F.col("found"), F.col("split"))).alias("head_of"), F.array_sort(F.collect_list(F.struct("split", "kind", "bytes"))).alias("parts"))
        stitched = materialise(whole.select("file", "split", "head_of", "parts").mapInArrow(_stitch, "file string, split long, head_of long, n long, lacking long, last long, data binary"), "overhangs")
        off = stitched.where("lacking != 0").select("file", "head_of", "lacking", "last").collect()  # at most one a split, and guesses are rarely wrong
        wrong = [r for r in off if r.lacking > 0]
        if off and not wrong:
            raise ValueError(f"a record of impossible size: {off[0].file} is damaged")
        if not wrong:
            return scan, stitched.where("n > 0").select("file", "split", "n", "data")
        for r in wrong:
            if r.head_of is None:
                raise ValueError(f"the last record of {r.file} is cut off")
            forced[r.file, r.head_of] = r["last"] + r.lacking


def _gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place in its run, and the run's start, of each element of runs of these lengths; and Arrow offsets."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths)
    return place, np.repeat(starts, lengths), offsets.astype(np.int32)


def _strings(chars: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(chars.astype(np.uint8).tobytes()))


def decode(data: bytes, starts: list[int]) -> dict[str, pa.Array | np.ndarray]:
    """Columns of the records at starts; ref is the reference's number."""
    a, at = np.frombuffer(data, np.uint8), np.asarray(starts, np.int64)
    f = a[at[:, None] + np.arange(36)].copy().view(FIXED)[:, 0]
    l_seq = f["l_seq"].astype(np.int64)
    packed = at + 36 + f["l_name"] + 4 * f["n_cigar"].astype(np.int64)
    place, begin, names = _gathered(a, at + 36, f["l_name"].astype(np.int64) - 1)
    qname = _strings(a[begin + place], names)
    place, begin, ends = _gathered(a, packed, l_seq)
    pair = a[begin + (place >> 1)]
    seq = _strings(np.frombuffer(BASES, np.uint8)[np.where(place & 1, pair & 15, pair >> 4)], ends)
    qual = _strings(np.minimum(a[begin + np.repeat((l_seq + 1) // 2, l_seq) + place].astype(np.int16) + 33, 126), ends)
    return {"qname": qname, "flag": f["flag"].astype(np.int32), "ref": f["ref"].copy(), "pos": f["pos"].copy(), "mapq": f["mapq"].astype(np.int32), "rlen": f["l_seq"].copy(), "seq": seq, "qual": qual, "pnext": f["pnext"].copy(), "tlen": f["tlen"].copy()}


_DECODED = "file string, file_row long, qname string, flag int, ref int, pos int, mapq int, rlen int, seq string, qual string, pnext int, tlen int"


def _decoded(file: str, first: int, data: bytes, starts: list[int]) -> pa.RecordBatch:
    columns = {"file": pa.array([file] * len(starts)), "file_row": np.arange(first, first + len(starts), dtype=np.int64)} | decode(data, starts)
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def _record_reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records of splits (file, split, start, first row, data); start counts from the end of the header."""
    for (file, split, start, row), rows in _splits(batches):
        data, begun = b"", False
        for block in inflated((r[-1] for r in rows), split == 0):
            data += block
            if not begun:
                end = 0
                if split == 0:
                    read = header(data)
                    if read is None:
                        continue
                    end = read[1]
                if len(data) < end + start:
                    continue
                data, begun = data[end + start :], True
            if len(data) >= CHUNK:
                starts, end = starts_of(data, 0)
                if starts:
                    yield _decoded(file, row, data, starts)
                row, data = row + len(starts), data[end:]
        if begun:
            starts, _ = starts_of(data, 0)
            if starts:
                yield _decoded(file, row, data, starts)


def _overhang_reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for file, row, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            yield _decoded(file, row, data, starts_of(data, 0)[0])


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def bam(spark: SparkSession, path: str | list[str], sizes: DataFrame | None = None) -> DataFrame:
    """Alignments of BAM files; only those on references in sizes (chrom, length) if given. file_row is the record's number in its file, from 1.

    Files are read in splits, twice: for the places of records, and for the records. A task holds a chunk of a split. A
    file without records gives no rows; one that is cut off raises an error.
    """
    blocks = _blocks(spark, path)
    scan, overhangs = _resolved(blocks)
    # Rows before each split's own records and before those that hang over its end.
    units = scan.where("found").select("file", "split", F.lit(0).alias("kind"), "n").unionAll(overhangs.select("file", "split", F.lit(1), "n"))
    units = units.withColumn("row", 1 + F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("split", "kind").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    units = materialise(units, "units")
    own = scan.where("found and n > 0").join(units.where("kind = 0").select(F.col("file").alias("u_file"), F.col("split").alias("u_split"), "row"), (F.col("file") == F.col("u_file")) & (F.col("split") == F.col("u_split")))
    own = materialise(own.select(F.col("file").alias("s_file"), F.col("split").alias("s_split"), F.length("head").cast("long").alias("start"), "row"), "starts")
    few = own.limit(BROADCAST + 1).count() <= BROADCAST
    same = (F.col("file") == F.col("s_file")) & (F.col("split") == F.col("s_split"))
    if few:
        rows = blocks.join(F.broadcast(own), same)
    else:
        placed = blocks.withColumn("at", F.monotonically_increasing_id())
        rows = placed.join(own, same).repartition("file", "split").sortWithinPartitions("file", "split", "at")
    rows = rows.select("file", "split", "start", "row", "data").mapInArrow(_record_reader, _DECODED)
    over = overhangs.join(units.where("kind = 1").select(F.col("file").alias("u_file"), F.col("split").alias("u_split"), "row"), (F.col("file") == F.col("u_file")) & (F.col("split") == F.col("u_split"))).select("file", "row", "data")
    rows = rows.unionAll(over.mapInArrow(_overhang_reader, _DECODED))
    refs = scan.where("refs is not null").select(F.col("file").alias("r_file"), F.posexplode("refs").alias("r_ref", "rname"))
    rows = rows.join(_small(refs), (F.col("file") == F.col("r_file")) & (F.col("ref") == F.col("r_ref")), "left").withColumn("is_dup", F.col("flag").bitwiseAND(1024) > 0)
    rows = rows.select(*[c.split()[0] for c in SCHEMA.split(", ")])
    return rows if sizes is None else rows.join(_small(sizes), F.col("rname") == F.col("chrom"), "left_semi")


def parse(data: bytes) -> Iterator[tuple]:
    """Rows of SCHEMA of a whole decompressed file, one after the other."""
    read = header(data)
    if read is None:
        raise ValueError("the header is cut off")
    refs, at = read
    starts, end = starts_of(data, at)
    if end != len(data):
        raise ValueError("the last record is cut off")
    for row, start in enumerate(starts, 1):
        _, ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, _, pnext, tlen = _HEAD.unpack_from(data, start)
        at = start + 36 + l_name + 4 * n_cigar
        packed = data[at : at + (l_seq + 1) // 2]
        seq = b"".join(BASES[x >> 4 : (x >> 4) + 1] + BASES[x & 15 : (x & 15) + 1] for x in packed)[:l_seq].decode()
        qual = bytes(min(q + 33, 126) for q in data[at + len(packed) : at + len(packed) + l_seq]).decode()
        yield row, data[start + 36 : start + 35 + l_name].decode(), flag, refs[ref][0] if ref >= 0 else None, pos, mapq, l_seq, seq, qual, pnext, tlen, bool(flag & 1024)


def deflate(data: bytes) -> bytes:
    """One block."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return MAGIC + b"\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def encode_header(refs: list[tuple[str, int]]) -> bytes:
    text = ("@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in refs)).encode()
    names = b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in refs)
    return b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs)) + names


def bin_of(start: int, end: int) -> int:
    """The least bin that holds [start, end): level k from the bottom has bins of 2^(14 + 3k) bases, after all larger ones."""
    end = max(end, start + 1) - 1
    for level in range(5):
        shift = 14 + 3 * level
        if start >> shift == end >> shift:
            return ((1 << 3 * (5 - level)) - 1) // 7 + (start >> shift)
    return 0


_CODES = bytes(15 if BASES.find(bytes([c]).upper()) < 0 else BASES.find(bytes([c]).upper()) for c in range(256))


def encode(qname: str, flag: int, ref: int, pos: int, mapq: int, seq: str, qual: str | None, pnext: int, tlen: int) -> bytes:
    """A record whose bases all match; its mate is on the same reference."""
    codes = seq.encode().translate(_CODES) + b"\0"
    packed = bytes(a << 4 | b for a, b in zip(codes[0 : len(seq) : 2], codes[1::2]))
    quality = bytes(max(0, c - 33) for c in qual.encode()) if qual else b"\xff" * len(seq)
    cigar = struct.pack("<I", len(seq) << 4) if seq and pos >= 0 and not flag & 4 else b""
    name = qname.encode() + b"\0"
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name), mapq, bin_of(max(pos, 0), max(pos, 0) + len(seq)), len(cigar) // 4, flag, len(seq), ref if pnext >= 0 else -1, pnext, tlen) + name + cigar + packed + quality
    return struct.pack("<i", len(body)) + body


class _Part:
    """One sorted part: blocks as they fill, and what the index has of them: chunks by bin, and the first block of each window of 2^14 bases."""

    def __init__(self, out, refs: list[tuple[str, int]]):
        self.out, self.at, self.buffer, self.n = out, 0, bytearray(), 0
        self.bins: dict[int, dict[int, list[list[int]]]] = {}
        self.windows: dict[int, dict[int, int]] = {}
        self.n_refs = len(refs)
        self.buffer += encode_header(refs)
        self.flush()

    def flush(self) -> None:
        while self.buffer:
            block = deflate(bytes(self.buffer[:BLOCK]))
            self.out.write(block)
            self.at += len(block)
            del self.buffer[:BLOCK]

    def add(self, ref: int, pos: int, size: int, record: bytes) -> None:
        if self.buffer and len(self.buffer) + len(record) > BLOCK:
            self.flush()  # records begin in one block, and end there unless they are longer
        start = self.at << 16 | len(self.buffer)
        self.buffer += record
        if len(self.buffer) >= BLOCK:
            self.flush()
        end, self.n = self.at << 16 | len(self.buffer), self.n + 1
        if ref < 0 or pos < 0:
            return
        chunks = self.bins.setdefault(ref, {}).setdefault(bin_of(pos, pos + size), [])
        if chunks and chunks[-1][1] >> 16 == start >> 16:
            chunks[-1][1] = end
        else:
            chunks.append([start, end])
        for w in range(pos >> 14, (pos + max(size, 1) - 1 >> 14) + 1):
            self.windows.setdefault(ref, {}).setdefault(w, start)

    def close(self) -> bytes:
        """Ends the file, and gives the index."""
        self.flush()
        self.out.write(EOF_BLOCK)
        index = [b"BAI\1", struct.pack("<i", self.n_refs)]
        for ref in range(self.n_refs):
            bins, windows = self.bins.get(ref, {}), self.windows.get(ref, {})
            index.append(struct.pack("<i", len(bins)))
            for number, chunks in sorted(bins.items()):
                index.append(struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
            last, line = 0, []
            for w in range(max(windows, default=-1) + 1):
                last = windows.get(w, last)
                line.append(last)
            index.append(struct.pack("<i", len(line)) + struct.pack(f"<{len(line)}Q", *line))
        return b"".join(index)


class _Writer(PartsWriter):
    def __init__(self, path: str, refs: list[tuple[str, int]]):
        super().__init__(path)
        self.refs = refs

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, folder, name = self.trial()
        number = {n: i for i, (n, _) in enumerate(self.refs)}
        with fs.open_output_stream(f"{folder}/{name}.bam") as out:
            part = _Part(out, self.refs)
            for b in iterator:
                for qname, flag, rname, pos, mapq, seq, qual, pnext, tlen in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in WRITTEN), strict=True):
                    ref = number[rname] if rname is not None else -1
                    part.add(ref, pos, len(seq), encode(qname, flag, ref, pos, mapq, seq, qual, pnext, tlen))
            index = part.close()
        with fs.open_output_stream(f"{folder}/{name}.bam.bai") as out:
            out.write(index)
        return Written([f"{name}.bam", f"{name}.bam.bai"] if part.n else [])


#: Columns of alignments that are written.
WRITTEN = ("qname", "flag", "rname", "pos", "mapq", "seq", "qual", "pnext", "tlen")


class BamSource(DataSource):
    """spark.read.format("bam").load(file), one task, and .write.format("bam").option("references", "chr1:1000,chr2:500").save(folder); bam() and write_bam() split and sort."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        refs = [(r.rpartition(":")[0], int(r.rpartition(":")[2])) for r in self.options["references"].split(",")]
        return _Writer(self.options["path"], refs)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.path)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, path = open_at(partition.value)
        data, refs, row = b"", None, 1
        with fs.open_input_file(path) as raw, gzip.open(raw) as f:
            while chunk := f.read(CHUNK):
                data += chunk
                if refs is None:
                    if (read := header(data)) is None:
                        continue
                    refs, data = pa.array([n for n, _ in read[0]], pa.string()), data[read[1] :]
                starts, end = starts_of(data, 0)
                if starts:
                    got = decode(data, starts)
                    got["rname"] = refs.take(pa.array(got["ref"], mask=got["ref"] < 0))
                    got |= {"file_row": np.arange(row, row + len(starts)), "is_dup": (got["flag"] & 1024) > 0}
                    names = [c.split()[0] for c in SCHEMA.split(", ")]
                    yield pa.RecordBatch.from_arrays([got[n] if isinstance(got[n], pa.Array) else pa.array(got[n]) for n in names], names)
                row, data = row + len(starts), data[end:]
        if data or refs is None:
            raise ValueError(f"{path} is cut off or damaged")


def write_bam(alignments: DataFrame, path: str, references: list[tuple[str, int]]) -> None:
    """Alignments (WRITTEN) as a folder of BAM files in coordinate order over all, each with its index; unplaced ones come last. rname has to be among the references, or null."""
    spark = alignments.sparkSession
    spark.dataSource.register(BamSource)
    number = F.array_position(F.array(*[F.lit(n) for n, _ in references]), F.col("rname"))
    rows = alignments.select(*WRITTEN, F.coalesce(number, F.lit(1 << 31)).alias("ref"))
    # Names deal the records of one position to parts, however many there are.
    rows = rows.repartitionByRange("ref", "pos", "qname").sortWithinPartitions("ref", "pos").select(*WRITTEN)
    rows.write.format("bam").mode("append").option("references", ",".join(f"{n}:{size}" for n, size in references)).save(path)


def bins_over(start: int, end: int) -> set[int]:
    """All bins with a base of [start, end)."""
    return {0} | {((1 << 3 * (5 - level)) - 1) // 7 + k for level in range(5) for k in range(start >> 14 + 3 * level, (end - 1 >> 14 + 3 * level) + 1)}


def chunks_over(index: bytes, ref: int, start: int, end: int) -> list[tuple[int, int]]:
    """From where to where records over [start, end) can stand, by an index: merged, in order."""
    at, wanted, found, least = 8, bins_over(start, end), [], 0
    for r in range(ref + 1):
        n = struct.unpack_from("<i", index, at)[0]
        at += 4
        for _ in range(n):
            number, m = struct.unpack_from("<Ii", index, at)
            if r == ref and number in wanted:
                found += [struct.unpack_from("<QQ", index, at + 8 + 16 * i) for i in range(m)]
            at += 8 + 16 * m
        n = struct.unpack_from("<i", index, at)[0]
        if r == ref:
            if start >> 14 >= n:
                return []  # past the last record
            least = struct.unpack_from("<Q", index, at + 4 + 8 * (start >> 14))[0]
        at += 4 + 8 * n
    merged: list[list[int]] = []
    for a, b in sorted((max(a, least), b) for a, b in found if b > least):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def region_batches(data, chunks: list[tuple[int, int]], ref: int, start: int, end: int, size: int) -> Iterator[tuple[list[bytes], int]]:
    """The records over [start, end) in these chunks of an open file, some `size` bytes at a time, and how many blocks were opened until then; in the end what is left, if only the number."""
    out, opened, taken = [], 0, 0
    for a, b in chunks:
        at, skip, held = a >> 16, a & 0xFFFF, b""
        while at <= b >> 16:
            data.seek(at)
            head = data.read(18)
            if len(head) < 18:
                break
            length = block_size(head[4:]) + len(MAGIC)
            block, opened = inflate(head[4:] + data.read(length - 18)), opened + 1
            held += block[skip : b & 0xFFFF] if at == b >> 16 else block[skip:]
            at, skip = at + length, 0
            starts, done = starts_of(held, 0)
            for s in starts:
                _, r, pos, *_, l_seq, _, _, _ = _HEAD.unpack_from(held, s)
                if r > ref or r == ref and pos >= end:
                    yield out, opened
                    return
                if r == ref and pos + max(l_seq, 1) > start:
                    out.append(held[s : s + 4 + struct.unpack_from("<i", held, s)[0]])
                    taken += len(out[-1])
            held = held[done:]
            if taken >= size:
                yield out, opened
                out, taken = [], 0
    yield out, opened


def region_records(data, chunks: list[tuple[int, int]], ref: int, start: int, end: int) -> tuple[list[bytes], int]:
    """All records of region_batches(), and how many blocks were opened for them."""
    out, opened = [], 0
    for records, opened in region_batches(data, chunks, ref, start, end, REGION_BATCH):
        out += records
    return out, opened


def bam_region(spark: SparkSession, path: str, rname: str, start: int, end: int) -> DataFrame:
    """Alignments that cover a base of [start, end) (0-based) of rname, from a folder of write_bam(), and opened, the blocks that were read of their part up to them.

    Indices come through Spark, a part each; executors open the parts at the blocks that these name, so the folder has to
    be one that they can open.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, index in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, file = open_at(name.removesuffix(".bai"))
                with fs.open_input_file(file) as data:
                    first, refs = b"", None
                    at = 0
                    while refs is None:  # the header's own blocks
                        data.seek(at)
                        head = data.read(18)
                        size = block_size(head[4:]) + len(MAGIC)
                        first += inflate(head[4:] + data.read(size - 18))
                        at, refs = at + size, header(first)
                    names = [n for n, _ in refs[0]]
                    if rname not in names:
                        continue
                    ref = names.index(rname)
                    for records, opened in region_batches(data, chunks_over(index, ref, start, end), ref, start, end, REGION_BATCH):
                        if records:
                            places = np.cumsum([0, *map(len, records[:-1])])
                            got = decode(b"".join(records), list(places))
                            columns = {"qname": got["qname"], "flag": got["flag"], "pos": got["pos"], "mapq": got["mapq"], "rlen": got["rlen"], "seq": got["seq"], "opened": np.full(len(records), opened, np.int32)}
                            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))

    indices = spark.read.format("binaryFile").option("pathGlobFilter", "*.bai").load(path).select("path", "content")
    return indices.mapInArrow(run, "qname string, flag int, pos int, mapq int, rlen int, seq string, opened int").withColumn("rname", F.lit(rname))
