"""Removal of long byte strings that occur earlier, by sampled names and difference-cover suffix arrays."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import batch_rows, materialise, pieces, row_keys
from locusframe.llm.suffix_array import suffix_array

_PRIME = 0x100000001B3
#: Bytes of context sorted in one suffix array; and the most contexts of one name that are sorted so (the rest go by hashes of their strings).
SORT_BYTES, SORT_CONTEXTS = 1_500_000, 40_000


def window_hash(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of every length-byte string of data, by doubling."""
    out, done, part, size, p = None, 0, data.astype(np.uint64) + np.uint64(1), 1, _PRIME
    while True:
        if length & size:
            if out is None:
                out, done = part, size
            else:
                n = len(data) - done - size + 1
                out = out[:n] * np.uint64(p) + part[done : done + n]
                done += size
        if done == length:
            break
        n = len(part) - size
        part = part[:n] * np.uint64(p) + part[size:]
        p, size = p * p & 0xFFFFFFFFFFFFFFFF, size * 2
    x = out[: len(data) - length + 1]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _slide(x: np.ndarray, width: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """pick over every run of width elements, by block prefixes and suffixes."""
    n = len(x)
    m = -(-n // width) * width
    y = np.full(m, fill, x.dtype)
    y[:n] = x
    blocks = y.reshape(-1, width)
    left = pick.accumulate(blocks, axis=1).ravel()
    right = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(right[: n - width + 1], left[width - 1 : n])


def sampled_positions(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the least hash of some run of width positions: equal runs have them at equal places."""
    if len(hashes) <= width:
        return np.flatnonzero(hashes == hashes.min())
    least = _slide(hashes, width, np.minimum, 0xFFFFFFFFFFFFFFFF)
    pad = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(_slide(np.concatenate([pad, least, pad]), width, np.maximum, 0) == hashes)


_KEY = "none boolean, doc long, sub long"
_SAMPLES = f"name long, ctx long, {_KEY}, pos int, again boolean"
_MARKS = f"open boolean, name long, {_KEY}, pos int"
_CONTEXTS = f"name long, {_KEY}, start int, at int, bytes binary"
_RANGES = f"{_KEY}, lo int, hi int, key1 long, key2 long"


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=False) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(x.split()[0], _KINDS[x.split()[1]]) for x in ddl.split(", ")])


def _repeats(ctx: np.ndarray, name: np.ndarray, place: list[np.ndarray]) -> np.ndarray:
    """Which samples have one of their name and context at an earlier place among these; a place that comes twice is no earlier one."""
    order = np.argsort(ctx)
    same = ctx[order][1:] == ctx[order][:-1]
    several = order[np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))]
    out = np.zeros(len(ctx), bool)
    if len(several):
        several = several[np.lexsort([*(p[several] for p in place[::-1]), name[several], ctx[several]])]
        new = np.concatenate([[True], (ctx[several][1:] != ctx[several][:-1]) | (name[several][1:] != name[several][:-1])])
        first = several[np.flatnonzero(new)][np.cumsum(new) - 1]
        out[several] = np.any([p[several] != p[first] for p in place], axis=0)
    return out


def _sampler(length: int, gram: int) -> Callable:
    reach, schema = length - gram, _schema(_SAMPLES)

    def sampled(b: pa.RecordBatch) -> pa.RecordBatch | None:
        parts: list[tuple] = []
        for i, value in enumerate(b.column(3)):
            text = value.as_buffer() if value.is_valid else b""
            data = np.frombuffer(text, np.uint8) if text else np.zeros(0, np.uint8)
            if len(data) < length:
                continue
            hashes = window_hash(data, gram)
            at = sampled_positions(hashes, reach + 1)
            # The context is hashed as the names of its two ends and its middle, with its lengths at the text's ends.
            lo, hi = np.maximum(at - reach, 0), np.minimum(at + length, len(data))
            ctx = np.zeros(len(at), np.uint64)
            for step in range(0, 2 * length - gram, gram):
                ctx = (ctx ^ hashes[np.minimum(lo + step, hi - gram)]) * np.uint64(0x9E3779B97F4A7C15)
                ctx ^= ctx >> np.uint64(29)
            ctx = (ctx + (at - lo).astype(np.uint64) * np.uint64(1_000_003) + (hi - at).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            parts.append((hashes[at].view(np.int64), ctx.view(np.int64), np.full(len(at), i), at.astype(np.int32)))
        if not parts:
            return None
        name, ctx, row, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        none, doc, sub = (b.column(k).to_numpy(zero_copy_only=False)[row] for k in range(3))
        again = _repeats(ctx, name, [none, doc, sub, pos])
        return _batch([pa.array(x) for x in (name, ctx, none, doc, sub, pos, again)], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if (out := sampled(b)) is not None:
                yield out

    return run


def _marker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by name, ctx and place. The first row of each ctx is open if its name has several ctx; every later row, and every one marked before, is repeated with all its context."""
    schema = _schema(_MARKS)
    last: tuple | None = None  # the previous row
    first: list[pa.Array] = []  # the first row of its name
    told = True  # whether that row went out as open

    def out(b: pa.RecordBatch, at: np.ndarray, is_open: np.ndarray) -> list[pa.Array]:
        take = pa.array(at)
        return [pa.array(is_open), *(b.column(k).take(take).cast(schema.field(c).type) for c, k in (("name", 0), ("none", 2), ("doc", 3), ("sub", 4), ("pos", 5)))]

    for b in batches:
        again = np.flatnonzero(b.column(6).to_numpy(zero_copy_only=False))
        if len(again):
            yield pa.RecordBatch.from_arrays(out(b, again, np.zeros(len(again), bool)), schema=schema)
            b = b.filter(pc.invert(b.column(6)))
        if not b.num_rows:
            continue
        rows = [b.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
        moved = [np.concatenate([[last is None or r[0] != last[i]], r[1:] != r[:-1]]) for i, r in enumerate(rows)]
        new_name = moved[0]
        new_ctx = new_name | moved[1]
        same_row = ~np.any([new_ctx, *moved[2:]], axis=0)
        group = np.cumsum(new_name)
        several = np.bincount(group, weights=new_ctx & ~new_name, minlength=group[-1] + 1) > 0
        if several[0] and not told:
            yield pa.RecordBatch.from_arrays(first, schema=schema)
            told = True
        is_open = new_ctx & (~new_name | several[group])
        at = np.flatnonzero((is_open | ~new_ctx) & ~same_row)
        if len(at):
            yield pa.RecordBatch.from_arrays(out(b, at, is_open[at]), schema=schema)
        if new_name.any():
            i = np.flatnonzero(new_name)[-1:]
            first, told = out(b, i, np.array([True])), bool(several[group[i[0]]])
        last = tuple(r[-1] for r in rows)


def _cutter(length: int, gram: int) -> Callable:
    reach, schema = length - gram, _schema(_CONTEXTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for none, doc, sub, text, marks in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                for m in marks:
                    lo = max(0, m["pos"] - reach)
                    rows.append((m["name"], none, doc, sub, lo, m["pos"] - lo, text[lo : m["pos"] + length]))
                    if len(rows) == 20_000:
                        yield _batch(list(zip(*rows, strict=True)), schema)
                        rows = []
            if rows:
                yield _batch(list(zip(*rows, strict=True)), schema)

    return run


def repeated_starts(contexts: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, start in its text) of each length-byte string of the contexts that also starts earlier in some context.

    docs ranks the contexts' documents. The contexts are joined with a separator of its own each, their suffixes sorted,
    and neighbours compared over length bytes.
    """
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes + 1)
    data = np.frombuffer(b"\0".join([*contexts, b""]), np.uint8)
    of = np.repeat(np.arange(len(contexts), dtype=np.int32), sizes + 1)
    symbols = data.astype(np.int32) + 1
    symbols[ends - 1] = 257 + np.arange(len(contexts))
    order = suffix_array(symbols)
    order = order[order + length < ends[of[order]]]
    if len(order) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = window_hash(data, length)[order]
    same = hashes[1:] == hashes[:-1]
    pairs = np.flatnonzero(same)
    rows = np.lib.stride_tricks.sliding_window_view(data, length)
    for a in range(0, len(pairs), 50_000):
        p = pairs[a : a + 50_000]
        same[p] = (rows[order[p]] == rows[order[p + 1]]).all(axis=1)
    run = np.concatenate([[0], np.cumsum(~same)])
    context = of[order]
    start = order - (ends - sizes - 1)[context] + starts[context]
    place = docs[context].astype(np.int64) << 36 | start
    first = np.minimum.reduceat(place, np.flatnonzero(np.concatenate([[True], ~same])))
    later = place > first[run]
    return context[later], start[later]


def _comparer(length: int, gram: int, most: int) -> Callable:
    schema, half = _schema(_RANGES), (length - gram + 1) // 2

    def compare(rows: list[tuple]) -> pa.RecordBatch:
        keys = [r[1:4] for r in rows]
        ranks = {k: i for i, k in enumerate(sorted(set(keys)))}
        context, start = repeated_starts([r[6] for r in rows], np.array([ranks[k] for k in keys]), np.array([r[4] for r in rows]), length)
        order = np.lexsort((start, context))
        context, start = context[order], start[order]
        cut = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (start[1:] > start[:-1] + length)])) if len(start) else np.zeros(0, np.int64)
        last = np.concatenate([cut[1:], [len(start)]]).astype(np.int64) - 1 if len(cut) else cut
        who = [rows[i] for i in context[cut]]
        return _batch([*([r[k] for r in who] for k in (1, 2, 3)), start[cut].astype(np.int32), (start[last] + length).astype(np.int32), [None] * len(who), [None] * len(who)], schema)

    def wide(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        for _, none, doc, sub, lo, _, text in rows:
            for i in range(len(text) - length + 1):
                d = hashlib.blake2b(text[i : i + length], digest_size=16).digest()
                out.append((none, doc, sub, lo + i, lo + i + length, int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)))
        return _batch(list(zip(*out, strict=True)), schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: list[tuple] = []  # rows of finished names
        size = 0
        group: list[tuple] = []  # rows of one name; once it is too large for one array its rows go on as strings
        name, large = None, False
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if row[0] != name:
                    if large and group:
                        yield wide(group)
                    elif not large:
                        kept = _near(group, half, gram)
                        whole += kept
                        size += sum(len(r[6]) for r in kept)
                    if size >= SORT_BYTES:
                        yield compare(whole)
                        whole, size = [], 0
                    group, name, large = [], row[0], False
                group.append(row)
                if len(group) > most or large and len(group) >= 2_000:
                    yield wide(group)
                    group, large = [], True
        if large and group:
            yield wide(group)
        elif not large:
            whole += _near(group, half, gram)
        if whole:
            yield compare(whole)

    return run


def _near(group: list[tuple], half: int, gram: int) -> list[tuple]:
    """The contexts of a name that can share a long string with another: it reaches `half` bytes beyond the name on one side at least, so they have those bytes in common."""
    sides = []
    for r in group:
        at, text = r[5], r[6]
        sides.append((text[at - half : at] if at >= half else None, after if len(after := text[at + gram : at + gram + half]) == half else None))
    counts = [Counter(s[k] for s in sides if s[k] is not None) for k in (0, 1)]
    return [r for r, (left, right) in zip(group, sides, strict=True) if counts[0][left] > 1 or counts[1][right] > 1]


def _remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        out = []
        for doc, text, ranges in zip(*(b.column(i).to_pylist() for i in range(2)), b.column(2).to_pylist(), strict=True):
            text = text or b""
            spans: list[list[int]] = []
            for lo, hi in sorted((max(0, r["lo"]), min(len(text), r["hi"])) for r in ranges or []):
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(hi, spans[-1][1])
                else:
                    spans.append([lo, hi])
            kept, at = [], 0
            for lo, hi in spans:
                kept.append(text[at:lo])
                at = hi
            kept.append(text[at:])
            left = b"".join(kept)
            out.append((doc, len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left, spans))
        cols = list(zip(*out, strict=True)) if out else [[]] * 7
        spans_type = pa.list_(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), spans_type), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])


def substring_dedup(df: DataFrame, length: int = 100, gram: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes every byte covered by a length-byte string that also starts earlier (smaller id, or same text and earlier start).

    One row per row of df: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary) and spans ([from, to) pairs).
    Strings are judged on the input; matches never cross texts.

    Names (hashes of gram bytes) are sampled where they are the least of length - gram + 1 neighbours, so two equal
    strings hold a sampled name at the same place. Names are grouped; a sample whose whole context (length - gram bytes
    before it, length from it on) is that of an earlier sample is repeated entirely, and the first sample of each
    different context goes, with the context's bytes, to a suffix array of its group, built by difference cover, where
    neighbours that share length bytes are compared. Groups of over SORT_CONTEXTS different contexts are joined by a
    128-bit hash of each string instead. No step holds more than one text or one such group.

    Within a task, a sample whose name and context an earlier one there has is known to be repeated before any shuffle,
    so a frequent passage sends one row a task and context to the group of its name.

    Null texts count as empty. Null ids come after all others; rows with the same id are ordered by a hash of their
    text, and rows that repeat both id and text count as one document: each gets the same result. Other columns of df
    are not carried. An empty df gives an empty result.
    """
    plain = F.coalesce(F.col(text_col), F.lit(""))
    keys, _ = row_keys(df, id_col, plain)
    key = [k.split()[0] for k in _KEY.split(", ")]
    docs = df.select(F.col(id_col).cast("long").alias("id"), *keys, F.encode(plain, "UTF-8").alias("text"))
    samples = docs.select(*key, "text").mapInArrow(_sampler(length, gram), _SAMPLES)
    # Known repeats only pass through, so they are spread by place.
    spread = F.when(F.col("again"), F.xxhash64("doc", "pos")).otherwise(F.col("name"))
    marks = samples.repartition(spread).sortWithinPartitions("name", "ctx", *key, "pos").mapInArrow(_marker, _MARKS)
    with batch_rows(df.sparkSession, 2000):
        marks = materialise(marks, "samples")
    reach = length - gram

    def per_doc(rows: DataFrame, *what: str) -> DataFrame:
        return rows.groupBy(*[F.col(k).alias(f"m_{k}") for k in key]).agg(F.collect_list(F.struct(*what)).alias("found"))

    both = [F.col(k) == F.col(f"m_{k}") for k in key]
    opened = per_doc(marks.where("open"), "name", "pos")
    contexts = docs.join(opened, both).select(*key, "text", "found").mapInArrow(_cutter(length, gram), _CONTEXTS)
    compared = contexts.repartition("name").sortWithinPartitions("name", *key, "start").mapInArrow(_comparer(length, gram, SORT_CONTEXTS), _RANGES)
    with batch_rows(df.sparkSession, 500):
        compared = materialise(compared, "ranges")
    keyed = compared.where("key1 is not null")
    place = F.struct(*key, "lo")
    firsts = keyed.groupBy("key1", "key2").agg(F.min(place).alias("first"))
    later = keyed.join(firsts, ["key1", "key2"]).where(place > F.col("first")).select(*key, "lo", "hi")
    ranges = (
        marks.where("not open").select(*key, (F.col("pos") - reach).alias("lo"), (F.col("pos") + length).alias("hi"))
        .unionAll(compared.where("key1 is null").select(*key, "lo", "hi")).unionAll(later)
    )
    out = docs.join(per_doc(ranges, "lo", "hi"), both, "left").select("id", "text", "found")
    return out.mapInArrow(_remover, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<array<long>>")
