"""GIF files: LZW code streams, palettes, disposal, transparency and timed frames, in numpy."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np

@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    canvas: np.ndarray  # height x width x 4 of the whole picture as shown: RGBA


#: Codes have at most so many bits, and a table so many entries.
_MOST_BITS, _ENTRIES = 12, 4096


@cache
def _widths(bits: int) -> np.ndarray:
    """Bits of each code after a clear code: a table has an entry more for each, and codes grow when its size needs it."""
    first = (1 << bits) + 2
    return np.array([min(_MOST_BITS, max(bits + 1, (first + i - 1).bit_length())) for i in range(2 * _ENTRIES)], np.int64)


def _packed(codes: np.ndarray, widths: np.ndarray) -> bytes:
    ends = np.cumsum(widths)
    at = ends - widths
    value, byte, size = codes << (at & 7), at >> 3, int(ends[-1] + 7) // 8
    parts = [np.bincount(byte + k, weights=value >> 8 * k & 255, minlength=size + 2) for k in range(3)]  # bits don't overlap, so sums are unions
    return sum(parts)[:size].astype(np.uint8).tobytes()


@cache
def _empty(bits: int) -> list[int]:
    """The worker's table of codes by (code, sample); whoever uses it leaves it empty."""
    return [0] * (_ENTRIES << bits)


def lzw_encode(samples: bytes, bits: int = 8) -> bytes:
    """The compressing code stream of samples below 2^bits; the table is cleared when it is full."""
    clear = 1 << bits
    following, codes, starts = clear + 2, [clear], [1]
    table, keys = _empty(bits), []
    put, keep, rest = codes.append, keys.append, iter(samples)
    code = next(rest, None)
    for sample in rest:
        key = code << bits | sample
        longer = table[key]
        if longer:
            code = longer
            continue
        put(code)
        code = sample
        if following < _ENTRIES:
            table[key] = following
            keep(key)
            following += 1
        else:
            put(clear)
            for key in keys:
                table[key] = 0
            keys.clear()
            following = clear + 2
            starts.append(len(codes))
    for key in keys:
        table[key] = 0
    if code is not None:
        put(code)
    put(clear + 1)
    first = np.zeros(len(codes), np.int64)
    first[starts] = starts
    place = np.arange(len(codes)) - np.maximum.accumulate(first)
    place[0] = 0
    return _packed(np.array(codes, np.int64), _widths(bits)[place])


def _codes(data: bytes, bits: int) -> Iterator[tuple[np.ndarray, bool]]:
    """The codes between clear codes, and whether the stream goes on. Widths follow from a code's number since the last clear code, so codes are cut out in blocks."""
    clear = 1 << bits
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int32)
    widths, at, since, parts = _widths(bits), 0, 0, []
    while True:
        w = widths[since : since + _ENTRIES]
        ends = at + np.cumsum(w)
        k = int(np.searchsorted(ends, len(data) * 8, side="right"))
        w, ends = w[:k], ends[:k]
        place = ends - w
        byte = place >> 3
        codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (place & 7) & ((1 << w) - 1)
        special = np.flatnonzero((codes == clear) | (codes == clear + 1))
        stop = int(special[0]) if len(special) else k
        parts.append(codes[:stop])
        if stop == k and k:
            since, at = min(since + k, _ENTRIES), int(ends[-1])  # beyond a full table all codes have one width
            continue
        on = bool(k) and codes[stop] == clear
        yield np.concatenate(parts), on
        if not on:
            return
        parts, since, at = [], 0, int(ends[stop])


def _strings(codes: np.ndarray, bits: int) -> np.ndarray:
    """The samples that codes after a clear code stand for.

    The table's entry j is what the codes so far gave from the place of code j on, one sample more than code j's own
    string. So a code repeats an earlier place: its length is that of code j and one, and each of its samples is that of
    a place before, or a literal. Both are followed to their literals by doubling.
    """
    first = (1 << bits) + 2
    number = np.arange(len(codes), dtype=np.int32)
    literal = codes < 1 << bits
    parent = np.where(literal, number, codes - first).astype(np.int32)
    if (~literal & (parent >= number)).any():
        raise ValueError("a code outside the table")
    size, up = (~literal).astype(np.int32), parent
    while not ((further := up[up]) == up).all():
        size, up = size + size[up], further
    size = size + 1
    ends = np.cumsum(size)
    start = (ends - size).astype(np.int32)
    # Each sample's place in the strings, less that of the place it repeats, is the same for a whole code.
    back = np.repeat(start - start[parent], size)
    source = np.arange(ends[-1] if len(codes) else 0, dtype=np.int32) - back
    while not ((further := source[source]) == source).all():
        source = further
    out = np.zeros(len(source), np.uint8)
    out[start[literal]] = codes[literal]
    return out[source]


def lzw_decode(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first n samples of a code stream."""
    parts, got = [], 0
    for codes, _ in _codes(data, bits):
        parts.append(_strings(codes, bits))
        got += len(parts[-1])
        if got >= n:
            break
    if got < n:
        raise ValueError("a code stream that ends early")
    return np.concatenate(parts)[:n]


def _blocks(data: bytes) -> bytes:
    whole = len(data) // 255 * 255
    rows = np.empty((whole // 255, 256), np.uint8)
    rows[:, 0] = 255
    rows[:, 1:] = np.frombuffer(data[:whole], np.uint8).reshape(-1, 255)
    rest = data[whole:]
    return rows.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def _table(palette: np.ndarray) -> tuple[int, bytes]:
    """The exponent less one of a colour table's size, and its bytes, filled up."""
    k = max(1, int(len(palette) - 1).bit_length())
    full = np.zeros((1 << k, 3), np.uint8)
    full[: len(palette)] = palette
    return k - 1, full.tobytes()


def write(frames: list[dict], width: int, height: int, palette: np.ndarray) -> bytes:
    """frames: pixels (rows x columns of palette indices) and, if given, left, top, delay_ms, disposal, transparent and a palette of their own."""
    size, colours = _table(palette)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF0 | size, 0, 0), colours]
    for f in frames:
        pixels = np.ascontiguousarray(f["pixels"], np.uint8)
        clear, own = f.get("transparent"), f.get("palette")
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, f.get("disposal", 1) << 2 | (clear is not None), f.get("delay_ms", 100) // 10, clear or 0, 0))
        mine, local = (size, b"") if own is None else _table(own)
        bits = max(2, mine + 1)
        out.append(struct.pack("<BHHHHBB", 0x2C, f.get("left", 0), f.get("top", 0), pixels.shape[1], pixels.shape[0], 0 if own is None else 0x80 | mine, 0)[:-1] + local + bytes([bits]))
        out.append(_blocks(lzw_encode(pixels.tobytes(), bits)))
    return b"".join([*out, b";"])


def _read_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while size := data[at]:
        out.append(data[at + 1 : at + 1 + size])
        at += size + 1
    return b"".join(out), at + 1


def read(data: bytes) -> tuple[int, int, list[Frame]]:
    """Width, height and the frames as shown, after palettes, transparency, disposal and interlacing."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF file")
    width, height, flags = struct.unpack("<HHB", data[6:11])
    at, shared = 13, None
    if flags & 0x80:
        n = 3 << (flags & 7) + 1
        shared = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
        at += n
    canvas = np.zeros((height, width, 4), np.uint8)
    frames: list[Frame] = []
    delay, disposal, clear = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            block, at = _read_blocks(data, at + 2)
            if label == 0xF9:
                disposal, delay, clear = block[0] >> 2 & 7, struct.unpack("<H", block[1:3])[0] * 10, block[3] if block[0] & 1 else None
            continue
        left, top, w, h, packed = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at += 10
        palette = shared
        if packed & 0x80:
            n = 3 << (packed & 7) + 1
            palette = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
            at += n
        bits = data[at]
        block, at = _read_blocks(data, at + 1)
        pixels = lzw_decode(block, bits, w * h).reshape(h, w)
        if packed & 0x40:
            rows = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
            straight = np.empty_like(pixels)
            straight[rows] = pixels
            pixels = straight
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        pixels = pixels[: area.shape[0], : area.shape[1]]
        colours = np.full((max(256, len(palette)), 4), 255, np.uint8)
        colours[: len(palette), :3] = palette
        if clear is None:
            area[:] = colours[pixels]
        else:
            area[:] = np.where((pixels != clear)[..., None], colours[pixels], area)
        frames.append(Frame(left, top, w, h, delay, disposal, canvas.copy()))
        if disposal == 2:
            area[:] = 0
        elif before is not None:
            canvas = before
        delay, disposal, clear = 0, 0, None
    return width, height, frames
