"""Signature trees over set bitmaps: OR-combined bitmaps and size ranges, and a dual traversal that prunes by possible overlap."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Sets of a leaf, and children of an inner node.
LEAF, FAN = 16, 8


def bitmap(values: np.ndarray) -> bytes:
    """One bit a value at its low bits; 4 to 8 bits for each value, in 64 to 16,384 bits."""
    bits = 1 << min(14, max(6, int(len(values) * 4 - 1).bit_length()))
    out = np.zeros(bits, np.uint8)
    out[(values & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def fold(data: bytes, size: int) -> np.ndarray:
    """A bitmap folded to size bytes: bits stand for the same values taken modulo fewer."""
    return np.bitwise_or.reduce(np.frombuffer(data, np.uint8).reshape(-1, size), axis=0)


def bytes_of(a: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of bitmaps, and where each begins and ends."""
    ends = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1]
    return np.frombuffer(a.buffers()[2], np.uint8) if len(a) and ends[-1] else np.zeros(0, np.uint8), ends.astype(np.int64)


def may_reach(bitmaps: tuple[np.ndarray, np.ndarray], n: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (i, j) of sets of n values may reach the similarity, by sizes and by the most overlap that their bitmaps allow."""
    data, ends = bitmaps
    keep = (100 * n[i] >= percent * n[j]) & (100 * n[j] >= percent * n[i])
    size = np.diff(ends)
    a, b = np.where(size[i] <= size[j], i, j), np.where(size[i] <= size[j], j, i)
    kind = size[a] << 32 | size[b]
    for k in np.unique(kind[keep]):
        short, long = int(k >> 32), int(k & 0xFFFFFFFF)
        rows = np.flatnonzero(keep & (kind == k))
        for at in np.array_split(rows, -(-len(rows) * long // (1 << 22))):
            p = data[ends[a[at]][:, None] + np.arange(short)]
            q = np.bitwise_or.reduce(data[ends[b[at]][:, None] + np.arange(long)].reshape(len(at), -1, short), axis=1)
            ones = lambda x: np.bitwise_count(x).sum(axis=1, dtype=np.int64)
            most = ones(p & q) + np.minimum(n[a[at]] - ones(p), n[b[at]] - ones(q))
            keep[at] = most >= needed(n[a[at]], n[b[at]], percent)
    return keep


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap with which sets of sizes a and b reach the similarity."""
    return -(-percent * (a + b) // (100 + percent))


@dataclass
class _Level:
    bits: np.ndarray
    low: np.ndarray  # least set size
    high: np.ndarray
    excess: np.ndarray  # most values beyond set bits
    label: np.ndarray  # the sets' class, -1 if several
    shared: np.ndarray  # earlier groups that all the sets are in, as bits


def _level(below: _Level, fan: int) -> _Level:
    at = np.arange(0, len(below.low), fan)
    first, last = np.minimum.reduceat(below.label, at), np.maximum.reduceat(below.label, at)
    return _Level(np.bitwise_or.reduceat(below.bits, at, axis=0), np.minimum.reduceat(below.low, at), np.maximum.reduceat(below.high, at), np.maximum.reduceat(below.excess, at), np.where(first == last, first, -1), np.bitwise_and.reduceat(below.shared, at, axis=0))


def _possible(a: _Level, i: np.ndarray, b: _Level, j: np.ndarray, percent: int) -> np.ndarray:
    ok = (a.label[i] != b.label[j]) | (a.label[i] < 0)
    ok &= (100 * a.high[i] >= percent * b.low[j]) & (100 * b.high[j] >= percent * a.low[i])
    ok &= ~(a.shared[i] & b.shared[j]).any(axis=1)
    i, j = i[ok], j[ok]
    most = np.bitwise_count(a.bits[i] & b.bits[j]).sum(axis=1, dtype=np.int64) + np.minimum(a.excess[i], b.excess[j])
    out = np.flatnonzero(ok)
    return out[most >= needed(a.low[i], b.low[j], percent)]


def earlier(groups: list[list[int]], most: int = 1024) -> np.ndarray:
    """One row of bits a set, one bit for each of the earlier groups that several sets are in, the largest `most` of them."""
    of = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    values, code, counts = np.unique(np.array([v for g in groups for v in g], np.int64), return_inverse=True, return_counts=True)
    take = np.argsort(-counts, kind="stable")[: min(most, int((counts > 1).sum()))]
    place = np.full(len(values), -1)
    place[take] = np.arange(len(take))
    out = np.zeros((len(groups), max(1, -(-len(take) // 64)) * 64), np.uint8)
    at = place[code]
    out[of[at >= 0], at[at >= 0]] = 1
    return np.packbits(out, axis=1).view(np.uint64)


def candidate_pairs(bitmaps: list[bytes], sizes: np.ndarray, labels: np.ndarray, side: np.ndarray, percent: int, shared: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets of different class that may reach the similarity, none left out. side: 0 and 1 pair across; all 0 pairs within.

    shared: earlier groups of each set as bits (see earlier()); pairs that share one are left to it.

    Sets whose bitmaps have one length share a tree; from a similarity of a half on, lengths of linked sets differ by a step at most.
    """
    shared = np.zeros((len(bitmaps), 1), np.uint64) if shared is None else shared
    length = np.array([len(x) for x in bitmaps])
    steps = [np.flatnonzero(length == n) for n in np.unique(length)]
    jobs = [(x, side[x]) for x in steps if (side == 0).all() or len(set(side[x].tolist())) == 2]
    for x, y in zip(steps, steps[1:], strict=False):
        if length[y[0]] == 2 * length[x[0]]:
            for a, b in ([(x, y)] if (side == 0).all() else [(x[side[x] == 0], y[side[y] == 1]), (x[side[x] == 1], y[side[y] == 0])]):
                if len(a) and len(b):
                    jobs.append((np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])))
    pairs = [(rows[i], rows[j]) for rows, s in jobs if len(rows) > 1 for i, j in [_traverse([bitmaps[k] for k in rows], sizes[rows], labels[rows], s, percent, shared[rows])]]
    return tuple(np.concatenate(x) if pairs else np.zeros(0, np.int64) for x in (zip(*pairs, strict=True) if pairs else ([], [])))


def _traverse(bitmaps: list[bytes], sizes: np.ndarray, labels: np.ndarray, side: np.ndarray, percent: int, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    # Sets of like size that are in the same earlier groups stand together.
    step = np.floor(np.log(sizes) * (4 / np.log(100 / percent))).astype(int)
    order = np.lexsort((sizes, *(x.byteswap() for x in shared.T[::-1]), step, side))
    size = max(8, min(len(x) for x in bitmaps))
    bits = np.stack([fold(bitmaps[i].ljust(8, b"\0"), size) for i in order]).view(np.uint64)
    sizes, labels, shared, split = sizes[order].astype(np.int64), labels[order], shared[order], int((side == 0).sum())

    def tree(a: int, b: int) -> list[_Level]:
        part = bits[a:b]
        _, codes = np.unique(labels, return_inverse=True)
        levels = [_Level(part, sizes[a:b], sizes[a:b], sizes[a:b] - np.bitwise_count(part).sum(axis=1, dtype=np.int64), codes[a:b], shared[a:b])]
        while len(levels[-1].low) > 1:
            levels.append(_level(levels[-1], LEAF if len(levels) == 1 else FAN))
        return levels

    within = split == len(order)
    left = tree(0, split)
    right = left if within else tree(split, len(order))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    depth = (len(left) - 1, len(right) - 1)
    stack = [(depth[0], depth[1], np.array([0]), np.array([0]))]
    while stack:
        p, q, i, j = stack.pop()
        keep = _possible(left[p], i, right[q], j, percent)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if p == q == 0:
            found.append((i, j))
            continue
        if p >= q:
            i, j = _children(i, j, left, p)
            p -= 1
        else:
            j, i = _children(j, i, right, q)
            q -= 1
        if within and p == q:
            i, j = i[i <= j], j[i <= j]
            if p == 0:
                i, j = i[i < j], j[i < j]
        for a in range(0, len(i), 1 << 15):
            stack.append((p, q, i[a : a + (1 << 15)], j[a : a + (1 << 15)]))
    i = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
    j = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
    return order[i], order[j + (0 if within else split)]


def _children(i: np.ndarray, j: np.ndarray, tree: list[_Level], level: int) -> tuple[np.ndarray, np.ndarray]:
    fan = LEAF if level == 1 else FAN
    child = (i[:, None] * fan + np.arange(fan)).ravel()
    other = np.repeat(j, fan)
    ok = child < len(tree[level - 1].low)
    return child[ok], other[ok]
