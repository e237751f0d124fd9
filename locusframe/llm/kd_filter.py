"""k-d trees over blocks of integer points, and the filtering step of Lloyd's algorithm on them. Exact: all numbers are integers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Points of a leaf; nodes that are compared with all entries at once.
LEAF, CHUNK = 16, 1024


@dataclass
class Tree:
    """points (n, dims) in the tree's order, order (n) of them in the block, and of each level, from the root: lo, hi, sums (nodes, dims) and counts (nodes)."""

    points: np.ndarray
    order: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def n_levels(n: int) -> int:
    """Levels of the tree over n points; the last one has leaves of LEAF points, but the last of these."""
    levels = 1
    while LEAF << (levels - 1) < n:
        levels += 1
    return levels


def spans(n: int, level: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last point, exclusive, of each node of a level that has any."""
    size = LEAF << (levels - 1 - level)
    start = np.arange(0, n, size)
    return start, np.minimum(start + size, n)


def build(points: np.ndarray) -> Tree:
    """Splits at the median of the widest dimension, all nodes of a level at once. Nodes are full but for the last one of a level."""
    n, dims = points.shape
    levels = n_levels(n)
    order = np.arange(n)
    for level in range(levels - 1):
        size = LEAF << (levels - 1 - level)
        full = n // size * size
        parts = [order[:full].reshape(-1, size)] if full else []
        if n - full > size // 2:  # the last node is split as well, if it has points on both sides
            parts.append(order[full:].reshape(1, -1))
        for nodes in parts:
            p = points[nodes]
            widest = np.argmax(p.max(1) - p.min(1), 1)
            values = np.take_along_axis(p, widest[:, None, None], 2)[:, :, 0]
            nodes[:] = np.take_along_axis(nodes, np.argpartition(values, size // 2 - 1, 1), 1)
    points = points[order]
    starts, ends = spans(n, levels - 1, levels)
    lo, hi = np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts)
    sums, counts = np.add.reduceat(points.astype(np.int64), starts), ends - starts
    found = [(lo, hi, sums, counts)]
    for _ in range(levels - 1):
        at = np.arange(0, len(lo), 2)
        lo, hi, sums, counts = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.add.reduceat(sums, at), np.add.reduceat(counts, at)
        found.append((lo, hi, sums, counts))
    return Tree(points, order, found[::-1])


def _filtered(lo: np.ndarray, hi: np.ndarray, alive: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """alive (nodes, entries) without the entries that no point of the node's box is assigned to.

    The nearest entry z* to the box's middle stays. Another one goes if at the corner of the box that suits it best it
    is farther than z*, or as far with a larger index.
    """
    to_middle = 2 * entries[None] - (lo + hi)[:, None]
    far = np.where(alive, (to_middle * to_middle).sum(2), np.iinfo(np.int64).max)
    best = far.argmin(1)
    star = entries[best][:, None]
    corner = np.where(entries[None] > star, hi[:, None], lo[:, None])
    # |z - corner|^2 - |z* - corner|^2
    margin = ((entries[None] - star) * (entries[None] + star - 2 * corner)).sum(2)
    return alive & ~((margin > 0) | ((margin == 0) & (np.arange(len(entries))[None] > best[:, None])))


def assign(tree: Tree, entries: np.ndarray, want_codes: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, int]:
    """Sums (entries, dims) and counts of the points nearest to each entry (ties: the lower index), the code of each point of the block if asked for, and how many points were compared one by one."""
    n, dims = tree.points.shape
    entries = entries.astype(np.int64)
    sums, counts = np.zeros((len(entries), dims), np.int64), np.zeros(len(entries), np.int64)
    codes = np.zeros(n, np.uint8) if want_codes else None  # in the tree's order
    levels, compared = len(tree.levels), 0
    nodes, alive = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
    for level, (lo, hi, node_sums, node_counts) in enumerate(tree.levels):
        starts, ends = spans(n, level, levels)
        rest_nodes, rest_alive = [], []
        for at in range(0, len(nodes), CHUNK):
            some = nodes[at : at + CHUNK]
            kept = _filtered(lo[some].astype(np.int64), hi[some].astype(np.int64), alive[at : at + CHUNK], entries)
            one = kept.sum(1) == 1
            # Whole subtrees of one entry.
            whole, entry = some[one], kept[one].argmax(1)
            np.add.at(sums, entry, node_sums[whole])
            np.add.at(counts, entry, node_counts[whole])
            if codes is not None:
                for node, e in zip(whole, entry):
                    codes[starts[node] : ends[node]] = e
            rest_nodes.append(some[~one])
            rest_alive.append(kept[~one])
        nodes, alive = np.concatenate(rest_nodes), np.concatenate(rest_alive)
        if not len(nodes):
            break
        if level < levels - 1:
            below = len(tree.levels[level + 1][0])
            nodes, alive = np.repeat(2 * nodes, 2) + np.tile([0, 1], len(nodes)), np.repeat(alive, 2, 0)
            nodes, alive = nodes[nodes < below], alive[nodes < below]
    else:  # points of leaves with several entries
        for at in range(0, len(nodes), CHUNK // LEAF):
            some = nodes[at : at + CHUNK // LEAF]
            sizes = ends[some] - starts[some]
            where = np.repeat(starts[some] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
            p = tree.points[where].astype(np.int64)
            to_each = p[:, None] - entries[None]
            far = np.where(np.repeat(alive[at : at + CHUNK // LEAF], sizes, 0), (to_each * to_each).sum(2), np.iinfo(np.int64).max)
            entry = far.argmin(1)
            np.add.at(sums, entry, p)
            np.add.at(counts, entry, 1)
            compared += len(p)
            if codes is not None:
                codes[where] = entry
    if codes is not None:
        by_point = np.empty(n, np.uint8)
        by_point[tree.order] = codes
        codes = by_point
    return sums, counts, codes, compared


def pack(trees: list[Tree]) -> tuple[bytes, bytes, bytes]:
    """Points, order and levels of a block's trees, which have like shapes, as bytes. Counts aren't stored, as the shape gives them."""
    points = np.stack([t.points for t in trees]).astype(np.int32).tobytes()
    order = np.stack([t.order for t in trees]).astype(np.uint16).tobytes()
    boxes = b"".join(x.astype(np.int32).tobytes() + y.astype(np.int32).tobytes() + s.tobytes() for t in trees for x, y, s, _ in t.levels)
    return points, order, boxes


def unpack(n: int, parts: int, points: bytes, order: bytes, boxes: bytes) -> list[Tree]:
    p = np.frombuffer(points, np.int32).reshape(parts, n, -1)
    o = np.frombuffer(order, np.uint16).reshape(parts, n)
    dims, levels, at, trees = p.shape[2], n_levels(n), 0, []
    for k in range(parts):
        found = []
        for level in range(levels):
            starts, ends = spans(n, level, levels)
            m = len(starts) * dims
            lo, hi = (np.frombuffer(boxes, np.int32, m, at + 4 * m * i).reshape(-1, dims) for i in (0, 1))
            found.append((lo, hi, np.frombuffer(boxes, np.int64, m, at + 8 * m).reshape(-1, dims), ends - starts))
            at += 16 * m
        trees.append(Tree(p[k], o[k], found))
    return trees
