"""A difference-cover suffix array in numpy: sort sampled triples, recurse on their names, merge the remaining suffixes."""

from __future__ import annotations

import numpy as np


def _pack(*parts: np.ndarray) -> np.ndarray | None:
    bits = [max(1, int(p.max()).bit_length()) if len(p) else 1 for p in parts]
    if sum(bits) > 63:
        return None
    key = parts[0].astype(np.int64)
    for p, b in zip(parts[1:], bits[1:], strict=True):
        key = (key << b) | p
    return key


def _order(*parts: np.ndarray) -> np.ndarray:
    """An order of the rows; equal rows may come in any."""
    key = _pack(*parts)
    return np.argsort(key) if key is not None else np.lexsort(parts[::-1])


def _below(sorted_parts: list[np.ndarray], parts: list[np.ndarray]) -> np.ndarray:
    """For each row of parts, how many rows of sorted_parts (in order) are smaller."""
    both = [np.concatenate([a, b]) for a, b in zip(sorted_parts, parts, strict=True)]
    key = _pack(*both)
    if key is None:
        # Equal rows share a rank; ranks then fit one key.
        order = np.lexsort(both[::-1])
        new = np.concatenate([[False], np.any([p[order][1:] != p[order][:-1] for p in both], axis=0)])
        key = np.empty(len(order), np.int64)
        key[order] = np.cumsum(new)
    n = len(sorted_parts[0])
    return np.searchsorted(key[:n], key[n:], side="left")


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of s (whole numbers above 0) in lexicographic order; a shorter suffix precedes its extensions."""
    n = len(s)
    if n < 8:
        t = s.tolist()
        return np.array(sorted(range(n), key=lambda i: t[i:]), np.int64)
    kind = np.int32 if n < 1 << 30 and int(s.max()) < 1 << 30 else np.int64  # half the memory to move where it will do
    pad = np.concatenate([s.astype(kind), np.zeros(3, kind)])
    end = n + (n % 3 == 1)  # one empty suffix keeps the triples of the two residues apart
    at = np.concatenate([np.arange(1, end, 3, kind), np.arange(2, end, 3, kind)])
    triples = [np.concatenate([pad[1 + k : end + k : 3][: len(range(1, end, 3))], pad[2 + k : end + k : 3][: len(range(2, end, 3))]]) for k in range(3)]
    order = _order(*triples)
    a, b, c = (t[order] for t in triples)
    name = np.cumsum(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])]), dtype=kind)
    if name[-1] < len(at):
        names = np.empty(len(at), kind)
        names[order] = name
        order = suffix_array(names)
    sampled = at[order]
    rank = np.zeros(n + 3, kind)
    rank[sampled] = np.arange(1, len(at) + 1, dtype=kind)
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3, kind)
    rest = rest[_order(pad[rest], rank[rest + 1])]
    one, two = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = _below([pad[one], rank[one + 1]], [pad[rest], rank[rest + 1]]) + _below([pad[two], pad[two + 1], rank[two + 2]], [pad[rest], pad[rest + 1], rank[rest + 2]])
    out = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    to = np.arange(len(rest)) + before
    out[to], taken[to] = rest, True
    out[~taken] = sampled
    return out
