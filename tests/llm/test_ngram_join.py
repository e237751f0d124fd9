import random

import numpy as np
import pytest

from locusframe.llm import ngram_join as nj
from locusframe.llm import signature_tree as st


def sets_of(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d))
    return sorted(out, key=str)


def corpus(seed, n=150):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeÉfgh") for _ in range(r.randint(1, 7))) for _ in range(500)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage = text(60)
    rows = []
    for i in range(n):
        k = r.random()
        if rows and k < 0.4:
            w = r.choice(rows)[1].split(" ")
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((i, " ".join(w).upper() if r.random() < 0.2 and "É" not in " ".join(w) else " ".join(w)))
        elif k < 0.7:
            rows.append((i, text(r.randint(1, 40)) + "\n" + passage + "\t" + text(r.randint(0, 10))))
        else:
            rows.append((i, text(r.randint(1, 200))))
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "a b"), (n + 4, "A  b"), (None, rows[0][1]), (5, rows[7][1]), (6, rows[6][1]), (n + 5, "x " * 3000)]


@pytest.mark.parametrize("seed,heavy,block", [(1, 48, 4096), (2, 3, 4096), (3, 5, 7)])
def test_against_brute_force(spark, seed, heavy, block, monkeypatch):
    monkeypatch.setattr(nj, "HEAVY", heavy)
    monkeypatch.setattr(nj, "BLOCK", block)
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, id int").repartition(3)
    assert sorted((tuple(r) for r in nj.jaccard_components(df).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert nj.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n,cross", [(2, False), (40, True), (300, False), (200, True)])
def test_tree_keeps_every_similar_pair(n, cross):
    r = np.random.default_rng(n)
    sets = []
    for k in range(n):
        if k % 3 and sets:
            s = sets[r.integers(len(sets))]
            s = np.concatenate([s[r.random(len(s)) > 0.06], r.integers(0, 1 << 62, 3).astype(np.uint64)])
        else:
            s = r.integers(0, 1 << 62, r.integers(1, 300)).astype(np.uint64)
        sets.append(np.unique(s))
    sizes, labels, side = np.array([len(s) for s in sets]), r.integers(0, 50, n), np.arange(n) % 2 if cross else np.zeros(n, int)
    i, j = st.candidate_pairs([st.bitmap(s) for s in sets], sizes, labels, side, 80)
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    for a in range(n):
        for b in range(a + 1, n):
            both = len(np.intersect1d(sets[a], sets[b]))
            if labels[a] != labels[b] and (not cross or side[a] != side[b]) and 100 * both >= 80 * (sizes[a] + sizes[b] - both):
                assert (a, b) in got
    assert len(got) == len(i)
