import hashlib
import random

import numpy as np
import pytest

from locusframe.llm import substring_dedup as sd
from locusframe.llm.suffix_array import suffix_array


def brute(rows, length=100):
    """rows: (doc_id, text). By definition, over all strings of the texts in order."""
    docs = sorted({(d is None, d or 0, t or "", d) for d, t in rows})
    seen, out = set(), {}
    for _, _, text, d in docs:
        data = text.encode()
        covered = bytearray(len(data))
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                covered[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, c in zip(data, covered) if not c)
        spans = sum(c and not (i and covered[i - 1]) for i, c in enumerate(covered))
        out[d, text] = (len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed=3, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 8))) for _ in range(300)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    passages = [text(30) for _ in range(3)]
    rows = [(i, text(r.randint(1, 120))) for i in range(n)]
    for i in range(0, n, 4):
        rows[i] = (i, rows[i][1] + "\n" + passages[i % 3] + "\n" + text(r.randint(0, 20)))
    rows += [(n + i, rows[i][1]) for i in range(5)]
    rows += [(n + 10, rows[8][1].replace("a", "x", 2)), (n + 11, "ab" * 200), (n + 12, "ab" * 150 + "q"), (n + 13, ""), (n + 14, None), (None, passages[0]), (n + 15, "z" * 500)]
    return rows


@pytest.mark.parametrize("n", [*range(12), 50, 333])
@pytest.mark.parametrize("letters", [1, 2, 200])
def test_suffix_array(n, letters):
    s = np.random.default_rng(n).integers(1, letters + 1, n)
    t = s.tolist()
    assert suffix_array(s).tolist() == sorted(range(n), key=lambda i: t[i:])


def test_equal_strings_hold_equal_samples():
    data = np.frombuffer(random.Random(1).randbytes(3000), np.uint8)
    hashes = sd.window_hash(data, 32)
    at = set(sd.sampled_positions(hashes, 69).tolist())
    assert all(s + int(hashes[s : s + 69].argmin()) in at for s in range(0, 2900))


@pytest.mark.parametrize("contexts", [40_000, 3])
def test_against_brute_force(spark, contexts, monkeypatch):
    monkeypatch.setattr(sd, "SORT_CONTEXTS", contexts)
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, spans string").repartition(3)
    got = sd.substring_dedup(df).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    texts = dict((d, t or "") for d, t in rows)
    for g in got:
        assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == want[g.doc_id, texts[g.doc_id]], g.doc_id


def test_repeated_rows_and_empty_table(spark):
    text = " ".join(str(i * 7919) for i in range(60))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in sd.substring_dedup(df).collect())
    assert got == [(1, 0), (1, 0), (2, len(text))]
    assert sd.substring_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_repeats_of_rows_in_one_task_and_rows_without_id(spark, parts):
    r = random.Random(9)
    text = lambda: " ".join(str(r.randrange(10**6)) for _ in range(40))
    shared = text()
    ids = [(1, shared + "!"), (1, shared + "!"), (1, shared + "?"), (2, text() + "*" + shared), (3, text())]
    none = [(None, text() + chr(65 + i) + shared) for i in range(30)]  # no two have the same byte before the passage
    none += [(None, text()) for _ in range(30)]
    none += [none[0], none[40]]
    got = sd.substring_dedup(spark.createDataFrame(ids + none, "doc_id long, text string").repartition(parts)).collect()
    by = {}
    for g in got:
        by.setdefault(g.doc_id, []).append(g)
    assert len(got) == len(ids) + len(none)
    # Of the two texts of id 1 one comes first, by a hash; its two rows, or its one, keep everything.
    assert sorted(g.n_removed for g in by[1]) in ([0, 0, len(shared)], [0, len(shared), len(shared)])
    assert [g.n_removed for g in by[2]] == [len(shared)] and by[3][0].n_removed == 0
    # Each text without id loses the shared passage and no other text's ranges; repeats of a whole row are one document.
    assert sorted(g.n_removed for g in by[None]) == [0] * 31 + [len(shared)] * 31
    assert {g.kept_sha256 for g in by[None]} == {hashlib.sha256(t.replace(shared, "").encode()).hexdigest() for _, t in none}
