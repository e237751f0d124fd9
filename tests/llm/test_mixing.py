from collections import defaultdict
from math import exp, floor, log

import pytest
from pyspark.sql import functions as F

from locusframe.llm import mixing


def corpus(spark):
    rows = [(i, "w " * (i % 37), "hot" if i % 3 else f"s{i % 7}" if i % 14 else None, 1) for i in range(3000)]
    return spark.createDataFrame([*rows, (1, "w " * 1, "hot", 1), (None, None, "tiny", 1)], "doc_id long, text string, source string, epoch int").repartition(5)


@pytest.mark.parametrize("budget,limit,bucket", [(None, 2.0, 20_000), (None, 3.5, 100), (20_000, 2.0, 100), (None, 1.0, 50)])
def test_budgets_against_a_plain_version(spark, budget, limit, bucket, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    df = corpus(spark)
    hashed = F.xxhash64(F.lit(17), "doc_id", F.coalesce("text", F.lit("")))
    rows = [(r.source, max(1, len((r.text or "").split())), r.h & ((1 << 64) - 1), r.doc_id) for r in df.withColumn("h", hashed).collect()]
    total = defaultdict(int)
    for s, t, _, _ in rows:
        total[s] += t
    a = mixing.repetition_exponent(min(total.values()), max(total.values()), limit)
    assert max(total.values()) ** (1 - a) / min(total.values()) ** (1 - a) <= limit + 1e-9
    raw = {s: t**a for s, t in total.items()}
    scale = budget / sum(raw.values()) if budget else max(t / raw[s] for s, t in total.items())
    want = defaultdict(int)
    for s, t in total.items():
        b = floor(raw[s] * scale + 1e-6)
        own = sorted((h, -1 if d is None else d, n) for x, n, h, d in rows if x == s)
        rest, done = b % t, 0
        cut = -1
        for i, (h, _, n) in enumerate(own):
            done += n
            if (i + 1 == len(own) or own[i + 1][0] != h) and done <= rest:
                cut = h
        for h, d, _ in own:
            if b // t + (h <= cut):
                want[s, d] += b // t + (h <= cut)
    got = defaultdict(int)
    out = mixing.mix(df, repetition_limit=limit, budget_tokens=budget, block_tokens=5000).collect()
    for r in out:
        got[r.source, -1 if r.doc_id is None else r.doc_id] += 1
    assert got == want
    if not budget:
        assert {d for _, d in got} == {-1 if r[3] is None else r[3] for r in rows}


def test_entropy(spark):
    s = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "source string, tokens long")
    a = mixing.entropy_exponent(s, 0.9)
    z = [t**a for t in (1000, 100, 10)]
    assert abs(-sum(x / sum(z) * log(x / sum(z)) for x in z) - 0.9) < 1e-4
    assert mixing.entropy_exponent(s, 9.0) == 0.0 and mixing.entropy_exponent(s, 0.0) == 1.0
    assert exp(0) == 1


def test_empty_table(spark):
    assert mixing.mix(corpus(spark).limit(0)).count() == 0


def test_blocks_and_slots_against_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 100)
    out = mixing.mix(corpus(spark), repetition_limit=3.0, block_tokens=5000).collect()
    blocks = defaultdict(list)
    tokens, longest = defaultdict(int), defaultdict(int)
    for r in out:
        blocks[r.block].append(r)
        tokens[r.source] += r.n_tokens
        longest[r.source] = max(longest[r.source], r.n_tokens)
    assert sorted(blocks) == list(range(len(blocks))) and len(blocks) > 10
    part = defaultdict(int)
    for b, rows in blocks.items():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))  # places, each once
        for r in rows:
            part[b, r.source] += r.n_tokens
    # Each block has its share of each source, but for a document at each end; rows that a budget can't split may lack at the very end.
    for s, total in tokens.items():
        for b in range(len(blocks) - 1):
            assert abs(part[b, s] - total / len(blocks)) <= 2 * longest[s] + 1, (b, s)
    # Sources are mixed inside a block, not one after the other.
    assert all(len({r.source for r in sorted(rows, key=lambda r: r.slot)[:20]}) > 1 for rows in blocks.values() if len(rows) > 100)
