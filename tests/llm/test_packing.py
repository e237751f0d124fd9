import zlib
from collections import defaultdict

import numpy as np
import pytest

from locusframe.llm import packing, tokens


def whole(text):
    t = tokens.encoder(tokens.vocabulary_path("byte_bpe_50k.json"), tokens.vocabulary_path("byte_bpe_50k.tiktoken"))._whole
    return t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", " ", "a", "Hello  world", "it's we'll\n\nx ", "über naïve — “q” 12ab", "a<|endoftext|>b", "\x1c\x85 \u00a0日本", "line\n next\tline", "x" * 5000, "don't 'S 's", " lead", "tail ", "a\r\nb"])
def test_ids_are_those_of_the_tokenizer(text):
    e = tokens.encoder(tokens.vocabulary_path("byte_bpe_50k.json"), tokens.vocabulary_path("byte_bpe_50k.tiktoken"))
    assert np.frombuffer(e.encode(text), "<u4").tolist() == whole(text)


def test_level_is_the_one_of_least_squares():
    r = np.random.default_rng(0)
    levels = packing.Levels(16, 0)
    for k in range(400):
        size = int(r.integers(1, 16))
        costs = {}
        for h in [0, *(h for h in range(1, 16) if levels.counts[h] and h + size <= 16)]:
            n = levels.counts.copy()
            if h:
                n[h] -= 1
            if h + size < 16:
                n[h + size] += 1
            costs[h] = int((n**2).sum())
        assert costs[levels.level_for(size)] == min(costs.values())
        levels.place((k, 0, b"\0" * 4 * size, size))
        assert sum(len(x) for x in levels.open.values()) == levels.counts.sum()


def test_pieces(spark):
    r = np.random.default_rng(3)
    rows = [(int(i), " ".join("word" + str(x) for x in r.integers(0, 99, r.integers(0, 900))), "x") for i in range(60)] + [(60, None, "x"), (None, "null id", "x"), (5, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset string").repartition(3)
    got = packing.pack(df).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for p in got:
        sequences[p.sequence_id].append((p.offset, p.length))
        pieces[p.doc_id].append(p)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    assert sum(sum(n for _, n in s) < 1024 for s in sequences.values()) <= 3
    for d, t, _ in rows:
        if d == 5:
            continue
        ids = np.array([*whole(t or ""), 0], "<u4")
        at = 0
        for p in sorted(pieces[d], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert packing.pack(df.limit(0)).count() == 0
