import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.llm import quality, toxicity


def text(r, bad, words=60):
    w = ["".join(r.choice(["an", "the", "ri", "so", "le", "ti"]) for _ in range(r.randint(1, 3))) for _ in range(words)]
    for _ in range(bad):
        w[r.randrange(words)] = r.choice(["scumbag", "idiotic"])[:-2] + r.choice(["xx", "qu", "zo", "vi"])
    return " ".join(w)


def test_toxicity_sees_unseen_spellings(spark):
    r = random.Random(1)
    rows = [(i, text(r, 3 * (i % 2))) for i in range(400)]
    docs = spark.createDataFrame([(d, t, 0.5) for d, t in rows] + [(400, None, 0.1), (401, "", 0.1), (None, "the", 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(d, d % 2) for d, _ in rows[:300]] + [(None, 1), (5, None), (999, 1)], "doc_id long, toxic int")
    s = toxicity.Settings(max_positive=100, max_negative=100)
    model = toxicity.train(docs, labels, s)
    got = {g.doc_id: g.score for g in toxicity.score(docs, model, s).collect()}
    assert len(got) == 403 and all(0 <= x <= 1 for x in got.values())
    assert np.mean([(got[d] >= 0.5) == (d % 2 == 1) for d in range(300, 400)]) >= 0.95
    assert got[400] == got[401]
    assert toxicity.score(docs.limit(0), model, s).count() == 0
    assert toxicity.train(docs, labels.limit(0), s)[1] < 0


@pytest.mark.parametrize("grades", [2, 4])
def test_ordinal_grades(spark, grades):
    r = random.Random(2)
    rows = [(i, text(r, 5 * (i % grades))) for i in range(600)]
    docs = spark.createDataFrame([*rows, (600, None), (None, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % grades) for d, _ in rows[:450]] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert model.grades == list(range(grades)) and (np.diff(model.thresholds) > 0).all()
    got = {g.doc_id: g for g in quality.score(docs, model).collect()}
    assert len(got) == 602
    held = range(450, 600)
    assert np.corrcoef([got[d].expected_grade for d in held], [d % grades for d in held])[0, 1] > 0.8
    assert all(0 <= g.tail_probability <= 1 for g in got.values())
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.fit([], [], quality.Settings()).grades == [0.0]


def test_cumulative_link_gradient():
    s = quality.Settings(bits=4, steps=400, rate=0.1, decay=0.0)
    r = np.random.default_rng(0)
    x = r.normal(size=500)
    y = np.searchsorted([-1.0, 0.5], 2 * x + r.logistic(size=500)).astype(float)
    m = quality.fit([(np.array([1], np.int32), np.array([v], np.float32)) for v in x], y.tolist(), s)
    assert abs(m.weights[1] - 2) < 0.5 and np.abs(m.thresholds - [-1.0, 0.5]).max() < 0.5


def fnv_bucket(gram, bits):
    h = gram[0]
    for c in gram[1:]:
        h = (h * 16777619 + c) & 0xFFFFFFFF
    x = (h ^ (len(gram) * 2654435761 & 0xFFFFFFFF)) * 0x85EBCA6B & 0xFFFFFFFF
    x = (x ^ (x >> 15)) * 0xC2B2AE35 & 0xFFFFFFFF
    return x >> (32 - bits)


def plain_toxicity(text, model, s):
    words = sorted(set(re.findall(r"\w+", text.lower())))
    z = model[1]
    for w in words:
        b = f"<{w}>".encode()
        grams = [b[i : i + n] for n in s.grams for i in range(len(b) - n + 1)]
        z += sum(float(model[0][fnv_bucket(g, s.bits)]) for g in grams) / (len(grams) * math.sqrt(len(words))) if grams else 0
    return 1 / (1 + math.exp(-z))


def test_toxicity_scores_against_plain_loops(spark):
    s = toxicity.Settings(bits=12)
    r = np.random.default_rng(4)
    model = (r.normal(size=1 << 12).astype(np.float32), -0.3)
    texts = ["", "a", "Scumbag and SCUMBAG, ünï-code 12", "x" * 5000, "w " * 30_000 + "tail", "<b> a_b </b>", "漢字" * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for g in toxicity.score(df, model, s).collect():
        assert abs(g.score - plain_toxicity(texts[g.doc_id], model, s)) < 1e-4, g.doc_id


def test_toxicity_gradient_by_differences():
    s = toxicity.Settings(bits=6, dims=3, decay=0.01)
    r = np.random.default_rng(5)
    bags = [toxicity.bag(["".join(r.choice(list("abc"), 6)) for _ in range(5)], s) for _ in range(300)]
    y = (r.random(300) < 0.3).astype(float)
    data = toxicity._Sample(bags, y)
    params = [r.normal(size=(64, 3)), r.normal(size=(3, 2)), r.normal(size=2)]

    def loss(p):
        e, w, b = p
        total = 0.0
        for (idx, weight), label, k in zip(bags, y, data.balance):
            logits = (weight[:, None].astype(float) * e[idx]).sum(axis=0) @ w + b
            total += k * (np.log(np.exp(logits).sum()) - logits[int(label)])
        return total + 0.005 * ((e**2).sum() + (w**2).sum())

    for k, g in enumerate(data.gradients(params, 0.01)):
        for _ in range(6):
            at = tuple(r.integers(n) for n in params[k].shape)
            up, down = [p.copy() for p in params], [p.copy() for p in params]
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - g[at]) < 1e-5, (k, at)


def plain_quality(text, model, bits):
    words = text.split()
    n, counts = len(words), {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    found = {"bias of length %d" % int(np.log2(n + 1)): 0.5}
    shapes = {}
    for w in re.sub(r"\d+", "0", re.sub(r"[^\W\dA_]+", "a", re.sub(r"[A-ZÀ-ÖØ-Þ]+", "A", text))).split():
        shapes[w] = shapes.get(w, 0) + 1
    for w, k in shapes.items():
        found["s" + w] = math.sqrt(k / n)
    for w in counts:
        found["w" + w.lower()] = 1 / math.sqrt(len(counts))
    if n:
        for name, x in (("distinct", len(counts) / n), ("top", max(counts.values()) / n), ("upper", sum(w.isupper() for w in words) / n), ("size", min(1, len(text) / n / 20)), ("lines", min(1, 8 * text.count("\n") / n))):
            found[f"{name} {int(x * 10)}"] = 1.0
    z = sum(v * model.weights[zlib.crc32(k.encode()) >> (32 - bits)] for k, v in found.items())
    tail = [1 / (1 + math.exp(t - z)) for t in model.thresholds]
    return model.grades[0] + sum((b - a) * p for a, b, p in zip(model.grades, model.grades[1:], tail)), tail[-1]


def test_quality_scores_against_plain_loops(spark):
    s = quality.Settings(bits=12)
    r = np.random.default_rng(6)
    model = quality.Model([0.0, 1.0, 4.0], r.normal(size=1 << 12), np.array([-0.5, 0.7]))
    long = "é" * 100
    texts = ["", "a b", "One TWO three3\n\nOne", "w " * 30_000 + "tail", f"{long}x {long}y", "漢字" * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for g in quality.score(df, model, s).collect():
        want = plain_quality(texts[g.doc_id], model, 12)
        assert abs(g.expected_grade - want[0]) < 1e-4 and abs(g.tail_probability - want[1]) < 1e-4, g.doc_id
    # Tokens that differ behind a long common beginning have features of their own.
    a, b = (set(quality.features(t, s)[0].tolist()) for t in (long + "x", long + "y"))
    assert a != b


def test_quality_of_repeated_ratings_and_ids(spark):
    docs = spark.createDataFrame([(i, f"word{i % 3} text {i}") for i in range(60)] + [(5, "another text")] * 40 + [(7, "long " * 200_000)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(60)] + [(3, 0), (4, 1), (8, 1), (8, 1)]
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert model.grades == [0.0, 1.0]  # never one between
    again = quality.train(docs.repartition(7), spark.createDataFrame(labels[::-1], "doc_id long, quality int"))
    assert np.allclose(model.weights, again.weights) and np.allclose(model.thresholds, again.thresholds)
    clashing = docs.select("doc_id", "text", F.lit(1).alias("rating"), F.lit("x").alias("quality"))
    assert np.allclose(quality.train(clashing, spark.createDataFrame(labels, "doc_id long, quality int")).weights, model.weights)
