import random
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq

import corpus_pipeline
from test_line_dedup import brute as lines_brute
from test_ngram_join import brute as join_brute
from test_packing import whole

from locusframe.llm import mixing


def corpus(spark, folder):
    r = random.Random(5)
    words = ["".join(r.choice(["an", "the", "ri", "so", "le", "ti"]) for _ in range(r.randint(1, 3))) for _ in range(400)]
    line = lambda k: " ".join(r.choice(words) for _ in range(k))
    shared = [line(8) for _ in range(4)]
    rows = []
    for i in range(240):
        text = "\n".join(line(r.randint(3, 15)) for _ in range(r.randint(1, 8)))
        if i % 4 == 1:
            w = text.split(" ")
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(["scumbag", "idiotic", "scumbagqu"]))
            text = " ".join(w)
        if i % 5 == 0:
            text += "\n" + "\n".join(shared)
        if i % 20 == 7:
            text = rows[-3][1]
        rows.append((i, text, "en", f"s{i % 3}" if i % 2 else "hot", len(text), "extra"))
    rows += [(300, None, None, None, None, "x"), (301, "", "en", "hot", 0, "x"), (None, line(9), "en", "hot", 5, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 4 == 1) for i in range(0, 200)], "doc_id long, t boolean").selectExpr("doc_id", "1 as quality", "cast(t as int) as toxic").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages_against_plain_versions(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / f"s{i}"))
        docs = spark.read.parquet(str(tmp_path / f"s{i}"))
        if i < 4:
            assert docs.columns == corpus_pipeline.COLUMNS, name
        kept.append([r.asDict() for r in docs.collect()])
    toxic, lines, joined, mixed, packed = kept

    gone = {r[0] for r in rows} - {r["doc_id"] for r in toxic}
    bad = {i for i in range(240) if any(w in rows[i][1] for w in ("scumbag", "idiotic"))}
    assert len(gone & bad) >= 0.9 * len(bad) and len(gone - bad) <= 5

    want = lines_brute([(r["doc_id"], r["text"]) for r in toxic])
    after = {}
    for r in toxic:
        _, n, _, text = want[r["doc_id"], r["text"] or ""]
        if not (n and not text.strip(" \t\r\n")):
            after[r["doc_id"]] = text if r["text"] is not None else None
    assert {r["doc_id"]: r["text"] for r in lines} == after and any(r["n_chars"] != len(rows[0][1]) for r in lines)

    classes = join_brute([(r["doc_id"], r["text"]) for r in lines])
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in joined) == sorted((d is None, d or 0) for d, _, c in classes if d is None or c == d)

    counts = defaultdict(int)
    for r in mixed:
        counts[r["doc_id"]] += 1
    assert set(counts) == {r["doc_id"] for r in joined} and 1 <= min(counts.values()) and max(counts.values()) <= 2

    size = {r["doc_id"]: len(whole(r["text"] or "")) + 1 for r in joined}
    total = defaultdict(int)
    for p in packed:
        total[p["doc_id"]] += p["length"]
    assert total == {d: size[d] * n for d, n in counts.items()}
    fill = defaultdict(int)
    for p in packed:
        fill[p["sequence_id"]] += p["length"]
    assert max(fill.values()) <= 1024 and np.mean(list(fill.values())) > 200


def test_run(spark, tmp_path):
    folder = str(tmp_path / "in")
    corpus(spark, folder)
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_mixing_lays_out_blocks_and_slots(spark, tmp_path, monkeypatch):
    mix = mixing.mix
    monkeypatch.setattr(mixing, "mix", lambda *a, **b: mix(*a, **b, block_tokens=2000))
    rows = [(i, f"w{i} " * (1 + i % 9), "en", "hot" if i < 1500 else f"s{i % 2}", 1) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)  # the hot source first
    mixed = mixing.mix(docs).collect()
    want = [r.doc_id for r in sorted(mixed, key=lambda r: (r.block, r.slot))]
    assert max(r.block for r in mixed) > 3
    corpus_pipeline._mixing(spark, docs, "").write.parquet(str(tmp_path / "out"))
    got = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist()]
    assert got == want
    tenth = len(got) // 10
    assert all(0.3 < np.mean([d < 1500 for d in got[k : k + tenth]]) < 0.9 for k in range(0, 10 * tenth, tenth))


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert out.count() == 0 and (i == 4 or out.columns == corpus_pipeline.COLUMNS), name
    assert corpus_pipeline.run(spark, folder).count() == 0
