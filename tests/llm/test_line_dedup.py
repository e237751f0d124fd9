import random

from locusframe.llm.line_dedup import line_dedup


def brute(rows, run=3, long_words=50):
    seen, out = set(), {}
    for _, _, text, d in sorted({(d is None, d or 0, t or "", d) for d, t in rows}):
        lines = text.split("\n")
        at = [i for i, x in enumerate(lines) if x.strip(" \t\r")]
        s = [lines[i].strip(" \t\r") for i in at]
        gone = [False] * len(s)
        for i in range(len(s)):
            for key, n in ((tuple(s[i : i + run]), run), ((s[i],), 1)):
                if len(key) < n or (n == 1 and len(s[i].split()) < long_words):
                    continue
                if key in seen:
                    gone[i : i + n] = [True] * n
                seen.add(key)
        cut = {at[i] for i, g in enumerate(gone) if g}
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d, text] = (len(s), len(cut), runs, "\n".join(x for i, x in enumerate(lines) if i not in cut))
    return out


def test_against_brute_force(spark):
    r = random.Random(2)
    pool = [f"line {i} " + "w " * r.randint(0, 5) for i in range(40)] + ["", "  ", "long " * 55]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 12)))) for i in range(80)]
    rows += [(100, None), (101, rows[3][1]), (None, rows[5][1]), (7, rows[7][1]), (102, "a\nb\nc\na\nb\nc\r\n\n d"), (103, "x\n" * 5000)]
    df = spark.createDataFrame([(d, t, "q") for d, t in rows], "doc_id long, text string, kept string").repartition(3)
    got = line_dedup(df).collect()
    want = brute(rows)
    texts = dict((d, t or "") for d, t in rows)
    assert len(got) == len(rows)
    for g in got:
        assert (g.n_lines, g.n_removed, g.n_runs, g.kept) == want[g.doc_id, texts[g.doc_id]], g.doc_id


def test_empty_table_and_kept_columns(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", "x")], "doc_id long, text string, `__doc` string")
    assert line_dedup(df.limit(0)).count() == 0
    assert line_dedup(df, keep=["doc_id", "__doc"]).columns == ["doc_id", "__doc", "n_lines", "n_removed", "n_runs", "kept"]


def passages_brute(rows, run=3, long_words=50):
    """kept by id, where runs of fewer than `run` lines that reach long_words, with no shorter such run inside, count as well."""
    seen, out = set(), {}
    for d, text in sorted(rows):
        s = [x for x in text.split("\n") if x.strip()]
        n = [len(x.split()) for x in s]
        gone = [False] * len(s)
        for i in range(len(s)):
            for size in range(1, min(run, len(s) - i) + 1):
                inner = [sum(n[a:b]) for a in range(i, i + size) for b in range(a + 1, i + size + 1) if b - a < size]
                if size == run or (sum(n[i : i + size]) >= long_words and max(inner, default=0) < long_words):
                    key = tuple(s[i : i + size])
                    if key in seen:
                        gone[i : i + size] = [True] * size
                    seen.add(key)
        out[d] = "\n".join(x for x, g in zip(s, gone) if not g)
    return out


def test_repeated_passages_of_two_lines(spark):
    r = random.Random(4)
    pool = [f"line {i} " + "w " * r.randint(1, 40) + "e" for i in range(12)] + ["long " * 55 + "e"]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 4)))) for i in range(120)]
    a, b = "a " * 42 + "a", "b " * 48 + "b"
    rows += [(200, f"one\n{a}\n{b}\ntwo"), (201, f"three\n{a}\n{b}\nfour"), (202, f"{b}\n{a}"), (203, f"{a}\n{b}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.kept for x in line_dedup(df).collect()}
    assert got == passages_brute(rows)
    assert got[201] == "three\nfour" and got[202] == f"{b}\n{a}" and got[203] == ""
    assert {x.doc_id: x.kept for x in line_dedup(df, most_lines=1).collect()}[203] == f"{a}\n{b}"


def test_rows_without_id_are_told_apart(spark):
    own = lambda i: [f"own {i} {k}" for k in range(3)]
    shared = ["a b", "c d", "e f"]
    rows = [(None, "\n".join(own(i) + shared)) for i in range(300)] + [(5, "\n".join(shared))]
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(g.kept for g in got) == sorted(["\n".join(own(i)) for i in range(300)] + ["\n".join(shared)])
