import hashlib
import random
import zlib

from locusframe.llm import conversation_trie
from locusframe.llm.conversation_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(convs.get(c - c % 5, [])[:h] + own[h:])
    nodes = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    children = {k: [] for k in nodes}
    for k in nodes:
        if k:
            children[k[:-1]].append(k)
    total = {}
    for k in sorted(nodes, key=len, reverse=True):
        saved = (len(nodes[k]) - 1) * len(k[-1][1].encode()) if k else 0
        total[k] = (sum(total[x][0] for x in children[k]) or 1, saved + sum(total[x][1] for x in children[k]))
    sha = lambda k: hashlib.sha256(",".join(str(c) for c in sorted(nodes[k]) if rebuilt[c] == k).encode()).hexdigest()
    return sorted((min(m), len(k), -1 if not k else min(nodes[k[:-1]]), len(m), len(children[k]), total[k][0], total[k][1], sha(k)) for k, m in nodes.items())


def compare(spark, rows, parts=3):
    got = prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
    out = sorted((x.conv_id, x.depth, -1 if x.parent_conv_id is None else x.parent_conv_id, x.n_convs, x.n_children, x.n_leaves, x.saved_tokens, x.ends_sha256) for x in got)
    assert out == brute(rows)
    return out


def test_nodes_equal_brute_force(spark):
    r = random.Random(3)
    rows = []
    for c in r.sample(range(300), 180):
        for t in range(r.randint(1, 12)):
            rows.append((c, t, r.choice(["user", None, ""]), r.choice(["a", "é", "", None])))
    rows += [(None, 1, "user", "x"), (4, None, "user", "first"), (4, None, "user", "first"), (4, 3, "a", "tie"), (4, 3, "a", "sie")]
    out = compare(spark, rows)
    assert max(x[4] for x in out) > 3 and max(x[1] for x in out) > 8


def test_turns_that_one_conversation_leaves_out(spark):
    # Shorter than what it takes over, or with an absent or short family head.
    h = lambda c: zlib.crc32(str(c).encode()) % 9
    turnless = next(c for c in range(1000, 2000) if c % 5 and h(c) >= 2)
    short = next(c for c in range(2001, 3000) if c % 5 == 1 and h(c) >= 5)
    rows = [(turnless, 0, "user", "gone")] + [(short - 1, t, "user", f"b{t}") for t in range(2)] + [(short, t, "user", f"c{t}") for t in range(9)]
    out = compare(spark, rows)
    assert out[0][3] == 3 or out[-1][3] == 3


def test_long_conversations_and_one_hot_beginning(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "_BLOCK", 3)
    monkeypatch.setattr(conversation_trie, "_PIECE", 2)
    monkeypatch.setattr(conversation_trie, "_LEAST", 4)
    rows = [(0, t, "user", f"t{t}") for t in range(700)]
    rows += [(5 * i, t, "user", f"t{t}" if t < i else f"own {i} {t}") for i in range(1, 60) for t in range(i + 2)]  # leaves a long path at each of its messages
    rows += [(1000 + 5 * i, 0, "user", "hello") for i in range(120)]  # one node with many ends
    rows += [(5000 + 5 * i, t, "user", "hello" if not t else f"x{i}") for i in range(90) for t in range(2)]  # one node with many children
    out = compare(spark, rows, 6)
    assert max(x[4] for x in out) >= 90 and max(x[1] for x in out) == 700


def test_rounds_stay_few_on_a_comb(spark, monkeypatch):
    rounds = []
    made = conversation_trie.materialise
    monkeypatch.setattr(conversation_trie, "materialise", lambda d, name: rounds.append(name) or made(d, name))
    rows = [(5 * i, t, "user", f"t{t}" if t < i else "end") for i in range(60) for t in range(i + 1)]
    compare(spark, rows)
    assert rounds.count("active") <= 12


def test_empty_table_and_clashing_columns(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(0, 0, "user", "a", 5, 6), (1, 0, "user", "a", 7, 8)]
    assert prefix_trie(spark.createDataFrame(rows, SCHEMA + ", depth int, nth int")).count() == len(brute([r[:4] for r in rows]))
