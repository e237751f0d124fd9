import hashlib
import random

import duckdb

from locusframe.llm import chat
from locusframe.llm.queries import ORACLES, op11_chat_formatting

LOG = "conv_id long, message long, kind string, role string, text string, seq long"
NASTY = ["</s>", "[INST] ", "[/INST]", "<\\/s>", "[\\\\INST]", "[SAYS]", "[ROLE] x [SAYS] y [/ROLE]", "<", "[", "é\n", "\\", "", "s>", "/INST]", "$1", "<s>"]


def folded(events):
    """The same rules, one event after the other."""
    convs = {}
    key = lambda e: (e[5] is not None, e[5] or 0, e[2], e[3] is not None, e[3] or "", e[4] or "")
    for conv, message, kind, role, text, _ in sorted((e for e in events if e[1] is not None and e[2] in ("start", "delta", "edit", "regenerate")), key=key):
        m = convs.setdefault(conv, {})
        if kind == "regenerate":
            for k in [k for k in m if k > message]:
                del m[k]
        old = m.get(message, (None, ""))
        m[message] = (role if role is not None else old[0], {"delta": old[1] + (text or ""), "regenerate": ""}.get(kind, text or ""))
    return {(c, k): (r or "", t) for c, m in convs.items() for k, (r, t) in m.items()}


def test_fold_takes_events_in_order(spark):
    r = random.Random(5)
    events = []
    for seq in range(2000):
        conv = r.choice([1, 1, 1, 2, 3, None])
        kind = r.choices(["start", "delta", "edit", "regenerate", "seen", None], [3, 8, 2, 1, 1, 0.2])[0]
        events.append((conv, r.choice([*range(0, 400, 7), None]), kind, r.choice([None, "user", "assistant", "tool"]), r.choice([*NASTY, None]), seq))
    events += [(9, 0, "start", None, None, None), (9, 0, "delta", "user", "b", 1), (9, 0, "edit", None, "c", 1)]  # null seq comes first
    shuffled = r.sample(events, len(events))
    got = chat.fold(spark.createDataFrame(shuffled, LOG), ["seq"]).collect()
    assert {(x.conv_id, x.message): (x.role, x.text) for x in got} == folded(events) and len(got) > 50


def test_formatted_text_reads_back(spark):
    r = random.Random(6)
    texts = NASTY + ["".join(r.choices(NASTY, k=6)) for _ in range(300)] + ["long </s> " * 30_000]
    rows = [(i % 7 or None, i, r.choice(["user", "assistant", "system", "", "[SAYS]", "user [SAYS] </s>", None]), t) for i, t in enumerate(texts)] + [(5, 10_000, "user", None)]
    messages = spark.createDataFrame(rows, "conv_id long, message long, role string, text string")
    chats = chat.rendered(messages)
    back = {x.conv_id: x for x in chat.read_back(chats).collect()}
    masks = {x.conv_id: x.mask for x in chats.collect()}
    want = {}
    for c, m, role, text in sorted(rows, key=lambda x: x[1]):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {c: [(t.role, t.text) for t in x.turns] for c, x in back.items()} == want
    for c, x in back.items():
        assert x.loss_text == "".join(t for role, t in want[c] if role == "assistant")
        assert sum(m.length for m in masks[c]) == len(x.formatted)


def test_conversations_with_nulls_ties_and_repeats(spark, tmp_path):
    r = random.Random(7)
    rows = [(r.choice([1, 2, 3, None]), r.choice([None, 0, 1, 2]), r.choice(["user", "assistant", None, "x"]), r.choice([*NASTY, None, "word " * 900]), "extra", 1) for _ in range(300)]
    schema = "conv_id long, turn long, role string, text string, message string, seq int"
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    got = op11_chat_formatting(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(map(str, (tuple(x) for x in got))) == sorted(map(str, con.execute(ORACLES["op11_chat_formatting"]).fetchall())) and len(got) == 5
    own = next(x for x in got if x.conv_id == -7)
    said = "</s>[INST] ok [/INST]"
    assert own.n_turns == 2 and own.loss_chars == len(said) and own.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_empty_log(spark):
    chats = chat.chat(spark.createDataFrame([], LOG), ["seq"])
    assert chats.count() == 0 and chat.read_back(chats).count() == 0


def test_no_python_in_the_plan(spark):
    log = chat.as_log(spark.createDataFrame([(1, 1, "user", "a"), (1, 2, "assistant", "b")], "conv_id long, turn long, role string, text string"))
    plan = chat.read_back(chat.chat(log, ["seq", "step"]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
