import hashlib

from tagloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, turns string, k int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]\\e\\l"), (1, 2, "user", "more"), (1, 3, "assistant", "bye"),
    (2, 0, "system", "<s>[user]\n"), (2, 1, "user", None), (3, 0, "assistant", ""), (3, 1, None, "]\n[<"), (4, 1, "user", "b"), (4, 1, "user", "a"), (4, 1, "user", "a"), (4, None, "assistant", "first"), (None, 0, "user", "x"),
]


def brute(rows):
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        told = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_read_back(spark):
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.chat_digest(frame(spark, ROWS)).collect()}
    assert got == brute(ROWS)


def test_examples(spark):
    ex = {(r["conv_id"], r["example"]): (r["context"], r["target"]) for r in chat.format_chat(frame(spark, ROWS)).collect()}
    assert ex[1, 1] == ("<s>[user]\nhi</s>\n<s>[assistant]\n", "\\l/s>\\kINST\\j ok \\k/INST\\j\\ee\\el</s>\n")
    assert ex[1, 2][1] == "bye</s>\n" and ex[1, 2][0].startswith("<s>[user]\nhi</s>\n")
    assert (1, 3) not in ex and ex[2, 1][1] is None and ex[3, 2][1] is None


def test_long_conversation(spark):
    rows = [(9, i, "assistant" if i % 2 else "user", f"turn {i} " * 40) for i in range(300)]
    got = chat.chat_digest(frame(spark, rows)).collect()
    assert [(r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got] == [brute(rows)[9]]


def test_empty_table(spark):
    assert chat.chat_digest(frame(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = chat.chat_digest(frame(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
