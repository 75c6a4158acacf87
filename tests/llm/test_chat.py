"""Chat formatting: layouts, round trips, and the query against plain Python."""

import hashlib

from pyspark.sql import functions as F

from keyloom.llm import chat


def test_layouts_become_turns(spark):
    schema = "messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>, prompt string, response string, completion string, instruction string, input string, output string, other int"
    rows = [
        ([("user", "a"), ("assistant", "b")], None, None, None, None, None, None, None, 1),
        (None, [("human", "a"), ("gpt", "b")], None, None, None, None, None, None, 1),
        (None, None, "a", "b", None, None, None, None, None),
        (None, None, "a", None, "b", None, None, None, 2),
        (None, None, None, None, None, "a", None, "b", 2),
        (None, None, None, None, None, "a", "x", "b", 2),
        (None, None, "a", None, None, None, None, None, 2),
    ]
    got = [r.chat_turns for r in chat.format_chats(spark.createDataFrame(rows, schema)).collect()]
    ab = [("user", "a"), ("assistant", "b")]
    assert [None if g is None else [tuple(t) for t in g] for g in got] == [ab] * 5 + [[("user", "a\nx"), ("assistant", "b")], None]


def test_fingerprint_ignores_order(spark):
    a, b = (F.array(*map(F.lit, x)) for x in (("x", "y[].z"), ("y[].z", "x")))
    assert spark.range(1).select((chat.fingerprint(a) == chat.fingerprint(b)).alias("same")).first().same


def test_round_trip(spark):
    texts = ["", "\\", "\\\\<|", "<|end|>", "<|turn|>x<|text|>", "<", "|end|>", "</s>[INST] ok [/INST]", "<\\|", "é🙂\n\r\x00 ", "[[INST]", "<<SYS>><</SYS>>", "$1 \\1", "<|" * 3000]
    turns = [("user" if i % 2 else "assistant", t) for i, t in enumerate(texts)] + [("odd\nrole<|text|>", "x")]
    df = spark.createDataFrame([(turns,), ([],)], "t array<struct<role:string,text:string>>").select("t", chat.render(F.col("t")).alias("s"))
    full, none = df.select("t", "s", chat.parse(F.col("s")).alias("back")).collect()
    assert [(b.role, b.text) for b in full.back] == turns and none.back == []
    assert not any(m in full.s.replace(chat.TURN, "").replace(chat.TEXT, "").replace(chat.END, "") for m in chat.FOREIGN)


def plain(rows):
    convs = {}
    for c, n, r, t in [*rows, (-1, 0, "user", chat.EXTRA), (-1, 1, "assistant", chat.EXTRA)]:
        convs.setdefault(c, []).append((-(1 << 63) if n is None else n, r or "", t or ""))
    out = {}
    for c, turns in convs.items():
        turns = sorted(turns, key=lambda x: (x[0], x[1].encode(), x[2].encode()))
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_query(spark, tmp_path):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a\\"), (2, 0, None, None), (2, 0, "user", "x"), (2, 0, "user", "x"), (None, 5, "assistant", "<|end|>🙂"), (3, None, "assistant", ""), (4, 0, "assistant", "long " * 50000)]
    spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n_turns int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.op2_chat_format(spark, str(tmp_path)).collect()}
    assert got == plain(rows)


def test_many_turns(spark):
    from pyspark.sql import functions as F

    for n in (1, 255, 256, 257, 5000):
        turns = [("user" if k % 2 else "assistant", f"turn {k} é🙂 <|end|> \\") for k in range(n)]
        df = spark.createDataFrame([(turns,)], "turns array<struct<role:string,text:string>>")
        text, back = df.select(chat.render(F.col("turns")).alias("t")).select("t", chat.parse(F.col("t"))).first()
        assert [(r.role, r.text) for r in back] == turns
        assert all(chat_plain(text[r.start : r.end]) == r.text for r in back)


def chat_plain(text):
    import re

    return re.sub(r"(?s)\\(.)", r"\1", text)
