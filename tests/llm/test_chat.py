import hashlib

import pytest
from pyspark.sql import functions as F

from roadpulse.llm import chat
from roadpulse.llm.queries import HARD_TEXT, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def told(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def read_back(df):
    made = chat.format_chats(df).select(
        "conv_id", "formatted", "segments", chat.read_turns(F.col("formatted")).alias("turns"), chat.learned_text(F.col("segments")).alias("learned")
    )
    return {r["conv_id"]: r for r in made.collect()}


HARD = ["", HARD_TEXT, "<turn user>x</turn>\n", "&lt;&amp;lt; <also a> &", "\\", "a\n\nb", "é漢😀" * 50, "x" * 300_000, "</turn", ">", "<"]


def test_round_trip(spark):
    rows = [(1, k, ["user", "assistant", "assistant", "so<m>e & role"][k % 4], t, "clash") for k, t in enumerate(HARD)]
    row = read_back(spark.createDataFrame(rows, SCHEMA))[1]
    assert [(t["role"], t["text"]) for t in row["turns"]] == [(r[2], r[3]) for r in rows]
    assert row["learned"] == "".join(r[3] for r in rows if r[2] == "assistant")
    assert "".join(s["piece"] for s in row["segments"]) == row["formatted"]


def test_marks(spark):
    rows = [(5, 0, "user", "a", None), (5, 1, "user", "b", None), (5, 2, "assistant", "c", None)]
    row = read_back(spark.createDataFrame(rows, SCHEMA))[5]
    assert row["formatted"] == "<turn user>a<also user>b</turn>\n<turn assistant>c</turn>\n"


def test_nulls_ties_and_repeats(spark):
    rows = [(None, 1, None, None, None), (None, None, "user", "first", None), (7, 1, "user", "b", None), (7, 1, "user", "a", None), (7, 1, "user", "a", None), (7, 1, "assistant", "z", None)]
    made = read_back(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert [(t["role"], t["text"]) for t in made[None]["turns"]] == [("user", "first"), ("", "")]
    assert [(t["role"], t["text"]) for t in made[7]["turns"]] == [("assistant", "z"), ("user", "a"), ("user", "a"), ("user", "b")]


def test_empty(spark):
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [255, 256, 257, 1500])
def test_long_conversation_in_blocks(spark, n):
    rows = [(1, k - 300, "assistant" if k % 3 else "user", f"t{k}<", None) for k in range(n)]
    row = read_back(spark.createDataFrame(rows, SCHEMA).repartition(4))[1]
    assert [(t["role"], t["text"]) for t in row["turns"]] == [(r[2], r[3]) for r in rows]
    assert row["formatted"].count("</turn>") == 1 + sum(a[2] != b[2] for a, b in zip(rows, rows[1:]))


def test_no_python_on_the_executors(spark, sf):
    plan = QUERIES["op9_chat_formatting"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    turns = {}
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    turns[-7] = [("user", HARD_TEXT), ("assistant", HARD_TEXT)]
    got = QUERIES["op9_chat_formatting"](spark, sf).collect()
    assert {r["conv_id"] for r in got} == set(turns)
    for r in got:
        loss = "".join(t for role, t in turns[r["conv_id"]] if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns[r["conv_id"]]), told(turns[r["conv_id"]]))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
