from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from backglot.llm import chat, registry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, formatted string, segments int"


def test_query(spark):
    query, sql = registry.QUERIES["op10_chat_format"]
    assert compare(spark, connect(SF), "op10", query, sql, SF) == ""


TEXTS = [None, "", "\\", "\\\\", "###", "####", "</turn>", "</turn>\n### User: x", "\\t\\h\\b\\c", "\\### A: </turn>", "a\n" * 40_000, ": ", "é🙂"]


def test_round_trip_of_odd_texts_and_roles(spark):
    roles = ["user", "assistant", "system", "User", "tool: x", "\\r", None, "", "a</turn>###"]
    rows = [(i, j, role, text, "z", 1) for i, text in enumerate(TEXTS) for j, role in enumerate(roles)]
    made = chat.format_conversations(spark.createDataFrame(rows, SCHEMA))
    got = made.select("conv_id", "n_turns", chat.read_formatted(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        text = TEXTS[r["conv_id"]] or ""
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(role or "", text) for role in roles]
        assert r["loss"] == text and r["n_turns"] == len(roles)


@pytest.mark.parametrize(
    "roles, valid",
    [("su", False), ("sua", True), ("ua", True), ("uaua", True), ("uu", False), ("a", False), ("us", False), ("ssua", False), ("uau", False), ("x", False)],
)
def test_turn_order(spark, roles, valid):
    names = {"s": "system", "u": "user", "a": "assistant", "x": None}
    rows = [(1, i, names[r], "t", "z", 1) for i, r in enumerate(roles)]
    assert chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).first()["valid"] is valid


def test_ties_nulls_and_empty_table(spark):
    rows = [(None, 2, "user", "b", "z", 1), (None, None, "user", "n", "z", 1), (None, 2, "assistant", "a", "z", 1), (None, 2, "user", "b", "z", 1)]
    made = chat.format_conversations(spark.createDataFrame(rows, SCHEMA))
    turns = made.select(chat.read_formatted(F.col("formatted")).alias("t")).first()["t"]
    assert [(t["role"], t["text"]) for t in turns] == [("user", "n"), ("assistant", "a"), ("user", "b"), ("user", "b")]
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).collect() == []
