"""Plans that must not grow faster than their input, and the same results from both plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from backglot.functions.lexing import _line_pieces, document_pieces, lines, stage0_lexer, stage1_lexer
from backglot.operators import metrics

PAIRS = "id int, r array<string>, c array<string>"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_without_comments_are_lexed_as_a_whole(spark):
    texts = ["", " a\n\n  b 'x\n y' \"q\\\n z\" <<= é1 \t\n", "a == b\r\n c", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    for lexer in (stage0_lexer("en", "es"), stage1_lexer("es", "hi"), stage0_lexer("en", "es", keep_gaps=True)):
        by_line = F.array_join(F.transform(lines(F.col("t")), lambda x: F.array_join(_line_pieces(x, lexer, True), "")), "\n")
        pieces = document_pieces(F.col("t"), lexer)
        for row in df.select(F.array_join(pieces, "").alias("a"), by_line.alias("b"), pieces.alias("p")).collect():
            assert row["a"] == row["b"]
            assert "" not in (row["p"] or [])  # a line's empty indent was a piece


def test_pairs_are_counted_without_exploding_them(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["a"]), (2, None, ["a"])], PAIRS)
    plan = plan_of(metrics.pair_counts(df, "id", "r", "c"))
    assert "Generate" not in plan and "Exchange" not in plan


def test_rows_of_one_id_are_one_pair(spark):
    rows = [(1, ["a", "b"], ["a", "x"]), (1, ["x"], ["a"]), (None, ["1", "'s'", "!"], ["1"]), (None, [], ["1"]), (2, ["a"], ["a"])]
    got = {r["id"]: r for r in metrics.pair_counts(spark.createDataFrame(rows, PAIRS), "id", "r", "c").collect()}
    assert [(got[i]["hit1"], got[i]["r_len"], got[i]["c_len"]) for i in (1, None, 2)] == [(2, 3, 3), (1, 3, 2), (1, 1, 1)]
    assert (got[None]["r_numbers"], got[None]["r_strings"], got[None]["r_ops"]) == (1, 1, 1)
