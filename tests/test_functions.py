"""Column functions on small literals."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from backglot.functions import languages, lexing, text
from backglot.operators import memory as mem
from backglot.operators import runs


def values(spark, column, cells, kind="string"):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("x"))).collect()]


def test_extract_code(spark):
    cells = [
        "a ```python\n def f(): pass \n``` b ```python x```",
        "```python\n\u2003x = 1\n```",
        "```python\nimport os",
        "no fence, for all",
        None,
    ]
    assert values(spark, text.extract_code, cells) == ["def f(): pass", None, None, None, None]
    assert values(spark, text.fenced_block, cells)[1] == "x = 1"


def test_clean_number(spark):
    cells = ["0,78\n", "1.2.3", " 7 ", "about 3.5%", "", None, "-2e-1", "1_000", "n/a", "100,", "1.0d"]
    assert values(spark, text.clean_number, cells) == [0.78, 1.23, 7.0, 3.5, 0.0, 0.0, -0.2, 1000.0, 0.0, 100.0, 1.0]
    assert math.isnan(values(spark, text.clean_number, ["nan"])[0])


def test_display_name(spark):
    assert values(spark, text.display_name, ["el (Greek)", " Zh-CN (Mandarin) (x)"]) == ["el", "Zh-CN"]


@pytest.mark.parametrize(
    ("answer", "both", "tagged"),
    [
        (" ```python\nx\n``` y", "x", "x"),
        ("```\nx\n```", "x", "```\nx\n```"),
        ("a ```python\nx", "x", "x"),
        ("  plain ", "plain", "plain"),
        ("", "", ""),
        (None, None, None),
    ],
)
def test_clean_response(spark, answer, both, tagged):
    assert values(spark, lambda c: text.clean_response(c, True), [answer]) == [both]
    assert values(spark, lambda c: text.clean_response(c, False), [answer]) == [tagged]


def test_tokens_of_both_lexers(spark):
    line = 'x<<=y**2 ... "a\\"b" é \'open'
    stage0 = values(spark, lexing.stage0_lexer("en", "zh-CN").tokens, [line])[0]
    stage1 = values(spark, lexing.stage1_lexer("en", "zh-CN").tokens, [line])[0]
    assert stage0 == ["x", "<", "<=", "y", "**", "2", " ", ".", ".", ".", " ", '"a\\"b"', " ", " ", "'open"]
    assert stage1 == ["x", "<<=", "y", "**", "2", " ", "...", " ", '"a\\"b"', " ", " ", "'open"]


def test_comment_split(spark):
    lines = ["x = 1  # note", "s = '#' # c", "s = 'it # open", "#", '"a" "b#"', "plain  "]
    assert values(spark, lexing.code_part, lines) == ["x = 1", "s = '#'", "s = 'it # open", "", '"a" "b#"', "plain  "]
    assert values(spark, lexing.comment_part, lines) == ["# note", "# c", "", "#", "", ""]


def test_long_string_does_not_overflow_the_matcher(spark):
    line = '"' + "ab\\n" * 50_000 + '" + x'
    tokens = values(spark, lexing.stage0_lexer("en", "es").tokens, [line])[0]
    assert [len(t) for t in tokens] == [200_002, 1, 1, 1, 1]


@pytest.mark.parametrize(
    ("target", "expected"),
    [
        ("en", [True, True, False, False, True]),
        ("es", [True, False, True, False, False]),
        ("zh-CN", [True, False, False, True, False]),
        ("zh", [True, False, False, True, False]),
        ("xx", [True, False, False, False, False]),
    ],
)
def test_script_flag(spark, target, expected):
    words = ["12", "abc", "ñ", "定义", "x_1"]
    assert values(spark, lambda c: languages.is_target_language(c, target), words) == expected


def test_identifier_roundtrip(spark):
    rows = spark.createDataFrame(
        [("get_name", "obtener-nombre x"), ("get_name", None), ("name", ""), ("___", None)], "w string, hit string"
    )
    phrase = mem.phrase_of(F.col("w"))
    got = rows.select(mem.identifier_of(F.col("w"), phrase, F.col("hit"))).collect()
    assert [r[0] for r in got] == ["obtener_nombre_x", "get_name", "name", "___"]


def test_run_key(spark):
    names = ["Stage_2_gpt_en_zh-CN_0_30_10_5.csv", "evaluation_summary_google_en_hi_30.json", "other.csv"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(*runs.run_key(F.col("n"))).collect()
    assert tuple(rows[0]) == ("Stage_2", "gpt", "en", "zh-CN", 0, 30, 10, 5)
    assert tuple(rows[1])[:4] == ("evaluation_summary", "google", "en", "hi")
    assert tuple(rows[2]) == (None,) * 8
