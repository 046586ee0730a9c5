"""Operators: brute-force checks, both physical plans, skew, recovery of partial work."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from backglot.functions.lexing import stage0_lexer, stage1_lexer
from backglot.functions.profiles import text_profile
from backglot.operators import dictionary, fewshot, lookup, memory, metrics, positions, reports, runs, substitution
from backglot.session import scratch_path
from backglot.sources import tables

# A slice of an English-Mandarin keyword table, with the collision of "and" and "with".
KEYWORDS = [("def", "定义"), ("for", "为了"), ("in", "在"), ("and", "和"), ("with", "和"), ("return", "返回"), ("x", None)]
CODE = (
    "def f(items):\n    for i in items:  #  keep this\n        print('for', i)\n\n    #only\n    return and_ and \"in\"\n"
)


@pytest.fixture(scope="module")
def words(spark):
    rows = [(i, *pair) for i, pair in enumerate(KEYWORDS)]
    return dictionary.keyword_dictionary(spark.createDataFrame(rows, "i int, src string, tgt string"), F.col("i"))


def substituted(spark, words, code, source, target, inline):
    df = spark.createDataFrame([(1, code), (2, None), (3, "")], "id long, code string")
    lexer = stage0_lexer(source, target)
    out = substitution.substitute_documents(df, "id", "code", "out", words, lexer, inline_rows=inline)
    return {r["id"]: r["out"] for r in out.collect()}


@pytest.mark.parametrize("inline", [5000, 0])
def test_substitution_there_and_back(spark, words, inline):
    there = substituted(spark, words, CODE, "en", "zh-CN", inline)
    assert there[1] == (
        "定义 f(items):\n    为了 i 在 items: #keep this\n        print('for', i)\n\n     #only\n    返回 and_ 和 \"in\"\n"
    )
    assert (there[2], there[3]) == (None, "")
    back = substituted(spark, words, there[1], "zh-CN", "en", inline)[1]
    assert "return and_ with \"in\"" in back


def test_last_keyword_wins_and_collisions_are_reported(spark, words):
    got = {r["word"]: r["repl"] for r in words.collect()}
    assert got["和"] == "with" and got["and"] == "和" and "x" not in got
    pairs = spark.createDataFrame(KEYWORDS, "src string, tgt string")
    assert [tuple(r) for r in dictionary.collisions(pairs).collect()] == [("和", 2)]


def test_keyword_table_from_wide_columns(spark):
    wide = spark.createDataFrame([(0, "if", "si", None)], "n int, EnglishKey string, SpanishKey string, GreekKey string")
    assert {tuple(r) for r in dictionary.keyword_table(wide, "n").collect()} == {(0, "en", "if"), (0, "es", "si")}
    assert dictionary.wide_pair(wide, "n", "en", "es").first()[1:] == ("if", "si")


@pytest.mark.parametrize("inline", [5000, 0])
def test_stage1_translation(spark, inline):
    df = spark.createDataFrame([(1, "def get_name(self): # read it\n    return get_name + ñame - 12 #")], "id int, code string")
    table = spark.createDataFrame(
        [("en", "es", "get name", "obtener nombre"), ("en", "es", "return", "volver-a"), ("en", "es", "read it", "leer-lo"),
         ("en", "fr", "return", "rendre"), ("en", "es", "return", "zz"), ("en", "es", None, "null")],
        "src string, tgt string, phrase string, translation string",
    )
    out = memory.translate_documents(df, "id", "code", "out", table, stage1_lexer("en", "es"), inline_rows=inline)
    assert out.first()["out"] == (
        "def obtener_nombre(self): # leer_lo\n    volver_a obtener_nombre + ñame - 12 #"
    )


def hot_tables(spark):
    """A fact table where one key holds half of all rows and a tenth has no key."""
    key = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 10 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50))
    facts = spark.range(4000).select("id", key.alias("word"))
    dim = facts.where("word is not null and word <> 'k3'").select("word").distinct()
    return facts, dim.withColumn("repl", F.reverse("word"))


def test_salted_join_equals_broadcast_join(spark, monkeypatch):
    facts, dim = hot_tables(spark)
    plain = lookup.lookup_join(facts, dim, "word", ["id"], broadcast=True)
    monkeypatch.setattr(lookup, "TASK_ROWS", 300)  # the hot key spreads over seven salts
    salted = lookup.lookup_join(facts, dim, "word", ["id"], broadcast=False)
    assert salted.count() == 4000
    assert sorted(map(str, plain.collect())) == sorted(map(str, salted.select(plain.columns).collect()))


def test_broadcast_bound_is_measured(spark):
    _, dim = hot_tables(spark)
    assert lookup.fits_broadcast(dim)
    assert not lookup.fits_broadcast(dim, rows=3)
    assert not lookup.fits_broadcast(dim, size=10)


def python_bleu(ref: list[str], cand: list[str]) -> float:
    def grams(t, n):
        return Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))

    logs = 0.0
    for n in range(1, 5):
        r, c = grams(ref, n), grams(cand, n)
        hit = sum(min(v, r[g]) for g, v in c.items())
        if n == 1 and hit == 0:
            return 0.0
        logs += math.log(hit / max(1, sum(c.values())) if hit else 2.2250738585072014e-308) / 4
    return (1.0 if len(cand) > len(ref) else math.exp(1 - len(ref) / len(cand))) * math.exp(logs)


def test_bleu_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, rng.choices("abc", k=rng.randint(0, 40)), rng.choices("abcd", k=rng.randint(0, 40))) for i in range(150)]
    rows += [(1000, list("abcd"), list("abcd")), (1001, ["a"], ["a"]), (1002, [], []), (1003, ["a"] * 500, ["a"] * 300)]
    df = spark.createDataFrame(rows, "id int, r array<string>, c array<string>")
    got = {x["id"]: x["b"] for x in metrics.pair_counts(df, "id", "r", "c").select("id", metrics.bleu_score().alias("b")).collect()}
    for i, r, c in rows:
        assert got[i] == pytest.approx(python_bleu(r, c) if c else 0.0, abs=1e-12)
    assert got[1000] == pytest.approx(1.0)


def test_text_evaluation(spark):
    text = "One, two (three) and Four"
    rows = [(1, text, text), (2, text, "zwei, drei"), (3, text, "One ("), (4, None, text), (5, text, None)]
    pairs = spark.createDataFrame(rows, "id int, original string, back string")
    got = {r["id"]: r for r in metrics.evaluate_pairs(pairs, text_profile).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1]["bleu_score"] == pytest.approx(1.0) and got[1]["structure_score"] == 1.0 and got[1]["token_match"] == 1.0
    assert got[1]["overall_score"] == pytest.approx(0.8)  # no embeddings given
    assert got[2]["structure_score"] == 0.0 and got[2]["syntax_valid"] is True
    assert got[3]["syntax_valid"] is False


def test_scores_stay_within_bounds(spark):
    texts = ["", "a", "One, two (three) for 4.5", "!!", "x " * 50, '"open']
    rows = [(i * 10 + j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)]
    scored = metrics.evaluate_pairs(spark.createDataFrame(rows, "id int, original string, back string"), text_profile)
    for r in scored.collect():
        for name in ("bleu_score", "structure_score", "token_match", "overall_score"):
            assert 0.0 <= r[name] <= 1.0 + 1e-12, (name, r)


def test_positions_are_dense_for_skewed_keys(spark):
    keys = spark.range(500).select((F.col("id") * F.col("id") * F.col("id")).alias("k")).repartition(7)
    rows = positions.with_position(keys, "k").orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(500))
    assert [r["k"] for r in rows] == [i**3 for i in range(500)]


def test_slice_overflow_restarts(spark):
    rows = positions.with_position(spark.range(10).withColumnRenamed("id", "k"), "k")
    total = F.lit(10)
    assert positions.slice_rows(rows, F.lit(4), F.lit(6), total).count() == 6
    assert {r["pos"] for r in positions.slice_rows(rows, F.lit(5), F.lit(6), total).collect()} == set(range(6))
    assert [r["k"] for r in positions.first_rows(rows, "k", 3).collect()] == [0, 1, 2]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_forward_fill_across_blocks(spark, block):
    cells = [None, "a", None, None, None, None, None, "b", None, None]
    rows = spark.createDataFrame([("r", i, c) for i, c in enumerate(cells)], "g string, p long, v string")
    filled = reports.forward_fill(rows, "g", "p", "v", block).orderBy("p").collect()
    assert [r["v"] for r in filled] == [None, *["a"] * 6, *["b"] * 3]


def test_report_sheet_from_csv(spark):
    path = scratch_path(spark, "sheet")
    head = ["Language", "No of Examples", *reports.REPORT_HEADERS]
    rows = [["Table 1", *[None] * 7], head, ["el (Greek)", "0", "0,5\n", "90", "1", "1", "1", "0.7,"], [None, "5", *["1"] * 6]]
    rows += [["note", *[None] * 7]]
    names = ", ".join(f"c{i} string" for i in range(8))
    spark.createDataFrame(rows, names).coalesce(1).write.option("escape", '"').csv(path)
    got = reports.model_report(tables.read_report_cells(spark, path), "report", "pos", "cells").orderBy("pos").collect()
    assert [(r["language"], r["examples"], r["bleu_score"], r["overall"]) for r in got] == [
        ("el (Greek)", 0.0, 0.5, 0.7),
        ("el (Greek)", 5.0, 1.0, 1.0),
    ]


def test_missing_header_is_an_error(spark):
    cells = spark.createDataFrame([("r", 0, ["a", "b"])], "report string, pos long, cells array<string>")
    with pytest.raises(Exception, match="no header row"):
        reports.find_headers(cells, "report", "pos", "cells").collect()


def test_absent_column_is_an_error(spark):
    cells = spark.createDataFrame([("r", 0, ["Language", "No of Examples"]), ("r", 1, ["x", "5"])], "report string, pos long, cells array<string>")
    with pytest.raises(Exception, match="no column 'Bleu Score'"):
        reports.model_report(cells, "report", "pos", "cells").collect()


def test_large_sizes_and_missing_sets(spark):
    examples = spark.range(60).select(F.col("id").alias("pos"), F.lit("s").alias("src"), F.lit("t").alias("tgt"))
    sets = fewshot.example_sets(examples, spark.createDataFrame([(50,), (12,), (0,)], "chunk_size long"))
    assert {r["chunk_size"]: r["n_examples"] for r in sets.collect()} == {0: 0, 12: 12, 50: 50}
    turned = fewshot.example_sets(examples, spark.createDataFrame([(1,)], "chunk_size long"), reverse=True).first()
    assert "Original code:\nt\nComplete translation:\ns" in turned["examples_text"]
    rows = spark.createDataFrame([(1, "x")], "id int, code string")
    with pytest.raises(Exception, match="no example set of size 7"):
        fewshot.build_prompts(rows, "code", F.array(F.lit(7).cast("long")), sets, "English", "Greek").collect()


def test_pivot_finds_all_models(spark):
    rows = spark.createDataFrame([("x", "m", 1.0), ("x", "n", 3.0), ("y", "m", 2.0)], "language_display string, model string, overall double")
    got = {r["language_display"]: (r["m"], r["n"]) for r in reports.language_model_pivot(rows).collect()}
    assert got == {"x": (1.0, 3.0), "y": (2.0, None)}


@pytest.mark.parametrize("inline", [5000, 0])
def test_repeated_and_null_keys_and_words(spark, inline):
    docs = spark.createDataFrame([(1, "for x in y"), (1, "print x"), (None, "foo bar"), (2, None)], "id int, code string")
    table = spark.createDataFrame([("for", "para"), ("print", "imprime"), ("foo", "uno"), ("foo", "dos"), (None, "z")], "word string, repl string")
    out = substitution.substitute_documents(docs, "id", "code", "out", table, stage0_lexer("en", "es"), inline)
    assert sorted(str(r["out"]) for r in out.collect()) == ["None", "dos bar", "imprime x", "para x in y"]


@pytest.mark.parametrize("inline", [5000, 0])
def test_long_phrases_and_comments_stay_whole(spark, inline):
    comment = "# " + "ñandú " * 3000 + "x"
    docs = spark.createDataFrame([(1, f"a {comment}")], "id int, code string")
    memory_table = spark.createDataFrame([("es", "zh-CN", "q", "r")], "src string, tgt string, phrase string, translation string")
    out = memory.translate_documents(docs, "id", "code", "out", memory_table, stage1_lexer("es", "zh-CN"), inline).first()["out"]
    assert out.endswith("ñandú x") and len(out) == len(f"a {comment}")


def test_word_of_half_of_all_tokens(spark):
    docs = spark.range(40).select("id", F.concat(F.repeat(F.lit("hot "), 50), F.col("id").cast("string")).alias("code"))
    table = spark.createDataFrame([("hot", "h")], "word string, repl string")
    out = substitution.substitute_documents(docs, "id", "code", "out", table, stage0_lexer("en", "es"), 0)
    assert {r["out"] for r in out.collect()} == {"h " * 50 + str(i) for i in range(40)}


def test_cells_with_null_keys_are_done_once(spark):
    grid = spark.createDataFrame([(None, 1), ("a", 1), ("b", None)], "m string, k int")
    assert runs.missing_cells(grid, grid.limit(2), ["m", "k"]).count() == 1
    assert runs.missing_cells(grid, grid, ["m", "k"]).count() == 0


def test_prompt_reads_as_specified(spark):
    examples = spark.createDataFrame([(0, "a", "b"), (1, "c", "d")], "pos long, src string, tgt string")
    grid = fewshot.sweep_grid(spark.createDataFrame([(2,)], "n1 long"), "n1")
    assert sorted(r["chunk_size"] for r in grid.collect()) == [0, 2]
    sets = fewshot.example_sets(examples, grid)
    rows = spark.createDataFrame([(1, "x = 1")], "id int, code string")
    prompts = fewshot.build_prompts(rows, "code", F.array(F.lit(0).cast("long"), F.lit(2).cast("long")), sets, "English", "Greek")
    got = {r["chunk_size"]: r for r in prompts.collect()}
    assert got[0]["n_examples"] == 0 and "Example 1" not in got[0]["prompt"]
    assert "\nExample 2:\nOriginal code:\nc\nComplete translation:\nd\n" + "-" * 50 + "\n" in got[2]["prompt"]
    assert got[2]["prompt"].startswith("Complete the translation of this partially English Python code to completely Greek")


def test_resume_computes_only_missing_cells(spark):
    path = scratch_path(spark, "resume")
    grid = spark.createDataFrame([("a", 0), ("a", 5), ("b", 0)], "model string, chunk int")
    keys = ["model", "chunk"]
    assert runs.skip_done(grid, path, keys).count() == 3
    runs.write_cells(grid.where("model = 'a'").withColumn("v", F.lit(1)), path, keys)
    assert [tuple(r) for r in runs.skip_done(grid, path, keys).collect()] == [("b", 0)]
    runs.write_cells(grid.where("chunk = 0").withColumn("v", F.lit(2)), path, keys)
    got = {(r["model"], r["chunk"]): r["v"] for r in spark.read.parquet(path).collect()}
    assert got == {("a", 0): 2, ("a", 5): 1, ("b", 0): 2}
    assert runs.skip_done(grid, path, keys, force=True).count() == 3


def test_cells_without_rows_and_number_like_keys_are_done(spark):
    path, keys = scratch_path(spark, "resume"), ["model", "chunk"]
    grid = spark.createDataFrame([("007", 0), ("008", 0), (None, 1)], "model string, chunk int")
    runs.write_cells(grid.where("model = '007'").withColumn("v", F.lit(1)), path, keys, cells=grid)
    assert runs.skip_done(grid, path, keys).count() == 0


def test_csv_keeps_line_breaks_and_quotes(spark):
    path = scratch_path(spark, "csv")
    rows = [(1, 'a "b"\nc, d'), (2, "plain"), (3, "back\\slash")]
    tables.write_csv(spark.createDataFrame(rows, "id int, code string"), path)
    assert sorted(tuple(r) for r in tables.read_csv(spark, path, "id int, code string").collect()) == rows


def test_partition_count_does_not_change_results(spark, words):
    docs = spark.range(60).select("id", F.concat(F.lit(CODE), F.col("id")).alias("code"))
    lexer = stage0_lexer("en", "zh-CN")
    results = [
        sorted(
            map(str, substitution.substitute_documents(docs.repartition(n), "id", "code", "out", words, lexer, inline).collect())
        )
        for n in (1, 7)
        for inline in (5000, 0)
    ]
    assert all(r == results[0] for r in results)


def test_substitution_with_inline_dictionary_has_no_shuffle(spark, words):
    path = scratch_path(spark, "docs")
    spark.range(10).select("id", F.lit(CODE).alias("code")).write.parquet(path)
    out = substitution.substitute_documents(
        spark.read.parquet(path), "id", "code", "out", words, stage0_lexer("en", "zh-CN")
    )
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
