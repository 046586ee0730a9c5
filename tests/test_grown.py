"""The growing memory, the gap-preserving lexer, the linear own look-up, sheets from files."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from backglot.functions.lexing import document_pieces, stage0_lexer, stage1_lexer
from backglot.operators import reports, substitution
from backglot.operators.memory_store import MemoryStore
from backglot.session import scratch_path
from backglot.sources.tables import read_report_cells, write_report_cells

PAIR = "src string, tgt string, phrase string, translation string"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_later_answers_replace_earlier_ones_without_a_shuffle(spark):
    path = scratch_path(spark, "memory")
    store = MemoryStore(spark, path, "memory_versions", 4)
    store.upsert(spark.createDataFrame([("en", "es", "a", "z"), ("en", "es", "a", "y"), ("en", "fr", "a", "f"), ("en", "es", "b", "b1"), ("en", "es", None, "n")], PAIR), 1)
    store.upsert(spark.createDataFrame([("en", "es", "b", "b3"), ("en", "es", "b", "b2"), ("en", "es", "c", "c")], PAIR), 2)
    store.upsert(spark.createDataFrame([("en", "es", "b", "b0")], PAIR), 1)  # late, of an earlier version
    want = [("en", "es", "a", "y"), ("en", "es", "b", "b2"), ("en", "es", "c", "c"), ("en", "fr", "a", "f")]
    assert sorted(tuple(r) for r in store.current().collect()) == want
    assert "Exchange" not in plan_of(store.current())
    spark.sql("DROP TABLE memory_versions")  # the files stay
    again = MemoryStore(spark, path, "memory_again", 4)
    assert sorted(tuple(r) for r in again.current().collect()) == want

    docs = spark.createDataFrame([(1, "a b d\nd = d # e")], "id int, text string")
    lexer = stage1_lexer("en", "es")
    demand = again.demand(docs, "id", "text", lexer)
    assert {(r["phrase"], r["uses"]) for r in demand.collect()} >= {("d", 3)}
    assert not {"a", "b"} & {r["phrase"] for r in demand.collect()}
    memory_side = plan_of(demand.hint("merge")).split("memory_again")[0].split("Scan parquet")[0]
    assert memory_side.count("Exchange hashpartitioning(src") == 0


def test_gap_pieces_join_to_the_document(spark):
    draw = random.Random(5)
    letters = "ab_1 \t\n\r#\"'\\+=<>!()é中и\u00a0\u2028😀;"
    rows = [(i, "".join(draw.choice(letters) for _ in range(draw.randint(0, 60)))) for i in range(400)]
    rows += [(1000, ""), (1001, "x  # c "), (1002, "#"), (1003, "'a # b' # c"), (1004, " \n#\n\n")]
    df = spark.createDataFrame(rows, "id int, text string")
    pieces = document_pieces(F.col("text"), stage0_lexer("en", "es", keep_gaps=True))
    got = {r["id"]: r["t"] for r in df.select("id", F.array_join(pieces, "").alias("t")).collect()}
    assert got == dict(rows)


def test_own_lookup_is_linear_and_equal_to_the_literal(spark):
    words = [f"w{i}" for i in range(200_000)]
    rows = [(1, " ".join(words)), (2, "w1 w1 w999999"), (3, None), (4, ""), (4, "w5 w6\nw7")]
    docs = spark.createDataFrame(rows, "id int, text string")
    lexer = stage0_lexer("en", "es")
    table = spark.createDataFrame([(w, w.upper() + "x") for w in words[::50]] + [("w1", "B"), ("w1", "A")], "word string, repl string")
    start = time.time()
    joined = substitution.substitute_documents(docs, "id", "text", "out", table, lexer, inline_rows=0).collect()
    assert time.time() - start < 90
    literal = substitution.substitute_documents(docs, "id", "text", "out", table, lexer).collect()
    assert sorted(map(str, joined)) == sorted(map(str, literal))
    assert {r["out"] for r in joined if r["id"] == 2} == {"A A w999999"}


def test_fill_carries_over_blocks_and_null_groups(spark):
    draw = random.Random(2)
    rows = [(g, p, draw.choice([None, None, None, f"{g}{p}"])) for g in ("a", "b", None) for p in range(0, 300, 3)]
    df = spark.createDataFrame(rows, "g string, p long, v string")
    want = []
    for group in ("a", "b", None):
        last = None
        for g, p, v in rows:
            if g == group:
                last = v or last
                want.append((g, p, last))
    got = [tuple(r) for r in reports.forward_fill(df, "g", "p", "v", block_rows=20).select("g", "p", "v").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_sheets_in_files_keep_rows_and_cells(spark):
    path = scratch_path(spark, "sheets")
    rows = [("r1", i, [str(i), None, "a,\n\"b\"", " x "]) for i in range(30)] + [("r2", 0, ["only", "", None, None])]
    cells = spark.createDataFrame(rows, "report string, pos long, cells array<string>")
    write_report_cells(cells, "report", "pos", "cells", 4, path)
    back = read_report_cells(spark, f"{path}/report=*")
    back = back.withColumn("report", F.regexp_extract("report", "report=([^/]+)", 1)).orderBy("report", "pos").collect()
    assert [(r["report"], r["cells"][0]) for r in back] == [(r, c[0]) for r, _, c in rows]
    assert back[3]["cells"][2] == 'a,\n"b"' and back[3]["cells"][1] is None
