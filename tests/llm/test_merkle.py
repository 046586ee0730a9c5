"""Merkle manifest against its SQL twin and against plain recursion."""

from __future__ import annotations

import random
from hashlib import sha256

import pytest

from backglot.llm import merkle
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def levels_of(leaves: list[str]) -> list[list[str]]:
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def way(levels: list[list[str]], i: int, node: str) -> tuple[list[str], str]:
    siblings = []
    for nodes in levels[:-1]:
        pair = nodes[i // 2 * 2 : i // 2 * 2 + 2]
        siblings += [n for k, n in enumerate(pair, i // 2 * 2) if k != i]
        pair[i % 2] = node
        i, node = i // 2, digest(*pair)
    return siblings, node


def plain(rows: list[tuple]) -> list[tuple]:
    """``(id, leaf, subroot, root, proof, folded)`` of ``(tree, id, leaf, given)``."""
    trees = {}
    for row in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])):
        trees.setdefault(row[0], []).append(row)
    inner = {t: levels_of([r[2] for r in of]) for t, of in trees.items()}
    over = levels_of([inner[t][-1][0] for t in trees])
    out = []
    for at, (tree, of) in enumerate(trees.items()):
        for i, (_, key, leaf, given) in enumerate(of):
            low, node = way(inner[tree], i, given)
            high, root = way(over, at, node)
            out.append((key, leaf, inner[tree][-1][0], over[-1][0], digest(*low, *high), root))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [1, 3, 10])
def test_proofs_equal_plain_recursion(spark, bits):
    draw = random.Random(bits)
    rows = []
    for tree, size in [("", 1), ("=a", 37), ("=b", 2), ("=c", 1), ("=d", 64), ("=é", 9), ("=z", 5)]:
        for i in range(size):
            leaf = digest(tree, str(i % 30))
            rows.append((tree, None if i % 11 == 5 else i % 30, leaf, leaf if draw.random() < 0.7 else digest("x")))
    df = spark.createDataFrame(rows, "tree string, doc_id long, digest string, given string")
    found = [tuple(r) for r in merkle.prove_rows(df, "doc_id", bits).collect()]
    assert sorted(found, key=str) == plain(rows)


def test_one_row_one_group_and_nothing(spark):
    kinds = "tree string, doc_id int, digest string, given string"
    leaf = digest("1")
    one = merkle.prove_rows(spark.createDataFrame([("=x", 4, leaf, leaf)], kinds), "doc_id").collect()
    assert [tuple(r) for r in one] == [(4, leaf, leaf, leaf, digest(), leaf)]
    assert merkle.prove_rows(spark.createDataFrame([], kinds), "doc_id").collect() == []


def test_missing_coordinates_are_least():
    draw = random.Random(3)
    for _ in range(200):
        width = draw.randint(1, 70)
        levels = levels_of([str(i) for i in range(width)])
        held = draw.sample(range(width), draw.randint(1, width))
        want = set()
        for i in held:
            for level, nodes in enumerate(levels[:-1]):
                if i >> level ^ 1 < len(nodes):
                    want.add((level, i >> level ^ 1))
        derived = {(level, i >> level) for i in held for level in range(len(levels))}
        got = merkle.missing_coordinates(held, width)
        assert len(got) == len(set(got)) and set(got) == want - derived


def test_query_equals_sql(spark):
    assert compare(spark, connect(FOLDER), "op11", merkle.op11_merkle_manifest, merkle.OP11_SQL, FOLDER) == ""


def test_nulls_repeats_long_texts_and_clashing_columns(spark, tmp_path):
    rows = [
        (1, None, None, None, None, "a"), (1, "s", "", 0, "", "a"), (None, "s", "en", 3, "abc", "a"), (2, "s", "en", 3, "é" * 200_000, "a"),
        (2, "s", "en", 3, "é" * 200_000, "a"), (None, None, "en", None, "1:a", "a"), (7, "s", None, 4, "x", "a"), (14, "s", "日", 4, "x", "a"),
    ]
    kinds = "doc_id long, source string, lang string, n_chars long, text string, leaf string"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/documents.parquet")
    assert_same(spark, tmp_path)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert merkle.op11_merkle_manifest(spark, str(tmp_path)).collect() == []


def assert_same(spark, folder):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    assert compare(spark, con, "op11", merkle.op11_merkle_manifest, merkle.OP11_SQL, str(folder)) == ""
