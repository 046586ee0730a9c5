from __future__ import annotations

import random
import re

import pytest

from backglot.llm import neardup
from backglot.sources.tables import scan

SF = "/root/testdata/sf0.001"


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, n):
    """Components by comparing every document with all others that share a shingle."""
    sets, where, parent = {}, {}, {}
    for key, text in rows:
        sets[key] = shingles(text, n)
        parent[key] = key
        for s in sets[key]:
            where.setdefault(s, []).append(key)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for key, own in sets.items():
        for other in {o for s in own for o in where[s]}:
            if other < key:
                common = len(own & sets[other])
                if 100 * common >= 80 * (len(own) + len(sets[other]) - common):
                    a, b = sorted((top(key), top(other)))
                    parent[b] = a
    return {k: (len(s), top(k)) for k, s in sets.items()}


def test_query(spark):
    docs = scan(spark, SF, "documents")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], 4)
    got = neardup.op1_minhash_near_dedup(spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == len(want)


@pytest.mark.parametrize("trees, depth, small", [(20, 4, 8), (20, 1, 2)])
def test_large_group_of_near_copies_and_strays(spark, trees, depth, small):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(150):
        words = base.copy()
        for _ in range(draw.randint(0, 6)):
            words[draw.randrange(120)] = word()
        rows.append((1000 + i, " ".join(words)))
    for i in range(60):  # share a passage, and nothing else
        rows.append((i, " ".join(base[:40] + [word() for _ in range(80)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(docs, 4, 80, trees, depth, small).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 4)


def test_odd_inputs(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "A b"), (5, "a  B"), (6, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"),
            (None, "a b c d e f"), (8, "long " * 30_000), (9, "x\x1fy z")]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, component_id int, doc string")
    got = neardup.near_duplicates(docs, 4).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(
        [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 3, 6), (7, 3, 6), (7, 3, 6), (None, 3, None), (8, 1, 8), (9, 1, 9)],
        key=key,
    )
    assert neardup.near_duplicates(docs.limit(0), 4).collect() == []


def test_one_id_on_different_texts(spark):
    words = lambda c, n: [f"{c}{i}" for i in range(n)]
    a, b, d = " ".join(words("a", 60)), " ".join(words("b", 60)), " ".join(words("d", 60))
    rows = [(1, a), (2, a), (2, b), (3, b + " z"), (4, d), (5, d), (5, "other words altogether")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(docs, 4).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [
        (1, 57, 1), (2, 57, 1), (2, 57, 1), (3, 58, 1), (4, 57, 4), (5, 1, 4), (5, 57, 4)
    ]
