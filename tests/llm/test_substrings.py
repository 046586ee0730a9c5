from __future__ import annotations

import hashlib
import random
import re

import pytest

from backglot.llm import registry, substrings
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def brute(rows, span):
    least, out = {}, []
    split = [(k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in rows]
    for k, words in split:
        if k is not None:
            for i in range(len(words) - span + 1):
                w = tuple(words[i : i + span])
                least[w] = min(k, least.get(w, k))
    for k, words in split:
        gone = set()
        for i in range(len(words) - span + 1):
            if k is not None and least[tuple(words[i : i + span])] < k:
                gone.update(range(i, i + span))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((k, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def same(got, want):
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_query(spark):
    query, sql = registry.QUERIES["op6_substring_dedup"]
    assert compare(spark, connect(SF), "op6", query, sql, SF) == ""


@pytest.mark.parametrize("crowded", [160_000, 30])
def test_overlapping_passages(spark, monkeypatch, crowded):
    monkeypatch.setattr(substrings, "CROWDED", crowded)
    draw = random.Random(9)
    few = ["a", "b", "Ab", "é", "x,"]
    passages = [[draw.choice(few) for _ in range(draw.randint(5, 30))] for _ in range(12)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(draw.randint(0, 6)):
            words += draw.choice(passages)[draw.randint(0, 4) :] if draw.random() < 0.6 else [draw.choice(few) for _ in range(9)]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for span in (5, 13):
        same(substrings.removal_digests(docs, span).collect(), brute(rows, span))


def test_odd_inputs(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(1, None), (2, ""), (3, " \n"), (5, text), (4, "pre " + text), (5, text), (None, text), (6, "x " * 20_000), (8, "x " * 15_000), (7, text.replace(" ", "\t"))]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, start int, doc string")
    same(substrings.removal_digests(docs).collect(), brute(rows, 13))
    cut = substrings.remove_repeats(docs).collect()
    assert sorted(r["text"] for r in cut if r["doc_id"] in (5, 7)) == ["", "", ""]
    assert [r["text"] for r in cut if r["doc_id"] == 1] == [None] and cut[0].asDict().keys() == {"doc_id", "text", "start", "doc"}
    assert substrings.removal_digests(docs.limit(0)).collect() == []


def test_one_id_on_different_texts(spark):
    clean = " ".join(f"c{i}" for i in range(20))
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(1, text), (2, clean + " " + text), (2, "short one"), (2, clean), (2, text), (3, "p " + clean), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(substrings.removal_digests(docs).collect(), brute(rows, 13))
    cut = substrings.remove_repeats(docs).collect()
    assert sorted(r["text"] for r in cut if r["doc_id"] == 2) == ["", clean, clean, "short one"]


def test_long_runs_are_cut_into_segments_that_still_match(spark, monkeypatch):
    """Passages of one anchor that start at different words: their pieces differ, their windows do not."""
    unit = [f"u{i}" for i in range(7)]
    long_ = (unit * 1_500)[: 9_000]
    rows = [(1, " ".join(long_)), (2, " ".join(["pre"] + long_[3:8_000] + ["post"])), (3, "other " + " ".join(f"z{i}" for i in range(50)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(substrings.removal_digests(docs).collect(), brute(rows, 13))


def test_only_what_the_result_reads_is_left(spark):
    import os

    from backglot.llm import neardup
    from backglot.session import scratch_path

    base = os.path.dirname(scratch_path(spark, "x"))
    docs = spark.createDataFrame([(i, " ".join(f"w{j % (7 + i % 3)}" for j in range(40))) for i in range(30)], "doc_id long, text string")
    for run in (lambda: substrings.removal_digests(docs), lambda: neardup.near_duplicates(docs)):
        before = set(os.listdir(base))
        result = run()
        left = set(os.listdir(base)) - before
        assert len(left) == 1, left
        assert result.count() == 30
