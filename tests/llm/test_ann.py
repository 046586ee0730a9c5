from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from backglot.llm import ann
from backglot.sources.tables import scan

SF = "/root/testdata/sf0.1"


def brute(rows, asks, k):
    """Exact nearest rows per query id."""
    rows = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for q, x in rows:
        if asks(q):
            scored = sorted((-math.fsum((x * v).tolist()), i) for i, v in rows if i != q)
            out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def grouped(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_SAMPLE", 150)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    monkeypatch.setattr(ann, "STRETCH_ROWS", 100)
    monkeypatch.setattr(ann, "GROUP_QUERIES", 16)
    want = brute([(r["vec_id"], r["embedding"]) for r in scan(spark, SF, "embeddings").collect()], lambda q: q % 20 == 0, 20)
    got = grouped(ann.op9_nearest_neighbours(spark, SF).collect())
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    for q in got:
        scores = {i: s for _, i, s in want[q]}
        assert all(scores.get(i, s) == s for _, i, s in got[q])
        assert [(-s, i) for _, i, s in got[q]] == sorted((-s, i) for _, i, s in got[q])


def test_odd_inputs(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [float("inf"), 1.0]),
            (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (20, [-1.0, 0.0])]
    vectors = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, rank int, id int")
    got = grouped(ann.search(vectors, F.col("vec_id") % 10 == 0, 4).collect())
    assert got == {
        0: [(1, 1, 1.0), (2, 9, 1.0), (3, 9, 1.0), (4, 2, 0.5)],
        20: [(1, 2, -0.5), (2, 0, -1.0), (3, 1, -1.0), (4, 9, -1.0)],
    }
    assert ann.search(vectors.limit(0), F.lit(True)).collect() == []
    assert ann.search(vectors.where("vec_id = 0"), F.lit(True)).collect() == []


def test_one_vector_of_very_many_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "STRETCH_ROWS", 100)
    draw = np.random.RandomState(0)
    rows = [(i, [1.0] * 8 if i % 3 == 0 else draw.randn(8).tolist()) for i in range(1200)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = grouped(ann.search(vectors, F.col("vec_id") % 100 == 0, 20).collect())
    want = brute(rows, lambda q: q % 100 == 0, 20)
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    assert got[300] == want[300]


def test_parts_are_balanced():
    x = np.random.RandomState(2).randn(1000, 8)
    part = ann.balanced_parts(x, ann.nearest(x, 10), 7)
    assert np.bincount(part, minlength=7).max() <= math.ceil(1.1 * 1000 / 7)


def test_calibrated_on_rows_held_out_of_fitting(monkeypatch):
    seen = {}
    kept = ann.calibrate

    def spy(router, x, k, target):
        seen["held"] = x
        return kept(router, x, k, target)

    class Fitted(ann.Router):
        def __init__(self, x, *rest):
            seen["fitted"] = x
            super().__init__(x, *rest)

    monkeypatch.setattr(ann, "calibrate", spy)
    monkeypatch.setattr(ann, "Router", Fitted)
    x = np.random.RandomState(5).randn(1500, 16)
    _, parts, probes = ann.fit_router(x, 20)
    assert parts == 2
    held, fitted = ({r.tobytes() for r in seen[c]} for c in ("held", "fitted"))
    assert len(held) == 300 and len(fitted) == 1200 and not held & fitted and 1 <= probes <= parts


def test_repeated_query_rows_ask_once(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 9.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.9, 0.0]), (3, [0.8, 0.0]), (4, [0.7, 0.0]), (5, [0.6, 0.0])]
    got = grouped(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 4).collect())
    assert {q: [(r, i) for r, i, _ in found] for q, found in got.items()} == {0: [(r, r) for r in (1, 2, 3, 4)]}  # [0, 9] is the least vector
    assert [s for *_, s in got[0]] == [0.0] * 4


def test_probes_until_there_are_enough_candidates(spark, monkeypatch):
    """One part holds all but a few rows of another direction, which ask for more neighbours than their part has."""
    monkeypatch.setattr(ann, "PART_SAMPLE", 50)
    monkeypatch.setattr(ann, "calibrate", lambda *_: 1)
    draw = np.random.RandomState(1)
    rows = [(100 + i, [1.0 + x, x]) for i, x in enumerate(draw.randn(200) / 50)] + [(i, [-1.0 - i / 10, 0.0]) for i in range(5)]
    vectors = spark.createDataFrame([(int(i), [float(y) for y in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = grouped(ann.search(vectors, F.col("vec_id") < 5, 20).collect())
    assert got.keys() == set(range(5)) and all(len(found) == 20 for found in got.values())
