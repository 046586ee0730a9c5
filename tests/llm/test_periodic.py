"""Periodic runs against a comparison of all lags, and the query's digests against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from backglot.llm import periodic
from backglot.llm.arrow import mix
from backglot.sources.tables import scan

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(words: list) -> list[tuple[int, int, int]]:
    """Every lag, every maximal stretch; the smallest period of equal stretches stays."""
    best = {}
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                best.setdefault((i - q, j), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def found_runs(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    first = np.cumsum([0] + [len(t) for t in texts])
    words = mix(np.array([w for t in texts for w in t], np.uint64) + np.uint64(7))
    out = [[] for _ in texts]
    for start, length, period in periodic.find_runs(words, first).tolist():
        of = int(np.searchsorted(first, start, side="right")) - 1
        out[of].append((start - int(first[of]), length, period))
    return out


def nested(draw: random.Random, depth: int) -> list[int]:
    if depth == 0:
        return [draw.randrange(3) for _ in range(draw.randint(1, 3))]
    part = nested(draw, depth - 1) * draw.randint(1, 6) + [draw.randrange(3) for _ in range(draw.randint(0, 2))]
    return part * draw.randint(1, 5)


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_all_lags(seed):
    draw = random.Random(seed)
    texts = [[], [1], [1] * 5, [1] * 6, [1] * 400]
    for _ in range(60):
        texts.append([draw.randrange(draw.choice([1, 2, 3, 50])) for _ in range(draw.randint(0, 80))])
        texts.append(nested(draw, draw.randint(1, 3))[:900])
        noise = nested(draw, 2)[:300]
        for _ in range(draw.randint(0, 3)):
            noise.insert(draw.randrange(len(noise) + 1), draw.randrange(4))
        texts.append(noise)
    assert found_runs(texts) == [all_runs(t) for t in texts]


def test_occurrences_nearer_than_the_scale_only():
    """Grams of two words that come again one word later give no diagonal of a lag of two or three."""
    assert found_runs([[1, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14]]) == [[]]


def test_long_texts_of_one_word_and_of_one_long_period():
    block = [i * i % 9973 for i in range(9000)]
    assert found_runs([[5] * 300_000, block * 4, block * 3]) == [[(0, 300_000, 1)], [(0, 36_000, 9000)], []]
    ladder = ([1] * 10 + [2]) * 20_000
    got = found_runs([ladder])[0]
    assert (0, 220_000, 11) in got and len(got) == 20_001


def expected(doc_id, text) -> dict:
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = all_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    return {
        "doc_id": doc_id,
        "n_runs": len(runs),
        "start": best[0],
        "length": best[1],
        "period": best[2],
        "exponent_milli": best[1] and 1000 * best[1] // best[2],
        "runs_sha256": hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    }


def test_query_equals_brute_force(spark):
    got = sorted((r.asDict() for r in periodic.op12_periodic_runs(spark, FOLDER).collect()), key=lambda r: r["doc_id"])
    given = scan(spark, FOLDER, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    assert got == [expected(r["doc_id"], r["text"]) for r in given]
    assert sum(r["n_runs"] for r in got) > 5


def test_odd_inputs(spark):
    planted = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(None, "a a a a a a"), (planted, None), (planted, "  "), (planted, "x y z\tw v\x0bu"), (3, "b c " * 40_000), (3, "b c " * 40_000), (4, "")]
    df = spark.createDataFrame([(*r, "clash", [1]) for r in rows], "doc_id long, text string, collapsed string, runs array<int>")
    text = periodic.plant_period(F.col("text"), F.col("doc_id"))
    df = df.select("doc_id", text.alias("text"), "collapsed", "runs")
    got = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.collapse_runs(df).collect()), key=str)
    want = []
    for doc_id, given in rows:
        words = WORD.findall(given or "")
        if doc_id == 3:
            want.append((3, [(0, 80_000, 2)], "b c"))
        elif doc_id is None:
            want.append((None, [(0, 6, 1)], "a"))
        elif not words:
            want.append((doc_id, [], ""))
        else:
            n, g = len(words), zlib.crc32(str(doc_id).encode()) // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            spun = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            gone = {i for s, length, q in all_runs(spun) for i in range(s + q, s + length)}
            want.append((doc_id, all_runs(spun), " ".join(w for i, w in enumerate(spun) if i not in gone)))
    assert got == sorted(want, key=str)
    assert periodic.collapse_runs(df.limit(0)).collect() == []
