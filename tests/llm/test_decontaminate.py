from __future__ import annotations

import random
import re

import pytest

from backglot.llm import decontaminate as dc
from backglot.sources.tables import scan

SF = "/root/testdata/sf0.001"


def words(text):
    out = []
    for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower()):
        bare = re.sub(r"^[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]{0,4}|[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]{0,4}$", "", w)
        out.append(bare or w)
    return out


def distance(item, text):
    """Least edit distance of ``item`` to any stretch of ``text``, by the full table."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != v)))
        row = new
    return min(row)


def brute(docs, items, percent):
    out = []
    for d, t in docs:
        for i, x in items:
            item = words(x)
            if item and (n := distance(item, words(t))) <= len(item) * percent // 100:
                out.append((d, i, n, len(item)))
    return sorted(out)


def test_myers():
    draw = random.Random(8)
    for _ in range(500):
        item = [draw.randint(0, 4) for _ in range(draw.randint(1, 90))]
        text = [draw.randint(0, 4) for _ in range(draw.randint(0, 120))]
        assert dc.myers(item, text)[0] == distance(item, text)


@pytest.mark.parametrize("percent, block", [(15, 2_000_000), (30, 60), (0, 2_000_000)])
def test_edited_passages(spark, monkeypatch, percent, block):
    monkeypatch.setattr(dc, "BLOCK_WORDS", block)
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    some = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(draw.choice([1, 3, 7, 20, 45])))) for i in range(12)]
    docs = []
    for d in range(60):
        passage = draw.choice(items)[1].split()
        for _ in range(draw.randint(0, len(passage) // 4)):
            p = draw.randrange(len(passage) + 1)
            draw.choice([lambda: passage.insert(p, "new"), lambda: passage.__delitem__(slice(p, p + 1)), lambda: passage.__setitem__(slice(p, p + 1), ["x"])])()
        docs.append((d, "  ".join(some(draw.randint(0, 30)) + [f"({w.upper()}," for w in passage] + some(draw.randint(0, 30)))))
    got = dc.find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), percent)
    assert sorted(tuple(r)[:4] for r in got.collect()) == brute(docs, items, percent)


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in scan(spark, SF, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in scan(spark, SF, "benchmark").collect()]
    got = sorted(tuple(r)[:4] for r in dc.op8_decontaminate(spark, SF).collect())
    docs = [(d, t) for d, t in docs if len(t) < 3000]  # the full table takes long
    short = {d for d, _ in docs}
    assert [r for r in got if r[0] in short] == brute(docs, items, dc.PERCENT) and got


def test_odd_inputs(spark):
    docs = [(1, None), (2, ""), (3, "a b c"), (None, "x a, b! C y"), (3, "a b c"), (4, "q " * 30_000)]
    items = [(1, None), (2, ""), (3, "a b c"), (None, "A B c"), (3, "a b c")]
    given = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, item int, distance int")
    tests = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = sorted((tuple(r)[:4] for r in dc.find_items(given, tests).collect()), key=key)
    assert got == sorted([(d, i, 0, 3) for d in (3, 3, None) for i in (3, 3, None)], key=key)
    assert dc.find_items(given.limit(0), tests).collect() == [] == dc.find_items(given, tests.limit(0)).collect()
