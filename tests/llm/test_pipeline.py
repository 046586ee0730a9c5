from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from backglot.llm import bpe
from backglot.sources.tables import hand_over, scan
from tests.llm import test_decontaminate, test_neardup, test_substrings

SF = "/root/testdata/sf0.001"
FIELDS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage."""
    docs, out = scan(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = hand_over(stage(spark, docs, SF), name)
        out[name] = docs.collect(), after.collect()
        docs = after
    return out


def test_only_toxic_documents_go(stages, spark):
    before, after = stages["toxicity"]
    labels = {r["doc_id"]: r["toxic"] for r in scan(spark, SF, "labels").collect()}
    kept = {r["doc_id"]: r for r in after}
    assert all(kept[r["doc_id"]] == r for r in before if r["doc_id"] in kept) and len(kept) < len(before)
    clean = [r for r in before if labels.get(r["doc_id"]) == 0]
    assert sum(r["doc_id"] in kept for r in clean) >= 0.98 * len(clean)


def test_one_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    want = test_neardup.brute([(r["doc_id"], r["text"]) for r in before], 5)
    assert sorted(r["doc_id"] for r in after) == sorted(k for k, (_, c) in want.items() if k == c)


def test_repeats_are_cut(stages):
    before, after = stages["substrings"]
    want = {r[0]: r for r in test_substrings.brute([(r["doc_id"], r["text"]) for r in before], 13)}
    given = {r["doc_id"]: r for r in before}
    assert len(after) == len(before)
    for r in after:
        if want[r["doc_id"]][2]:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == want[r["doc_id"]][3] and r["n_chars"] == len(r["text"])
        else:
            assert r == given[r["doc_id"]]


def test_contaminated_documents_go(stages, spark):
    before, after = stages["decontamination"]
    items = [(r["item_id"], r["text"]) for r in scan(spark, SF, "benchmark").collect()]
    short = [(r["doc_id"], r["text"]) for r in before if len(r["text"]) < 3000]
    bad = {d for d, *_ in test_decontaminate.brute(short, items, 15)}
    kept = {r["doc_id"] for r in after}
    assert all((d in kept) == (d not in bad) for d, _ in short)


def test_encoded(stages):
    before, after = stages["byte_bpe"]
    ranks = {p: i for i, p in enumerate(bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in before}
    assert len(after) == len(before)
    for r in after:
        assert r["ids"] == library.encode_ordinary(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_columns_and_run(stages, spark):
    for name, (before, after) in stages.items():
        assert list(before[0].asDict()) == FIELDS and (name == "byte_bpe" or list(after[0].asDict()) == FIELDS)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages["byte_bpe"][1]))


def test_nulls(spark):
    rows = [(1, None, "en", None, None), (None, "a b", None, "s", 3), (2, "", None, None, 0), (3, "ok " * 20, "en", "s", 60)]
    docs = spark.createDataFrame(rows, scan(spark, SF, "documents").schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert sorted(map(str, docs.collect())) == sorted(map(str, spark.createDataFrame(rows, docs.schema).collect()))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 4


def test_empty_table(spark):
    docs = spark.createDataFrame([], scan(spark, SF, "documents").schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == FIELDS and docs.collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect() == []


def test_repeated_rows_long_texts_and_clashing_columns(spark):
    """Repeated rows stay beside each other; other columns pass through, whatever their names."""
    words = " ".join(f"w{i * 7919 % 50_021}" for i in range(40_000))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, words, "en", "s", len(words)), (2, passage, "en", "s", len(passage)), (2, passage, "en", "s", len(passage)), (3, "x " * 30_000, None, None, 60_000)]
    schema = scan(spark, SF, "documents").schema
    plain = spark.createDataFrame(rows, schema)
    names = ["row", "score", "doc", "begins", "version", "component_id", "label", "ids", "found"]
    from pyspark.sql import functions as F

    docs = plain.withColumns({n: F.lit(n) for n in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == FIELDS + names
        assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == sorted((r[0], r[1]) for r in rows)
        assert all(r[n] == n for r in docs.collect() for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 4
