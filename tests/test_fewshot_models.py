"""The way back of every model starts from that model's own stage-2 rows: a case written by hand, and counts."""

from __future__ import annotations

import hashlib
from collections import Counter

from backglot.operators import fewshot as fs
from backglot.plans import fewshot_queries as fq

SF = "/root/testdata/sf0.001"


def test_two_models_with_different_answers(spark, tmp_path):
    """Document 1 is asked of both models: "uno" answers the first, "dos" the second, whatever the size."""
    tables = {
        "documents": ("doc_id long, text string, source string", [(1, "one", "s"), (2, None, "s")]),
        "benchmark": ("item_id long, text string", [(1, "zeta")]),
        "conversations": ("conv_id long, turn long, role string, text string", [(1, 0, "user", "uno"), (1, 1, "assistant", "dos")]),
    }
    for name, (kinds, rows) in tables.items():
        spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = fq.stage2_backward(spark, str(tmp_path)).where("doc_id = 1").collect()
    got = sorted((r["chunk_size"], r["model"], r["partial_back"], r["back"], r["status"]) for r in rows)
    assert got == [(k, m, t, t, "answered") for k in (0, 1) for m, t in (("first", "uno"), ("second", "dos"))]


def test_every_model_goes_back_as_often(spark):
    counts = Counter(r["model"] for r in fq.stage2_backward(spark, SF).collect())
    assert counts["first"] == counts["second"] == 200 * 5  # documents, sizes


def test_manifest_digests_whole_prompts(spark, tmp_path):
    """Two documents with one text and model are one request; its id is the digest of the prompt that is sent."""
    tables = {
        "documents": ("doc_id long, text string, source string", [(1, "one", "s"), (2, "one", "s"), (3, None, "s"), (4, "one", "t")]),
        "benchmark": ("item_id long, text string", [(1, "zeta")]),
    }
    for name, (kinds, rows) in tables.items():
        spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/{name}.parquet")
    shot = f"\nExample 1:\nOriginal code:\nzeta\nComplete translation:\natez\n{fs.EXAMPLE_RULE}\n"
    want = set()
    for size, examples in ((0, ""), (1, shot)):
        prompt = fs.PROMPT_TEMPLATE.format(source="English", target="Spanish", examples=examples, code="one")
        digest = hashlib.sha256(prompt.encode()).hexdigest()
        want |= {("s", size, digest, 2, 1), ("t", size, digest, 1, 4), ("s", size, None, 1, 3)}
    assert {tuple(r) for r in fq.request_manifest(spark, str(tmp_path)).collect()} == want


def test_texts_stay_out_of_the_answer_join_and_equal_outputs_go_back_once(spark, tmp_path, monkeypatch):
    tables = {
        "documents": ("doc_id long, text string, source string", [(1, "one", "s"), (2, None, "s"), (2, "two", "s")]),
        "benchmark": ("item_id long, text string", [(1, "zeta")]),
        "conversations": ("conv_id long, turn long, role string, text string", [(1, 0, "user", "uno")]),
    }
    for name, (kinds, rows) in tables.items():
        spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/{name}.parquet")
    joined, taken_back = [], []
    join, substitute = fs.lookup_join, fq.substitute_documents
    monkeypatch.setattr(fs, "lookup_join", lambda facts, *rest: joined.append(facts.columns) or join(facts, *rest))
    monkeypatch.setattr(fq, "substitute_documents", lambda df, key, text, *rest: taken_back.append((text, df.count())) or substitute(df, key, text, *rest))
    rows = fq.stage2_backward(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["partial_back"], r["status"]) for r in rows) == {
        (1, "uno", "answered"): 2, (1, "one", "missing"): 2, (2, None, "missing"): 4, (2, "two", "missing"): 4,
    }
    assert len(joined) == 2 and not any({"text", "partial", "partial_back"} & set(columns) for columns in joined)
    assert taken_back == [("text", 3), ("translated", 4)]
