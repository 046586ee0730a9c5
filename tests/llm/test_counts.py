from __future__ import annotations

import public_tokenizers
from tokenizers import Tokenizer

from backglot.llm.counts import VOCABULARY, count_tokens, op3_token_counts
from backglot.sources.tables import scan

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\n b", "a \n b", "\ta  b c ", "  x",
    "don't we'll I'M x's", "<|endoftext|>", "a<|endoftext|> b <|endoftext|><|endoftext|>", " <|endoftext|>  c",
    "日本語 テスト 🙂🙂  ok", "123 456  7", "x" * 5000, "word " * 3000, "\x1c\x1d a\x85b", "é ​ z", "!!  ?? ...\r\n\r\n",
]


def expected(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    return [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_odd_texts_and_clashing_columns(spark):
    rows = [(i, t, 7, "k") for i, t in enumerate(ODD)] + [(1, "a", 7, "k"), (None, "b c", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, key string")
    with open(public_tokenizers.path(VOCABULARY), encoding="utf-8") as file:
        got = count_tokens(docs, file.read(), limit=3).collect()
    texts = [r[1] for r in rows]
    want = [(r[0], len((r[1] or "").encode()), n, n > 3) for r, n in zip(rows, expected(texts))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    with open(public_tokenizers.path(VOCABULARY), encoding="utf-8") as file:
        assert count_tokens(docs, file.read()).collect() == []


def test_query(spark):
    given = {r["doc_id"]: r["text"] for r in scan(spark, SF, "documents").collect()}
    got = {r["doc_id"]: r for r in op3_token_counts(spark, SF).collect()}
    assert got.keys() == given.keys()
    for (k, t), n in zip(given.items(), expected(given.values())):
        assert tuple(got[k]) == (k, len(t.encode()), n, n > 512)
