from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from backglot.llm import bpe
from backglot.sources.tables import scan

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  ", "\n", "a", "a  b", "a\n b \t", "don't we'll x's", "<|endoftext|> x", "日本語 テスト 🙂🙂 ok",
    "123 456  7", "x" * 3000, "ab" * 400 + " cd", "é ​ z", "!!??...\r\n\r\n", "nonsenseword " * 500, "\x1c\x1d a\x85b",
]


@pytest.fixture(scope="module")
def pieces():
    return bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def library(pieces):
    ranks = {p: i for i, p in enumerate(pieces)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_odd_texts_and_round_trip(spark, pieces, library):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] + [(0, "again", 1)], "doc_id int, text string, ids int")
    got = sorted((r["doc_id"], r["ids"]) for r in bpe.encode(docs, pieces).collect())
    want = sorted([(i, library.encode_ordinary(t or "")) for i, t in enumerate(ODD)] + [(0, library.encode_ordinary("again"))])
    assert got == want
    for i, ids in got:
        if i:
            assert bpe.decode(ids, pieces).decode() == (ODD[i] or "")


def test_empty_table(spark, pieces):
    assert bpe.encode_digests(spark.createDataFrame([], "doc_id long, text string"), pieces).collect() == []


def test_long_words_merge_alike(pieces, library):
    ranks = {p: i for i, p in enumerate(pieces)}
    draw = random.Random(5)
    for _ in range(200):
        word = "".join(draw.choice("abcdeéß🙂th") for _ in range(draw.randint(1, 300)))
        assert bpe.heap_merges(word.encode(), ranks) == library._encode_single_piece(word)


def test_query(spark, pieces, library):
    given = {r["doc_id"]: r["text"] for r in scan(spark, SF, "documents").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = bpe.op2_byte_bpe(spark, SF).collect()
    assert len(rows) == len(given)
    for r in rows:
        ids = library.encode_ordinary(given[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids)).encode()))
        assert r["decoded_sha256"] == sha(given[r["doc_id"]].encode())


def test_more_pieces_than_a_cell_holds_raise(spark):
    with pytest.raises(ValueError, match="65,536"):
        bpe.PairRanks(spark, [i.to_bytes(3, "big") for i in range(65_537)])


def test_words_merge_side_by_side_as_alone(spark, pieces, library):
    """Words of all lengths at once, among them some that hold several pairs of one rank."""
    draw = random.Random(6)
    words = [bytes(draw.choices(b"abcdeth\xc3\xa9\xf0\x9f", k=draw.randint(2, bpe.LONG_WORD))) for _ in range(500)]
    words += [b"ab" * 20, b"a" * 40, b"th" * 8, b"\xff\xfe"]
    ranks = {p: i for i, p in enumerate(pieces)}
    words = [w for w in words if w not in ranks]
    table = bpe.PairRanks(spark, pieces).table.value
    got = bpe.merge_words([[ranks[bytes([b])] for b in w] for w in words], table)
    assert [memoryview(x).cast("i").tolist() for x in got] == [library._encode_single_piece(w) for w in words]
    assert bpe.merge_words([], table) == []
