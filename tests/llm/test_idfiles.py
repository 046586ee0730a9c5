from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from backglot.llm import idfiles
from backglot.llm.counts import VOCABULARY
from backglot.llm.units import split_units, unit_starts
from backglot.session import scratch_path
from backglot.sources.tables import scan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(VOCABULARY))


def expected(rows, library):
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query(spark, library):
    rows = [(r["doc_id"], r["text"]) for r in scan(spark, SF, "documents").collect()]
    assert sorted(map(tuple, idfiles.op4_id_files(spark, SF).collect())) == expected(rows, library)


def test_odd_inputs_and_small_segments(spark, library, monkeypatch):
    monkeypatch.setattr(idfiles, "SEGMENT_IDS", 16)
    texts = [None, "", " ", "a  b\n c ", "x" * 4000, "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "word " * 3000, "é🙂 日本"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "tie"), (3, "tie"), (None, "no key")]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, shard int, key string")
    with open(public_tokenizers.path(VOCABULARY), encoding="utf-8") as file:
        vocabulary = file.read()
    path = scratch_path(spark, "ids")
    idfiles.write_ids(docs, vocabulary, path)
    got = [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in idfiles.read_ids(spark, path).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected(rows, library)
    path = scratch_path(spark, "ids")
    idfiles.write_ids(docs.limit(0), vocabulary, path)
    assert idfiles.read_ids(spark, path).collect() == []


ODD = ["  two", "a  b  c 　d é ", " \x1cx \x85y", "end  ", "", " ", "  ", "a\n b \n\n c", " “quoted” — dash", "日本 語  z ​w"]


def test_units_are_cut_alike_in_bytes():
    texts = [*ODD, " ".join(ODD)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    units = [u.encode() for t in texts for u in split_units(t)]
    starts = unit_starts(data, at)
    assert list(starts) == list(np.cumsum([0, *map(len, units[:-1])]))


def test_units_reach_the_library_joined(library, monkeypatch):
    with open(public_tokenizers.path(VOCABULARY), encoding="utf-8") as file:
        encoder = idfiles.UnitEncoder(file.read())
    given = []

    class Counting:
        def encode_batch_fast(self, texts, add_special_tokens):
            given.extend(texts)
            return library.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    encoder.tokenizer = Counting()
    mark = "<|endoftext|>"
    texts = [" ".join(f"w{i * i}ä x\n{i}" for i in range(2000)), *ODD, f"a  {mark}  b {mark}{mark} c", f"{mark} ", "x" * 500 + " " + "y" * 500]
    for slice_bytes in (1 << 21, 64):
        monkeypatch.setattr(idfiles, "SLICE", slice_bytes)
        parts = list(encoder.encode(pa.array(texts)))
        ids, sizes = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
        assert np.array_equal(ids, [i for t in texts for i in library.encode(t, add_special_tokens=False).ids])
        assert list(sizes) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(given) < 2 * 4000 / 16  # one text per unit before
