"""Hashed text features and linear scoring, shared by the toxicity and the quality classifier."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backglot.llm.arrow import mix, text_bytes, text_slices, word_hashes, word_spans
from backglot.session import ship_package

BITS = 20  # 2**BITS hashed features
_U = np.uint64
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CLASS = np.arange(256, dtype=np.uint8)  # letters by case, digits, other bytes as they are
_CLASS[97:123] = _CLASS[128:256] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48

#: What a feature function returns for one slice: the text's number and the feature's number, with repeats.
Features = tuple[np.ndarray, np.ndarray]


def _index(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (mix(hashes + _U(kind * 0x9E3779B97F4A7C15 % (1 << 64))) >> _U(64 - BITS)).astype(np.int64)


def bare_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Spans without up to ``most`` signs at either side."""
    starts, ends = starts.copy(), ends.copy()
    for _ in range(most):
        cut = (ends - starts > 1) & ~_LETTER[data[ends - 1]]
        ends[cut] -= 1
        cut = (ends - starts > 1) & ~_LETTER[data[starts]]
        starts[cut] += 1
    return starts, ends


def word_features(column: pa.Array, prefixes: tuple[int, ...] = (4, 5, 6)) -> Features:
    """Lower-case words without signs around them, and their first bytes."""
    data, at = text_bytes(pc.utf8_lower(column))
    starts, ends, first = word_spans(data, at)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(first))
    starts, ends = bare_spans(data, starts, ends)
    owners, found = [owner], [_index(word_hashes(data, starts, ends, True), 1)]
    for k in prefixes:
        longer = np.flatnonzero(ends - starts > k)
        owners.append(owner[longer])
        found.append(_index(word_hashes(data, starts[longer], starts[longer] + k, True), 10 + k))
    return np.concatenate(owners), np.concatenate(found)


def ngram_features(column: pa.Array) -> Features:
    """Words, shapes of words, and pairs of either; a word that repeats one of the two before it has its own marks."""
    data, at = text_bytes(column)
    starts, ends, first = word_spans(data, at)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(first))
    words = word_hashes(data, *bare_spans(data, starts, ends), True)
    classes = _CLASS[data]
    tail = word_hashes(classes, np.maximum(starts, ends - 3), ends, False)
    head = word_hashes(classes, starts, np.minimum(ends, starts + 2), False)
    shapes = mix(tail * _U(3) + head)
    owners, found = [owner, owner], [_index(words, 1), _index(shapes, 2)]
    for step, kinds in ((1, (3, 4, 5)), (2, (None, None, 6))):
        if len(owner) <= step:
            continue
        same = owner[step:] == owner[:-step]
        for kind, values in zip(kinds, (words, shapes)):
            if kind:
                owners.append(owner[step:][same])
                found.append(_index(mix(values[:-step] * _U(5) + values[step:])[same], kind))
        again = same & (words[step:] == words[:-step])
        owners.append(owner[step:][again])
        found.append(np.full(int(again.sum()), _index(np.zeros(1, _U), kinds[2])[0]))
    return np.concatenate(owners), np.concatenate(found)


def distinct(features: Features, keep: np.ndarray | None = None) -> Features:
    """Indicators: each feature once per text, those of ``keep`` only."""
    owner, found = features
    if keep is not None:
        wanted = keep[found]
        owner, found = owner[wanted], found[wanted]
    both = np.unique(owner.astype(np.int64) << BITS | found)
    return both >> BITS, both & ((1 << BITS) - 1)


class Rows:
    """Sparse indicator rows: the features ``found`` of all rows, and where each row's begin."""

    CHUNK = 1 << 22  # entries summed at once

    def __init__(self, found: np.ndarray, at: np.ndarray):
        self.found, self.at, self.n = found, at, len(at) - 1
        self.owner = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(at))

    def counts(self, weight: np.ndarray) -> np.ndarray:
        """Per feature, the summed weight of the rows that have it."""
        total = np.zeros(1 << BITS)
        for i in range(0, len(self.found), self.CHUNK):
            part = slice(i, i + self.CHUNK)
            total += np.bincount(self.found[part], weight[self.owner[part]], 1 << BITS)
        return total

    def only(self, keep: np.ndarray) -> Rows:
        mask = keep[self.found]
        return Rows(self.found[mask], np.concatenate([[0], np.cumsum(mask)])[self.at])

    def dot(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weight[self.found], self.n)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int, features: Callable[[pa.Array], Features]
) -> tuple[Rows, np.ndarray]:
    """Features and labels of at most ``rows`` labelled documents, the least by a hash of their id.

    ``usable`` is a condition on ``doc_id`` of the labels. Of repeated labels of a document the largest counts, of
    repeated documents the text with the least hash. Only ids travel as a broadcast, at most ``rows``, and only feature
    numbers of one row per id reach the driver.
    """
    ship_package(docs.sparkSession)
    known = labels.where(usable & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                owner, found = distinct(features(part.column("text")))
                ends = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(found.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), lists], ["doc_id", "label", "found"])

    kind = dict(texts.dtypes)
    got = texts.mapInArrow(work, f"doc_id {kind['doc_id']}, label {kind['label']}, found array<int>").toArrow()
    got = got.sort_by("doc_id").combine_chunks()
    if not len(got):
        return Rows(np.zeros(0, np.int32), np.zeros(1, np.int64)), np.zeros(0)
    lists = got.column("found").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    at = lists.offsets.to_numpy().astype(np.int64)
    found = lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
    sample = Rows(found, at - at[0])
    # Both models look only at features that several rows have; the others are most of the memory.
    every = np.bincount(found, minlength=1 << BITS)
    return sample.only(every >= 3), np.array(got.column("label").to_pylist(), float)


def apply_scores(
    docs: DataFrame, features: Callable[[pa.Array], Features], score: Callable[[int, np.ndarray, np.ndarray, dict], np.ndarray], model: dict
) -> DataFrame:
    """``docs`` with ``score``: a function of the number of texts, the indicators of ``model['keep']``, and the model.

    A column of that name is replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("score")
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                owner, found = distinct(features(part.column("text")), shared.value["keep"])
                scores = score(part.num_rows, owner, found, shared.value)
                keep = [n for n in part.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in keep), pa.array(scores, pa.float64())], [*keep, "score"])

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes if n != "text")
    return docs.mapInArrow(work, f"{schema}, score double")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
