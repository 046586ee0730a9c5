"""Benchmark decontamination by pigeonhole edit matching over words.

Words are lower-case runs between white space, without up to four signs at either side. A test item of ``n`` words may
differ from a passage by ``n * PERCENT / 100`` word edits (rounded down): its error budget ``e``. It is split into
``e + 1`` pieces; a passage within the budget holds one of them exactly. So a document's words are scanned for the
first words of pieces (a bitmap, then a sorted table), hits are compared with the whole piece, and the stretch of words
around a hit is verified with Myers' bit-parallel edit distance.

Items are handled in blocks of bounded size, so a test set of any size is matched completely; documents are never
shuffled, and a passage that very many documents hold costs each of them its own verification only.

Defined results for odd inputs: null and empty texts and items have no words and match nothing; an item of so few words
that its budget is 0 matches exact passages only; repeated rows give repeated results, for items and documents alike;
null ids are reported as null; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backglot.llm.arrow import text_bytes, text_slices, window_hashes, word_hashes, word_spans
from backglot.llm.linear import bare_spans
from backglot.session import ship_package
from backglot.sources.tables import scan

PERCENT = 15  # word edits allowed, of an item's words
SEED = 4  # first words of a piece that are looked up
BLOCK_WORDS = 2_000_000  # words of the items matched in one scan of the documents
TABLE_BITS = 22
_U = np.uint64


def plain_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words start."""
    data, at = text_bytes(pc.utf8_lower(pc.fill_null(column, "")))
    starts, ends, first = word_spans(data, at)
    return word_hashes(data, *bare_spans(data, starts, ends), True), first


def pieces(n: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Word ranges of the error-budget-plus-one pieces of an item of ``n`` words."""
    count = n * percent // 100 + 1
    edges = [i * n // count for i in range(count + 1)]
    return list(zip(edges, edges[1:]))


def myers(item: list[int], passage: list[int]) -> tuple[int, int]:
    """Least edit distance of ``item`` to any stretch of ``passage``, and where the first best stretch ends."""
    m = len(item)
    match: dict[int, int] = {}
    for i, w in enumerate(item):
        match[w] = match.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(passage):
        eq = match.get(w, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(across | plus))
        down = plus & across
        score += (1 if up & top else 0) - (1 if down & top else 0)
        up = up << 1 & full
        down = down << 1 & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


class Items:
    """The test items of one block, indexed by the first words of their pieces."""

    def __init__(self, ids: list, texts: pa.Array, percent: int):
        words, first = plain_words(texts)
        self.ids, self.percent = ids, percent
        self.words = [words[a:b] for a, b in zip(first, first[1:])]
        found: dict[int, list[tuple[int, int, int]]] = {}
        for i, own in enumerate(self.words):
            for a, b in pieces(len(own), percent):
                if b > a:
                    found.setdefault(min(SEED, b - a), []).append((i, a, b))
        self.seeds = {}
        for q, rows in found.items():
            at = np.array([0, q])
            keys = np.array([window_hashes(self.words[i][a : a + q], at, q)[0][0] for i, a, _ in rows])
            order = np.argsort(keys, kind="stable")
            table = np.zeros(1 << TABLE_BITS, bool)
            table[(keys >> _U(64 - TABLE_BITS)).astype(np.int64)] = True
            self.seeds[q] = keys[order], np.array(rows)[order], table

    def hits(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """``(text, item, place)`` of every whole piece found; ``place`` is where the item's first word would be."""
        for q, (keys, rows, table) in self.seeds.items():
            hashes, valid = window_hashes(words, first, q)
            place = np.flatnonzero(valid & table[(hashes >> _U(64 - TABLE_BITS)).astype(np.int64)])
            low, high = np.searchsorted(keys, hashes[place], "left"), np.searchsorted(keys, hashes[place], "right")
            text = np.searchsorted(first, place, "right") - 1
            for p, t, a, b in zip(place[high > low].tolist(), text[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                for i, start, stop in rows[a:b].tolist():
                    end = p + stop - start
                    if end <= first[t + 1] and np.array_equal(words[p:end], self.words[i][start:stop]):
                        yield t, i, p - start

    def matches(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """``(text, item, distance, end)`` of every item found in a text, with the first of its best stretches."""
        places: dict[tuple[int, int], set[int]] = {}
        for t, i, place in self.hits(words, first):
            places.setdefault((t, i), set()).add(place)
        for (t, i), found in places.items():
            item = self.words[i]
            n, budget = len(item), len(item) * self.percent // 100
            spare = 2 * budget
            stretches: list[list[int]] = []
            for place in sorted(found):
                a, b = max(int(first[t]), place - spare), min(int(first[t + 1]), place + n + spare)
                if stretches and a <= stretches[-1][1]:
                    stretches[-1][1] = max(b, stretches[-1][1])
                else:
                    stretches.append([a, b])
            best = None
            for a, b in stretches:
                distance, end = myers(item.tolist(), words[a:b].tolist())
                if distance <= budget and (best is None or distance < best[0]):
                    best = distance, a + end - int(first[t])
            if best:
                yield t, i, *best


def item_blocks(items: DataFrame, key: str, text: str) -> Iterator[tuple[list, pa.Array]]:
    """The items with words, in blocks of about ``BLOCK_WORDS``; one block at a time reaches the driver."""
    given = items.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL")
    size = given.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()[0]
    count = -(-size // BLOCK_WORDS)
    block = F.pmod(F.xxhash64("id", "text"), F.lit(max(1, count)))
    for b in range(count):
        got = given.where(block == b).toArrow().combine_chunks()
        yield got.column("id").to_pylist(), pa.concat_arrays(got.column("text").chunks) if len(got) else pa.array([], pa.string())


def find_items(
    docs: DataFrame, items: DataFrame, percent: int = PERCENT, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``(key, item_key, distance, n_words, end_word)`` of every item within its error budget of a stretch of a document."""
    spark = docs.sparkSession
    ship_package(spark)
    given = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    kind, item_kind = dict(given.dtypes)["doc"], dict(items.dtypes)[item_key]
    schema = f"doc {kind}, item {item_kind}, distance int, n_words int, end_word int"
    found = None
    for ids, texts in item_blocks(items, item_key, item_text):
        shared = spark.sparkContext.broadcast(Items(ids, texts, percent))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = shared.value
            for batch in batches:
                for part in text_slices(batch):
                    rows = list(held.matches(*plain_words(part.column("text"))))
                    if rows:
                        owner, item, distance, end = (list(c) for c in zip(*rows))
                        yield pa.RecordBatch.from_arrays(
                            [
                                part.column("doc").take(pa.array(owner)),
                                pa.array([held.ids[i] for i in item], arrow_kind),
                                pa.array(distance, pa.int32()),
                                pa.array([len(held.words[i]) for i in item], pa.int32()),
                                pa.array(end, pa.int32()),
                            ],
                            ["doc", "item", "distance", "n_words", "end_word"],
                        )

        arrow_kind = _arrow_kind(ids)
        part = given.mapInArrow(work, schema)
        found = part if found is None else found.union(part)
    found = spark.createDataFrame([], schema) if found is None else found
    return found.withColumnsRenamed({"doc": key, "item": item_key})


def _arrow_kind(ids: list) -> pa.DataType:
    kind = pa.array(ids).type
    return pa.int64() if pa.types.is_null(kind) else kind


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return find_items(scan(spark, folder, "documents"), scan(spark, folder, "benchmark"))
