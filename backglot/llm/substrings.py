"""Substring deduplication by suffix automata of reference shards.

A word goes when a window of ``span`` words that covers it also occurs in a document with a smaller id. An automaton
of the whole corpus fits nowhere, and streaming all documents past one automaton per shard of all documents would
be quadratic, so shards are dealt by content:

* Every window has an anchor, the least hash of the ``GRAM``-word runs inside it. Equal windows have equal anchors, so
  whatever can match lies in one shard. Consecutive windows with one anchor form one segment of words.
* Anchors that occur in one document only cannot match. Two-document anchors are found by a pre-aggregated count and
  kept as a bitmap of fixed size, which is broadcast; a false hit costs a segment, never a result.
* Distinct segments with the least document of each (pre-aggregated, so a passage of a third of all documents is one
  row) are dealt by anchor. A task streams its shards: it builds the suffix automaton of a shard's segments, where every
  state knows the least document it occurs in, and runs each segment through it for its matching statistics.
* An anchor whose distinct segments hold very many words (a common phrase among ever different words) would make a large
  shard. Their windows are compared by a 128-bit digest instead, one pre-aggregated minimum for all. A long run of one
  anchor is cut into overlapping segments. So a task's automaton is bounded in words.

The result, the least document of each window of a distinct segment, meets the documents' segments by digest, and the
documents' texts move once, to meet the windows to cut. Words are compared by 48 of their hash's bits beside the anchor.

Defined results for odd inputs: null and empty texts have no words; the digest of no words is that of the empty
string; rows of one ``doc_id`` never remove each other's words, and each loses its own, whether their texts are equal or not; a null ``doc_id`` neither removes nor loses words;
an empty table gives an empty result; other columns are kept as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from backglot.llm.arrow import mix, ragged, text_bytes, text_slices, window_hashes, word_hashes, word_spans
from backglot.session import ship_package
from backglot.sources.tables import Scratch, scan

GRAM = 4  # words of an anchor
BITMAP_BITS = 28  # 2**28 bits: 32 MB, whatever the corpus
CROWDED = 160_000  # words of an anchor's distinct segments above which their windows are compared by digest
SEGMENT_WINDOWS = 4_096  # windows of a segment at most; a longer run of one anchor is several segments
SHARD_WORDS = 4_000  # words of a task's current automaton
WORD_BYTES = 6
_U = np.uint64


def _anchored(column: pa.Array, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, where texts start, and for each window (by its first word) its anchor and whether it is one."""
    data, at = text_bytes(column)
    starts, ends, first = word_spans(data, at)
    words = word_hashes(data, starts, ends, lower=False)
    gram = min(GRAM, span)
    grams, _ = window_hashes(words, first, gram)
    n = len(words) - span + 1
    if n <= 0:
        return words, first, np.zeros(0, _U), np.zeros(0, bool)
    least = grams[:n].copy()
    for k in range(1, span - gram + 1):
        np.minimum(least, grams[k : n + k], out=least)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return words, first, mix(least), text[:n] == text[span - 1 :]  # least hashes crowd near zero


def _runs(anchors: np.ndarray, valid: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of every run of windows of one text with one anchor, long runs in pieces.

    Pieces of a run share ``span - 1`` words, so each window lies in one.
    """
    place = np.flatnonzero(valid)
    if not len(place):
        return place, place
    new = np.ones(len(place), bool)
    new[1:] = (anchors[place[1:]] != anchors[place[:-1]]) | (text[place[1:]] != text[place[:-1]]) | (np.diff(place) > 1)
    heads = np.flatnonzero(new)
    since = np.arange(len(place)) - np.repeat(heads, np.diff(np.append(heads, len(place))))
    heads = np.flatnonzero(since % SEGMENT_WINDOWS == 0)
    tails = np.append(heads[1:], len(place)) - 1
    return place[heads], place[tails]


def _owners(first: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]


def anchor_batches(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """``(doc, anchors)``: the distinct anchors of every text."""
    for batch in batches:
        for part in text_slices(batch):
            _, first, anchors, valid = _anchored(part.column("text"), span)
            heads, _ = _runs(anchors, valid, _owners(first, len(anchors)))
            owner = _owners(first, len(anchors))[heads]
            keys = anchors[heads]
            order = np.lexsort((keys, owner))
            owner, keys = owner[order], keys[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
            counts = np.bincount(owner[new], minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("doc"), ragged(keys[new].view(np.int64), counts, pa.int64())], ["doc", "anchors"])


def bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """Set of 64-bit ``key`` as ``2**bits`` bits; at most ``2**(bits - 6)`` rows reach the driver, whatever the input."""
    at = F.shiftrightunsigned("key", 64 - bits)
    one = F.expr("shiftleft(1L, CAST(at & 63 AS INT))")
    parts = keys.select(at.alias("at")).select(F.shiftright("at", 6).alias("word"), one.alias("bit"))
    got = parts.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 6), _U)
    out[got.column("word").to_numpy()] = got.column("bit").to_numpy().view(_U)
    return out


def in_bitmap(values: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    at = values >> _U(64 - bits)
    return (table[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1) > 0


def _segments(batches: Iterator[pa.RecordBatch], span: int, shared) -> Iterator[tuple]:
    """Per slice: the slice and, per segment whose anchor may repeat, its row there, anchor, place in the text, and words."""
    for batch in batches:
        for part in text_slices(batch):
            words, first, anchors, valid = _anchored(part.column("text"), span)
            if not len(anchors):
                continue
            valid &= in_bitmap(anchors, shared.value, BITMAP_BITS)
            owner = _owners(first, len(anchors))
            heads, tails = _runs(anchors, valid, owner)
            raw = np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]
            texts = [raw[a : b + span].tobytes() for a, b in zip(heads, tails)]
            doc = owner[heads]
            yield part, pa.array(doc), anchors[heads], (heads - first[doc]).astype(np.int32), texts


def _digests(texts: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=16).digest() for t in texts), np.int64).reshape(-1, 2)
    return pa.array(both[:, 0]), pa.array(both[:, 1])


def place_batches(batches: Iterator[pa.RecordBatch], span: int, shared) -> Iterator[pa.RecordBatch]:
    """``(doc, version, start, d1, d2)``: where segments lie, and their digest."""
    for part, row, _, start, texts in _segments(batches, span, shared):
        own = [part.column(c).take(row) for c in ("doc", "version")]
        yield pa.RecordBatch.from_arrays([*own, pa.array(start), *_digests(texts)], ["doc", "version", "start", "d1", "d2"])


def segment_batches(batches: Iterator[pa.RecordBatch], span: int, shared) -> Iterator[pa.RecordBatch]:
    """``(doc, key, words)``: segments by anchor."""
    for part, row, anchors, _, texts in _segments(batches, span, shared):
        yield pa.RecordBatch.from_arrays([part.column("doc").take(row), pa.array(anchors.view(np.int64)), pa.array(texts, pa.binary())], ["doc", "key", "words"])


def window_batches(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """``(d1, d2, at, w1, w2, least, most)``: the windows of segments, by digest."""
    for batch in batches:
        rows: list[tuple] = []
        for words, least, most in zip(*(batch.column(c).to_pylist() for c in ("words", "least", "most"))):
            d1, d2 = np.frombuffer(hashlib.blake2b(words, digest_size=16).digest(), np.int64).tolist()
            for at in range(len(words) // WORD_BYTES - span + 1):
                window = hashlib.blake2b(words[at * WORD_BYTES : (at + span) * WORD_BYTES], digest_size=16).digest()
                rows.append((d1, d2, at, *np.frombuffer(window, np.int64).tolist(), least, most))
        kind = batch.schema.field("least").type
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), kind, kind]
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["d1", "d2", "at", "w1", "w2", "least", "most"])


class SuffixAutomaton:
    """Of several word sequences; every state knows the least document that holds its words."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.least: list = [None]

    def _state(self, length: int, moves: dict, link: int, least) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.least.append(least)
        return len(self.next) - 1

    def _split(self, at: int, word: int) -> int:
        """The state of ``at``'s words and ``word``, split off from a longer one where need be."""
        to = self.next[at][word]
        if self.length[to] == self.length[at] + 1:
            return to
        clone = self._state(self.length[at] + 1, dict(self.next[to]), self.link[to], self.least[to])
        self.link[to] = clone
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = clone
            at = self.link[at]
        return clone

    def add(self, words: list[int], doc) -> None:
        last = 0
        for word in words:
            if word in self.next[last]:
                last = self._split(last, word)
            else:
                new = self._state(self.length[last] + 1, {}, 0, doc)
                at = last
                while at >= 0 and word not in self.next[at]:
                    self.next[at][word] = new
                    at = self.link[at]
                if at >= 0:
                    self.link[new] = self._split(at, word)
                last = new
            if self.least[last] is None or doc < self.least[last]:
                self.least[last] = doc

    def settle(self) -> None:
        """Hand the least documents on to all suffixes; after the last ``add``."""
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up = self.link[state]
            if up > 0 and self.least[state] < self.least[up]:
                self.least[up] = self.least[state]

    def windows(self, words: list[int], span: int) -> list:
        """Matching statistics cut at ``span``: per window of ``words``, the least document that holds it (None: none does)."""
        state, matched, found = 0, 0, []
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            while state and self.length[self.link[state]] >= span:
                state = self.link[state]
                matched = min(matched, self.length[state])
            if i >= span - 1:
                found.append(self.least[state] if matched >= span else None)
        return found


def _words(coded: bytes) -> list[int]:
    wide = np.zeros((len(coded) // WORD_BYTES, 8), np.uint8)
    wide[:, :WORD_BYTES] = np.frombuffer(coded, np.uint8).reshape(-1, WORD_BYTES)
    return wide.view(_U).ravel().tolist()


def match_batches(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """``(d1, d2, leasts)`` of distinct segments sorted by key: the least document of each window, where any document loses words."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        sizes: dict[int, int] = {}
        for key, *_ in rows:
            sizes[key] = sizes.get(key, 0) + 1
        automaton = SuffixAutomaton()
        coded = {words: _words(words) for key, words, _, _ in rows if sizes[key] > 1}
        for key, words, least, _ in rows:
            if sizes[key] > 1:
                automaton.add(coded[words], least)
        automaton.settle()
        texts, leasts = [], []
        for key, words, least, most in rows:
            if sizes[key] > 1:
                found = automaton.windows(coded[words], span)
            else:  # the key's only segment
                found = [least] * (len(words) // WORD_BYTES - span + 1)
            if any(x < most for x in found):
                texts.append(words)
                leasts.append(found)
        return pa.RecordBatch.from_arrays([*_digests(texts), pa.array(leasts, pa.list_(kind))], ["d1", "d2", "leasts"])

    held: list[tuple] = []
    size, last, kind = 0, None, pa.int64()
    for batch in batches:
        kind = batch.schema.field("least").type
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "words", "least", "most"))):
            if row[0] != last and size > SHARD_WORDS * WORD_BYTES:
                yield made(held)
                held, size = [], 0
            held.append(row)
            last, size = row[0], size + len(row[1])
    if held:
        yield made(held)


def version(text: str) -> Column:
    """Digest that tells apart the texts of rows of one document."""
    return F.unhex(F.md5(text)).alias("version")


def repeated_windows(docs: DataFrame, span: int, scratch: Scratch) -> DataFrame:
    """``(doc, version, begins)`` of ``(doc, text)``: first words of windows that a smaller document holds.

    Several rows per document and text; ``version`` tells the texts of one document apart.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.where("doc IS NOT NULL")
    kind = dict(docs.dtypes)["doc"]
    anchors = docs.mapInArrow(lambda b: anchor_batches(b, span), f"doc {kind}, anchors array<bigint>")
    rows = anchors.select("doc", F.explode("anchors").alias("key"))
    met = rows.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("key")
    shared = spark.sparkContext.broadcast(bitmap(met, BITMAP_BITS))

    segments = docs.mapInArrow(lambda b: segment_batches(b, span, shared), f"doc {kind}, key bigint, words binary")
    distinct = segments.groupBy("key", "words").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    distinct = scratch.keep(distinct, "segments")
    words = F.sum(F.octet_length("words") / WORD_BYTES).alias("total")
    crowded = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n"), words).where((F.col("n") > 1) & (F.col("total") > CROWDED))
    crowded = scratch.keep(crowded.select("key"), "crowded")
    dealt = distinct.join(crowded, "key", "left_anti").select("key", "words", "least", "most").repartition("key").sortWithinPartitions("key")
    matched = dealt.mapInArrow(lambda b: match_batches(b, span), f"d1 bigint, d2 bigint, leasts array<{kind}>")

    schema = f"d1 bigint, d2 bigint, at int, w1 bigint, w2 bigint, least {kind}, most {kind}"
    windows = scratch.keep(distinct.join(crowded, "key", "left_semi").select("words", "least", "most").mapInArrow(lambda b: window_batches(b, span), schema), "windows")
    least = scratch.keep(windows.groupBy("w1", "w2").agg(F.min("least").alias("first"), F.max("most").alias("m")).where("first < m").drop("m"), "least")
    met = windows.join(least, ["w1", "w2"]).where("first < most")
    placed = met.groupBy("d1", "d2").agg(F.collect_list(F.struct("at", "first")).alias("found"))
    # Windows that no smaller document holds are null.
    at = lambda i: F.filter("found", lambda f: f["at"] == i)
    full = F.transform(F.sequence(F.lit(0), F.array_max(F.col("found.at"))), lambda i: F.get(at(i), F.lit(0))["first"])
    results = scratch.keep(matched.union(placed.select("d1", "d2", full.alias("leasts"))), "leasts")
    scratch.drop(distinct, crowded, windows, least)

    schema = f"doc {kind}, version binary, start int, d1 bigint, d2 bigint"
    places = docs.select("doc", version("text"), "text").mapInArrow(lambda b: place_batches(b, span, shared), schema)
    joined = places.join(results, ["d1", "d2"])
    below = F.filter(F.sequence(F.lit(0), F.size("leasts") - 1), lambda i: F.get("leasts", i) < F.col("doc"))
    cut = joined.select("doc", "version", F.transform(below, lambda i: i + F.col("start")).alias("begins"))
    return cut.where(F.size("begins") > 0)


def cut_batches(batches: Iterator[pa.RecordBatch], span: int, build) -> Iterator[pa.RecordBatch]:
    """Feeds ``build`` with the words of each text, and a mask of those to remove."""
    for batch in batches:
        for part in text_slices(batch):
            words, masks = [], []
            for text, begins in zip(part.column("text").to_pylist(), part.column("begins").to_pylist()):
                split = text.encode().split()
                edge = np.zeros(len(split) + 1, np.int64)
                if begins:
                    np.add.at(edge, begins, 1)
                    np.add.at(edge, np.array(begins) + span, -1)
                words.append(split)
                masks.append(np.cumsum(edge)[:-1] > 0)
            yield build(part, words, masks)


def _with_windows(docs: DataFrame, span: int, key: str, text: str) -> DataFrame:
    """``docs`` as ``(row, text, begins)``, each row beside the windows that it loses."""
    scratch = Scratch(docs.sparkSession)
    found = repeated_windows(docs.select(F.col(key).alias("doc"), F.col(text).alias("text")), span, scratch)
    found = scratch.keep(found.groupBy("doc", "version").agg(F.flatten(F.collect_list("begins")).alias("begins")), "begins")
    scratch.drop_others(found)
    rows = docs.select(F.col(key).alias("doc"), F.struct(*[F.col(c) for c in docs.columns if c != text]).alias("row"), F.col(text).alias("text"))
    return rows.select("*", version("text")).join(found, ["doc", "version"], "left").select("row", "text", "begins")


def remove_repeats(docs: DataFrame, span: int = 13, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated words cut out of ``text``; texts that lose nothing stay as they are.

    What is left of a text that loses words is joined by single spaces.
    """

    def build(part: pa.RecordBatch, words: list[list[bytes]], masks: list[np.ndarray]) -> pa.RecordBatch:
        texts = part.column("text").to_pylist()
        cut = [b" ".join(w for w, m in zip(ws, ms) if not m).decode() if ms.any() else t for t, ws, ms in zip(texts, words, masks)]
        return pa.RecordBatch.from_arrays([part.column("row"), pa.array(cut, pa.string())], ["row", "text"])

    given = _with_windows(docs, span, key, text)
    kind = dict(given.dtypes)["row"]
    # Null texts stay null.
    cut = given.withColumn("row", F.struct("row", F.col("text").isNull().alias("absent"))).mapInArrow(
        lambda b: cut_batches(b, span, build), f"row struct<row:{kind},absent:boolean>, text string"
    )
    columns = [F.col(f"row.row.`{c}`") if c != text else F.when(~F.col("row.absent"), F.col("text")).alias(text) for c in docs.columns]
    return cut.select(*columns)


def removal_digests(docs: DataFrame, span: int = 13, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_words, n_removed, kept_sha256)`` per row of ``docs``."""

    def build(part: pa.RecordBatch, words: list[list[bytes]], masks: list[np.ndarray]) -> pa.RecordBatch:
        shas = [hashlib.sha256(b" ".join(w for w, m in zip(ws, ms) if not m)).hexdigest() for ws, ms in zip(words, masks)]
        columns = [part.column("row").field("key"), pa.array(map(len, words), pa.int64()), pa.array((int(m.sum()) for m in masks), pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(shas, pa.string())], ["key", "n_words", "n_removed", "kept_sha256"])

    given = _with_windows(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), span, "key", "text")
    kind = dict(docs.dtypes)[key]
    schema = f"key {kind}, n_words long, n_removed long, kept_sha256 string"
    return given.mapInArrow(lambda b: cut_batches(b, span, build), schema).withColumnRenamed("key", key)


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return removal_digests(scan(spark, folder, "documents"))


OP6_SQL = r"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM split)
), first AS (SELECT win, min(doc_id) AS least FROM windows GROUP BY win HAVING min(doc_id) < max(doc_id)),
removed AS (
  SELECT DISTINCT doc_id, i + k AS p FROM windows JOIN first USING (win), range(13) AS r(k) WHERE least < doc_id
), gone AS (SELECT doc_id, list(p) AS ps FROM removed GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN words ELSE
    list_filter(words, lambda w, j: NOT list_contains(ps, j)) END, ' '), '')) AS kept_sha256
FROM split LEFT JOIN gone USING (doc_id)
"""
