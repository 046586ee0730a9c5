"""Byte-level BPE: ranked merges over the byte arrays of distinct words, for all new words of a slice at once.

A task reads its documents in order. Texts are cut into units and these into pre-tokens ("words"); a word that the task
meets for the first time starts as the array of its bytes' ranks, and ``merge_words`` merges its pair of least rank again
and again, one merge of every unfinished word a step. The ranks of pairs are a broadcast array, in which each pair lies in
one of two slots, so a look-up reads at most two cells. A unit's ids are kept, so a text is joined from its units' ids. All
steps are narrow, so nothing is shuffled and no key can be hot.

Words that are pieces themselves need no merge. Words above ``LONG_WORD`` bytes take the same merges in the same order
from a heap.

Defined results for odd inputs: a null or empty text has no ids and decodes to no bytes; repeated rows give
repeated results; an empty table gives an empty result; other columns are not read. Bytes that are not UTF-8
cannot occur in a Spark string.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backglot.llm.arrow import ragged, text_slices
from backglot.llm.units import PATTERN, split_units
from backglot.session import ship_package
from backglot.sources.tables import scan

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LONG_WORD = 40  # bytes; longer words are merged by the heap
TABLE_WORDS = 400_000  # distinct words or units a task keeps before it starts afresh
LONG_UNIT = 200  # longer stretches of text are encoded, but not kept
WIDTHS = (8, 16, LONG_WORD)  # words are merged beside words of about their length
NEVER = 1 << 30  # where no merge is possible


def read_ranks(path: str) -> list[bytes]:
    """Byte strings by rank, from a rank file."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    pieces: list[bytes] = [b""] * len(pairs)
    for coded, rank in pairs:
        pieces[int(rank)] = base64.b64decode(coded)
    return pieces


class PairRanks:
    """Rank of two adjacent pieces' concatenation, broadcast as one array: each pair lies in one of its two slots.

    A cell holds ``left << 32 | right << 16 | rank``, or -1.
    """

    def __init__(self, spark: SparkSession, pieces: list[bytes]):
        if len(pieces) > 1 << 16:
            raise ValueError("ranks of more than 65,536 pieces do not fit a cell")
        rank = {p: i for i, p in enumerate(pieces)}
        pairs = [(rank[p[:k]] << 16 | rank[p[k:]], i) for p, i in rank.items() for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank]
        slots = 1 << max(8, (3 * len(pairs)).bit_length())
        homes = [x.tolist() for x in pair_homes(np.array([k for k, _ in pairs], np.int64), slots)]
        homes = dict(zip([k for k, _ in pairs], zip(*homes)))
        held: list = [None] * slots
        for moving in pairs:
            at = homes[moving[0]][0]
            for _ in range(500):
                moving, held[at] = held[at], moving
                if moving is None:
                    break
                a, b = homes[moving[0]]
                at = b if at == a else a
            else:
                raise ValueError("the pair table needs more slots")
        self.table = spark.sparkContext.broadcast(np.array([-1 if c is None else c[0] << 16 | c[1] for c in held], np.int64))


def pair_homes(pairs: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """The two slots of every pair."""
    keys, shift = pairs.astype(np.uint64), np.uint64(64 - (slots.bit_length() - 1))
    return tuple(((keys * np.uint64(odd)) >> shift).astype(np.int64) for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def pair_ranks(table: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ranks of pairs, -1 where the two are no piece together."""
    pairs = left.astype(np.int64) << 16 | right
    first, second = pair_homes(pairs, len(table))
    one, other = table[first], table[second]
    return np.where(one >> 16 == pairs, one & 65535, np.where(other >> 16 == pairs, other & 65535, -1))


def merge_words(words: list[list[int]], table: np.ndarray) -> list[bytes]:
    """Little-endian 32-bit ids of words given as their bytes' ranks: the pair of the least rank is merged, leftmost first, until none is left.

    Words stand side by side in columns. Parts keep the place of their first byte and know the part after and before them; a
    merge makes two new pairs at most, and only those are looked up.
    """
    out: list[bytes] = [b""] * len(words)
    least = 0
    for width in WIDTHS:
        chosen = [i for i, w in enumerate(words) if least < len(w) <= width]
        least = width
        if not chosen:
            continue
        n = np.array([len(words[i]) for i in chosen])
        count, place = len(chosen), np.arange(width + 1)[:, None]
        parts = np.full((width + 1, count), -1, np.int64)
        parts.T[np.arange(width + 1) < n[:, None]] = np.concatenate([words[i] for i in chosen])
        after = np.where(place + 1 < n, place + 1, width) + np.zeros((1, count), np.int64)
        before = place - 1 + np.zeros((1, count), np.int64)
        found = np.full((width + 1, count), NEVER, np.int32)  # rank and place of the pair that begins here
        at, column = np.nonzero(place + 1 < n)

        def look(at: np.ndarray, column: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            ranks = pair_ranks(table, left, right)
            found[at, column] = np.where(ranks < 0, NEVER, ranks << 6 | at)

        look(at, column, parts[at, column], parts[at + 1, column])
        open_ = np.arange(count)
        while len(open_):
            best = np.minimum.reduce(found if len(open_) == count else found[:, open_], axis=0)
            open_, best = open_[best < NEVER], best[best < NEVER]
            at, rank = (best & 63).astype(np.int64), (best >> 6).astype(np.int64)
            gone = after[at, open_]
            follows = after[gone, open_]
            parts[at, open_], parts[gone, open_], found[gone, open_] = rank, -1, NEVER
            after[at, open_], before[follows, open_], found[at, open_] = follows, at, NEVER
            more = follows < width
            look(at[more], open_[more], rank[more], parts[follows[more], open_[more]])
            more = before[at, open_] >= 0
            ahead = before[at[more], open_[more]]
            look(ahead, open_[more], parts[ahead, open_[more]], rank[more])
        whole = parts.T >= 0
        raw, ends = parts.T[whole].astype("<i4").tobytes(), np.cumsum(4 * whole.sum(1)).tolist()
        for i, a, b in zip(chosen, [0, *ends], ends):
            out[i] = raw[a:b]
    return out


def heap_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long word, in ``n log n``."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end = list(range(1, n + 1))  # of the part that starts here
    prev = list(range(-1, n - 1))
    alive = [True] * n

    def offer(i: int) -> None:
        if i >= 0 and end[i] < n and (r := ranks.get(word[i : end[end[i]]])) is not None:
            heapq.heappush(heap, (r, i, end[i], end[end[i]]))

    heap: list[tuple[int, int, int, int]] = []
    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, middle, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != middle or end[middle] != stop:
            continue
        alive[middle], end[i] = False, stop
        if stop < n:
            prev[stop] = i
        offer(i)
        offer(prev[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Coder:
    """Ids of texts; the ids of the words and units that a task has met are kept."""

    def __init__(self, pieces: list[bytes], table: np.ndarray):
        self.ranks, self.table = {p: i for i, p in enumerate(pieces)}, table
        self.bytes = [self.ranks[bytes([i])] for i in range(256)]
        self.find = regex.compile(PATTERN).findall
        self.words: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of every text. No word spans two units."""
        if max(len(self.words), len(self.units)) > TABLE_WORDS:
            self.words, self.units = {}, {}
        split = [split_units(text) for text in texts]
        units, words = self.units, self.words
        cut = {u: self.find(u) for found in split for u in found if u not in units}
        waiting: dict[str, list[int]] = {}
        for w in {w for found in cut.values() for w in found if w not in words}:
            coded = w.encode()
            own = self.ranks.get(coded)
            if own is not None:
                words[w] = np.array([own], "<i4").tobytes()
            elif len(coded) > LONG_WORD:
                words[w] = np.array(heap_merges(coded, self.ranks), "<i4").tobytes()
            else:
                waiting[w] = [self.bytes[b] for b in coded]
        words.update(zip(waiting, merge_words(list(waiting.values()), self.table)))
        extra: dict[str, bytes] = {}
        for u, found in cut.items():
            (units if len(u) <= LONG_UNIT else extra)[u] = b"".join([words[w] for w in found])
        ids = (lambda u: units[u] if u in units else extra[u]) if extra else units.__getitem__
        return [b"".join(map(ids, found)) for found in split]


def encode(docs: DataFrame, pieces: list[bytes], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids array<int>)`` per row of ``docs``, as the rank table's tokenizer gives them."""
    return _joined(docs, pieces, key, text, "ids array<int>", lambda ids: [_lists(ids)], ["ids"])


def decode(ids: Iterator[int] | np.ndarray, pieces: list[bytes]) -> bytes:
    """Bytes of ids: their binary pieces in order."""
    return b"".join(map(pieces.__getitem__, ids))


def _joined(docs, pieces, key, text, schema, build, names) -> DataFrame:
    """Per row what ``build`` makes of the ids (numpy arrays) of a slice's documents."""
    spark = docs.sparkSession
    ship_package(spark)
    shared, table = spark.sparkContext.broadcast(pieces), PairRanks(spark, pieces).table
    kind = dict(docs.dtypes)[key]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            for part in text_slices(batch):
                coder = coder or Coder(shared.value, table.value)
                ids = [np.frombuffer(x, "<i4") for x in coder.encode(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("key"), *build(ids)], ["key", *names])

    given = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return given.mapInArrow(work, f"key {kind}, {schema}").withColumnRenamed("key", key)


def _shas(ids: list[np.ndarray], pieces: list[bytes]) -> pa.Array:
    return pa.array((hashlib.sha256(decode(x.tolist(), pieces)).hexdigest() for x in ids), pa.string())


def _lists(ids: list[np.ndarray]) -> pa.Array:
    return ragged(np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32), np.array([len(x) for x in ids]), pa.int32())


def encode_digests(docs: DataFrame, pieces: list[bytes], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the number of ids, the digest of the decimal ids, and that of the bytes decoded from the ids."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pieces)

    def build(ids: list[np.ndarray]) -> list[pa.Array]:
        shown = list(map(str, range(len(shared.value))))
        listed = (hashlib.sha256(",".join(map(shown.__getitem__, x.tolist())).encode()).hexdigest() for x in ids)
        return [pa.array(map(len, ids), pa.int64()), pa.array(listed, pa.string()), _shas(ids, shared.value)]

    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    return _joined(docs, pieces, key, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", build, names)


def encode_round_trip(docs: DataFrame, pieces: list[bytes], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its ids, their number, and the digest of the bytes decoded from them."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def build(ids: list[np.ndarray]) -> list[pa.Array]:
        return [_lists(ids), pa.array(map(len, ids), pa.int64()), _shas(ids, shared.value)]

    return _joined(docs, pieces, key, text, "ids array<int>, n_tokens long, decoded_sha256 string", build, ["ids", "n_tokens", "decoded_sha256"])


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    pieces = read_ranks(public_tokenizers.path(VOCABULARY))
    return encode_digests(scan(spark, folder, "documents"), pieces)
