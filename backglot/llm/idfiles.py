"""Token ids in files: encoded texts, in ascending key order, as payloads of the adaptive coder.

Documents are range-partitioned by key. A task encodes its documents in order and packs their ids into segments of about
``SEGMENT_IDS`` ids; a row of the file holds a segment's place (shard, number, ids before it in the shard), its
documents' keys and lengths, and its payload (see ``coder``). Every segment can be read by itself. Only one total per
shard reaches the driver, to know where each shard begins.

Defined results for odd inputs: a null or empty text holds the end id only; a null key comes first; rows of one key are
ordered by text; an empty table gives an empty file and an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backglot.llm import coder
from backglot.llm.arrow import text_bytes, text_slices
from backglot.llm.counts import BATCH, VOCABULARY, PieceCounter
from backglot.llm.units import MAYBE_WHITE, unit_starts
from backglot.session import scratch_path, ship_package, shuffle_partitions
from backglot.sources.tables import scan

END_ID = 2
SEGMENT_IDS = 1 << 21
TEXT_BYTES = 1 << 24  # bytes of text whose distinct units are encoded once
SLICE = 1 << 21  # bytes of text whose ids are put together at once
JOINED = 32  # units that go to the library as one text
SCHEMA = "shard int, segment int, base long, keys array<{key}>, lengths array<int>, payload binary"


class UnitEncoder(PieceCounter):
    """Ids of texts by a tokenizers vocabulary; the ids of a unit of text are found once per call.

    The library takes a call's overhead for every text, so units go to it joined: where a unit starts with a space, no
    pre-token spans its start. Ids of a byte-level vocabulary stand for known numbers of bytes, which tell the units apart.
    """

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        super().__init__(vocabulary)
        self.special_bytes = re.compile(self.special.pattern.encode()) if self.special is not None else None
        self.joins = not any(c.isspace() for mark in self.marks for c in mark)  # joined units must not make up a special string
        pieces = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(pieces.values(), default=0) + 1, np.int64)
        self.n_bytes[list(pieces.values())] = list(map(len, pieces))  # a byte-level piece has a character per byte

    def special_spans(self, texts: pa.Array, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Starts and ends in ``data`` of the special strings inside texts, a row each."""
        hit = np.zeros(len(texts), bool)
        for mark in self.marks:
            hit |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        found = [(at[i] + m.start(), at[i] + m.end()) for i in np.flatnonzero(hit) for m in self.special_bytes.finditer(data[at[i] : at[i + 1]])]
        return np.array(found, np.int64).reshape(-1, 2)

    def library_ids(self, texts: list[str], batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and their number in every text."""
        ids = [np.zeros(0, "<u4")]
        for i in range(0, len(texts), batch):
            ids += [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts[i : i + batch], add_special_tokens=False)]
        return np.concatenate(ids), np.fromiter(map(len, ids[1:]), np.int64, len(texts))

    def unit_ids(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct units, where each unit's ids begin, and their number."""
        data, at = text_bytes(units)
        second = data[np.minimum(at[:-1] + 1, len(data) - 1)]
        tail = (data[at[:-1]] == 32) & (np.diff(at) > 1) & ~MAYBE_WHITE[second] & self.joins
        joined, edges = text_bytes(units.filter(pa.array(tail)))
        bounds = np.append(edges[:-1:JOINED], edges[-1])
        ids, _ = self.library_ids([str(joined[a:b], "utf-8") for a, b in zip(bounds, bounds[1:])], BATCH // JOINED)
        reached = np.append(0, np.cumsum(self.n_bytes[ids]))
        place = np.searchsorted(reached, edges)
        if reached[-1] != edges[-1] or (reached[place] != edges).any():  # the vocabulary changes texts
            tail[:], ids, place = False, ids[:0], place[:1]
        other, sizes = self.library_ids(units.filter(pa.array(~tail)).to_pylist())
        size = np.empty(len(units), np.int64)
        size[tail], size[~tail] = np.diff(place), sizes
        begin = np.empty(len(units), np.int64)
        begin[tail], begin[~tail] = place[:-1], len(ids) + np.cumsum(sizes) - sizes
        return np.concatenate([ids, other]), begin, size

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For stretches of texts: the first one, their ids one after another, and their number in every text."""
        data, at = text_bytes(texts)
        spans = self.special_spans(texts, data, at)
        starts = unit_starts(data, np.union1d(at, spans))
        if len(spans):  # a special string is a unit of its own
            span = np.searchsorted(spans[:, 0], starts, side="right") - 1
            starts = starts[(span < 0) | (starts == spans[span, 0]) | (starts >= spans[span, 1])]
        if not len(starts):
            yield 0, np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
            return
        offsets = np.append(starts, len(data)).astype(np.int32)
        units = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        ids, begin, size = self.unit_ids(units.dictionary)
        which = units.indices.to_numpy()
        edge = np.searchsorted(starts, at)  # of the texts' units
        cuts = [*np.unique(np.searchsorted(at[:-1], np.arange(0, len(data), SLICE))), len(texts)]
        for a, b in zip(cuts, cuts[1:]):
            part = which[edge[a] : edge[b]]
            sizes = size[part]
            ends = np.append(0, np.cumsum(sizes))
            yield a, ids[np.repeat(begin[part] - ends[:-1], sizes) + np.arange(ends[-1])], np.diff(ends[edge[a : b + 1] - edge[a]])


def large_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Keys and texts in slices of at most ``TEXT_BYTES`` bytes of text, but one row at least."""
    parts, size = [], 0
    merged = lambda: tuple(pa.concat_arrays([p.column(c) for p in parts]) for c in ("key", "text"))
    for batch in batches:
        for part in text_slices(batch, limit=SLICE):
            n = int(text_bytes(part.column("text"))[1][-1])
            if parts and size + n > TEXT_BYTES:
                yield merged()
                parts, size = [], 0
            parts.append(part)
            size += n
    if parts:
        yield merged()


def write_ids(docs: DataFrame, vocabulary: str, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> None:
    """Encode every text, append ``end_id``, and write the ids in ascending order of ``key``."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(vocabulary)
    kind = dict(docs.dtypes)[key]
    given = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    begins = F.substring("text", 1, 256)  # whole texts would go to the driver as samples
    ordered = given.repartitionByRange(shuffle_partitions(spark), "key", begins).sortWithinPartitions("key", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnitEncoder(shared.value)
        shard = TaskContext.get().partitionId()
        base, number, size = 0, 0, 0
        keys, lengths, ids = [], [], []

        def segment() -> pa.RecordBatch:
            one = lambda values, t: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(t))
            columns = [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([base], pa.int64())]
            columns += [one(pa.concat_arrays(keys), keys[0].type), one(pa.array(np.concatenate(lengths)), pa.int32())]
            columns += [pa.array([coder.encode(np.concatenate(ids))], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["shard", "segment", "base", "keys", "lengths", "payload"])

        for part_keys, texts in large_slices(batches):
            for first, found, sizes in encoder.encode(texts):
                found = np.insert(found, np.cumsum(sizes), end_id)
                sizes += 1
                edge = np.append(0, np.cumsum(sizes))
                start = 0
                while start < len(sizes):  # rows up to the one that fills the segment
                    stop = min(int(np.searchsorted(edge, edge[start] + SEGMENT_IDS - size)), len(sizes))
                    keys.append(part_keys.slice(first + start, stop - start))
                    lengths.append(sizes[start:stop])
                    ids.append(found[edge[start] : edge[stop]])
                    size += int(edge[stop] - edge[start])
                    start = stop
                    if size >= SEGMENT_IDS:
                        yield segment()
                        base, number, size = base + size, number + 1, 0
                        keys, lengths, ids = [], [], []
        if ids:
            yield segment()

    ordered.mapInArrow(work, SCHEMA.format(key=kind)).write.parquet(path)


def read_ids(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``(key, start, n_tokens, ids binary)`` from the files: place in the whole, and little-endian 32-bit ids."""
    ship_package(spark)
    files = spark.read.parquet(path)
    ends = files.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    begin, starts = 0, []
    for row in sorted(ends.collect()):  # one row per shard
        starts.append((row["shard"], begin))
        begin += row["n"]
    kind = dict(files.dtypes)["keys"].removeprefix("array<").removesuffix(">")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                lengths = row.column("lengths").flatten().to_numpy().astype(np.int64)
                ids = coder.decode(row.column("payload")[0].as_buffer()).astype("<u4")
                edge = np.concatenate([[0], np.cumsum(lengths)])
                place = row.column("base")[0].as_py() + edge[:-1]
                bounds = pa.py_buffer((4 * edge).astype(np.int32))
                slices = pa.Array.from_buffers(pa.binary(), len(lengths), [None, bounds, pa.py_buffer(ids)])
                shard = pa.array(np.full(len(lengths), row.column("shard")[0].as_py(), np.int32))
                yield pa.RecordBatch.from_arrays([shard, row.column("keys").flatten(), pa.array(place), pa.array(lengths), slices], names)

    names = ["shard", "key", "place", "n_tokens", "ids"]
    found = files.mapInArrow(work, f"shard int, key {kind}, place long, n_tokens long, ids binary")
    shards = spark.createDataFrame(starts, "shard int, begin long")
    joined = found.join(F.broadcast(shards), "shard")  # as many rows as shards
    return joined.select(F.col("key").alias(key), (F.col("begin") + F.col("place")).alias("start"), "n_tokens", "ids")


def op4_id_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "ids")
    with open(public_tokenizers.path(VOCABULARY), encoding="utf-8") as file:
        write_ids(scan(spark, folder, "documents"), file.read(), path)
    read = read_ids(spark, path)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
