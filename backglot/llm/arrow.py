"""Arrow batches inside tasks: slices bounded in bytes, words as spans, vectorised hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20  # text handled at once inside a task
PIECE_BYTES = 1 << 18  # bytes of words hashed at once: the index arrays take some 40 bytes a byte
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True  # what ends a word: [\x20\x09-\x0D]
_random = np.random.RandomState(20_240_501)
_BYTE = _random.randint(1, 1 << 62, 256).astype(_U) * _U(4) + _U(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_WORD = _U(0x2545F4914F6CDD1D)
_STEP = _random.randint(1, 1 << 62, 64).astype(_U) * _U(4) + _U(3)


def give_back() -> None:
    """Hand freed memory back to the system: workers live on, and their heaps would stay as large as their largest slice."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``limit`` bytes of text, but one row at least; null texts become empty."""
    text = pc.fill_null(batch.column(column), "")
    batch = batch.set_column(batch.schema.get_field_index(column), pa.field(column, text.type), text)
    ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    give_back()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each text starts (one more entry than texts)."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word of every text, and where each text's words start."""
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of every word's bytes; ``lower`` takes A-Z as a-z. Works in pieces, so memory does not follow the text."""
    table = _LOWER if lower else _BYTE
    upto = np.cumsum(ends - starts)
    out = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):
        before = upto[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(upto, before + PIECE_BYTES, side="right")))
        if ends[i] - starts[i] > PIECE_BYTES:
            out[i] = _long_word(data[starts[i] : ends[i]], table)
        else:
            out[i:j] = _some_words(data, starts[i:j], ends[i:j], table)
        i = j
    return out


def _some_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    lengths = ends - starts
    power = _powers(int(lengths.max()))
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    values = table[data[place + np.repeat(starts, lengths)]] * power[place]
    return mix(np.add.reduceat(values, first) + lengths.astype(_U) * _WORD)


def _long_word(word: np.ndarray, table: np.ndarray) -> np.uint64:
    power, total = _powers(PIECE_BYTES), np.zeros(1, _U)
    reached = np.ones(1, _U)
    for i in range(0, len(word), PIECE_BYTES):
        part = table[word[i : i + PIECE_BYTES]]
        total += (part * power[: len(part)]).sum(dtype=_U) * reached
        reached *= power[-1] * _BASE
    return mix(total + np.array([len(word)], _U) * _WORD)[0]


def _powers(size: int) -> np.ndarray:
    power = np.full(size, _BASE, _U)
    power[0] = 1
    return np.cumprod(power)


def window_hashes(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``n`` consecutive words of one text, at the index of its first word; and which indices are such."""
    size = len(words)
    valid = np.zeros(size, bool)
    out = np.zeros(size, _U)
    if size >= n:
        total = np.zeros(size - n + 1, _U)
        for k in range(n):
            total += words[k : size - n + 1 + k] * _STEP[k]
        out[: size - n + 1] = mix(total)
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        valid[: size - n + 1] = text[: size - n + 1] == text[n - 1 :]
    return out, valid


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """List array of consecutive runs of ``values``."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
