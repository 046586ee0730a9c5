"""Word shingles of whole texts: distinct sets as 64-bit hashes, minwise hashes, sketches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from backglot.llm.arrow import mix, ragged, text_bytes, text_slices, window_hashes, word_hashes, word_spans

_U = np.uint64
_ROWS = 1 << 10  # shingles hashed at once


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of all runs of ``n`` words per text, A-Z taken as a-z.

    A text of fewer words is one run, a text without words (or null, given as empty) has none.
    """
    data, at = text_bytes(column)
    starts, ends, first = word_spans(data, at)
    words = word_hashes(data, starts, ends, lower=True)
    hashes, _ = window_hashes(words, first, n)
    sets = []
    for a, b in zip(first, first[1:]):
        if b - a >= n:
            sets.append(np.unique(hashes[a : b - n + 1]))
        elif b > a:
            short, _ = window_hashes(words[a:b], np.array([0, b - a]), int(b - a))
            sets.append(mix(short[:1] + _U(b - a)))
        else:
            sets.append(np.zeros(0, _U))
    return sets


class Minwise:
    """``trees`` x ``depth`` minwise hashes of a set."""

    def __init__(self, trees: int, depth: int, seed: int = 77):
        draw = np.random.RandomState(seed)
        self.trees, self.depth = trees, depth
        self.factors = draw.randint(1, 1 << 62, trees * depth).astype(_U) * _U(2) + _U(1)
        self.shifts = draw.randint(1, 1 << 62, trees * depth).astype(_U)

    def mins(self, values: np.ndarray) -> np.ndarray:
        best = np.full(len(self.factors), np.iinfo(np.uint64).max, _U)
        for i in range(0, len(values), _ROWS):
            part = values[i : i + _ROWS, None] * self.factors + self.shifts
            np.minimum(best, part.min(axis=0), out=best)
        return best

    def roots(self, mins: np.ndarray) -> np.ndarray:
        """Node of every tree at its first depth: a hash of the tree and its first minwise token."""
        tokens = mix(mins.reshape(self.trees, self.depth)[:, 0])
        return mix(mix(np.arange(self.trees, dtype=_U) + _U(1)) * _U(0x9E3779B97F4A7C15) + tokens)

    def sketch(self, mins: np.ndarray) -> bytes:
        """One byte of each minwise token, tree by tree: for branching on, and to estimate the similarity."""
        return (mix(mins ^ _U(0xD1B54A32D192ED03)) & _U(255)).astype(np.uint8).tobytes()


def set_digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def feature_batches(batches: Iterator[pa.RecordBatch], n: int, minwise: Minwise) -> Iterator[pa.RecordBatch]:
    """``(doc, n_shingles, digest, sketch, nodes)`` of ``(doc, text)``; no nodes without shingles."""
    for batch in batches:
        for part in text_slices(batch):
            sizes, digests, sketches, roots, counts = [], [], [], [], []
            for values in shingle_sets(part.column("text"), n):
                sizes.append(len(values))
                digests.append(set_digest(values))
                counts.append(minwise.trees if len(values) else 0)
                mins = minwise.mins(values)
                sketches.append(minwise.sketch(mins))
                if len(values):
                    roots.append(minwise.roots(mins))
            flat = np.concatenate(roots) if roots else np.zeros(0, _U)
            nodes = ragged(flat.view(np.int64), np.array(counts, np.int64), pa.int64())
            columns = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), nodes]
            yield pa.RecordBatch.from_arrays([part.column("doc"), *columns], ["doc", "n_shingles", "digest", "sketch", "nodes"])


def set_batches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """``(doc, digest, shingles)`` of ``(doc, text)``: the sorted set as 64-bit numbers, and its digest."""
    for batch in batches:
        for part in text_slices(batch):
            sets = shingle_sets(part.column("text"), n)
            columns = [pa.array([set_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column("doc"), *columns], ["doc", "digest", "shingles"])


def search_links(size: int, near, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest of ``size`` members: breadth first, each member meets only those not reached yet.

    ``near(i, others)`` tells which of ``others`` are near member ``i``. Members with one ``label`` are connected already.
    """
    links, rest = [], np.ones(size, bool)
    for start in range(size):
        if not rest[start]:
            continue
        queue = [start]
        if label is None:
            rest[start] = False
        else:
            queue = np.flatnonzero(rest & (label == label[start])).tolist()
            rest[queue] = False
        while queue:
            i = queue.pop()
            others = np.flatnonzero(rest)
            if not len(others):
                return links
            met = others[near(i, others)]
            if label is not None and len(met):
                met = met[np.unique(label[met], return_index=True)[1]]
                links += [(i, j) for j in met.tolist()]
                met = np.flatnonzero(rest & np.isin(label, label[met]))
            else:
                links += [(i, j) for j in met.tolist()]
            rest[met] = False
            queue += met.tolist()
    return links


def alike_by_sketch(sketches: list[bytes], sizes: np.ndarray, percent: int):
    """``near`` for :func:`search_links`: a pair at the threshold fails it once in some hundred million times."""
    codes = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
    want = percent / 100

    def near(i: int, others: np.ndarray) -> np.ndarray:
        small, large = np.minimum(sizes[i], sizes[others]), np.maximum(sizes[i], sizes[others])
        same = (codes[others] == codes[i]).sum(axis=1) / codes.shape[1]
        spread = np.sqrt(want * (1 - want) / np.minimum(large, codes.shape[1]))  # a small set has few tokens to draw from
        return (small * 100 >= large * percent) & (same >= want - 6 * spread)

    return near


def alike_by_set(sets: list[bytes], percent: int):
    """``near`` for :func:`search_links`, exact on whole sets."""
    values = [np.frombuffer(s, _U) for s in sets]
    sizes = np.array([len(v) for v in values], np.int64)
    kinds, ids = np.unique(np.concatenate(values), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(sizes)])

    def near(i: int, others: np.ndarray) -> np.ndarray:
        fits = np.minimum(sizes[i], sizes[others]) * 100 >= np.maximum(sizes[i], sizes[others]) * percent
        out = np.zeros(len(others), bool)
        if fits.any():
            mark = np.zeros(len(kinds), np.int32)
            mark[ids[at[i] : at[i + 1]]] = 1
            chosen = others[fits]
            if len(chosen) > 4:
                common = np.add.reduceat(mark[ids], at[:-1])[chosen].astype(np.int64)
            else:
                common = np.array([mark[ids[at[j] : at[j + 1]]].sum() for j in chosen.tolist()], np.int64)
            out[fits] = 100 * common >= percent * (sizes[i] + sizes[chosen] - common)
        return out

    return near
