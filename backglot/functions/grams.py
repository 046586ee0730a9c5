"""N-gram counts of token pairs, batch by batch inside a task.

All tokens of a slice of rows get dense numbers; an n-gram of a row is the number of its (n-1)-gram beside its last token,
numbered again. So counting costs one hash look-up per n-gram, nothing is shuffled or sorted, and a slice bounds the memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from backglot.functions.profiles import NAME_START

SLICE_TOKENS = 20_000  # tokens counted at once, one row at least: the tables of such a slice stay in a core's cache
KINDS = ("numbers", "strings", "ops")


def token_kinds(tokens: pa.Array) -> dict[str, np.ndarray]:
    """Which tokens are numbers, quoted strings, or single characters that begin no name."""
    flag = lambda x: pc.fill_null(x, False).to_numpy(zero_copy_only=False)
    numbers = flag(pc.match_substring_regex(tokens, "^[0-9]"))
    quoted = flag(pc.or_(pc.starts_with(tokens, '"'), pc.starts_with(tokens, "'")))
    names = flag(pc.match_substring_regex(tokens, f"^{NAME_START}"))
    length = pc.fill_null(pc.utf8_length(tokens), 0).to_numpy(zero_copy_only=False)
    return {"numbers": numbers, "strings": quoted & (length > 1), "ops": (length == 1) & ~numbers & ~names}


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and the index of each key among them."""
    coded = pa.array(keys).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)


def _side(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Tokens of all rows, and their number in each row; a null list has none."""
    return lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def count_slice(reference: pa.Array, candidate: pa.Array, most: int) -> dict[str, np.ndarray]:
    """Per row: clipped hits of the 1- to ``most``-grams, tokens and tokens by kind of both sides. Null tokens do not count."""
    (left, n_left), (right, n_right) = _side(reference), _side(candidate)
    rows, border = len(reference), len(left)
    coded = pa.concat_arrays([left, right]).dictionary_encode()
    token = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1  # 0: null
    row = np.concatenate([np.repeat(np.arange(rows), n_left), np.repeat(np.arange(rows), n_right)])
    counts = {}
    kinds = token_kinds(coded.dictionary)
    for side, part in (("r", slice(0, border)), ("c", slice(border, None))):
        there = token[part] > 0
        counts[f"{side}_len"] = np.bincount(row[part][there], minlength=rows)
        for kind in KINDS:
            is_kind = np.concatenate([[False], kinds[kind]])[token[part]]
            counts[f"{side}_{kind}"] = np.bincount(row[part][is_kind], minlength=rows)
    width = len(coded.dictionary) + 1
    ends = np.concatenate([np.repeat(np.cumsum(n_left), n_left), border + np.repeat(np.cumsum(n_right), n_right)])
    at, gram, owner = np.arange(len(token)), row, np.arange(rows)  # a 0-gram: the row itself
    for n in range(1, most + 1):
        inside = at + n <= ends[at]
        at, gram = at[inside], gram[inside]
        distinct, gram = _numbered(gram * width + token[at + n - 1])
        owner = owner[distinct // width]
        whole = (token[at] > 0) & (token[at + n - 1] > 0)
        in_left = at < border
        clipped = np.minimum(
            np.bincount(gram[in_left & whole], minlength=len(distinct)), np.bincount(gram[~in_left & whole], minlength=len(distinct))
        )
        counts[f"hit{n}"] = np.bincount(owner, weights=clipped, minlength=rows).astype(np.int64)
    return counts


def slices(reference: pa.Array, candidate: pa.Array) -> Iterator[tuple[int, int]]:
    """Starts and lengths of runs of rows with at most ``SLICE_TOKENS`` tokens, one row at least."""
    upto = np.cumsum(_side(reference)[1] + _side(candidate)[1])
    start = 0
    while start < len(upto):
        before = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + SLICE_TOKENS, side="right")))
        yield start, stop - start
        start = stop


def count_names(most: int) -> list[str]:
    return [*[f"hit{n}" for n in range(1, most + 1)], *[f"{s}_{k}" for s in "rc" for k in ("len", *KINDS)]]


def count_batches(batches: Iterator[pa.RecordBatch], most: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """The batches with the counts of their token lists ``_r`` and ``_c`` instead of these; ``whole``: without rows that lack one."""
    names = count_names(most)
    for batch in batches:
        if whole:
            batch = batch.filter(pc.and_(batch.column("_r").is_valid(), batch.column("_c").is_valid()))
        left, right = batch.column("_r"), batch.column("_c")
        parts = [count_slice(left.slice(i, size), right.slice(i, size), most) for i, size in slices(left, right)]
        rest = batch.drop_columns(["_r", "_c"])
        counts = [pa.array(np.concatenate([p[n] for p in parts]) if parts else [], pa.int64()) for n in names]
        yield pa.RecordBatch.from_arrays([*rest.columns, *counts], [*rest.schema.names, *names])
