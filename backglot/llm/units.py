"""Units of text: stretches that end before a single space which a non-space follows, where no pre-token can span."""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers

#: The tokenizers' pattern with its meaning of white space spelled out.
PATTERN = (
    public_tokenizers.PATTERN.replace(r"[^\s", r"[^\p{White_Space}")
    .replace(r"\s", r"\p{White_Space}")
    .replace(r"\S", r"\P{White_Space}")
)
UNEVEN = re.compile(r" (?=\s|\Z)")  # a space that no non-space follows: plain splitting at spaces is not enough
CUT = re.compile(r"(?= \S)")
_SPACES = [chr(i).encode() for i in range(0x3001) if chr(i).isspace()]  # what \s matches; none lies above
_WHITE = np.zeros(256, bool)
_WHITE[[s[0] for s in _SPACES if len(s) == 1]] = True
_MAYBE = np.zeros(256, bool)  # bytes that longer white space starts with
_MAYBE[[s[0] for s in _SPACES if len(s) > 1]] = True
MAYBE_WHITE = _WHITE | _MAYBE
_LONG = {n: [int.from_bytes(s) for s in _SPACES if len(s) == n] for n in (2, 3)}


def split_units(text: str) -> list[str]:
    """The units of a text in order; joined they are the text."""
    if not text:
        return []
    if UNEVEN.search(text):
        return [u for u in CUT.split(text) if u]
    head, *rest = text.split(" ")
    units = [f" {u}" for u in rest]
    return [head, *units] if head else units


def unit_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the units of UTF-8 texts start, as ``split_units`` cuts them; text ``i`` is ``data[at[i]:at[i + 1]]``."""
    cut = np.flatnonzero(data == 32)
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    cut = cut[~edge[cut + 1]]
    follows = data[cut + 1]
    good = ~_WHITE[follows]
    doubt = np.flatnonzero(_MAYBE[follows])
    if len(doubt):
        first = cut[doubt] + 1
        three = [data[np.minimum(first + i, len(data) - 1)].astype(np.int64) for i in range(3)]
        two = three[0] << 8 | three[1]
        good[doubt] = ~np.isin(two, _LONG[2]) & ~np.isin(two << 8 | three[2], _LONG[3])
    edge[cut[good]] = True
    return np.flatnonzero(edge[:-1])
