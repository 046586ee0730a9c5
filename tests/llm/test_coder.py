from __future__ import annotations

import numpy as np
import pytest

from backglot.llm import coder


@pytest.mark.parametrize("block", [1, 7, 64, 1024])
@pytest.mark.parametrize("kind", ["uniform", "skewed", "periodic", "constant", "extremes"])
def test_round_trip(kind, block):
    draw = np.random.RandomState(block)
    for n in (0, 1, 2, block, block + 1, 3000):
        ids = {
            "uniform": draw.randint(0, coder.MOST_ID + 1, n),
            "skewed": np.minimum(draw.zipf(1.3, n), 50_000),
            "periodic": np.arange(n) % 37 * 911,
            "constant": np.full(n, 50_256),
            "extremes": draw.choice([0, coder.MOST_ID], n),
        }[kind]
        assert np.array_equal(coder.decode(coder.encode(ids, block)), ids)


def test_compresses_and_blocks_are_independent():
    ids = np.arange(20_000) % 50 * 997
    payload = coder.encode(ids)
    assert len(payload) < 20_000 * 2 / 4
    longer = coder.encode(np.concatenate([ids[: 3 * 1024], ids[::-1]]))
    lanes = -(-23_072 // 1024)
    sizes = np.frombuffer(longer, "<u4", 2 * lanes, 16)[0:6:2]
    assert list(sizes) == list(np.frombuffer(payload, "<u4", 6, 16)[::2])


def test_damage_is_found():
    payload = bytearray(coder.encode(np.arange(5000)))
    payload[-9] ^= 4
    with pytest.raises(ValueError):
        coder.decode(bytes(payload))
    with pytest.raises(ValueError):
        coder.encode(np.array([-1]))
