"""Adaptive context-mixing range coder for token ids, in independent checksummed blocks.

Each block starts afresh. Three models predict its next id: order 2 and order 1 name the id that last followed the
same two ids or the same id, order 0 has adaptive counts of id ranges (narrow ranges for the small, frequent ids).
Orders 2 and 1 get as much of the probability as they have lately been right, both together where they name one id; the
rest is order 0's, spread over all ids. The ids named stand first, so one range-coding step codes one id. Order 0's counts
learn from the ids that nobody named; their sums are taken anew every few ids. Only integers are used: encoder and
decoder stay in step on every machine.

Blocks do not depend on each other, so the blocks of one payload are coded side by side: one numpy operation does one
step of all of them.

Payload: magic, number of ids, block length, number of blocks (4 bytes each, little-endian), then per block its number
of 32-bit words and the crc32 of its ids, then the words of all blocks.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CMR2"
BLOCK_IDS = 1024
_U, _U16 = np.uint64, np.uint16
# Order 0: id ranges of these widths cover ids below 54,272.
_BITS = np.repeat([6, 8, 10, 11], 16).astype(_U)
_STARTS = np.concatenate([[0], np.cumsum(1 << _BITS.astype(np.int64))])
MOST_ID = int(_STARTS[-1]) - 1
_RANGE_OF = np.repeat(np.arange(len(_BITS)), 1 << _BITS.astype(np.int64))
_RANGES = len(_BITS)
_NONE = _U16(0xFFFF)  # no id yet
_TABLE = 11  # bits of the contexts' tables
_SLOT = (1 << _TABLE) - 1
_RATE, _RIGHT = _U16(4), _U16(1535)  # how fast orders 1 and 2 gain and lose mass: of 65,536 each gets three eighths at most
_STEP, _LIMIT, _LEAST = 24, 1000, 2  # of order-0 counts; a range never gets less than _LEAST of 32,768
_NAMED, _ORDER0 = _U(16), _U(15)  # bits of the masses of the ids named, and of order 0
# The interval is kept in 62 bits; where it is below 30, the 32 bits above them are settled but for a carry.
_LOW, _WORD = _U(30), _U(32)
_BOTTOM, _UNSETTLED, _ONES = _U(1) << _LOW, (_U(1) << _LOW) - _U(1), (_U(1) << _WORD) - _U(1)


class _Models:
    """State of all blocks coded side by side; the last place of every array's shape is the block, row 0 order 1's, row 1 order 2's."""

    def __init__(self, lanes: int):
        self.stride = lanes
        self.named = np.full(2 * lanes << _TABLE, _NONE)
        self.counts = np.full(_RANGES * lanes, 4, np.int32)
        self.below = np.zeros((_RANGES + 1) * lanes, _U16)
        self.lane = np.arange(lanes)
        self.first = np.arange(2 * lanes).reshape(2, -1) << _TABLE
        self.mass = np.full((2, lanes), 12_288, _U16)
        self.last, self.mixed = np.zeros((2, lanes), np.int64)
        self.fresh: list[np.ndarray] = []

    def keep(self, n: int) -> None:
        """Go on with the first ``n`` blocks."""
        for name in ("lane", "first", "mass", "last", "mixed"):
            setattr(self, name, getattr(self, name)[..., :n])

    def sums(self, t: int) -> None:
        """Every few ids: masses of order 0 from its counts, in 1/32,768."""
        if t % 16 and (t > 32 or t % 4):
            return
        n = len(self.lane)
        if self.fresh:
            np.add.at(self.counts, np.concatenate(self.fresh), np.int32(_STEP))
            self.fresh = []
        counts = self.counts.reshape(_RANGES, -1)[:, :n]
        below = np.empty((_RANGES, n), np.int32)
        below[0] = counts[0]
        for i in range(1, _RANGES):
            np.add(below[i - 1], counts[i], out=below[i])
        full = below[-1] > _LIMIT
        below *= ((1 << int(_ORDER0)) - _RANGES * _LEAST << 12) // below[-1]
        below >>= 12
        below += np.arange(_LEAST, (_RANGES + 1) * _LEAST, _LEAST, np.int32)[:, None]
        table = self.below.reshape(_RANGES + 1, -1)[:, :n]
        table[1:] = below
        table[_RANGES] = 1 << int(_ORDER0)
        if full.any():
            np.right_shift(counts + full, full, out=counts)

    def predict(self, span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids named by orders 1 and 2; where the interval of order 2's ends, and that of order 1's after it."""
        self.at = np.array([self.last, self.last + self.mixed])
        self.at &= _SLOT
        self.at += self.first
        ids = self.named.take(self.at)
        self.known = ids != _NONE
        mass1, mass2 = self.mass * self.known
        unit = span >> _NAMED
        return ids, unit * (mass2 + mass1 * (ids[0] == ids[1])), unit * (mass1 + mass2)

    def learn(self, x: np.ndarray, right: np.ndarray, fresh: np.ndarray) -> None:
        """``fresh``: the counts of the ids that nobody named."""
        self.mass += right * _RIGHT - (self.mass >> _RATE) * self.known
        self.named[self.at] = x.astype(_U16)
        self.fresh.append(fresh)
        self.mixed, self.last = self.last * 2531, x


def encode(ids: np.ndarray, block: int = BLOCK_IDS) -> bytes:
    """Payload of ``ids`` (each from 0 to ``MOST_ID``)."""
    ids = np.asarray(ids, np.int64)
    if len(ids) and (ids.min() < 0 or ids.max() > MOST_ID):
        raise ValueError("id out of range")
    lanes = -(-len(ids) // block)
    header = MAGIC + struct.pack("<III", len(ids), block, lanes)
    if not lanes:
        return header
    padded = np.zeros(lanes * block, np.int64)
    padded[: len(ids)] = ids
    table = padded.reshape(lanes, block).T.copy()
    last = len(ids) - (lanes - 1) * block  # only the last block may be short
    models = _Models(lanes)
    lows, low, span = np.zeros(lanes, _U), np.zeros(lanes, _U), np.full(lanes, 1 << 62, _U)
    whose, words = [], []
    for t in range(min(block, len(ids))):
        if t == last:  # the short block is done
            lows[-1], low, span = low[-1], low[:-1], span[:-1]
            models.keep(lanes - 1)
        models.sums(t)
        x = table[t, : len(low)]
        r = _RANGE_OF.take(x)
        guess, end2, end1 = models.predict(span)
        right = x.astype(_U16) == guess
        second = right[1]
        named = right[0] | second
        at0 = r * models.stride + models.lane
        unit = span - end1 >> _ORDER0
        begin = models.below.take(at0)
        share = unit * (models.below.take(at0 + models.stride) - begin) >> _BITS.take(r)
        low += np.where(named, np.where(second, _U(0), end2), end1 + unit * begin + (x - _STARTS.take(r)).view(_U) * share)
        span = np.where(named, np.where(second, end2, end1 - end2), share)
        small = np.flatnonzero(span < _BOTTOM)
        settled = low.take(small)
        whose.append(small.astype(np.uint32))
        words.append(settled >> _LOW)
        low[small] = (settled & _UNSETTLED) << _WORD
        span[small] <<= _WORD
        models.learn(x, right, at0[~named])
    lows[: len(low)] = low
    whose = np.concatenate([*whose, np.arange(lanes), np.arange(lanes)])
    size = np.bincount(whose, minlength=lanes)
    flat = np.concatenate([*words, lows >> _LOW, (lows & _UNSETTLED) << _U(2)])
    flat = flat[np.argsort(whose.astype(np.min_scalar_type(lanes)), kind="stable")]
    while (carry := np.flatnonzero(flat > _ONES)).size:  # never out of a block's first word
        flat[carry] &= _ONES
        flat[carry - 1] += _U(1)
    sums = [zlib.crc32(b) for b in _block_bytes(ids, block)]
    return header + np.array([size, sums]).T.astype("<u4").tobytes() + flat.astype("<u4").tobytes()


def _block_bytes(ids: np.ndarray, block: int) -> list[memoryview]:
    """The little-endian 32-bit ids of every block."""
    data = memoryview(ids.astype("<u4").tobytes())
    return [data[i : i + 4 * block] for i in range(0, len(data), 4 * block)]


def decode(payload: bytes) -> np.ndarray:
    """The ids of a payload; an error if a block's checksum fails."""
    if payload[:4] != MAGIC:
        raise ValueError("not a payload")
    total, block, lanes = struct.unpack_from("<III", payload, 4)
    if not lanes:
        return np.zeros(0, np.int64)
    index = np.frombuffer(payload, "<u4", 2 * lanes, 16).reshape(lanes, 2).astype(np.int64)
    words = np.concatenate([np.frombuffer(payload, "<u4", -1, 16 + 8 * lanes), np.zeros(2, np.uint32)]).astype(_U)
    place = np.cumsum(index[:, 0]) - index[:, 0]
    code = words[place] << _LOW | words[place + 1] >> _U(2)  # less the encoder's low end
    words = (words[:-1] << _LOW | words[1:] >> _U(2)) & _ONES  # 62 bits are read, so what follows stands two bits off
    place += 1
    last = total - (lanes - 1) * block
    models = _Models(lanes)
    span = np.full(lanes, 1 << 62, _U)
    table = np.zeros((block, lanes), np.int64)
    for t in range(min(block, total)):
        if t == last:  # the short block is done
            code, span, place = code[:-1], span[:-1], place[:-1]
            models.keep(lanes - 1)
        models.sums(t)
        n = len(code)
        guess, end2, end1 = models.predict(span)
        named, second = code < end1, code < end2
        unit = span - end1 >> _ORDER0
        rest = code - end1  # without meaning where the id is named; so are the next lines
        value = (rest // unit).astype(_U16)
        above = models.below.reshape(_RANGES + 1, -1)[1:_RANGES, :n] <= value
        r = np.add.reduce(above.view(np.uint8), axis=0, dtype=np.uint8).astype(np.int64)
        at0 = r * models.stride + models.lane
        begin = models.below.take(at0)
        share = unit * (models.below.take(at0 + models.stride) - begin) >> _BITS.take(r)
        rest -= unit * begin
        inner = rest // share
        rest -= inner * share
        x = np.where(named, np.where(second, guess[1], guess[0]), _STARTS.take(r) + inner.view(np.int64))
        code = np.where(named, code - np.where(second, _U(0), end2), rest)
        span = np.where(named, np.where(second, end2, end1 - end2), share)
        small = np.flatnonzero(span < _BOTTOM)
        at = place.take(small)
        code[small] = code.take(small) << _WORD | words.take(at, mode="clip")
        span[small] <<= _WORD
        place[small] = at + 1
        models.learn(x, x.astype(_U16) == guess, at0[~named])
        table[t, :n] = x
    ids = table.T.reshape(-1)[: (lanes - 1) * block + last]
    for i, data in enumerate(_block_bytes(ids, block)):
        if zlib.crc32(data) != index[i, 1]:
            raise ValueError(f"checksum of block {i}")
    return ids
