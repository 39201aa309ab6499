"""CRC-32C of many byte strings at once, with NumPy.

A checksum of zero start is linear over XOR, and zero bytes in front of a string do
not change it. So strings are padded in front to whole blocks, all blocks advance
together through byte tables, and a block's value is carried over the bytes behind
it by tables for each power of two of blocks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: The reflected polynomial, the start and final value, the addend of masked checksums.
_POLYNOMIAL, _ONES, _DELTA = np.uint32(0x82F63B78), np.uint32(0xFFFFFFFF), np.uint32(0xA282EAD8)
_BLOCK = 64


@lru_cache(1)
def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ _POLYNOMIAL, t >> np.uint32(1))
    return t


@lru_cache(1)
def _slices() -> np.ndarray:
    """Row k: the value of a byte with k zero bytes behind it."""
    rows = [_byte_table()]
    for _ in range(7):
        rows.append(_byte_table()[rows[-1] & 255] ^ (rows[-1] >> np.uint32(8)))
    return np.stack(rows)


@lru_cache(64)
def _shift(power: int) -> np.ndarray:
    """Four tables, one for each byte of a value, that carry it over 2^power bytes."""
    if power:
        half = _shift(power - 1)
        return _apply(half, half)
    own = np.arange(256, dtype=np.uint32)
    one = lambda v: _byte_table()[v & 255] ^ (v >> np.uint32(8))
    return np.stack([one(own << np.uint32(8 * i)) for i in range(4)])


def _apply(tables: np.ndarray, v: np.ndarray) -> np.ndarray:
    return tables[0][v & 255] ^ tables[1][(v >> np.uint32(8)) & 255] ^ tables[2][(v >> np.uint32(16)) & 255] ^ tables[3][v >> np.uint32(24)]


def _carried(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each value carried over n bytes."""
    v, power = v.copy(), 0
    while (n >> power).any():
        on = np.flatnonzero((n >> power) & 1)
        v[on] = _apply(_shift(power), v[on])
        power += 1
    return v


def checksums(strings: list[bytes]) -> np.ndarray:
    """The CRC-32C of each string."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    n = -(-size // _BLOCK)
    pad = n * _BLOCK - size
    zero = bytes(_BLOCK)
    whole = np.frombuffer(b"".join([x for p, s in zip(pad.tolist(), strings, strict=True) for x in (zero[:p], s)]), np.uint8).reshape(-1, _BLOCK)
    value, t = np.zeros(len(whole), np.uint32), _slices()
    for i in range(0, _BLOCK, 8):
        low = value ^ whole[:, i : i + 4].copy().view("<u4")[:, 0]
        value = t[7][low & 255] ^ t[6][(low >> np.uint32(8)) & 255] ^ t[5][(low >> np.uint32(16)) & 255] ^ t[4][low >> np.uint32(24)]
        value ^= t[3][whole[:, i + 4]] ^ t[2][whole[:, i + 5]] ^ t[1][whole[:, i + 6]] ^ t[0][whole[:, i + 7]]
    owner = np.repeat(np.arange(len(strings)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    value = _carried(value, (n[owner] - 1 - place) * _BLOCK)
    out = _carried(np.full(len(strings), _ONES), size)
    np.bitwise_xor.at(out, owner, value)
    return out ^ _ONES


def masked(v: np.ndarray) -> np.ndarray:
    """Rotated by 15 bits and moved, so that checksums of data that hold checksums stay good."""
    return ((v >> np.uint32(15)) | (v << np.uint32(17))) + _DELTA
