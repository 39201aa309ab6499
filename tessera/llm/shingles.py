"""Word shingles as 64-bit hashes, for the operators that work on Arrow batches."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import xxhash

WORDS = 5
_CACHE = 400_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SHIFT = np.uint64(31)


class WordHashes(dict):
    """Word to 64-bit hash; emptied when full, so that memory stays bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_hashes = WordHashes()


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def hash_words(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


#: White space as ``str.split`` has it, by code point; all beyond the table is none. The same for bytes of Latin-1.
_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])
_SPACE_BYTES = _SPACE[:256].tobytes()
_BASE = np.uint64(0xD1342543DE82EF95)
#: Characters that are looked at together.
_PIECE = 1 << 18
_space = re.compile(r"\s")


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers modulo 2^64, and their inverses."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, x)])) for x in (_BASE, inverse))


def hash_text(text: str | None) -> np.ndarray:
    """A 64-bit hash for each of ``words_of`` a text, from a running sum over its code points, without a string for each word.

    Long texts go piece by piece, cut at white space.
    """
    out, at, text = [], 0, text or ""
    while at < len(text):
        cut = _space.search(text, at + _PIECE) if len(text) - at > _PIECE else None
        end = cut.end() if cut else len(text)
        out.append(_hashed_words(text[at:end].lower()))
        at = end
    return out[0] if len(out) == 1 else np.concatenate([np.empty(0, np.uint64), *out])


def _hashed_words(text: str) -> np.ndarray:
    text = f" {text} "
    try:
        held = text.encode("latin-1")
        c, space = np.frombuffer(held, np.uint8), np.frombuffer(held.translate(_SPACE_BYTES), bool)
    except UnicodeEncodeError:
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        space = _SPACE.take(c, mode="clip")
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _powers(max(2 * _PIECE, 1 << len(c).bit_length() if len(c) > 2 * _PIECE else 0))
    # a code point of 0 counts too
    total = np.add(c, 1, dtype=np.uint64)
    total *= power[: len(c)]
    np.cumsum(total, out=total)
    return mixed((total[ends] - total[starts]) * inverse[starts])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> _SHIFT)
    x *= _MIX
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> _SHIFT
    return x


def shingle_hashes(word_hashes: np.ndarray, n: int = WORDS) -> np.ndarray:
    """A hash for each run of n words; one for the whole of a shorter text; none for an empty one."""
    if not len(word_hashes):
        return word_hashes
    n = min(n, len(word_hashes))
    m = len(word_hashes) - n + 1
    out = np.full(m, n, np.uint64)
    for i in range(n):
        out *= _MULTIPLIER
        out += word_hashes[i : i + m]
    return mixed(out)


def permutations(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of k hash functions of 64-bit numbers."""
    r = np.random.default_rng(seed)
    return r.integers(0, 2**63, k, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, k, np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value under each function; the high bits decide, so a plain multiply is enough."""
    return np.array([(shingles * x + y).min() for x, y in zip(a, b, strict=True)], np.uint64)
