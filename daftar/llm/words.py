"""Words `[^\\x20\\x09-\\x0D]+` of whole batches of texts, and 64-bit hashes of words and of runs of words, as numpy arrays.

A word's hash takes eight bytes at a time through a mixing step; a run's hash is a tree of mixing steps over its words' hashes, so that no pattern
of letters or words makes two of them equal by construction. Different words or runs collide by chance alone, about once in 2**64 pairs.
"""

from __future__ import annotations

import numpy as np
import xxhash

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEYS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9)
#: Words of more bytes are hashed one by one by xxhash; shorter ones eight bytes at a time.
_SHORT = 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all else unchanged."""
    return _LOWER[data]


def spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts in `data`, and for each text the index of its first word (one more at the end). between: a flag per byte that is in no word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~between[data]
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    before[offsets[offsets < len(data)]] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[-1], after[:-1] = False, solid[1:]
    after[offsets[offsets > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _met(x: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
    """One hash of two in their order."""
    return mix(mix(x + np.uint64(_KEYS[seed])) ^ (y * np.uint64(_KEYS[(seed + 1) % 3] | 1)))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from every place on
    size = ends - starts
    out = mix(size.astype(np.uint64) * np.uint64(_KEYS[0]))
    left = np.flatnonzero(size <= _SHORT)
    done = 0
    while len(left):
        rest = np.minimum(size[left] - done, 8).astype(np.uint64)
        lane = eights[starts[left] + done] & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * rest))
        out[left] = _met(out[left], lane, 0)
        done += 8
        left = left[size[left] > done]
    for i in np.flatnonzero(size > _SHORT).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return out


def run_hashes(words: np.ndarray, at: np.ndarray, length: int, seed: int = 1) -> np.ndarray:
    """Hashes of the runs of `length` words that begin at the indexes `at`; every run lies inside `words`."""
    if not len(at):
        return np.zeros(0, np.uint64)
    out, begun, power, size = None, 0, words, 1  # power: hashes of the runs of `size` words from every index on
    while True:
        if length & size:
            part = power[at + begun]
            out = part if out is None else _met(out, part, seed)
            begun += size
        if begun == length:
            return mix(out ^ np.uint64(length * _KEYS[seed] % 2**64))
        power = _met(power[:-size], power[size:], (seed + 1) % 3)
        size *= 2


def whole_hashes(data: bytes, offsets: list[int], some: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of the words of some texts, joined by one space, as two columns of 64 bits."""
    found = [xxhash.xxh3_128_intdigest(b" ".join(data[offsets[i] : offsets[i + 1]].split())) for i in some]
    return np.array([h & (2**64 - 1) for h in found], np.uint64), np.array([h >> 64 for h in found], np.uint64)
