"""64-bit hashes of the words of many texts at once, in NumPy.

Words are the runs of bytes other than ``[\\x20\\x09-\\x0D]``, A-Z lower-cased.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_VALUE = np.random.default_rng(20).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes hashed at once: each takes some 40 bytes of arrays.
BLOCK = 2 << 20
#: Places of a word whose bytes' terms are in a table.
NEAR = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _terms(byte: np.ndarray, place: np.ndarray) -> np.ndarray:
    """What a byte at a place of its word adds to the hash: not linear in the byte, so bytes that change places don't cancel out."""
    return mix(_VALUE[byte] ^ mix(place.astype(np.uint64) * _BASE + np.uint64(1)))


_TABLE = _terms(np.tile(np.arange(256), NEAR), np.repeat(np.arange(NEAR), 256))


def _hash_block(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of data."""
    solid = ~_SPACE[data]
    edge = np.diff(solid.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.uint64), start
    size = end - start
    first = np.cumsum(size) - size
    place = np.arange(int(first[-1] + size[-1])) - np.repeat(first, size)
    byte = data[solid].astype(np.int64)
    if int(size.max()) <= NEAR:
        terms = _TABLE[place * 256 + byte]
    else:
        terms = _TABLE[np.minimum(place, NEAR - 1) * 256 + byte]
        far = np.flatnonzero(place >= NEAR)
        terms[far] = _terms(byte[far], place[far])
    return mix(np.add.reduceat(terms, first) + size.astype(np.uint64)), start


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the hashes of its words, in order."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        if len(texts[at]) > BLOCK:  # in parts, cut behind white space
            data, parts, s = np.frombuffer(texts[at], np.uint8), [], 0
            while s < len(data):
                e = min(s + BLOCK, len(data))
                while e < len(data) and not _SPACE[data[e - 1]]:
                    more = np.flatnonzero(_SPACE[data[e : e + BLOCK]])
                    e = e + int(more[0]) + 1 if len(more) else min(e + BLOCK, len(data))
                parts.append(_hash_block(data[s:e])[0])
                s = e
            out.append(np.concatenate(parts))
            at += 1
            continue
        to, size = at, 0
        while to < len(texts) and size + len(texts[to]) <= BLOCK:
            size += len(texts[to]) + 1
            to += 1
        to = max(to, at + 1)
        hashes, start = _hash_block(np.frombuffer(b" ".join(texts[at:to]), np.uint8))
        ends = np.cumsum([len(t) + 1 for t in texts[at:to]])
        cuts = np.searchsorted(start, ends)
        out += np.split(hashes, cuts[:-1])
        at = to
    return out


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of fewer words, the whole sequence as one."""
    if not len(words):
        return words
    width = min(n, len(words))
    total = np.full(len(words) - width + 1, np.uint64(width))
    for i in range(width):
        total = total * _BASE + words[i : len(words) - width + 1 + i]
    return np.unique(mix(total))
