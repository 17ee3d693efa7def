"""Word shingles as 64-bit numbers, computed by NumPy over blocks of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
#: The six ASCII blanks that end a word.
BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of text that are hashed together.
BLOCK = 1 << 17

_blank = np.zeros(256, bool)
_blank[list(BLANKS)] = True
_BASE = U(0x9E3779B97F4A7C15)


def _random(n: int, seed: int) -> np.ndarray:
    return np.random.RandomState(seed).randint(0, 1 << 32, (n, 2)).astype(U) @ np.array([1 << 32, 1], U) | U(1)


_letter = _random(256, 7)
_letter[65:91] = _letter[97:123]  # A-Z count as a-z
_place = _random(64, 11)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word, where it starts)."""
    letters = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate(([1], _blank[letters].view(np.int8), [1])))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.empty(0, U), start
    length = end - start
    first = np.cumsum(length) - length
    inner = np.arange(int(length.sum())) - np.repeat(first, length)
    powers = np.multiply.accumulate(np.full(int(length.max()), _BASE, U))
    terms = _letter[letters[np.repeat(start, length) + inner]] * powers[inner]
    return mixed(np.add.reduceat(terms, first)), start


def _combined(words: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(words) - k + 1, U)
    for i in range(k):
        out += words[i : len(out) + i] * _place[i % 64] + U(i)
    return mixed(out)


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of k words, ascending; with fewer words the whole sequence is one; without words there are none."""
    i = 0
    while i < len(texts):
        j, held = i, 0
        while j < len(texts) and (j == i or held + len(texts[j]) <= BLOCK):
            held += len(texts[j]) + 1
            j += 1
        words, start = word_hashes(b" ".join(texts[i:j]))
        ends = np.cumsum([len(t) + 1 for t in texts[i:j]])
        upto = np.searchsorted(start, ends)
        every = _combined(words, k) if len(words) >= k else np.empty(0, U)
        at = 0
        for to in upto:
            n = int(to) - at
            if n >= k:
                yield np.unique(every[at : to - k + 1])
            elif n:
                yield mixed(_combined(words[at:to], n) + U(n))
            else:
                yield np.empty(0, U)
            at = int(to)
        i = j


def set_hash(shingles: np.ndarray) -> int:
    """A number for a set: as a signed 64-bit integer."""
    total = np.add.reduce(mixed(shingles ^ U(0xD6E8FEB86659FD93)), dtype=U) + U(len(shingles))
    return int(mixed(np.array([total], U)).view(np.int64)[0])
