"""The binary Golay code (23, 12): every 23-bit word lies within 3 bits of exactly one of 4,096 codewords.

Words at distance 2 or less have a common neighbour, so the codeword sets of their radius-1 balls meet; a word's ball also
holds every word at distance 1. Both facts hold for shorter words (padded with zero bits that are never flipped).
"""

from __future__ import annotations

import functools
import itertools

import numpy as np

#: Fixed value: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@functools.lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of each byte in each of three places; the error pattern of each syndrome."""
    by_byte = np.array([[_remainder((v << shift) & 0x7FFFFF) for v in range(256)] for shift in (0, 8, 16)], np.int64)
    errors = np.zeros(2048, np.int64)
    for n in (1, 2, 3):
        for bits in itertools.combinations(range(23), n):
            word = sum(1 << b for b in bits)
            errors[_remainder(word)] = word
    return by_byte, errors


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each word of up to 23 bits."""
    by_byte, errors = _tables()
    syndrome = by_byte[0][words & 255] ^ by_byte[1][words >> 8 & 255] ^ by_byte[2][words >> 16 & 255]
    return (words ^ errors[syndrome]) >> 11


def ball(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codeword indices of the words within one bit of each word: (position of the word, index)."""
    flips = np.concatenate([[0], 1 << np.arange(width)]).astype(np.int64)
    found = np.sort(decode(words[:, None] ^ flips), axis=1)
    first = np.ones(found.shape, bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    at, _ = np.nonzero(first)
    return at, found[first]
