"""The binary Golay code [23, 12, 7]: which codewords lie within four bits of a 23-bit word.

The code is perfect: each word lies within three bits of exactly one codeword. Two words that differ in one bit at most
therefore share one: the nearest codeword of either lies within four bits of the other.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, a factor of x^23 + 1.
GENERATOR = 0b110001110101
LENGTH, DIMENSION = 23, 12


def syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder of each word modulo the generator."""
    words = words.astype(np.int64)
    for bit in range(LENGTH - 1, LENGTH - DIMENSION, -1):
        words = np.where(words >> bit & 1, words ^ GENERATOR << (bit - DIMENSION + 1), words)
    top = words >> (LENGTH - DIMENSION) & 1
    return np.where(top, words ^ GENERATOR, words)


@cache
def errors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest, near, number): by syndrome the error of at most three bits, and all errors of at most four.

    near has six columns, of which the first ``number`` hold errors.
    """
    bits = 1 << np.arange(LENGTH)
    patterns = [np.zeros(1, np.int64)]
    for _ in range(4):
        last = patterns[-1]
        more = (last[:, None] | bits[None, :])[(bits[None, :] > last[:, None])]
        patterns.append(more)
    size = 1 << (LENGTH - DIMENSION)
    nearest = np.zeros(size, np.int64)
    few = np.concatenate(patterns[:4])
    nearest[syndrome(few)] = few
    every = np.concatenate(patterns)
    of = syndrome(every)
    order = np.argsort(of, kind="stable")
    number = np.bincount(of, minlength=size)
    near = np.zeros((size, int(number.max())), np.int64)
    place = np.arange(len(every)) - np.repeat(np.cumsum(number) - number, number)
    near[of[order], place] = every[order]
    return nearest, near, number


def index(codewords: np.ndarray) -> np.ndarray:
    """The 12-bit index of each codeword: its upper bits, of which the others are a function."""
    return codewords >> (LENGTH - DIMENSION)


def nearest(words: np.ndarray) -> np.ndarray:
    """Index of the codeword within three bits."""
    return index(words ^ errors()[0][syndrome(words)])


def within_four(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices, number): for each word the indices of the codewords within four bits, in its first columns."""
    s = syndrome(words)
    _, near, number = errors()
    return index(words[:, None] ^ near[s]), number[s]
