"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified as larger (L) or smaller (S) than their right neighbour. The leftmost S suffixes of each run
are sorted, by recursion on the names of their substrings, and all others are induced from them in two passes. Over few
letters a pass visits the buckets of first letters in turn and moves each bucket's predecessors in one stable counting
sort, so that Python sees only one step for each bucket and each repeat of a letter. In a short text, or over many
letters, whose buckets are small, it visits the suffixes one by one. Both are linear.

The names of a recursion are many. They are spelled as two digits each where the string of digits is still shorter than
the one that the names stand for by a tenth: suffixes that begin at a name keep their order, and digits are few letters.
"""

from __future__ import annotations

import numpy as np

#: Letters up to which a pass moves whole buckets, and the length of text, in letters of the alphabet, from which it does.
LETTERS, LONG = 512, 100


def types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last position holds the unique least letter."""
    n = len(text)
    step = np.sign(text[1:].astype(np.int64) - text[:-1])
    known = np.where(step != 0, np.arange(n - 1), n - 1)
    nearest = np.minimum.accumulate(known[::-1])[::-1]
    return np.append(np.append(step, 1)[nearest] > 0, True)


def induce(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array that follows from seeds, the leftmost S positions in the order that they are to have."""
    n = len(text)
    counts = np.bincount(text, minlength=sigma)
    ends = np.cumsum(counts)
    begins = ends - counts
    if sigma > LETTERS or n < LONG * sigma:
        return _induce_each(text, smaller, seeds, begins, ends)
    larger = np.bincount(text[~smaller], minlength=sigma)
    sa = np.full(n, -1, np.int64)
    letters = text[seeds]
    order = np.argsort(letters, kind="stable")
    seeds, letters = seeds[order], letters[order]
    number = np.bincount(letters, minlength=sigma)
    seeds_end = ends.copy()
    sa[ends[letters] - number[letters] + np.arange(len(seeds)) - (np.cumsum(number) - number)[letters]] = seeds
    head = begins.copy()

    def spread(j: np.ndarray, free: np.ndarray, sign: int) -> None:
        c = text[j]
        order = np.argsort(c, kind="stable")
        j, c = j[order], c[order]
        k = np.bincount(c, minlength=sigma)
        rank = np.arange(len(j)) - (np.cumsum(k) - k)[c]
        sa[free[c] + rank if sign > 0 else free[c] - 1 - rank] = j
        free += sign * k

    for c in np.flatnonzero(counts):
        lo = begins[c]
        while lo < head[c]:
            hi = head[c]
            j = sa[lo:hi] - 1
            j = j[j >= 0]
            spread(j[~smaller[j]], head, 1)
            lo = hi
        j = sa[seeds_end[c] - number[c] : seeds_end[c]] - 1
        j = j[j >= 0]
        spread(j[~smaller[j]], head, 1)
    tail = ends.copy()
    for c in np.flatnonzero(counts)[::-1]:
        hi = ends[c]
        while hi > tail[c]:
            lo = tail[c]
            j = sa[lo:hi][::-1] - 1
            j = j[j >= 0]
            spread(j[smaller[j]], tail, -1)
            hi = lo
        j = sa[begins[c] : begins[c] + larger[c]][::-1] - 1
        j = j[j >= 0]
        spread(j[smaller[j]], tail, -1)
    sa[0] = n - 1
    return sa


def _induce_each(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """induce() suffix by suffix."""
    letter, is_smaller, tail = text.tolist(), smaller.tolist(), ends.tolist()
    sa = [0] * len(letter)  # nothing is induced from suffix 0, so that 0 stands for an empty place too
    for i in seeds[::-1].tolist():
        c = letter[i]
        tail[c] -= 1
        sa[tail[c]] = i
    head = begins.tolist()
    for i in sa:  # sees what the loop itself places further on
        if i and not is_smaller[i - 1]:
            c = letter[i - 1]
            sa[head[c]] = i - 1
            head[c] += 1
    tail = ends.tolist()
    for at in range(len(sa) - 1, -1, -1):
        i = sa[at]
        if i and is_smaller[i - 1]:
            c = letter[i - 1]
            tail[c] -= 1
            sa[tail[c]] = i - 1
    return np.array(sa, np.int64)


def same_substrings(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the substrings of the given lengths at a and at b agree."""
    out = np.ones(len(a), bool)
    open_ = np.flatnonzero(length > 0)
    for k in range(64):
        out[open_] = text[a[open_] + k] == text[b[open_] + k]
        open_ = open_[out[open_] & (length[open_] > k + 1)]
        if not len(open_):
            return out
    for p in open_.tolist():  # long ones, pair by pair
        out[p] = np.array_equal(text[a[p] : a[p] + length[p]], text[b[p] : b[p] + length[p]])
    return out


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array of text, whose last letter is 0 and stands nowhere else; letters are under sigma."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    smaller = types(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    sa = induce(text, smaller, lms, sigma)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    in_order = sa[is_lms[sa]]
    end = np.zeros(n, np.int64)
    end[lms] = np.append(lms[1:], lms[-1])
    a, b = in_order[:-1], in_order[1:]
    length = end[b] - b + 1
    same = (end[a] - a + 1) == length
    same[same] = same_substrings(text, a[same], b[same], length[same])
    names = np.zeros(n, np.int64)
    names[in_order] = np.concatenate(([0], np.cumsum(~same)))
    reduced = names[lms]
    top = int(names[in_order[-1]]) + 1
    if top < len(lms):
        in_order = lms[_order_of_names(reduced, top, n)]
    return induce(text, smaller, in_order, sigma)


def _order_of_names(names: np.ndarray, top: int, n: int) -> np.ndarray:
    """The suffix array of names, under top, which stand for a text of n letters."""
    base = int(np.ceil(np.sqrt(top)))
    if top <= LETTERS or base >= LETTERS or 2 * len(names) > 0.9 * n or 2 * len(names) < 10 * LONG * base:
        return suffix_array(names.astype(np.uint16 if top <= LETTERS else np.int64), top)
    digits = np.zeros(2 * len(names) + 1, np.uint16)
    digits[:-1:2], digits[1::2] = names // base + 1, names % base + 1
    sa = suffix_array(digits, base + 1)
    return sa[(sa % 2 == 0) & (sa < 2 * len(names))] // 2


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """PLCP: for each position the common prefix with the suffix before it in the suffix array.

    PLCP[i] >= PLCP[i-1] - 1, with equality wherever the letters before the two suffixes agree; only the other,
    irreducible positions are compared letter by letter, eight letters at a time.
    """
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    known = phi >= 0
    head = np.ones(n, bool)
    inner = known & (i > 0) & (phi > 0)
    j = np.flatnonzero(inner)
    head[j] = (text[j - 1] != text[phi[j] - 1]) | (phi[j - 1] != phi[j] - 1)
    head &= known
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = text
    words = np.lib.stride_tricks.as_strided(padded, (n + 9, 8), (1, 1))
    a = np.flatnonzero(head)
    b, length, open_ = phi[a], np.zeros(len(a), np.int64), np.arange(len(a))
    while len(open_):
        x, y = a[open_] + length[open_], b[open_] + length[open_]
        same = (words[x] == words[y]) & (np.maximum(x, y)[:, None] + np.arange(8) < n)
        k = np.where(same.all(1), 8, same.argmin(1))
        length[open_] += k
        open_ = open_[(k == 8) & (np.maximum(x, y) + 8 < n)]
    plcp = np.zeros(n, np.int64)
    plcp[a] = length
    last = np.maximum.accumulate(np.where(head | ~known, i, 0))
    plcp = np.where(known, np.maximum(plcp[last] - (i - last), 0), 0)
    return plcp
