"""Vectorised hashing of words and word sequences (numpy, 64-bit, wrapping).

A chunk of texts is one flat array of characters. The hash of a slice is the sum of a number for each of its characters
that depends, mixed and not by a polynomial, on the character and its place in the slice: equal only for equal slices
but for chance, also where a text repeats itself in patterns. Sums may be taken in parts, so a slice of any length needs
no more memory than a block. Every hash depends on the characters alone, never on the chunk, the task or the machine.
"""

from __future__ import annotations

import numpy as np

#: Characters that are mixed at a time.
BLOCK = 1 << 17


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64): spreads every input bit over the whole word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _placed(chars: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A number for each character (under 2**21) at its place in a slice."""
    return mix64((chars.astype(np.uint64) | places.astype(np.uint64) << np.uint64(21)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03))


def slice_hashes(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of chars[starts[i]:ends[i]] for every i; no slice is empty."""
    sizes = ends - starts
    sums = np.empty(len(sizes), dtype=np.uint64)
    done = np.concatenate(([0], np.cumsum(sizes)))
    begin = 0
    with np.errstate(over="ignore"):
        while begin < len(sizes):
            end = max(begin + 1, int(np.searchsorted(done, done[begin] + BLOCK, side="right")) - 1)
            if sizes[begin] > BLOCK:
                end, total = begin + 1, np.uint64(0)
                for at in range(0, int(sizes[begin]), BLOCK):
                    part = chars[starts[begin] + at : min(starts[begin] + at + BLOCK, ends[begin])]
                    total += np.add.reduce(_placed(part, np.arange(at, at + len(part))))
                sums[begin] = total
            else:
                own, firsts = sizes[begin:end], done[begin:end] - done[begin]
                places = np.arange(done[end] - done[begin]) - np.repeat(firsts, own)
                sums[begin:end] = np.add.reduceat(_placed(chars[np.repeat(starts[begin:end], own) + places], places), firsts)
            begin = end
        return mix64(sums + sizes.astype(np.uint64))


def chunks_of(sizes: list[int], limit: int) -> list[tuple[int, int]]:
    """Consecutive ranges whose sizes sum to at most limit (or that hold one element)."""
    out, begin, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            out.append((begin, i))
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        out.append((begin, len(sizes)))
    return out
