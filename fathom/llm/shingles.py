"""Sets of hashed word shingles of whole texts.

Words are maximal runs of anything but the ASCII white space characters, with A-Z lower-cased. A text with fewer
words than the shingle width gives its whole word sequence as one shingle; one without words gives the empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .hashing import chunks_of, mix64, slice_hashes

CHUNK_BYTES = 1 << 18
_SPACE = bytes(range(9, 14)) + b" "
#: A-Z to a-z, every separator to a blank.
_FOLD = bytes(32 if i in _SPACE else i + 32 if 65 <= i <= 90 else i for i in range(256))


def word_hashes(folded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text (separators are blanks) and each text's first word index, plus the end."""
    joined = b" ".join(folded) + b" "
    chars = np.frombuffer(joined, dtype=np.uint8)
    word = np.zeros(len(chars) + 1, dtype=bool)
    np.not_equal(chars, 32, out=word[1:])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    sizes = np.fromiter(map(len, folded), dtype=np.int64, count=len(folded)) + 1
    firsts = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    return slice_hashes(chars, starts, ends), firsts


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the shingle that begins at each word of a chunk, and how many of them each text has."""
    counts = np.diff(firsts)
    codes = np.zeros(len(words), dtype=np.uint64)
    padded = np.concatenate((words, np.zeros(width, dtype=np.uint64)))
    for j in range(width):
        codes = codes * np.uint64(0xD6E8FEB86659FD93) + padded[j : j + len(words)]
    codes = mix64(codes)
    for t in np.flatnonzero((counts > 0) & (counts < width)):
        short = np.uint64(counts[t])
        for w in words[firsts[t] : firsts[t + 1]]:
            short = short * np.uint64(0xA0761D6478BD642F) + w
        codes[firsts[t]] = mix64(np.array([short], dtype=np.uint64))[0]
    return codes, np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))


def shingle_sets(texts: list[str | None], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(position of the text, its sorted distinct shingle hashes) for every text, in order."""
    folded = [(t or "").encode("utf-8", "surrogatepass").translate(_FOLD) for t in texts]
    for begin, end in chunks_of([len(f) for f in folded], CHUNK_BYTES):
        with np.errstate(over="ignore"):
            words, firsts = word_hashes(folded[begin:end])
            codes, counts = shingle_hashes(words, firsts, width)
        for t in range(end - begin):
            own = np.sort(codes[firsts[t] : firsts[t] + counts[t]])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            yield begin + t, own
