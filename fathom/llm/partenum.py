"""PartEnum signatures for a Jaccard threshold (exact: every similar enough pair shares a signature).

Sizes fall into bands whose ends grow by 1/threshold**2. Instance i of the scheme serves the pairs whose larger set
lies in band i; a set signs the instance of its own band and, if a set of the next band can still be similar to it,
that one too. Sets of one instance with similarity >= threshold differ in at most k features.

The feature domain (64-bit hashes) is cut into groups of `parts` equal ranges each. Two similar sets have few
differences in some group: with d differences allowed in a group, k // (d + 1) + 1 groups hold one with at most d of
them. There at least parts - d of its ranges agree, so both sets share a subset of parts - d ranges, content for content.
A signature is a group, a subset of its ranges and what the set has in them; all subsets of that size are enumerated.
Up to ENUMERATED differences, d is 1 and groups have three ranges, of which pairs are signed; for larger sets, where
groups are many and enumeration would only multiply the signatures, d is 0 and a group is one range.

There are `spare` more groups than needed, so similar sets share at least spare + 1 signatures. Each set leaves out its
`spare` weakest ones: those with the fewest features, by a hash among equals. Of the shared signatures the strongest
stays in both sets, as at least `spare` weaker ones come before it in either. So nothing is lost, and signatures that
hold one or two features, which unrelated texts share by a common phrase, are hardly ever used.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

from .hashing import mix64

#: Differences up to which subsets of a group's ranges are enumerated.
ENUMERATED = 12


class PartEnum:
    def __init__(self, percent: int):
        if not 0 < percent <= 100:
            raise ValueError("percent must be in 1..100")
        self.percent = percent
        self._ends = [0, 1]
        self.edges, self._halves = cache(self._edges), cache(self._half_edges)

    def band(self, size: int) -> int:
        """Band i holds the sizes _ends[i] .. _ends[i + 1] - 1."""
        while self._ends[-1] <= size:
            last = self._ends[-1]
            self._ends.append(max(last + 1, last * 10000 // self.percent**2 + 1))
        return int(np.searchsorted(self._ends, size, side="right")) - 1

    def instances(self, size: int) -> list[int]:
        """The instances that a set of this size signs; none for the empty set."""
        if size == 0:
            return []
        own = self.band(size)
        self.band(self._ends[own + 1])
        return [own, own + 1] if 100 * size >= self.percent * self._ends[own + 1] else [own]

    def differences(self, instance: int) -> int:
        """Most features in which two similar sets of the instance can differ."""
        while len(self._ends) <= instance + 1:
            self.band(self._ends[-1])
        most = self._ends[instance + 1] - 1
        return 2 * most * (100 - self.percent) // (100 + self.percent)

    def shape(self, instance: int) -> tuple[int, int, int, int]:
        """(groups, ranges of a group, ranges of a signature, spare groups)."""
        k = self.differences(instance)
        if k == 0:
            return 1, 1, 1, 0
        if k <= ENUMERATED:
            spare = k // 4
            return k // 2 + 1 + spare, 3, 2, spare
        spare = k // 6
        return k + 1 + spare, 1, 1, spare

    def _edges(self, instance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lower ends of the ranges (but the first), the ranges of each signature, and a salt for each signature."""
        groups, parts, chosen, _ = self.shape(instance)
        inner = np.array([(i << 64) // (groups * parts) for i in range(1, groups * parts)], dtype=np.uint64)
        subsets = np.array([[g * parts + i for i in c] for g in range(groups) for c in combinations(range(parts), chosen)])
        with np.errstate(over="ignore"):
            return inner, subsets, mix64(np.arange(len(subsets), dtype=np.uint64) + np.uint64((instance << 32) + 1))

    def _half_edges(self, instance: int) -> np.ndarray:
        n = 2 * (self.differences(instance) + 3)
        return np.array([(j << 64) // n for j in range(1, n)], dtype=np.uint64)

    def _of_sketch(self, instance: int) -> int:
        return (len(self._halves(instance)) + 1) // 2

    def sketch(self, features: np.ndarray) -> bytes:
        """Four bits for each of twice as many ranges as features may differ, two ranges in a byte, for each instance that
        the set signs. Sets that differ in d features differ in at most d of these, so more of them rule a pair out."""
        out = []
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix64(features + np.uint64(0x2545F4914F6CDD1D)))))
            for i in self.instances(len(features)):
                cuts = np.concatenate(([0], np.searchsorted(features, self._halves(i)), [len(features)]))
                codes = (mix64(sums[cuts[1:]] - sums[cuts[:-1]]) >> np.uint64(60)).astype(np.uint8)
                out.append(codes[::2] << 4 | codes[1::2])
        return np.concatenate(out).tobytes() if out else b""

    @staticmethod
    def differing(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """In how many ranges parts of sketches differ, along the last axis."""
        both = one ^ two
        return np.count_nonzero(both & 15, axis=-1) + np.count_nonzero(both >> 4, axis=-1)

    def part_of_sketch(self, size: int, instance: int) -> slice:
        """Where a set's sketch has the bytes of an instance."""
        begin = 0
        for i in self.instances(size):
            n = self._of_sketch(i)
            if i == instance:
                return slice(begin, begin + n)
            begin += n
        raise ValueError(f"a set of size {size} does not sign instance {instance}")

    def allowed(self, size: int, other: int) -> int:
        """Most features in which two similar sets of these sizes can differ."""
        return (size + other) * (100 - self.percent) // (100 + self.percent)

    def signatures(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All signatures of a set, given as its sorted distinct feature hashes, and the instance of each."""
        out, of = [], []
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix64(features + np.uint64(0x632BE59BD9B4E019)))))
            for i in self.instances(len(features)):
                inner, subsets, salts = self.edges(i)
                cuts = np.concatenate(([0], np.searchsorted(features, inner), [len(features)]))
                content, held = mix64(sums[cuts[1:]] - sums[cuts[:-1]]), np.diff(cuts)
                codes = salts.copy()
                for column in range(subsets.shape[1]):
                    codes = mix64(codes + content[subsets[:, column]])
                spare = self.shape(i)[3]
                if spare:
                    order = np.lexsort((codes, held[subsets].sum(axis=1)))
                    codes = codes[order[spare:]]
                out.append(codes)
                of.append(np.full(len(codes), i, dtype=np.int32))
        return (np.concatenate(out), np.concatenate(of)) if out else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32))
