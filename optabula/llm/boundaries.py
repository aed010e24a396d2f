"""A compressed sorted set of offsets, made for `select`: the k-th smallest member.

Offsets are cut into chunks of 2**16. A chunk that holds members is a container of the kind that
takes the fewest bytes: a sorted array, a bitmap or a list of runs. Cumulative cardinalities over
the containers lead `select` to one container by binary search; the container answers locally.
"""

from __future__ import annotations

import numpy as np

CHUNK_BITS = 16
CHUNK = 1 << CHUNK_BITS
WORD = 64


class ArrayContainer:
    """The low halves of the members, sorted."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def n_bytes(self) -> int:
        return self.low.nbytes

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """One bit per place of the chunk, with the members counted before each word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(CHUNK, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(counts) - counts

    def n_bytes(self) -> int:
        return self.words.nbytes + self.before.nbytes

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        word = int(self.words[at])
        for _ in range(k - int(self.before[at])):
            word &= word - 1  # drop the lowest member
        return at * WORD + (word & -word).bit_length() - 1


class RunContainer:
    """First member of each run of consecutive members, with the members counted before it."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray):
        self.starts, self.before = starts.astype(np.uint16), np.cumsum(lengths) - lengths
        self.before = self.before.astype(np.int32)

    def n_bytes(self) -> int:
        return self.starts.nbytes + self.before.nbytes

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[at]) + k - int(self.before[at])


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container of sorted distinct places of a chunk."""
    breaks = np.flatnonzero(np.diff(low) != 1) + 1
    n_runs = len(breaks) + 1
    as_array, as_bitmap, as_runs = 2 * len(low), CHUNK // 8 + 4 * (CHUNK // WORD), 6 * n_runs
    if as_runs < min(as_array, as_bitmap):
        first = np.r_[0, breaks]
        return RunContainer(low[first], np.diff(np.r_[first, len(low)]))
    return ArrayContainer(low) if as_array <= as_bitmap else BitmapContainer(low)


class BoundarySet:
    """A set of sorted distinct offsets from 0 up."""

    def __init__(self, offsets: np.ndarray):
        offsets = np.asarray(offsets, np.int64)
        chunks = offsets >> CHUNK_BITS
        cuts = np.flatnonzero(np.diff(chunks)) + 1
        parts = np.split(offsets, cuts) if len(offsets) else []
        self.first = [int(p[0]) >> CHUNK_BITS << CHUNK_BITS for p in parts]
        self.containers = [container(p & (CHUNK - 1)) for p in parts]
        self.cumulative = np.cumsum([len(p) for p in parts]) if parts else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return int(self.cumulative[-1]) if len(self.cumulative) else 0

    def select(self, k: int) -> int:
        """The k-th smallest offset, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(f"{k} is not below the {len(self)} members")
        at = int(np.searchsorted(self.cumulative, k, side="right"))
        before = int(self.cumulative[at - 1]) if at else 0
        return self.first[at] + self.containers[at].select(k - before)
