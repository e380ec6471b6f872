"""A cuckoo filter over 32-byte digests, as one byte string."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

SLOTS = 4
KICKS = 500


def _parts(digests: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint (never 0) and the two buckets of each digest (n x 32 bytes)."""
    words = np.ascontiguousarray(digests).view("<u4")
    prints = (words[:, 0] & 0xFFFF).astype(np.uint32)
    prints[prints == 0] = 1
    first = words[:, 1] & np.uint32(buckets - 1)
    return prints, first, _other(first, prints, buckets)


def _other(bucket, prints, buckets: int):
    """The bucket's partner: depends on the fingerprint alone, and is its own inverse."""
    spread = (prints * np.uint32(0x5BD1E995)) >> np.uint32(7)
    return (bucket ^ spread) & np.uint32(buckets - 1)


class CuckooFilter:
    """Membership with deletions; a digest that is in is always found.

    Only digests that were inserted may be deleted; the exact count table next to the
    filter makes sure of that.
    """

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def of_size(cls, keys: int) -> CuckooFilter:
        buckets = 1
        while buckets * SLOTS * 0.85 < keys + 1:
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    @classmethod
    def build(cls, digests: np.ndarray) -> CuckooFilter:
        """A filter of these digests; doubled until every one finds a slot."""
        size = len(digests)
        while True:
            made = cls.of_size(size)
            if made.insert(digests):
                return made
            size = 2 * max(size, made.table.size)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def insert(self, digests: np.ndarray) -> bool:
        """False if one found no slot; the filter is then to be built anew."""
        if not len(digests):
            return True
        table, buckets = self.table, len(self.table)
        chooser = np.random.default_rng(0)
        for print_, *places in zip(*_parts(digests, buckets), strict=True):
            for bucket in places:
                free = np.flatnonzero(table[bucket] == 0)
                if len(free):
                    table[bucket, free[0]] = print_
                    break
            else:
                bucket, held = places[0], print_
                for _ in range(KICKS):
                    slot = int(chooser.integers(SLOTS))
                    moved = np.uint32(table[bucket, slot])
                    table[bucket, slot] = held
                    held, bucket = moved, _other(bucket, moved, buckets)
                    free = np.flatnonzero(table[bucket] == 0)
                    if len(free):
                        table[bucket, free[0]] = held
                        break
                else:
                    return False
        return True

    def delete(self, digests: np.ndarray) -> None:
        if not len(digests):
            return
        for print_, *places in zip(*_parts(digests, len(self.table)), strict=True):
            for bucket in places:
                at = np.flatnonzero(self.table[bucket] == print_)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break

    def contains(self, digests: np.ndarray) -> np.ndarray:
        if not len(digests):
            return np.zeros(0, bool)
        prints, first, second = _parts(digests, len(self.table))
        both = (self.table[first] == prints[:, None]) | (self.table[second] == prints[:, None])
        return both.any(1)


def digest_matrix(digests: Iterable[bytes]) -> np.ndarray:
    data = b"".join(digests)
    return np.frombuffer(data, np.uint8).reshape(-1, 32)
