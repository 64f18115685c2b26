"""Minimal perfect hashing of integer keys by a cascade of bit arrays (Limasset et al., 2017).

Keys are dealt to buckets by hash, and each bucket is built by itself: at each level a key whose place in the level's bit
array is taken by it alone sets that bit, the others go to the next level. A key's number is the rank of its bit, so n keys
get the numbers 0 to n - 1. The keys are kept in the order of their numbers, so that a key that is not in the set is told.

Defined cases: no keys make an empty table; repeated keys are an error (``build`` is given distinct ones).
"""

from __future__ import annotations

import numpy as np

_LEVELS = 64
_BUCKET = 999  # number of the hash that deals to buckets


def mixed(keys: np.ndarray, number: int) -> np.ndarray:
    """One of a family of hashes of 64-bit keys: the finalizer of splitmix64 on the key and the hash's number."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(number + 1) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(keys, _BUCKET) % np.uint64(buckets)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of bits in each level, the words of all levels, and the keys in order of their numbers."""
    sizes, words, order = [], [], []
    while len(keys):
        if len(sizes) == _LEVELS:
            raise ValueError("keys must be distinct")
        n = max(1, -(-2 * len(keys) // 64))
        at = (mixed(keys, len(sizes)) % np.uint64(64 * n)).astype(np.int64)
        alone = np.bincount(at, minlength=64 * n)[at] == 1
        placed = np.argsort(at[alone], kind="stable")
        bits = np.zeros(64 * n, dtype=np.uint8)
        bits[at[alone]] = 1
        sizes.append(n)
        words.append(np.packbits(bits, bitorder="little").view(np.uint64))
        order.append(keys[alone][placed])
        keys = keys[~alone]
    return np.array(sizes, np.int32), np.concatenate([np.zeros(0, np.uint64), *words]), np.concatenate([np.zeros(0, np.int64), *order])


class Table:
    """All buckets' functions, in order of the buckets' numbers."""

    def __init__(self, buckets: int, built: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.buckets = buckets
        levels = max([len(sizes) for _, sizes, _, _ in built], default=0)
        self.bits, self.first, words, at = np.zeros((levels, buckets), np.int64), np.zeros((levels, buckets), np.int64), [], 0
        self.keys = np.concatenate([np.zeros(0, np.int64), *(keys for *_, keys in sorted(built, key=lambda b: b[0]))])
        for bucket, sizes, own, _ in sorted(built, key=lambda b: b[0]):
            self.bits[: len(sizes), bucket] = sizes.astype(np.int64) * 64
            self.first[: len(sizes), bucket] = (at + np.r_[0, np.cumsum(sizes[:-1])]) * 64
            words.append(own)
            at += len(own)
        self.words = np.concatenate([np.zeros(0, np.uint64), *words])
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words).astype(np.int64))[:-1]].astype(np.int64) if at else np.zeros(0, np.int64)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number, -1 if it is not in the set."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        bucket, left = bucket_of(keys, self.buckets), np.arange(len(keys))
        for level in range(len(self.bits)):
            size = self.bits[level, bucket[left]]
            left, size = left[size > 0], size[size > 0]
            if not len(left):
                break
            at = self.first[level, bucket[left]] + (mixed(keys[left], level) % size.astype(np.uint64)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = self.before[at[hit] >> 6] + below[hit]
            left = left[~hit]
        out[out >= 0] = np.where(self.keys[out[out >= 0]] == keys[out >= 0], out[out >= 0], -1)
        return out
