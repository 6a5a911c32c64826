"""Word shingles of whole texts as sets of 64-bit numbers (numpy, inside tasks)."""

from __future__ import annotations

import hashlib

import numpy as np

BUCKETS = 1 << 16


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct ``width``-word shingles of a text, sorted; a shorter text is one shingle.

    A-Z are lower-cased and words are runs of anything but space and \\t-\\r.
    """

    def __init__(self, width: int = 5):
        self.width, self.hash = width, _WordHash()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").lower().split()
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.hash.__getitem__, words), np.uint64, n)
        k = min(n, self.width)
        with np.errstate(over="ignore"):
            x = _mix(h[:n - k + 1] + np.uint64(k))
            for i in range(1, k):
                x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i:n - k + 1 + i])
        return np.unique(x)


def set_id(shingles: np.ndarray) -> int:
    """A number for the set: equal sets, equal numbers."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def min_hash_bands(shingles: np.ndarray, bands: int) -> list[int]:
    """Numbers that near sets often share: each mixes two min-hashes (none for the empty set).

    The numbers of a set are sorted and even, so the least of each equal range of them is a
    min-hash (of the next range where one is empty)."""
    if not len(shingles):
        return []
    width = (1 << 64) // (2 * bands)
    edges = np.array([k * width for k in range(2 * bands)], np.uint64)
    least = shingles[np.searchsorted(shingles, edges) % len(shingles)]
    return (_mix(least[::2] * np.uint64(0xBF58476D1CE4E5B9) + least[1::2]) + np.arange(bands, dtype=np.uint64)).view(np.int64).tolist()


def bucket_counts(shingles: np.ndarray) -> np.ndarray:
    return np.bincount((shingles >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)


def ordered(shingles: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Shingles renamed so that their numeric order is the global order: rare buckets first.

    ``rank`` permutes the buckets (the top 16 bits), so renaming is one-to-one."""
    out = (rank[(shingles >> np.uint64(48)).astype(np.int64)] << np.uint64(48)) | (shingles & np.uint64((1 << 48) - 1))
    out.sort()
    return out


def parity_map(shingles: np.ndarray) -> bytes:
    """One parity bit per slot, with at least twice as many slots as shingles (a power of two)."""
    slots = 1 << max(6, int(2 * len(shingles) - 1).bit_length())
    low = _mix(shingles)
    hits = np.bincount((low & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(hits.astype(np.uint8), bitorder="little").tobytes()


def parity_distance(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets: odd slots of their difference."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())
