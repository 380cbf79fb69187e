"""Whole numbers in compressed binary columns, the ranges of hashes that exchanges are dealt by, and sorted places."""

from __future__ import annotations

import numpy as np
import zstandard


def squeeze(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, in as few bytes as the largest takes, compressed."""
    x = x.astype(np.min_scalar_type(int(x.max(initial=0))))
    return bytes([x.itemsize]) + zstandard.ZstdCompressor(1).compress(x.tobytes())


def loosen(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), f"u{data[0]}").astype("i8")


def steps(x: np.ndarray) -> bytes:
    """Rising numbers, as differences."""
    return squeeze(np.diff(x, prepend=0))


def hash_range(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Which of `parts` equal ranges of 64 bits a hash lies in: rising as the hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype("i8")


def stable_order(x: np.ndarray) -> np.ndarray:
    """The stable argsort of whole numbers from 0 on. Numbers are sorted with their places in their lowest bits, which is
    several times faster than sorting places; what has no room for them is sorted the other way."""
    bits = len(x).bit_length()
    if int(x.max(initial=0)).bit_length() + bits > 64:
        return np.argsort(x, kind="stable")
    keyed = (x.astype("u8") << np.uint64(bits)) | np.arange(len(x), dtype="u8")
    keyed.sort()
    return (keyed & np.uint64((1 << bits) - 1)).astype("i8")


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique() of whole numbers from 0 on, with the inverse. Numbers of 64 bits are sorted by their high bits; if
    different ones are alike in those, np.unique() itself is taken."""
    bits = len(x).bit_length()
    if int(x.max(initial=0)).bit_length() + bits <= 64:
        order = stable_order(x)
    else:
        low = np.uint64((1 << bits) - 1)
        keyed = (x.astype("u8") & ~low) | np.arange(len(x), dtype="u8")
        keyed.sort()
        order = (keyed & low).astype("i8")
    found = x[order]
    if (found[1:] < found[:-1]).any():
        return np.unique(x, return_inverse=True)
    fresh, inverse = np.ones(len(x), "?"), np.empty(len(x), "i8")
    fresh[1:] = found[1:] != found[:-1]
    inverse[order] = np.cumsum(fresh) - 1
    return found[fresh], inverse
