"""Plain Python that runs on the executors: words, hashes and fingerprints of single texts."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
GAP = re.compile(rb"[\x20\x09-\x0D]")
BLOCK = 1 << 22


def release() -> None:
    """Hand freed memory back to the system, so that a worker that waits for its next task is small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no such function in this C library
        return


def word_lists(text: str | None, block: int = BLOCK) -> Iterator[list[bytes]]:
    """The lower-cased (A-Z) words of a text, some MB of it at a time."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(LOWER)
    at = 0
    while at < len(data):
        cut = GAP.search(data, at + block) if at + block < len(data) else None
        end = cut.start() if cut else len(data)
        if found := data[at:end].split():  # at the same bytes as WORD, in half its time
            yield found
        at = end + 1


def shingle_lists(text: str | None, k: int) -> Iterator[list[bytes]]:
    """The space-joined ``k``-word shingles, repeats included; a text of fewer words is one shingle, a wordless one has none."""
    held: list[bytes] = []
    any_yet = False
    for found in word_lists(text):
        held += found
        if len(held) >= k:
            yield [b" ".join(x) for x in zip(*(held[i:] for i in range(k)), strict=False)]
            any_yet, held = True, held[len(held) - k + 1 :]
    if held and not any_yet:
        yield [b" ".join(held)]


def majority(hash_lists: Iterator[np.ndarray], bits: int) -> np.ndarray:
    """Little-endian bits (0 or 1), each 1 where over half the hashes have it."""
    total, ones = 0, np.zeros(bits, dtype=np.int64)
    for h in hash_lists:
        rows = np.ascontiguousarray(h).view(np.uint8).reshape(len(h), bits // 8)
        ones += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(h)
    return (2 * ones > total).astype(np.uint8)


def simhash64(text: str | None, k: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's ``k``-word shingles under XXH64; zero without words."""
    digest = xxhash.xxh64_intdigest
    lists = (np.array([digest(s, seed) for s in x], dtype="<u8") for x in shingle_lists(text, k))
    return int(np.packbits(majority(lists, 64), bitorder="little").view("<u8")[0])


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each lower-cased (A-Z) word of a text."""
    digest = xxhash.xxh64_intdigest
    parts = [np.array([digest(w, 11) for w in x], dtype=np.uint64) for x in word_lists(text)]
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)


BASE = 0x9E3779B97F4A7C15 | 1


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each ``k`` consecutive words; empty for fewer words. Differences of weighted sums, modulo 2**64."""
    n = len(words)
    if n < k:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, BASE, dtype=np.uint64)], dtype=np.uint64)
        down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, pow(BASE, -1, 1 << 64), dtype=np.uint64)], dtype=np.uint64)
        sums = np.r_[np.uint64(0), np.cumsum(words * down, dtype=np.uint64)]
        h = (sums[k:] - sums[:-k]) * up[: n - k + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))
