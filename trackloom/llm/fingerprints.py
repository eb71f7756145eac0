"""SimHash fingerprints of texts, computed in numpy inside a task."""

from __future__ import annotations

import numpy as np
import xxhash

#: Shingles hashed at once: 64 bit counters for so many take 4 MB.
_BLOCK = 1 << 16


def shingle_hashes(text: str | None, words: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every word shingle, repeats included.

    A-Z is lower-cased, words are runs of anything but ASCII white space, a shingle is ``words`` of them joined by one
    space. Fewer words give one hash of them all, no word gives none.
    """
    # bytes.lower() and bytes.split() know ASCII only, which is just what is asked for
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = [
        digest(joined[a:b], seed)
        for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    ]
    return np.array(hashes, np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; 0 for none."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        some = np.ascontiguousarray(hashes[at : at + _BLOCK].astype("<u8"))
        bits = np.unpackbits(some.view(np.uint8), bitorder="little").reshape(-1, 64)
        total += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint as an unsigned integer; 0 for a text without words."""
    return majority(shingle_hashes(text, words, seed))
