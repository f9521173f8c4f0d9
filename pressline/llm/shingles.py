"""Word shingle sets of many texts at once, as sorted arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain

import numpy as np
import xxhash

#: Fixed odd multipliers of the hashes.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= _MIX
    h ^= h >> np.uint64(29)
    h *= _BASE
    h ^= h >> np.uint64(32)
    return h


def word_hashes(words: Iterable[bytes], n: int) -> np.ndarray:
    """The xxh3 hash of each of ``n`` words, taken over all its bytes."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)


def shingle_sets(texts: list[bytes | None], words: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of ``words`` words (lower-cased A-Z, parted by
    ASCII white space); with fewer words the whole sequence is the only one; without words there is none."""
    split = [(t or b"").lower().split() for t in texts]
    cuts = np.cumsum([0, *map(len, split)])
    hashes = word_hashes(chain.from_iterable(split), int(cuts[-1]))
    salt = np.cumprod(np.full(words, _BASE), dtype=np.uint64) ^ np.uint64(0xA5A5A5A5)
    salt = salt | np.uint64(1)
    n = max(0, len(hashes) - words + 1)
    grams = np.zeros(n, np.uint64)
    for k in range(words):
        grams += hashes[k:k + n] * salt[k]
    grams = _mixed(grams)
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(unique_sorted(grams[a:b - words + 1]))
        elif b > a:  # a sequence of few words: its length keeps it apart from shingles
            out.append(_mixed(np.array([(hashes[a:b] * salt[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def unique_sorted(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]]


def set_digest(members: np.ndarray) -> int:
    """A signed 64-bit digest of a sorted set."""
    return xxhash.xxh3_64_intdigest(members.tobytes()) - (1 << 63)
