"""Word and shingle hashes inside tasks."""

from __future__ import annotations

from sys import byteorder

import numpy as np
from xxhash import xxh3_64_intdigest

_REMEMBERED = 1 << 19
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, element by element."""
    x = (x ^ (x >> _S)) * _A
    x = (x ^ (x >> _S)) * _B
    return x ^ (x >> _S)


class Words:
    """64-bit hashes of the words of a text; remembers words it has met."""

    def __init__(self, remembered: int = _REMEMBERED) -> None:
        self.known: dict[bytes, bytes] = {}
        self.remembered = remembered

    def __call__(self, text: str) -> np.ndarray:
        return self.of(text.encode("utf-8", "replace"))

    def of(self, raw: bytes) -> np.ndarray:
        # bytes.lower() changes A-Z only, bytes.split() splits at the ASCII white space
        words = raw.lower().split()
        known = self.known
        try:
            held = b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > self.remembered:
                known.clear()
            for w in set(words).difference(known):
                known[w] = xxh3_64_intdigest(w).to_bytes(8, byteorder)
            held = b"".join(map(known.__getitem__, words))
        return np.frombuffer(held, np.uint64)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n-word window in place order; of the whole sequence if it is shorter, none if it is empty."""
    if not len(words):
        return words
    n_here = min(n, len(words))
    total = np.zeros(len(words) - n_here + 1, np.uint64)
    for k in range(n_here):
        total += words[k : k + len(total)] * _ODD[k]
    return mix(total + np.uint64(n_here))
