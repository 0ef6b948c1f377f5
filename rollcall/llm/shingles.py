"""Word shingles of whole texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Words whose hashes a Python worker remembers at most; only speed depends on it.
REMEMBERED = 200_000


class _Hashes(dict):
    """64-bit hashes by word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def forget() -> None:
    """Frees the words that this Python worker remembers."""
    _HASHES.clear()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xE9846AF9B1A615D)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xE9846AF9B1A615D)
    return h ^ (h >> np.uint64(28))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, A-Z lower-cased, and where each text's words begin and end."""
    if len(_HASHES) > REMEMBERED:
        forget()
    hash_of = _HASHES.__getitem__
    found = [np.fromiter(map(hash_of, words), np.uint64, len(words)) for words in (t.lower().split() for t in texts)]  # bytes split at ASCII white space
    return np.concatenate([np.zeros(0, np.uint64), *found]), np.cumsum([0, *map(len, found)])


def shingle_sets(texts: list[bytes], n: int = WORDS) -> list[np.ndarray]:
    """For each text its distinct shingles of n words, sorted; a shorter text is one shingle, one without words none."""
    hashes, bounds = word_hashes(texts)
    rolled = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        rolled = rolled * _STEP + hashes[k : k + len(rolled)]
    rolled = mixed(rolled)
    found = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            found.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for h in hashes[a:b]:
                whole = np.uint64((int(whole) * int(_STEP) + int(h)) & 0xFFFFFFFFFFFFFFFF)
            found.append(mixed(np.array([whole, 0], np.uint64))[:1])
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return 0
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int(np.count_nonzero(large[at] == small))
