"""Word and shingle hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

U = np.uint64
#: An odd base of the polynomial hash, its inverse modulo 2**64, and about how many bytes are hashed at once.
BASE, BLOCK = 0x9E3779B97F4A7C15, 1 << 20
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


class Words(dict):
    """64-bit hashes of words, kept while they fit."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def hashed(words: list[bytes], known: Words) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), U, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    return h ^ (h >> U(33))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return words[:0]
    h = words[:n].copy()
    for i in range(1, k):
        h = mixed(h) + words[i : n + i]
    return mixed(h)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, BLOCK), base, U)
        step[0] = 1
        have = _POWERS[base] = np.cumprod(step)
    return have[:n]


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than ASCII white space."""
    inside = np.concatenate([[False], ~((data == 32) | ((data >= 9) & (data <= 13))), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the words, from one running sum over all bytes."""
    sums = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * powers(BASE, len(data)))])
    return mixed((sums[ends] - sums[starts]) * powers(INVERSE, len(data) + 1)[starts] + (ends - starts).astype(U))


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """For each whole text its distinct k-word shingles in order of their hashes. A-Z count as a-z, words end at ASCII white space; a text
    of fewer words is one shingle, one without words has none."""
    block: list[bytes] = []
    size = 0
    for text in texts:
        block.append((text or "").encode("utf-8", "surrogatepass").lower())
        size += len(block[-1]) + 1
        if size >= BLOCK:
            yield from _block_sets(block, k)
            block, size = [], 0
    yield from _block_sets(block, k)


def _block_sets(block: list[bytes], k: int) -> Iterator[np.ndarray]:
    if not block:
        return
    data = np.frombuffer(b" ".join(block), np.uint8)
    starts, ends = word_places(data)
    words = word_hashes(data, starts, ends) if len(starts) else np.empty(0, U)
    all_grams = grams(words, k)
    first = np.searchsorted(starts, np.cumsum([0, *(len(b) + 1 for b in block)]))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        own = np.sort(all_grams[a : b - k + 1]) if b - a >= k else grams(words[a:b], b - a)
        yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) > 1 else own


def shingle_set(text: str | None, k: int) -> np.ndarray:
    return next(shingle_sets([text], k))
