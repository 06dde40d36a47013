"""Hashes of words and word shingles of many texts at once, on byte arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Bytes of text that are hashed at once.
CHUNK = 2_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK characters, one text at least."""
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > CHUNK:
            yield a, i
            a, size = i, 0
        size += len(t or "")
    if texts:
        yield a, len(texts)


def word_hashes(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, and where each text's words begin (one
    more entry than texts).  ``lower`` folds A to Z alone."""
    parts = [(t or "").encode("utf-8", "replace") for t in texts]
    b = np.frombuffer(b" ".join([*parts, b""]) if parts else b"", np.uint8)
    begins = np.cumsum([0] + [len(p) + 1 for p in parts])
    if lower:
        b = np.where((b >= 65) & (b <= 90), b | 32, b)
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    ends = np.flatnonzero(inside & ~np.r_[inside[1:], False]) + 1
    length = ends - starts
    place = np.flatnonzero(inside)
    first = np.cumsum(length) - length
    power = np.empty(int(length.max()), np.uint64)
    power[0] = 1
    np.multiply.accumulate(np.full(len(power) - 1, _ODD), out=power[1:])
    value = (b[place].astype(np.uint64) + np.uint64(1)) * power[np.arange(len(place)) - np.repeat(first, length)]
    return mixed(np.add.reduceat(value, first)), np.searchsorted(starts, begins)


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words of one text; fewer words are one shingle together, none give none."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        h = np.full(1, np.uint64(n), np.uint64)
        for w in words:
            h = mixed(h * _ODD + w)
        return h
    h = words[: n - k + 1].copy()
    for i in range(1, k):
        h = h * _ODD + words[i : n - k + 1 + i]
    return mixed(h ^ np.uint64(k << 56))


def shingle_sets(texts: list[str | None], k: int, lower: bool = True) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for a, b in chunks(texts):
        words, at = word_hashes(texts[a:b], lower)
        out += [np.unique(windows(words[at[i] : at[i + 1]], k)) for i in range(b - a)]
    return out
