"""Hashed word shingles of whole texts, by numpy over the bytes of many texts at once.

Words are runs of anything but the six ASCII blanks, A-Z lower-cased. A word's hash is a polynomial
of its bytes modulo 2^64, mixed; a shingle's hash chains those of its words. Texts with fewer words
than a shingle has give one shingle of all their words; texts without words give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHINGLE = 5

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.arange(256, dtype=np.uint64) + 1
_VALUE[ord("A"):ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD = 1 << 64

#: Bytes of text hashed at a time; longer texts are cut between words.
SEGMENT = 1 << 20
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on all others."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(inverse: bool) -> np.ndarray:
    """Powers of the base, or of its inverse, for the places of a segment."""
    name = "down" if inverse else "up"
    if name not in _POWERS:
        base = np.uint64(pow(_BASE, -1, _WORD) if inverse else _BASE)
        with np.errstate(over="ignore"):
            steps = np.full(2 * SEGMENT + 1, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS[name]


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of at most 2 * SEGMENT bytes."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~_BLANK[data]
    edges = np.diff(solid)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * _powers(False)[:len(data)], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * _powers(True)[starts]
        return starts, mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(_BASE))


def _cuts(data: np.ndarray, limits: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about SEGMENT bytes that end where a text does or at a blank."""
    at, n = 0, int(limits[-1])
    while at < n:
        end = int(limits[np.searchsorted(limits, at + SEGMENT, "right") - 1])
        if end <= at:  # inside a long text
            blanks = np.flatnonzero(_BLANK[data[at + SEGMENT:at + 2 * SEGMENT]])
            end = min(n, at + SEGMENT + int(blanks[0]) if len(blanks) else at + 2 * SEGMENT)
            end = min(end, int(limits[np.searchsorted(limits, at, "right")]))
        yield at, end
        at = end


def word_hashes(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's begin (one more than texts).

    Two texts that touch are kept apart: a word ends where its text does. A word longer than a
    segment (1 MB) is hashed as several.
    """
    starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for a, b in _cuts(data, limits):
        inner = np.unique(
            limits[np.searchsorted(limits, a, "right"):np.searchsorted(limits, b, "left")])
        # a blank after every text keeps their words apart
        part = np.insert(data[a:b], inner - a, 0x20)
        at, h = _words(part)
        starts.append(at - np.searchsorted(inner - a + np.arange(len(inner)), at) + a)
        hashes.append(h)
    starts, hashes = np.concatenate(starts), np.concatenate(hashes)
    return hashes, np.searchsorted(starts, limits)


def shingle_hashes(data: np.ndarray, limits: np.ndarray, n: int = SHINGLE) \
        -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles in order, repeats included, and where each text's begin."""
    words, at = word_hashes(data, limits)
    count = np.diff(at)
    many = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    ends = np.concatenate([[0], np.cumsum(many)])
    text = np.repeat(np.arange(len(count)), many)
    first = at[:-1][text] + np.arange(ends[-1]) - ends[:-1][text]
    length = np.minimum(count, n)[text]
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    h, short = length.astype(np.uint64), bool((length < n).any())
    with np.errstate(over="ignore"):
        for k in range(n):
            step = h * np.uint64(0xD6E8FEB86659FD93) + padded[first + k]
            h = np.where(k < length, step, h) if short else step
    return mix(h), ends


def shingle_sets(data: np.ndarray, limits: np.ndarray, n: int = SHINGLE) \
        -> Iterator[np.ndarray]:
    """Each text's different shingles, as sorted hashes."""
    h, at = shingle_hashes(data, limits, n)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield np.unique(h[a:b])
