"""Hashes of words and of word shingles, for whole batches of texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C55)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_FOLD = np.uint64(0xD6E8FEB86659FD93)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.Generator(np.random.PCG64(20240)).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
PIECE = 1 << 20


def _powers(base: np.uint64) -> np.ndarray:
    """The first PIECE + 1 powers modulo 2**64."""
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(PIECE, base)]))


@cache
def _both_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE), _powers(_UNBASE)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, one to one."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(32))
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of each word of ASCII-lower-cased bytes, taken PIECE bytes at a time."""
    b = np.frombuffer(data, np.uint8)
    blank = _BLANK[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    up, down = _both_powers()
    sums = np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(b), PIECE):
            # sums up to each byte of the piece; a word over its edge adds up from its parts
            part = np.zeros(min(PIECE, len(b) - at) + 1, np.uint64)
            np.cumsum(_BYTE[b[at : at + PIECE]] * up[: len(part) - 1], out=part[1:])
            i, k = np.searchsorted(stop, at, "right"), np.searchsorted(start, at + PIECE)
            first, last = np.maximum(start[i:k] - at, 0), np.minimum(stop[i:k] - at, len(part) - 1)
            here = (part[last] - part[first]) * down[first]
            if k > i and start[i] < at:
                # so many bytes of the word came before
                here[0] *= np.uint64(pow(int(_BASE), int(at - start[i]), 1 << 64))
            sums[i:k] += here
        return start, mix(sums)


def _fold(h: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        s = np.full(len(h) - k + 1, np.uint64(k) * _BASE, np.uint64)
        for j in range(k):
            s = (s ^ h[j : len(h) - k + 1 + j]) * _FOLD
            s ^= s >> np.uint64(31)
        return mix(s)


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """For each text its distinct k-word shingles as sorted hashes; with fewer words, the one sequence they are."""
    held: list[bytes] = []
    size = 0
    for i in range(len(texts) + 1):
        data = (texts[i] or "").encode("utf-8", "surrogatepass").lower() if i < len(texts) else b""
        if held and (i == len(texts) or size + len(data) > PIECE):
            yield from _sets(held, k)
            held, size = [], 0
        held.append(data)
        size += len(data) + 1


def _sets(held: list[bytes], k: int) -> Iterator[np.ndarray]:
    start, h = word_hashes(b"\n".join(held))
    ends = np.cumsum([len(x) + 1 for x in held])
    cuts = [0, *np.searchsorted(start, ends).tolist()]
    every = _fold(h, k) if len(h) >= k else None
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        if z - a >= k:
            yield np.unique(every[a : z - k + 1])
        elif z > a:
            yield _fold(h[a:z], z - a)
        else:
            yield np.zeros(0, np.uint64)
