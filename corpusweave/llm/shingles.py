"""Hashed word shingles of many texts at once (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np

#: Constants of the hash: arbitrary odd numbers and a seeded table.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = np.random.Generator(np.random.PCG64(6)).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Text hashed in one go.
CHUNK = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (ASCII lower case, cut at ASCII white space) and each text's end in them.

    A word's hash is a polynomial in its bytes, taken from running sums over the whole buffer."""
    data = b" ".join(texts).lower() + b" "
    buf = np.frombuffer(data, np.uint8)
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _powers(_BASE, len(buf)), out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(buf))[starts] + (ends - starts).astype(np.uint64))
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    return words, np.searchsorted(starts, text_ends)


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``size``-word shingles; fewer words give one, none give none."""
    out: list[np.ndarray] = []
    batch: list[bytes] = []
    held = 0
    for t in texts:
        batch.append(t or b"")
        held += len(batch[-1])
        if held >= CHUNK:
            out += _sets(batch, size)
            batch, held = [], 0
    return out + _sets(batch, size) if batch else out


def _sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    words, ends = word_hashes(texts)
    n = len(words)
    runs = np.zeros(n, np.uint64)
    for k in range(min(size, n)):
        runs[:n - k] += words[k:] * _PLACE[k]
    runs = mix(runs)
    out, start = [], 0
    for end in ends.tolist():
        if end - start >= size:
            s = np.sort(runs[start:end - size + 1])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif end > start:
            own = words[start:end] * _PLACE[:end - start]
            s = mix(own.sum(dtype=np.uint64, keepdims=True) + np.uint64(end - start))
        else:
            s = np.empty(0, np.uint64)
        out.append(s)
        start = end
    return out
