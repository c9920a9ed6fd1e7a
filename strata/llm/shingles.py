"""Word shingles as sorted arrays of distinct 64-bit hashes, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_bytes = np.random.default_rng(1).integers(1, 2**64, 256, dtype=U)
_other = np.random.default_rng(2).integers(1, 2**64, 256, dtype=U)
_white = np.zeros(256, dtype=bool)
_white[[9, 10, 11, 12, 13, 32]] = True
_base = U(0x9E3779B97F4A7C15)
_inverse = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Bytes hashed at once (a longer word at once all the same).
SLICE = 1 << 19

_powers = [np.ones(1, dtype=U), np.ones(1, dtype=U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, b in enumerate((_base, _inverse)):
            p = np.full(size, b, dtype=U)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=U)
    return _powers[0], _powers[1]


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts, and where each text's words end. A-Z are lower-cased; words are separated by
    blanks and the control characters 9 to 13. Bytes are hashed in slices that end between words."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b" " + b" ".join(t.lower() for t in texts) + b" ", dtype=np.uint8)
    white = _white[data]
    edges = np.flatnonzero(white[1:] != white[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    words, at = [], 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE, side="right")))
        low, high = int(starts[at]), int(ends[to - 1])
        up, down = powers(high - low + 1)
        sums = np.zeros(high - low + 1, dtype=U)
        np.cumsum(_bytes[data[low:high]] * up[: high - low], out=sums[1:], dtype=U)
        a, b = starts[at:to] - low, ends[at:to] - low
        words.append(mix((sums[b] - sums[a]) * down[a] + (b - a).astype(U)))
        at = to
    hashes = np.concatenate(words) if words else np.zeros(0, dtype=U)
    return hashes, np.searchsorted(starts, np.cumsum(lengths + 1), side="left")


def run_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of every run of bytes."""
    out: tuple[list, list] = [], []
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(stops, starts[at] + SLICE, side="right")))
        low, high = int(starts[at]), int(stops[to - 1])
        up, down = powers(high - low + 1)
        a, b = starts[at:to] - low, stops[at:to] - low
        for table, hashes in zip((_bytes, _other), out, strict=True):
            sums = np.zeros(high - low + 1, dtype=U)
            np.cumsum(table[data[low:high]] * up[: high - low], out=sums[1:], dtype=U)
            hashes.append(mix((sums[b] - sums[a]) * down[a] + (b - a).astype(U)))
        at = to
    return tuple(np.concatenate(h) if h else np.zeros(0, dtype=U) for h in out)


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles of k words; one of all words if there are fewer; none without words."""
    words, ends = hashed_words(texts)
    run = words[: max(0, len(words) - k + 1)]
    for j in range(1, k):
        run = mix(run) * U(3) + words[j : len(words) - k + 1 + j]
    run = mix(run)
    at = 0
    for end in ends.tolist():
        n = end - at
        if n >= k:
            yield np.unique(run[at : end - k + 1])
        elif n:
            one = words[at : at + 1]
            for j in range(1, n):
                one = mix(one) * U(3) + words[at + j : at + j + 1]
            yield mix(one + U(n))
        else:
            yield np.zeros(0, dtype=U)
        at = end
