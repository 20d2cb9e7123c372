"""Word and byte hashes of many texts at once, for operators that compare passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random number for each byte; white space counts nothing.
VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
VALUE_WORD = np.where(BLANK, np.uint64(0), VALUE)
VALUE_LOWER = VALUE_WORD.copy()
VALUE_LOWER[65:91] = VALUE_WORD[97:123]
BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
_powers = {BASE: np.ones(1, np.uint64), WORD_BASE: np.ones(1, np.uint64)}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers of a base, modulo 2 ** 64."""
    if len(_powers[base]) < n:
        many = 1 << max(10, int(n - 1).bit_length())
        full = np.full(many, base, np.uint64)
        full[0] = 1
        _powers[base] = np.multiply.accumulate(full)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def batches(texts: list[bytes], size: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about `size` bytes; a longer text is a range of its own."""
    start = total = 0
    for k, t in enumerate(texts):
        if k > start and total + len(t) > size:
            yield start, k
            start, total = k, 0
        total += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word of all texts, its first byte and the byte after it within the joined texts, and per text the first word's index (one more at the end)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = BLANK[data]
    before = np.empty_like(blank)
    before[0], before[1:] = True, blank[:-1]
    starts = np.flatnonzero(~blank & before)
    ends = np.flatnonzero(blank & ~before)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, first
    place = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    # White space after a word counts nothing, so its place may run on.
    factor = powers(BASE, int((ends - starts).max()) + 1)
    value = (VALUE_LOWER if lower else VALUE_WORD)[data[starts[0] :]] * factor[np.minimum(place, len(factor) - 1)]
    return mix(np.add.reduceat(value, starts - starts[0])), starts, ends, first


def windows(hashes: np.ndarray, n: int, base: np.uint64 = WORD_BASE) -> np.ndarray:
    """Hash of every n hashes in a row, by prefix sums: one number for each place where n fit."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    # Sum of h[i + j] * base ** j: prefix sums of h[i] * base ** i, divided by base ** i (base is odd, so it has an inverse).
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    if inverse not in _powers:
        _powers[inverse] = np.ones(1, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(base, len(hashes)), dtype=np.uint64)])
    return mix((total[n:] - total[:-n]) * powers(inverse, len(hashes) - n + 1))


def anchor_of(values: np.ndarray, n: int) -> np.ndarray:
    """Winnowing: for every n values in a row the place of the least, the last of equal ones (compared by their high bits)."""
    if len(values) < n:
        return np.zeros(0, np.int64)
    bits = np.uint64(max(24, len(values).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    best, have = (values & ~low) | (low - np.arange(len(values), dtype=np.uint64)), 1
    while have < n:
        step = min(have, n - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    return (low - (best & low)).astype(np.int64)


def anchors(values: np.ndarray, n: int) -> np.ndarray:
    """The places that anchor_of() chooses for some window."""
    place = anchor_of(values, n)
    return place[np.append(True, place[1:] != place[:-1])] if len(place) else place
