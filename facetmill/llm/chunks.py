"""Content-defined chunks of many byte strings at once.

A rolling hash over WINDOW bytes runs through each string; a cut lies where the hash is the smallest
within REACH positions on either side. So cuts depend on nearby content only: an edit moves the
cuts around it and leaves the rest alone. Chunks are longer than REACH, save at the ends. With ``most`` longer stretches without
a cut, as periodic strings have, are cut every ``most`` bytes from their begin on.
"""

from __future__ import annotations

import numpy as np

WINDOW = 4
REACH = 4
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, np.int64).astype(np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def _rolling(data: np.ndarray, window: int) -> np.ndarray:
    """A 32-bit hash of the ``window`` bytes from each position on."""
    h = np.zeros(len(data), np.uint32)
    for i in range(window):
        h *= np.uint32(0x01000193)
        h[: len(h) - i] += data[i:]
    h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    return h ^ (h >> np.uint32(13))


def cut_chunks(texts: list[bytes], window: int = WINDOW, reach: int = REACH, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, length, digest) of every chunk, in order; an empty text has no chunk."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    total = int(sizes.sum())
    if not total:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    filled = np.flatnonzero(sizes)
    ends = np.cumsum(sizes)[filled]
    starts = ends - sizes[filled]
    rolled = _rolling(data, window)
    lowest = np.full(total, np.uint32(0xFFFFFFFF))
    for i in range(1, min(reach, total - 1) + 1):
        np.minimum(lowest[i:], rolled[:-i], out=lowest[i:])
        np.minimum(lowest[:-i], rolled[i:], out=lowest[:-i])
    # positions whose windows would run over an end of their string are no cuts; each string starts a chunk
    cut = rolled < lowest
    for i in range(reach):
        cut[np.minimum(starts + i, ends - 1)] = False
    for i in range(1, reach + window):
        cut[np.maximum(ends - i, starts)] = False
    cut[starts] = True
    bounds = np.flatnonzero(cut)
    length = np.diff(bounds, append=total)
    long = np.flatnonzero(length > most) if most else ()
    if len(long):
        many = (length[long] - 1) // most
        cut[np.repeat(bounds[long], many) + most * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + 1)] = True
        bounds = np.flatnonzero(cut)
        length = np.diff(bounds, append=total)
    text = filled[np.searchsorted(ends, bounds, side="right")]
    within = np.arange(total) - np.repeat(bounds, length)
    powers = np.multiply.accumulate(np.full(int(length.max()), np.uint64(0x9E3779B97F4A7C15)))
    digest = np.add.reduceat(_BYTE[data] * powers[within], bounds)
    return text, length, _mix(digest + length.astype(np.uint64))
