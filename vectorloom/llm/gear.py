"""Content-defined cuts by a gear rolling hash, vectorised.

The hash of a position is the sum over the last 32 bytes b[i-j] of GEAR[b] << j in
32 bits: what the recurrence h = (h << 1) + GEAR[b] leaves of a window. It is built
by doubling, so a block costs five numpy passes. A cut is a position whose top bits
are zero; since it depends on 32 bytes only, an insertion moves later cuts with the
text.
"""

from __future__ import annotations

import numpy as np

WINDOW, _BLOCK = 32, 1 << 20


def _table() -> np.ndarray:
    """256 values by the splitmix64 rule from seed 0."""
    with np.errstate(over="ignore"):
        x = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


GEAR = _table()


def rolling(data: np.ndarray) -> np.ndarray:
    """The hash at every byte of data (uint8); the first bytes have shorter windows."""
    h = GEAR[data]
    for by in (1, 2, 4, 8, 16):
        if len(h) <= by:
            break
        more = h[:-by] << np.uint32(by)
        h = h.copy()
        h[by:] += more
    return h


def candidates(data: np.ndarray, bits: int, window: int = WINDOW) -> np.ndarray:
    """Positions after which the hash of the last `window` bytes allows a cut: one in 2**bits. Memory is bounded by blocks."""
    found = []
    for at in range(0, len(data), _BLOCK):
        lead = min(at, WINDOW - 1)
        h = rolling(data[at - lead : at + _BLOCK])[lead:]
        found.append(np.flatnonzero((h << np.uint32(WINDOW - window)) >> np.uint32(32 - bits) == 0) + (at + 1))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _least(x: np.ndarray, by: int) -> np.ndarray:
    """The least of each value and the `by` - 1 before it, by doubling."""
    have = 1
    while have < by:
        step = min(have, by - have)
        x = np.concatenate([x[:step], np.minimum(x[step:], x[:-step])])
        have += step
    return x


def minima(data: np.ndarray, radius: int, window: int) -> np.ndarray:
    """Positions after whose byte the hash of the last `window` bytes is less than in `radius` places before and no more than in `radius` after.

    They lie over `radius` apart, and each depends on 2 * radius + window bytes around it
    only: unlike cuts that count from the one before, none is moved by what stands
    farther away. Memory is bounded by blocks.
    """
    found = []
    for at in range(0, len(data), _BLOCK):
        lo, hi = max(0, at - radius - WINDOW), min(len(data), at + _BLOCK + radius)
        h = (rolling(data[lo:hi]) << np.uint32(WINDOW - window)).astype(np.int64)
        edge = np.full(radius, 1 << 32, np.int64)
        wide = np.concatenate([edge, h, edge])
        before, after = _least(wide, radius)[radius - 1 : -radius - 1], _least(wide[::-1], radius)[::-1][radius + 1 : len(wide) - radius + 1]
        own = np.flatnonzero((h < before) & (h <= after)) + lo
        found.append(own[(own >= at) & (own < at + _BLOCK)] + 1)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def cut(ends: list[int], size: int, least: int, most: int, may_end=None) -> list[int]:
    """Ends of the chunks of size bytes: the first candidate at least `least` on, or `most` bytes on.

    may_end(position) -> position moves a forced cut back, as to a character's start.
    """
    out, last = [], 0
    for e in [*ends, size]:
        while e - last > most:
            forced = last + most
            if may_end is not None:
                forced = max(may_end(forced), last + 1)
            out.append(forced)
            last = forced
        if e - last >= least and e < size:
            out.append(e)
            last = e
    if size > last:
        out.append(size)
    return out
