"""Counts and sums of a bootstrap's draws for many nodes at once: what a task does with its replicates.

Draws come from the generator x -> 48271 x mod 2^31 - 1 (Park and Miller), seeded by a hash of where they are drawn, so the
d-th draw is the seed times the factor's d-th power: all draws of a block of nodes are one product of seeds and powers.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np

FACTOR, PRIME = 48271, 2**31 - 1
#: Values are drawn one by one only within leaves of so many tasks.
LEAF = 32
#: Draws that are held at a time.
_HELD = 1 << 16


@functools.lru_cache(maxsize=32)
def _powers(size: int) -> np.ndarray:
    """The factor's powers 1 .. size at least."""
    out = np.array([FACTOR], dtype=np.uint64)
    while len(out) < size:
        out = np.concatenate([out, out * out[-1] % np.uint64(PRIME)])
    return out


def _seeds(key: str, *columns: np.ndarray) -> np.ndarray:
    """A seed in 1 .. 2^31 - 2 for each row of the columns, behind the common key."""
    first = lambda row: int.from_bytes(hashlib.sha1("|".join((key, *map(str, row))).encode()).digest()[:4], "big")
    return np.fromiter((first(r) % (PRIME - 1) + 1 for r in zip(*[c.tolist() for c in columns])), dtype=np.uint64, count=len(columns[0]))


def _blocks(seeds: np.ndarray, times: np.ndarray):
    """(rows, draws, there): blocks of rows with like counts; ``there`` tells a row's own draws."""
    order = np.argsort(times, kind="stable")
    powers = _powers(1 << int(times.max(initial=1) - 1).bit_length())
    at = 0
    while at < len(order):
        rows = order[at:at + max(1, _HELD // int(times[order[at]]))]
        rows = rows[times[rows] * len(rows) <= 2 * _HELD] if len(rows) > 1 else rows
        most = int(times[rows[-1]])
        for start in range(0, most, _HELD):
            d = np.arange(start, min(most, start + _HELD))
            x = seeds[rows, None] * powers[None, start:start + len(d)]
            x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))
            yield rows, np.minimum(x, x - np.uint64(PRIME)), d[None, :] < times[rows, None]  # a smaller x wraps around
        at += len(rows)


def split(key: str, n: int, rep: np.ndarray, a: np.ndarray, b: np.ndarray, times: np.ndarray, widest: int) -> tuple[np.ndarray, ...]:
    """(rep, a, b, times) of the nodes below the given ones, down to those of ``widest`` leaves at most: each splits its draws by halves of its leaves."""
    done = []
    while True:
        rep, a, b, times = (x[times > 0] for x in (rep, a, b, times))
        small = b - a <= widest
        done.append([x[small] for x in (rep, a, b, times)])
        rep, a, b, times = (x[~small] for x in (rep, a, b, times))
        if not len(rep):
            return tuple(np.concatenate(x) for x in zip(*done))
        half = (a + b) // 2
        wide, part = np.minimum(b * LEAF, n) - a * LEAF, (half - a) * LEAF
        below = ((part * PRIME - 1) // wide + 1).astype(np.uint64)  # x * wide < part * PRIME
        left = np.zeros(len(rep), dtype=np.int64)
        for rows, x, there in _blocks(_seeds(key, rep, a, b), times):
            left[rows] += np.count_nonzero((x < below[rows, None]) & there, axis=1)
        rep, a, b, times = np.tile(rep, 2), np.concatenate([a, half]), np.concatenate([half, b]), np.concatenate([left, times - left])


def sums(key: str, rep: np.ndarray, leaf: np.ndarray, times: np.ndarray, values: np.ndarray, first: int) -> np.ndarray:
    """The sum of each node's draws from its leaf; ``values`` are those of all leaves from the leaf ``first`` on, by place."""
    start = (leaf - first) * LEAF
    size = np.minimum(len(values) - start, LEAF)
    out = np.zeros(len(rep))
    for rows, x, there in _blocks(_seeds(key, rep, leaf), times):
        pick = (x * size[rows, None].astype(np.uint64) / float(PRIME)).astype(np.int64)
        out[rows] += np.where(there, values[start[rows, None] + pick], 0.0).sum(axis=1)
    return out
