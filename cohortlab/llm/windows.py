"""Hashes of word windows, and a choice of them that texts with a run in common share.

Of each 26 windows that start one after another, the one with the least hash is chosen (all of them if several have it).
The choice depends on nothing else, so two texts that share a run of 51 words share a chosen window of it, and chosen
windows of a run begin at most 26 words apart.
"""

from __future__ import annotations

import numpy as np

from cohortlab.llm.shingles import _mixed

# Words of a window, and of the shortest run of which a window is sure to be chosen.
WINDOW, RUN = 26, 51
_K = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xD6E8FEB86659FD93)
# Factors of the run hashes: 5 modulo 8, so that powers repeat as late as they can.
_FACTORS = 0xD1342543DE82EF95, 0x9FB21C651E98DF25


def _joined(a: np.ndarray, b: np.ndarray, at: int) -> np.ndarray:
    n = len(b) - at
    return _mixed(a[:n] * _K + b[at:])


def _lane(h: np.ndarray) -> np.ndarray:
    two = _joined(h, h, 1)
    four = _joined(two, two, 2)
    eight = _joined(four, four, 4)
    sixteen = _joined(eight, eight, 8)
    return _joined(_joined(sixteen, eight, 16), two, 24)


def window_hashes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window of a sequence, given by the hashes of its words."""
    if len(h) < WINDOW:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return _lane(_mixed(h)), _lane(_mixed(h ^ _OTHER))


def _powers(factor: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.full(n, factor, np.uint64)]).cumprod(dtype=np.uint64)


def run_hashes(h: np.ndarray, starts: np.ndarray, stops: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each run of a sequence, given by the hashes of its words and where it starts and stops; runs of
    different kinds differ. Each is a difference of two sums over the sequence, so a run costs the same at any length."""
    out = []
    for words, factor in zip((_mixed(h), _mixed(h ^ _OTHER)), _FACTORS, strict=True):
        sums = np.concatenate([np.zeros(1, np.uint64), (words * _powers(factor, len(h))[:-1]).cumsum(dtype=np.uint64)])
        moved = (sums[stops] - sums[starts]) * _powers(pow(factor, -1, 1 << 64), len(h))[starts]
        out.append(_mixed(moved + (stops - starts).astype(np.uint64) * _K + np.uint64(kind)))
    return out[0], out[1]


def _extreme(x: np.ndarray, least: np.ufunc) -> np.ndarray:
    """Of each 26 numbers in a row."""
    two = least(x[:-1], x[1:])
    four = least(two[:-2], two[2:])
    eight = least(four[:-4], four[4:])
    sixteen = least(eight[:-8], eight[8:])
    return least(sixteen[:-10], sixteen[10:])


def chosen(sizes: list[int], hashes: np.ndarray) -> np.ndarray:
    """Where the chosen windows begin in texts that follow each other, given by their numbers of words and the window
    hashes of the whole. No window reaches into another text."""
    n, reach = len(hashes), RUN - WINDOW
    if n <= reach:
        return np.empty(0, np.int64)
    least = _extreme(hashes, np.minimum)
    start = np.concatenate([[0], np.cumsum(sizes)])
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
    inside = np.arange(len(least)) + RUN <= start[text + 1]
    least[~inside] = 0
    none = np.zeros(reach, np.uint64)
    most = _extreme(np.concatenate([none, least, none]), np.maximum)
    return np.flatnonzero((most == hashes) & (most > 0))
