"""Minimal perfect hash of 128-bit keys, built and probed in numpy.

Level by level each remaining key marks one of ``GAMMA`` times as many bits; keys alone on their bit
are done, the others go to the next level. A key's number is the rank of its bit among all bits set.
"""

from __future__ import annotations

import numpy as np

from matchpulse.llm.common import BASE, U, mixed

GAMMA = 2


def _place(first: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mixed(first + U(level) * (second | U(1)) * BASE) % U(size)).astype(np.int64)


class MinimalHash:
    """Numbers the distinct keys (first[i], second[i]) from 0 without gaps."""

    def __init__(self, first: np.ndarray, second: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = len(first)
        done = 0
        while len(first):
            size = max(64, len(first) * GAMMA)
            place = _place(first, second, len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            self.levels.append((alone, np.cumsum(alone) - 1 + done))
            done += int(alone.sum())
            left = ~alone[place]
            first, second = first[left], second[left]

    def number(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Numbers of keys; a key that was not put in gets any number or -1."""
        out = np.full(len(first), -1, np.int64)
        left = np.arange(len(first))
        for level, (alone, rank) in enumerate(self.levels):
            place = _place(first[left], second[left], level, len(alone))
            here = alone[place]
            out[left[here]] = rank[place[here]]
            left = left[~here]
        return out
