"""What a task has worked out for each word: kept by use, within a bound, for tokenizers that work word by word."""

from __future__ import annotations

import numpy as np

REMEMBERED, LONG = 200_000, 256


class Ragged:
    """Rows of any length over one flat array."""

    def __init__(self, dtype):
        self.pool, self.begin, self.size = np.zeros(0, dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def append(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.pool = np.concatenate([self.pool, values.astype(self.pool.dtype, copy=False)])

    def rows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of these rows one after the other, and the rows' sizes."""
        size = self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.begin[at] - (ends - size), size) + np.arange(total)], size

    def kept(self, at: np.ndarray) -> None:
        self.pool, self.size = self.rows(at)
        self.begin = np.cumsum(self.size) - self.size


class WordMemory(dict):
    """Number of each word in the order of meeting it. Beyond ``limit`` words, or 24 times as many
    characters, only words of up to LONG characters met twice or more stay, the most frequent half of ``limit`` at most.

    A user calls ``numbers`` on some words, works out those in ``fresh``, and cuts its own columns
    to the numbers that ``forget`` returns.
    """

    def __init__(self, limit: int = REMEMBERED):
        super().__init__()
        self.limit, self.fresh, self.met, self.chars = limit, [], np.zeros(0, np.int64), 0

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.fresh.append(word)
        self.chars += len(word)
        return at

    def numbers(self, words: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        self.met = np.concatenate([self.met, np.zeros(len(self.fresh), np.int64)])
        self.met += np.bincount(at, minlength=len(self))
        return at

    def forget(self) -> np.ndarray | None:
        """None while there is room; else the old numbers of the words that stay, which are now numbered from 0."""
        if len(self) <= self.limit and self.chars <= 24 * self.limit:
            return None
        names, most = list(self), self.limit // 2
        stay = np.flatnonzero((self.met > 1) & (np.fromiter(map(len, names), np.int64, len(names)) <= LONG))
        if len(stay) > most:
            stay = np.sort(stay[np.argsort(-self.met[stay], kind="stable")[:most]])
        self.clear()
        self.update((names[i], k) for k, i in enumerate(stay.tolist()))
        self.met, self.chars = self.met[stay] // 2, sum(map(len, self))
        return stay
