"""Rolling hashes over bytes with numpy: of every n-gram, of any stretch, of words."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
TABLE = np.random.default_rng(0x5EED).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_P, _P_INV):
        steps = np.full(n, base, dtype=np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^0, P^1, ... and their inverses, at least ``n`` of each."""
    return _powers(1 << max(16, (n - 1).bit_length()))


class Hashed:
    """Hashes of stretches of ``data``: equal bytes, equal hashes, wherever they stand.

    With ``table`` None the symbols are 64-bit numbers that are hashes themselves.
    """

    def __init__(self, data: np.ndarray, table: np.ndarray | None = TABLE) -> None:
        n = len(data)
        up, self._down = powers(n + 1)
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data if table is None else table[data]) * up[:n], out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self._sums[end] - self._sums[start]) * self._down[start])

    def grams(self, n: int) -> np.ndarray:
        count = len(self._sums) - n
        return mixed((self._sums[n:] - self._sums[:-n]) * self._down[:count])


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` values in a row."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, width)
    front = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], front[width - 1 : width - 1 + n])
