"""Hashed byte n-grams of folded text, computed with numpy a block at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _fold() -> np.ndarray:
    """ASCII letters in lower case, digits as 0, other ASCII as a space; bytes of other letters as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[:128] = 32
    table[48:58] = 48
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    return table


FOLD = _fold()


def folded(text: str) -> np.ndarray:
    """The folded bytes of ``text`` between two spaces."""
    return FOLD[np.frombuffer(f" {text} ".encode("utf-8", "replace"), dtype=np.uint8)]


def codes(data: np.ndarray, sizes: Sequence[int], bits: int) -> Iterator[np.ndarray]:
    """The hashes below 2^bits of the n-grams of ``data``, for each block and each n of ``sizes`` (1 to 7)."""
    for at in range(0, len(data), BLOCK):
        for n in sizes:
            part = data[at : at + BLOCK + n - 1]
            if len(part) < n:
                continue
            count = len(part) - n + 1
            v = np.full(count, n, dtype=np.uint64)
            for k in range(n):
                v <<= np.uint64(8)
                v |= part[k : k + count]
            v *= _ODD
            v >>= np.uint64(64 - bits)
            yield v.view(np.int64)


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[str]:
    """The strings of an Arrow column one at a time, null as empty."""
    for value in column:
        yield value.as_py() or ""
