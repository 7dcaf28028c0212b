"""Vectorised 64-bit hashing of pieces of a text, portions of a task's rows, and a worker's memory."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and their inverses, n of each at least."""
    if len(_tables.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            out = np.ones(size, np.uint64)
            done = 1
            while done < size:
                out[done : 2 * done] = out[:done] * _U(pow(base, done, 1 << 64))
                done *= 2
            _tables[name] = out
    return _tables["up"], _tables["down"]


def portions(frames: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """The rows in portions of about ``most`` code points of their text."""
    for frame in frames:
        portion = np.cumsum([len(t) if t else 0 for t in frame["text"]], dtype=np.int64) // most
        yield from (part for _, part in frame.groupby(portion, sort=False))


def release() -> None:
    """Give memory that is free in this process back to the machine: workers wait for other stages beside an executor that needs it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)
