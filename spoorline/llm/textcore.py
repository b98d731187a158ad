"""Vectorised work on bytes: words, rolling hashes, shingles. NumPy only, no Spark."""

from __future__ import annotations

import contextlib
import ctypes
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
#: A random number for each byte, for rolling hashes; and one for each place in a shingle.
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
PLACE = _rng.integers(1, 2**63, 16, dtype=np.uint64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(int(BASE), -1, 2**64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLAB = 1 << 20
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function over batches, giving freed memory back to the system at the end of its task.

    Python workers live on between tasks and stages, and what their allocators keep adds up.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def tidied_group(f: Callable[..., pd.DataFrame]) -> Callable[..., pd.DataFrame]:
    """The same for a function over groups, after each group."""
    if len(inspect.signature(f).parameters) == 2:

        def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            out = f(a, b)
            release()
            return out

        return both

    def one(a: pd.DataFrame) -> pd.DataFrame:
        out = f(a)
        release()
        return out

    return one


def release() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library trims by itself
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly (the finaliser of splitmix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which the hash of any range of bytes or 64-bit numbers follows, and the powers to align it."""
    up, down = powers(len(data) + 1)
    c = np.zeros(len(data) + 1, U64)
    np.cumsum((BYTE[data] if data.dtype == np.uint8 else data) * up[: len(data)], out=c[1:])
    return c, down


def word_numbers(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit number for each word of texts, the same for the same word, and the texts' bounds among them."""
    starts, ends = word_bounds(data, bounds)
    c, down = prefix_hashes(data)
    return mix((c[ends] - c[starts]) * down[starts] + (ends - starts).astype(U64)), np.searchsorted(starts, bounds)


def slabs(column: pa.Array, size: int = SLAB) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of whole texts of about size bytes.

    Yields first row, end row, the run's bytes, and the texts' bounds in them. Null: empty.
    """
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    at = np.frombuffer(at, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; words don't cross the bounds of texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~IS_SPACE[data]
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    edge = bounds[:-1][bounds[:-1] < len(data)]
    before[edge] = False
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    last = bounds[1:] - 1
    after[last[last >= 0]] = False
    # The end of a text that precedes empty texts is marked by the same bound.
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of lower-cased words.

    A text of fewer than width words has one shingle, the whole sequence; without words none.
    """
    data = LOWER[data]
    starts, ends = word_bounds(data, bounds)
    c, down = prefix_hashes(data)
    w = mix((c[ends] - c[starts]) * down[starts] + (ends - starts).astype(U64))
    first = np.searchsorted(starts, bounds)
    n = len(w) - width + 1
    s = np.zeros(max(n, 0), U64)
    for k in range(width if n > 0 else 0):
        s += w[k : k + n] * PLACE[k]
    s = mix(s)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        m = b - a
        if m >= width:
            out.append(np.unique(s[a : b - width + 1]))
        elif m:
            h = (w[a:b] * PLACE[:m]).sum(dtype=U64, keepdims=True) + PLACE[width : width + 1] * U64(m)
            out.append(mix(h))
        else:
            out.append(np.zeros(0, U64))
    return out


def pack48(h: np.ndarray) -> bytes:
    """The low 48 bits of each number."""
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(b: bytes) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view(U64).ravel()
