"""Content-chosen places (minimisers) in texts, vectorised. NumPy only, no Spark."""

from __future__ import annotations

import numpy as np

from spoorline.llm import textcore as tc


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k bytes (or numbers) from each place."""
    c, down = tc.prefix_hashes(data)
    return tc.mix((c[k:] - c[:-k]) * down[: len(data) - k + 1])


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """The least of every w numbers in a row, by running minima over blocks of w."""
    n = len(h)
    pad = -n % w
    x = np.concatenate((h, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, w)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    behind = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(units: np.ndarray, window: int, k: int, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end: runs of windows that share their anchor, the first place of the
    least hash of k bytes or numbers within the window. Windows across the texts' bounds don't count.

    Hashes are compared by their upper bits; the lower ones hold the place, so that the first of
    equals wins. Returns anchor places, their hashes, and the first and last window start of each run.
    """
    none = np.zeros(0, np.int64)
    if len(units) < window:
        return none, none.view(np.uint64), none, none
    h = gram_hashes(units, k)
    mask = np.uint64((1 << max(len(h).bit_length(), 1)) - 1)
    low = window_minima((h & ~mask) | np.arange(len(h), dtype=np.uint64), window - k + 1)
    where = (low & mask).astype(np.int64)
    starts = np.arange(len(where))
    if bounds is not None:
        end = bounds[np.searchsorted(bounds, starts, "right")]
        starts = starts[starts + window <= end]
        where = where[starts]
    cut = np.ones(len(starts), bool)
    cut[1:] = (where[1:] != where[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(starts))[: len(first)] - 1
    return where[first], h[where[first]], starts[first], starts[last]
