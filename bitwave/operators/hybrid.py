"""Inverse MDCT, overlap, frequency inversion and polyphase synthesis.

Both memories reach one granule back: the overlap comes from the previous granule's lines alone, and
the synthesis filter sees 15 past time steps of 18 in a granule. So a granule needs its own lines and
its predecessor's, which is a lag over the good granules of a channel, and no running state.
Kernels work on batches: lines (n, 576), subbands (n, 18, 32), samples (n, 576).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import tables


def _windows() -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(9)
    long = np.sin(np.pi / 36 * (17 - i + 0.5)), np.sin(np.pi / 36 * (i + 0.5))
    k = np.arange(3)
    near = np.concatenate([np.ones(6), np.sin(np.pi / 12 * (5 - k + 0.5))])
    far = np.concatenate([np.zeros(6), np.sin(np.pi / 12 * (k + 0.5))])
    return np.stack(long), np.stack([near, far])


def halves(lines: np.ndarray, short: np.ndarray, long_bands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first (n, 32, 18), next overlap (n, 32, 9)). For long subbands first holds the nine values
    that mix with the overlap; for short ones the time values after the first six, without overlap."""
    big, small = tables.imdct_matrices()
    x = lines.reshape(-1, 32, 18)
    full = x @ big
    first, after = np.zeros((len(x), 32, 18)), full[:, :, 18:27].copy()
    first[:, :, :9] = -full[:, :, :9]
    is_short = short[:, None] & (np.arange(32)[None, :] >= long_bands[:, None])
    if is_short.any():
        k = np.arange(3)
        near, far = np.sin(np.pi / 12 * (5 - k + 0.5)), np.sin(np.pi / 12 * (k + 0.5))
        y = x[is_short].reshape(-1, 6, 3).transpose(0, 2, 1) @ small  # (m, window, 12)
        out = np.zeros((len(y), 27))
        for w in range(3):
            held = y[:, w - 1, 6:9] if w else np.zeros((len(y), 3))
            out[:, 6 + 6 * w : 9 + 6 * w] = held * near + y[:, w, :3] * far
            out[:, 9 + 6 * w : 12 + 6 * w] = held[:, ::-1] * far[::-1] - y[:, w, 2::-1] * near[::-1]
        out[:, 24:] = y[:, 2, 6:9]
        first[is_short], after[is_short] = out[:, :18], out[:, 18:]
    return first, after


def subbands(lines, block_type, switching, mixed, before, before_type, before_switching, before_mixed) -> np.ndarray:
    """(n, 18, 32) from the lines of each granule and of the one before it (zeros for the first)."""
    kind = lambda t, s, m: ((s != 0) & (t == 2), np.where((s != 0) & (t == 2) & (m != 0), 2, 0))
    short, long_bands = kind(block_type, switching, mixed)
    first, _ = halves(lines, short, long_bands)
    _, held = halves(before, *kind(before_type, before_switching, before_mixed))
    is_short = short[:, None] & (np.arange(32)[None, :] >= long_bands[:, None])
    normal, stop = _windows()
    w = np.where(((block_type & 3) == 3)[:, None, None], stop[None], normal[None])
    near, far = w[:, None, 0], w[:, None, 1]
    total = first[:, :, :9]
    out = np.concatenate([held * near - total * far, (held * far + total * near)[:, :, ::-1]], axis=2)
    # Short: six values straight from the overlap, the first window meets the three left of it.
    k = np.arange(3)
    s_near, s_far = np.sin(np.pi / 12 * (5 - k + 0.5)), np.sin(np.pi / 12 * (k + 0.5))
    straight = first.copy()
    straight[:, :, :6] = held[:, :, :6]
    straight[:, :, 6:9] += held[:, :, 6:9] * s_near
    straight[:, :, 9:12] += (held[:, :, 6:9] * s_far)[:, :, ::-1]
    out = np.where(is_short[:, :, None], straight, out).transpose(0, 2, 1)
    flip = np.ones((18, 32))
    flip[1::2, 1::2] = -1
    return out * flip


def synthesis(now: np.ndarray, before: np.ndarray, window: np.ndarray | None = None) -> np.ndarray:
    """576 samples for each granule from its subbands and those of the one before it."""
    d = tables.published_window() if window is None else np.asarray(window, float)
    v = np.concatenate([before, now], axis=1) @ tables.cosine_matrix().T  # (n, 36, 64)
    out = np.zeros((len(now), 18, 32))
    for i in range(8):
        out += d[64 * i : 64 * i + 32] * v[:, 18 - 2 * i : 36 - 2 * i, :32]
        out += d[64 * i + 32 : 64 * i + 64] * v[:, 17 - 2 * i : 35 - 2 * i, 32:]
    return out.reshape(-1, 576)


#: Granules of a run that are transformed together; their temporaries fit a core's cache.
ROWS = 32


def subbands_of_run(lines: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """subbands() of granules in a row, (n, 18, 32) from n + 1 of them: lines (n + 1, 576) and kinds
    (n + 1, 3) of block type, switching and mixed."""
    kind, switching, mixed = kinds.T
    if ((switching != 0) & (kind == 2)).any():
        return subbands(lines[1:], *kinds[1:].T, lines[:-1], *kinds[:-1].T)
    big, _ = tables.imdct_matrices()
    both = np.concatenate([-big[:, :9], big[:, 18:27]], axis=1)
    normal, stop = _windows()
    out = np.empty((len(lines) - 1, 18, 32))
    for a in range(0, len(out), ROWS):
        b = min(len(out), a + ROWS)
        full = (lines[a : b + 1].reshape(-1, 18) @ both).reshape(-1, 32, 18)
        total, held = full[1:, :, :9], full[:-1, :, 9:]
        is_stop = (kind[a + 1 : b + 1] & 3) == 3
        near, far = normal
        if is_stop.any():
            w = np.where(is_stop[:, None, None], stop[None], normal[None])
            near, far = w[:, None, 0], w[:, None, 1]
        out[a:b, :9] = (held * near - total * far).transpose(0, 2, 1)
        out[a:b, 9:] = (held * far + total * near)[:, :, ::-1].transpose(0, 2, 1)
    np.negative(out[:, 1::2, 1::2], out=out[:, 1::2, 1::2])
    return out


def synthesis_of_run(bands: np.ndarray, window: np.ndarray | None = None) -> np.ndarray:
    """synthesis() of granules in a row: (n, 576) samples from n + 1 granules' subbands."""
    d = tables.published_window() if window is None else np.asarray(window, float)
    cosine, n = np.ascontiguousarray(tables.cosine_matrix().T), len(bands) - 1
    out = np.zeros((18 * n, 32))
    for a in range(0, n, ROWS // 2):
        b = min(n, a + ROWS // 2)
        v, here = bands[a : b + 1].reshape(-1, 32) @ cosine, out[18 * a : 18 * b]
        low, high, part = np.ascontiguousarray(v[:, :32]), np.ascontiguousarray(v[:, 32:]), np.empty_like(here)
        for i in range(8):
            here += np.multiply(low[18 - 2 * i : 18 - 2 * i + len(here)], d[64 * i : 64 * i + 32], out=part)
            here += np.multiply(high[17 - 2 * i : 17 - 2 * i + len(here)], d[64 * i + 32 : 64 * i + 64], out=part)
    return out.reshape(-1, 576)


# --- Columns -------------------------------------------------------------------------------------


def inverted(samples: Column) -> Column:
    """Odd time steps of odd subbands negated; samples are time-major, 32 for each step."""
    odd = lambda i: (F.floor(i / 32) % 2 == 1) & (i % 2 == 1)
    return F.transform(samples, lambda x, i: F.when(odd(i), -x.cast("double")).otherwise(x.cast("double")))


def _times(values: Column, matrix: np.ndarray) -> Column:
    """A constant matrix times a column of arrays, in this order of summation."""
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in matrix])
    dot = lambda row: F.aggregate(F.zip_with(row, values, lambda a, b: a * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.transform(rows, dot)


def synthesis_vector(step: Column) -> Column:
    """64 values of the cosine matrix times 32 subbands."""
    return _times(step, tables.cosine_matrix())


def imdct_long(lines: Column) -> Column:
    """36 values of 18 lines, before any window."""
    return _times(lines, tables.imdct_matrices()[0].T)
