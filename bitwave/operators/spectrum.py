"""Requantising, stereo and antialiasing: as column expressions for long blocks, and as numpy kernels
over whole batches for every block type."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import tables

# --- Columns -------------------------------------------------------------------------------------


def requantised(value: Column, gain: Column, scale: Column, factor: Column, pre: Column) -> Column:
    """sign * |value|**(4/3) * 2**(0.25 (gain - 214) - 0.5 (1 + scale) (factor + pre)) in double."""
    exponent = (gain - 214) * 0.25 - (scale + 1) * 0.5 * (factor + pre)
    size = F.pow(F.abs(value).cast("double"), F.lit(4.0 / 3.0)) * F.pow(F.lit(2.0), exponent)
    return F.when(value == 0, 0.0).when(value < 0, -size).otherwise(size)


def band_of(line: Column, rate: int) -> Column:
    """Long scalefactor band of a line (0 to 575)."""
    return F.element_at(F.array(*[F.lit(int(b)) for b in tables.band_of_line(rate)]), line + 1)


def middle_side(mid: Column, side: Column) -> tuple[Column, Column]:
    half = math.sqrt(0.5)
    left = F.zip_with(mid, side, lambda m, s: (m.cast("double") + s.cast("double")) * half)
    return left, F.zip_with(mid, side, lambda m, s: (m.cast("double") - s.cast("double")) * half)


def intensity(mid: Column, right: Column, from_line: Column, position: Column) -> tuple[Column, Column]:
    """Lines from from_line on are taken from mid by the ratio of a position; 7 leaves them as they are."""
    ratios = tables.intensity_ratios()
    l_ratio, r_ratio = (F.element_at(F.array(*[F.lit(x[i]) for x in [*ratios, (1.0, 0.0)]]), F.least(position, F.lit(7)) + 1) for i in (0, 1))
    applies = lambda i: (i >= from_line) & (position < 7)
    left = F.transform(mid, lambda m, i: F.when(applies(i), m.cast("double") * l_ratio).otherwise(m.cast("double")))
    both = F.zip_with(F.transform(mid, lambda m, i: F.struct(m.alias("m"), i.alias("i"))), right, lambda x, r: F.when(applies(x["i"]), x["m"].cast("double") * r_ratio).otherwise(r.cast("double")))
    return left, both


def antialiased(lines: Column, boundaries: int) -> Column:
    """Butterflies over the first boundaries between subbands of 18 lines. Each line has one partner at
    most, so the result reads the input only."""
    cosine, sine = (F.array(*[F.lit(x[i]) for x in tables.butterflies()]) for i in (0, 1))

    def at(x: Column, i: Column) -> Column:
        low = i % 18  # within the subband
        up, down = (low >= 10) & (i < 18 * boundaries), (low < 8) & (i >= 18) & (i < 18 * (boundaries + 1))
        k = F.when(up, 17 - low).otherwise(low)
        c, s = F.get(cosine, k), F.get(sine, k)
        partner = lambda j: F.coalesce(F.get(lines, j).cast("double"), F.lit(0.0))
        mine = x.cast("double")
        return F.when(up, mine * c - partner(i + 1 + 2 * k) * s).when(down, mine * c + partner(i - 1 - 2 * k) * s).otherwise(mine)

    return F.transform(lines, at)


# --- Kernels: arrays of shape (n, 576) ------------------------------------------------------------


@lru_cache(maxsize=64)
def short_order(rate: int, mixed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(input line, output line, band, window) of the short-block lines of bands 0 or 3 to 11."""
    band = tables.bands(rate, short=True)
    source, target, bands, windows = [], [], [], []
    for s in range(3 if mixed else 0, 12):
        width = band[s + 1] - band[s]
        for j in range(width):
            f = band[s] + j
            for w in range(3):
                i = 3 * band[s] + (3 * j + w if mixed else w * width + j)
                o = (f // 6) * 18 + (f % 6) * 3 + w
                if i < 576 and o < 576:
                    source.append(i), target.append(o), bands.append(s), windows.append(w)
    return tuple(map(np.array, (source, target, bands, windows)))


#: The largest coefficient: 15 and 13 escape bits.
MOST = 15 + (1 << 13) - 1


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    """sign(v) * |v| ** (4/3) of v from -MOST to MOST."""
    v = np.arange(-MOST, MOST + 1, dtype=np.float64)
    return np.sign(v) * np.abs(v) ** (4.0 / 3.0)


def requantise(rate: int, g: dict) -> np.ndarray:
    """576 spectral lines of a granule."""
    power = _powers()[np.array(g["coef"], np.int64) + MOST]
    base, step = 0.25 * (g["global_gain"] - 214), 0.5 * (1 + g["scalefac_scale"])
    short = g["window_switching"] and g["block_type"] == 2
    out = np.zeros(576)
    lines = slice(0, 0) if short and not g["mixed"] else slice(0, 36) if short else slice(0, 576)
    band = tables.band_of_line(rate)[lines]
    factor = np.asarray(g["scalefac_l"])[band] + (np.asarray(tables.PRETAB)[band] if g["preflag"] else 0)
    out[lines] = power[lines] * 2.0 ** (base - step * factor)
    if short:
        source, target, bands, windows = short_order(rate, bool(g["mixed"]))
        gain = 2.0 * np.asarray(g["subblock_gain"])[windows] + step * np.asarray(g["scalefac_s"])[bands, windows]
        out[target] = power[source] * 2.0 ** (base - gain)
    return out


def requantise_many(rates: list[int], granules: list[dict], coef: np.ndarray) -> np.ndarray:
    """(n, 576): requantise() of each granule, whose coefficients are a row of coef."""
    out = np.empty((len(granules), 576))
    kinds: dict[int, list[int]] = {}
    for i, (rate, g) in enumerate(zip(rates, granules, strict=True)):
        if g["window_switching"] and g["block_type"] == 2:
            out[i] = requantise(rate, g | {"coef": coef[i]})
        else:
            kinds.setdefault(rate, []).append(i)
    for rate, rows in kinds.items():
        band, gs = tables.band_of_line(rate), [granules[i] for i in rows]
        base, step, pre = (np.array(x, np.float64)[:, None] for x in ([0.25 * (g["global_gain"] - 214) for g in gs], [0.5 * (1 + g["scalefac_scale"]) for g in gs], [g["preflag"] for g in gs]))
        gain = 2.0 ** (base - step * (np.array([g["scalefac_l"] for g in gs]) + pre * np.array(tables.PRETAB)))
        for a in range(0, len(rows), 64):
            at = rows[a : a + 64]
            out[at] = _powers()[coef[at].astype(np.int64) + MOST] * gain[a : a + 64][:, band]
    return out


def stereo(rate: int, mode: int, extension: int, right: dict, xr: list[np.ndarray]) -> list[np.ndarray]:
    """Middle-side and intensity stereo of a granule's two channels."""
    if mode != 1 or not extension & 3:
        return xr
    left_in, right_in = xr
    half = math.sqrt(0.5)
    pair = (left_in + right_in) * half, (left_in - right_in) * half
    if not extension & 1:
        return list(pair)
    start = right["zero_start"]
    ratio = np.array([*tables.intensity_ratios(), (1.0, 0.0)])
    position = np.full(576, 7)
    below = np.zeros(576, bool)
    touched = np.zeros(576, bool)
    short = right["window_switching"] and right["block_type"] == 2
    lines = np.arange(0) if short and not right["mixed"] else np.arange(36 if short else 576)
    if len(lines):
        band = tables.band_of_line(rate)[lines]
        position[lines] = np.where(band < 21, np.asarray(right["scalefac_l"])[band], 7)
        below[lines], touched[lines] = lines < start, True
    if short:
        # The layout of requantise() is taken; the lines of a band follow the coded order 3 j + w.
        _, target, bands, windows = short_order(rate, bool(right["mixed"]))
        edge = np.asarray(tables.bands(rate, short=True))
        f = (target // 18) * 6 + (target % 18) // 3
        coded = 3 * edge[bands] + 3 * (f - edge[bands]) + windows
        position[target] = np.minimum(np.asarray(right["scalefac_s"])[bands, windows], 7)
        below[target], touched[target] = coded < start, True
    moved = touched & ~below & (position < 7)
    position = np.minimum(position, 7)
    out_l, out_r = left_in.copy(), right_in.copy()
    out_l[moved], out_r[moved] = (left_in * ratio[position, 0])[moved], (left_in * ratio[position, 1])[moved]
    if extension & 2:
        out_l[below], out_r[below] = pair[0][below], pair[1][below]
    return [out_l, out_r]


@lru_cache(maxsize=2)
def _boundaries(count: int) -> tuple[np.ndarray, ...]:
    """Cosines, sines and the lines on either side of the first boundaries between subbands."""
    c, s = np.array(tables.butterflies()).T
    return c, s, (np.arange(count) * 18 + 17)[:, None] - np.arange(8)[None, :], (np.arange(1, count + 1) * 18)[:, None] + np.arange(8)[None, :]


def antialias(g: dict, xr: np.ndarray) -> np.ndarray:
    short = g["window_switching"] and g["block_type"] == 2
    if short and not g["mixed"]:
        return xr
    c, s, a, b = _boundaries(1 if short else 31)
    out = xr.copy()
    out[a], out[b] = xr[a] * c - xr[b] * s, xr[b] * c + xr[a] * s
    return out


def antialias_many(granules: list[dict], xr: np.ndarray) -> None:
    """antialias() of each row, in place."""
    kept = np.array([bool(g["window_switching"] and g["block_type"] == 2) for g in granules])
    c, s, a, b = _boundaries(31)
    for i in np.nonzero(kept)[0]:
        xr[i] = antialias(granules[i], xr[i])
    rows = np.nonzero(~kept)[0]
    for i in range(0, len(rows), 64):
        at = rows[i : i + 64][:, None, None]
        up, down = xr[at, a], xr[at, b]
        xr[at, a], xr[at, b] = up * c - down * s, down * c + up * s
