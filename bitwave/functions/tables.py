"""Lookup tables of the audio format, and functions that build the larger ones."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from .published import LARGE_CODES, WINDOW

# --- Fixed values of the format. They must equal the published ones for right results. -----------

STATUS = {
    "OK": 0, "NEED_MORE_DATA": 1, "END_OF_STREAM": 2,
    "INVALID_HEADER": -1, "UNSUPPORTED": -2, "INVALID_ARG": -3, "SYNC_NOT_FOUND": -4, "RESERVOIR_UNDERFLOW": -5,
    "HUFFMAN_FAIL": -6, "BUFFER_TOO_SMALL": -7, "DECODE": -8, "SEEK_NOT_SUPPORTED": -9, "SEEK_OUT_OF_RANGE": -10,
}

#: kbit/s by bitrate index; 0 is free format, 15 is not allowed.
BITRATES_1 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 0)
BITRATES_2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160, 0)
#: Hz by 4 * version + rate index; version 0 is 2.5, 1 is reserved, 2 is 2, 3 is 1.
RATES = (11025, 12000, 8000, 0, 0, 0, 0, 0, 22050, 24000, 16000, 0, 44100, 48000, 32000, 0)

#: First lines of the scalefactor bands, long blocks.
LONG_BANDS = {
    44100: (0, 4, 8, 12, 16, 20, 24, 30, 36, 44, 52, 62, 74, 90, 110, 134, 162, 196, 238, 288, 342, 418, 576),
    48000: (0, 4, 8, 12, 16, 20, 24, 30, 36, 42, 50, 60, 72, 88, 106, 128, 156, 190, 230, 276, 330, 384, 576),
    32000: (0, 4, 8, 12, 16, 20, 24, 30, 36, 44, 54, 66, 82, 102, 126, 156, 194, 240, 296, 364, 448, 550, 576),
    22050: (0, 6, 12, 18, 24, 30, 36, 44, 54, 66, 80, 96, 116, 140, 168, 200, 238, 284, 338, 402, 476, 576, 576),
    24000: (0, 6, 12, 18, 24, 30, 36, 44, 54, 66, 80, 96, 114, 136, 162, 194, 232, 278, 332, 394, 464, 576, 576),
}
#: The same for short blocks, per window.
SHORT_BANDS = {
    44100: (0, 4, 8, 12, 16, 22, 30, 40, 52, 66, 84, 106, 136, 192),
    48000: (0, 4, 8, 12, 16, 22, 28, 38, 50, 64, 80, 100, 126, 192),
    32000: (0, 4, 8, 12, 16, 22, 30, 42, 58, 78, 104, 138, 180, 192),
    22050: (0, 4, 8, 12, 16, 20, 24, 28, 32, 38, 44, 52, 62, 192),
    24000: (0, 4, 8, 12, 16, 20, 24, 28, 34, 40, 48, 56, 66, 192),
}
#: Rates that share the tables of another rate.
BANDS_OF = {11025: 22050, 12000: 24000, 16000: 22050, 8000: 22050}

#: Scalefactor lengths (slen1, slen2) by scalefac_compress, MPEG-1.
SLEN = ((0, 0), (0, 1), (0, 2), (0, 3), (3, 0), (1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2), (3, 3), (4, 2), (4, 3))
PRETAB = (0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 3, 3, 3, 2, 0)
#: Of the butterflies between subbands: cosine is 1 / sqrt(1 + c * c), sine is c / sqrt(1 + c * c).
BUTTERFLY = (-0.6, -0.535, -0.33, -0.185, -0.095, -0.041, -0.0142, -0.0037)

#: Pair codes by table: {(x, y): code}.
PAIR_CODES = {
    1: {(0, 0): "1", (0, 1): "001", (1, 0): "01", (1, 1): "000"},
    2: {(0, 0): "1", (0, 1): "010", (0, 2): "000001", (1, 0): "011", (1, 1): "001", (1, 2): "00001", (2, 0): "00011", (2, 1): "00010", (2, 2): "000000"},
    3: {(0, 0): "11", (0, 1): "10", (0, 2): "000001", (1, 0): "001", (1, 1): "01", (1, 2): "00001", (2, 0): "00011", (2, 1): "00010", (2, 2): "000000"},
    5: {
        (0, 0): "1", (0, 1): "010", (0, 2): "000110", (0, 3): "0000101", (1, 0): "011", (1, 1): "001", (1, 2): "000100", (1, 3): "0000100",
        (2, 0): "000111", (2, 1): "000101", (2, 2): "0000111", (2, 3): "00000001", (3, 0): "0000110", (3, 1): "000001", (3, 2): "0000001", (3, 3): "00000000",
    },
    6: {
        (0, 0): "111", (0, 1): "011", (0, 2): "00101", (0, 3): "0000001", (1, 0): "110", (1, 1): "10", (1, 2): "0011", (1, 3): "00010",
        (2, 0): "0101", (2, 1): "0100", (2, 2): "00100", (2, 3): "000001", (3, 0): "000011", (3, 1): "00011", (3, 2): "000010", (3, 3): "0000000",
    },
}
PAIR_CODES |= {t: {(x, y): code for x, row in enumerate(rows) for y, code in enumerate(row.split())} for t, rows in LARGE_CODES.items()}
#: Quadruple codes of table A by 8v + 4w + 2x + y.
QUAD_CODES = ("1", "0101", "0100", "00101", "0110", "000101", "00100", "000100", "0111", "00011", "00110", "000000", "00111", "000010", "000011", "000001")
#: Escape bits of tables 16 to 31; 16 to 23 share one tree and 24 to 31 another.
LINBITS = {16: 1, 17: 2, 18: 3, 19: 4, 20: 6, 21: 8, 22: 10, 23: 13, 24: 4, 25: 5, 26: 6, 27: 7, 28: 8, 29: 9, 30: 11, 31: 13}
#: Tables without codes: their pairs are zeros and take no bits.
EMPTY_TABLES = (0, 4, 14)

# --- Built from rules or parameters ---------------------------------------------------------------


@lru_cache(maxsize=1)
def header_tables() -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(status, frame bytes without padding) by the 11 header bits of version, layer, protection,
    bitrate and rate. The status leaves out sync and emphasis; no valid combination is so short that
    the side information of either channel mode would not fit."""
    statuses, sizes = [], []
    for key in range(2048):
        version, layer, bitrate, rate = key >> 9, (key >> 7) & 3, (key >> 2) & 15, key & 3
        status, size = 0, 0
        if version == 1 or layer == 0:
            status = STATUS["INVALID_HEADER"]
        elif layer != 1:
            status = STATUS["UNSUPPORTED"]
        elif bitrate == 15:
            status = STATUS["INVALID_HEADER"]
        elif bitrate == 0:
            status = STATUS["UNSUPPORTED"]
        elif rate == 3:
            status = STATUS["INVALID_HEADER"]
        else:
            hz = RATES[4 * version + rate]
            size = 144000 * BITRATES_1[bitrate] // hz if version == 3 else 72000 * BITRATES_2[bitrate] // hz
            if size < 6 + (32 if version == 3 else 17):
                raise AssertionError("a frame may be shorter than its side information")
        statuses.append(status)
        sizes.append(size)
    return tuple(statuses), tuple(sizes)


def bands(rate: int, short: bool = False) -> tuple[int, ...]:
    of = SHORT_BANDS if short else LONG_BANDS
    return of.get(BANDS_OF.get(rate, rate), of[44100])


@lru_cache(maxsize=16)
def band_of_line(rate: int) -> np.ndarray:
    """Long band (0 to 21) of each of 576 lines."""
    return np.clip(np.searchsorted(np.array(bands(rate)), np.arange(576), side="right") - 1, 0, 21)


def intensity_ratios() -> list[tuple[float, float]]:
    """(left, right) for positions 0 to 6; tan(p * pi / 12) : 1, with position 0 all to the left."""
    out = []
    for p in range(7):
        right = 0.0 if p == 0 else 1.0 if p == 6 else math.tan(p * math.pi / 12) / (1 + math.tan(p * math.pi / 12))
        out.append((1.0 - right, right))
    return out


def butterflies() -> list[tuple[float, float]]:
    return [(1 / math.sqrt(1 + c * c), c / math.sqrt(1 + c * c)) for c in BUTTERFLY]


@lru_cache(maxsize=1)
def imdct_matrices() -> tuple[np.ndarray, np.ndarray]:
    """(18 x 36, 6 x 12): coefficients to time, before any window."""

    def of(n: int) -> np.ndarray:
        k, i = np.arange(n // 2)[:, None], np.arange(n)[None, :]
        return np.cos(np.pi / (2 * n) * (2 * i + 1 + n // 2) * (2 * k + 1))

    return of(36), of(12)


@lru_cache(maxsize=1)
def cosine_matrix() -> np.ndarray:
    """64 x 32, with the factor two that makes up for half-scale spectra."""
    i, k = np.arange(64)[:, None], np.arange(32)[None, :]
    return 2 * np.cos((16 + i) * (2 * k + 1) * np.pi / 64)


@lru_cache(maxsize=1)
def designed_window() -> np.ndarray:
    """A 512-point synthesis window by design: a Kaiser-windowed low-pass of a sixty-fourth of the
    rate, with the signs and the peak of the published table; close to it, not equal."""
    n = np.arange(512) - 256.0
    cut = 1.0 / 64 * 1.03
    low = np.sinc(n * cut) * np.kaiser(513, 9.0)[:512]
    signs = np.where((np.arange(512) // 64) % 2 == 1, -1.0, 1.0)
    out = 1.144989014 * low * signs
    out[256:] = np.where((np.arange(256, 512) // 64) % 2 == 1, -1.0, 1.0) * 1.144989014 * low[256:]
    return out


@lru_cache(maxsize=1)
def published_window() -> np.ndarray:
    return np.array(WINDOW) / 65536


def codebooks(extra: dict[int, dict[tuple[int, int], str]] | None = None) -> dict[int, tuple[dict[str, tuple[int, int]], int]]:
    """By table 0 to 31: ({code: (x, y)}, escape bits). Tables without an entry are not decodable.

    extra holds trees by their first table (7 to 13, 15, 16, 24) that replace the built-in ones, as a
    caller loads them; see load_codes. Each tree must be complete: its Kraft sum is one."""
    return _codebooks(extra) if extra else _built_in()


@lru_cache(maxsize=1)
def _built_in() -> dict[int, tuple[dict[str, tuple[int, int]], int]]:
    return _codebooks({})


def _codebooks(extra: dict) -> dict[int, tuple[dict[str, tuple[int, int]], int]]:
    trees = PAIR_CODES | extra
    for t, codes in trees.items():
        if sum(2.0 ** -len(c) for c in codes.values()) != 1.0:
            raise ValueError(f"table {t} is no complete code")
    out: dict[int, tuple[dict, int]] = {t: ({}, 0) for t in EMPTY_TABLES}
    for t in range(32):
        tree = trees.get(16 if 16 <= t < 24 else 24 if t >= 24 else t)
        if tree:
            out[t] = ({c: xy for xy, c in tree.items()}, LINBITS.get(t, 0))
    return out


def load_codes(rows) -> dict[int, dict[tuple[int, int], str]]:
    """extra of codebooks() from rows (table, x, y, code), as of a Parquet or CSV file."""
    out: dict[int, dict[tuple[int, int], str]] = {}
    for table, x, y, code in rows:
        out.setdefault(int(table), {})[int(x), int(y)] = code
    return out
