"""Bit slices of binary columns, most significant bit first."""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_slice(content: Column, pos: Column, width: int) -> Column:
    """width bits (1 to 32) from a zero-based bit position, as a long; null past the end."""
    if not 1 <= width <= 32:
        raise ValueError("a slice has 1 to 32 bits")
    first = F.floor(pos / 8).cast("int")
    whole = F.conv(F.hex(F.substring(content, first + 1, F.lit(5))), 16, 10).cast("long")
    have = F.least(F.lit(5), F.length(content) - first)
    # Fewer than five bytes are moved up, so the slice always ends 40 - width - pos % 8 bits from the end.
    value = F.call_function("shiftleft", whole, ((F.lit(5) - have) * 8).cast("int"))
    shift = (F.lit(40 - width) - pos % 8).cast("int")
    return F.when(pos + width <= F.length(content) * 8, F.call_function("shiftright", value, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long")))


def align(pos: Column) -> Column:
    """The next bit position at a byte boundary."""
    return (F.ceil(pos / 8) * 8).cast("long")


class Bits:
    """A reader over bytes for layouts whose widths depend on what was read."""

    def __init__(self, data: bytes):
        self.data, self.pos, self.error, self.total = data, 0, False, 8 * len(data)

    @cached_property
    def windows(self) -> list[int]:
        """The 32 bits from each byte on; zeros follow the end."""
        d = np.frombuffer(self.data + bytes(4), np.uint8).astype(np.uint32)
        return ((d[:-3] << 24) | (d[1:-2] << 16) | (d[2:-1] << 8) | d[3:]).tolist()

    def peek(self, n: int) -> str:
        """The next n bits, or fewer before the end, as digits."""
        end = min(self.pos + n, self.total)
        part = self.data[self.pos >> 3 : (end + 7) >> 3]
        return bin(int.from_bytes(b"\1" + part, "big"))[3 + (self.pos & 7) :][: end - self.pos]

    def read(self, n: int) -> int:
        if n == 0:
            return 0
        end = self.pos + n
        if n > 32 or end > self.total:
            self.error = True
            return 0
        part = self.data[self.pos >> 3 : (end + 7) >> 3]
        self.pos = end
        return (int.from_bytes(part, "big") >> (-end & 7)) & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        if self.pos + n > self.total:
            self.pos, self.error = self.total, True
        else:
            self.pos += n
