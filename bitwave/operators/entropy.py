"""Side information, scalefactors and Huffman codes. Frames are independent here once their main data
are assembled, so all of it runs batch by batch without a shuffle. decode_many() reads the codes of all
granules of a block in step; frames with anything else than short codes are left to decode_granules()."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.bits import Bits

S = tables.STATUS


def side_info(data: bytes | None, version: int, channels: int) -> tuple[int, dict]:
    """(status, side information) at the start of data, which begins after the frame header."""
    size = (17 if channels == 1 else 32) if version == 3 else (9 if channels == 1 else 17)
    if data is None:
        return S["INVALID_ARG"], {}
    if len(data) < size:
        return S["NEED_MORE_DATA"], {}
    return _parsed(bytes(data[:size]), version, channels)


@lru_cache(maxsize=4096)
def _parsed(data: bytes, version: int, channels: int) -> tuple[int, dict]:
    one, bits = version == 3, Bits(data)
    begin = bits.read(9 if one else 8)
    private = bits.read((5 if channels == 1 else 3) if one else (1 if channels == 1 else 2))
    scfsi = [[bits.read(1) for _ in range(4)] if one else [0] * 4 for _ in range(channels)]
    granules = []
    for _ in range(2 if one else 1):
        for _ in range(channels):
            g = {"part2_3_length": bits.read(12), "big_values": bits.read(9), "global_gain": bits.read(8), "scalefac_compress": bits.read(4 if one else 9), "window_switching": bits.read(1)}
            if g["window_switching"]:
                g |= {"block_type": bits.read(2), "mixed": bits.read(1), "table_select": [bits.read(5), bits.read(5), 0], "subblock_gain": [bits.read(3) for _ in range(3)]}
                g |= {"region0_count": 8 if g["block_type"] == 2 and not g["mixed"] else 7, "region1_count": 0}
            else:
                g |= {"block_type": 0, "mixed": 0, "table_select": [bits.read(5) for _ in range(3)], "subblock_gain": [0] * 3, "region0_count": bits.read(4), "region1_count": bits.read(3)}
            g |= {"preflag": bits.read(1) if one else 0, "scalefac_scale": bits.read(1), "count1table": bits.read(1)}
            if g["big_values"] > 288:
                return S["INVALID_HEADER"], {}
            g["plain_factors"] = not any(n for *_, n in layout(version, g)) and not any(map(any, scfsi))
            granules.append(g)
    silent = all(g["plain_factors"] and not g["part2_3_length"] for g in granules)
    return 0, {"main_data_begin": begin, "private_bits": private, "scfsi": scfsi, "granules": granules, "silent": silent}


def slen_lsf(compress: int) -> tuple[int, int, int, int]:
    if compress < 400:
        high = compress >> 4
        return high // 5, high % 5, (compress & 15) >> 2, compress & 3
    if compress < 500:
        rest = compress - 400
        return (rest >> 2) // 5, (rest >> 2) % 5, rest & 3, 0
    return (compress - 500) // 3, (compress - 500) % 3, 0, 0


def slen_columns(version: Column, compress: Column) -> list[Column]:
    """slen1 to slen4 as columns (MPEG-1 has two)."""
    pick = lambda i: F.element_at(F.array(*[F.lit(p[i]) for p in tables.SLEN]), compress.bitwiseAND(15) + 1)
    div = lambda a, b: F.floor(a / b).cast("int")
    high, mid, low = F.shiftright(compress, 4), F.shiftright(compress - 400, 2), compress - 500
    lsf = [
        F.when(compress < 400, div(high, 5)).when(compress < 500, div(mid, 5)).otherwise(div(low, 3)),
        F.when(compress < 400, high % 5).when(compress < 500, mid % 5).otherwise(low % 3),
        F.when(compress < 400, F.shiftright(compress.bitwiseAND(15), 2)).when(compress < 500, (compress - 400).bitwiseAND(3)).otherwise(0),
        F.when(compress < 400, compress.bitwiseAND(3)).otherwise(0),
    ]
    one = [pick(0), pick(1), F.lit(0), F.lit(0)]
    return [F.when(version == 3, a).otherwise(b).cast("int") for a, b in zip(one, lsf, strict=True)]


def layout(version: int, g: dict) -> list[tuple[str, int, int, int]]:
    """(kind, first band, end band, bits of each) of a granule's scalefactors in stream order."""
    short = g["block_type"] == 2 and g["window_switching"]
    if version == 3:
        a, b = tables.SLEN[g["scalefac_compress"] & 15]
        if short and g["mixed"]:
            return [("long", 0, 8, a), ("short", 3, 6, a), ("short", 6, 12, b)]
        if short:
            return [("short", 0, 6, a), ("short", 6, 12, b)]
        return [("long", 0, 6, a), ("long", 6, 11, a), ("long", 11, 16, b), ("long", 16, 21, b)]
    lens = slen_lsf(g["scalefac_compress"])
    if short:
        return [("short", 3 * i, 3 * i + 3, n) for i, n in enumerate(lens)]
    return [("long", a, b, n) for a, b, n in zip((0, 6, 11, 16), (6, 11, 16, 21), lens, strict=True)]


def part2_3_bits(info: dict, version: int, channels: int) -> int:
    return sum(g["part2_3_length"] for g in info["granules"])


def scalefactors(bits: Bits, version: int, info: dict, granule: int, channel: int, channels: int) -> tuple[list[int], list[list[int]]]:
    """(22 long, 13 x 3 short) factors; the second granule takes the first one's bands that scfsi shares."""
    g = info["granules"][granule * channels + channel]
    long, short = [0] * 22, [[0] * 3 for _ in range(13)]
    for part, (kind, a, b, n) in enumerate(layout(version, g)):
        if kind == "short":
            for sfb in range(a, b if n else a):
                short[sfb] = [bits.read(n) for _ in range(3)]
        elif version == 3 and granule == 1 and not (g["window_switching"] and g["block_type"] == 2) and info["scfsi"][channel][part]:
            long[a:b] = info["granules"][channel]["scalefac_l"][a:b]
        elif n:
            long[a:b] = [bits.read(n) for _ in range(a, b)]
    return long, short


def regions(rate: int, g: dict) -> tuple[int, int]:
    """First lines of the second and third region of big values."""
    if g["window_switching"]:
        if g["block_type"] == 2:
            return (72 if rate == 8000 else 36), 576
        return (36 if rate in (44100, 48000, 32000) else 108 if rate == 8000 else 54), 576
    band, a = tables.bands(rate), g["region0_count"] + 1
    b = a + g["region1_count"] + 1
    return (band[a] if a < 23 else 576), (band[b] if b < 23 else 576)




QUADS = {c: ((i >> 3) & 1, (i >> 2) & 1, (i >> 1) & 1, i & 1) for i, c in enumerate(tables.QUAD_CODES)}
PLAIN_QUADS = {f"{15 - i:04b}": q for i, q in enumerate(QUADS.values())}
LONGEST = 20
#: Bits that one look-up takes in: a code and its signs.
AHEAD = 12


def _look_ahead(codes: dict, escapes: bool) -> list:
    """By the next AHEAD bits: (bits, values with signs), None where they do not hold a code, its signs
    and nothing that escape bits follow."""
    out: list = [None] * (1 << AHEAD)
    for code, values in codes.items():
        signed = [i for i, v in enumerate(values) if v]
        size = len(code) + len(signed)
        if size > AHEAD or (escapes and 15 in values):
            continue
        for signs in range(1 << len(signed)):
            mine = list(values)
            for k, i in enumerate(signed):
                if signs >> (len(signed) - 1 - k) & 1:
                    mine[i] = -mine[i]
            low = (int(code, 2) << len(signed) | signs) << (AHEAD - size)
            out[low : low + (1 << (AHEAD - size))] = [(size, *mine)] * (1 << (AHEAD - size))
    return out


_ahead: dict[int, tuple] = {}


def ahead(codes: dict, escapes: bool = False) -> list:
    """_look_ahead(), made once for each table of codes that is alive."""
    known = _ahead.get(id(codes))
    if known is None or known[0] is not codes or known[1] != escapes:
        known = _ahead[id(codes)] = (codes, escapes, _look_ahead(codes, escapes))
    return known[2]


def _code(bits: Bits, codes: dict, end: int):
    """The value of the code at the position, which moves behind it; None without one before end."""
    string = bits.peek(min(LONGEST - 1, max(0, end - bits.pos)))
    for n in range(1, len(string) + 1):
        found = codes.get(string[:n])
        if found is not None:
            bits.pos += n
            return found
    return None


def spectrum(bits: Bits, rate: int, g: dict, length: int, books: dict, compat: bool = False) -> tuple[int, list[int]]:
    """(status, 576 values) of the length bits at the position, which ends behind them.

    One look-up gives a code with its signs; codes that are longer, have escape bits or stand at the
    very end are read bit by bit. Count-1 quadruples that need bits past the end of the data fail; with
    compat they are made of ones as if zeros followed. A table without codes in books is UNSUPPORTED."""
    end, out = bits.pos + length, [0] * 576
    if length == 0:
        return 0, out
    first, second = regions(rate, g)
    line, most = 0, min(576, 2 * g["big_values"])
    safe, windows, down, mask = min(end, bits.total), bits.windows, 32 - AHEAD, (1 << AHEAD) - 1
    for table, stop in zip(g["table_select"], (first, second, 576), strict=True):
        stop = min(stop, most)
        if line >= stop:
            continue
        if table not in books:
            return S["UNSUPPORTED"], out
        codes, linbits = books[table]
        if not codes:
            line = stop + (stop - line) % 2
            continue
        quick, pos = ahead(codes, linbits > 0), bits.pos
        while line < stop:
            found = quick[(windows[pos >> 3] >> (down - (pos & 7))) & mask] if pos < safe else None
            if found is not None and pos + found[0] <= safe:
                out[line], out[line + 1] = found[1], found[2]
                pos += found[0]
                line += 2
                continue
            bits.pos = pos
            pair = _code(bits, codes, end)
            if pair is None:
                return S["HUFFMAN_FAIL"], out
            for k, v in enumerate(pair):
                if linbits and v == 15:
                    if bits.pos + linbits > end:
                        return S["HUFFMAN_FAIL"], out
                    v += bits.read(linbits)
                if v:
                    if bits.pos + 1 > end:
                        return S["HUFFMAN_FAIL"], out
                    v = -v if bits.read(1) else v
                out[line + k] = v
            line += 2
            pos = bits.pos
        bits.pos = pos
    quads = PLAIN_QUADS if g["count1table"] else QUADS
    quick, pos = ahead(quads), bits.pos
    while line + 4 <= 576 and pos < end:
        found = quick[(windows[pos >> 3] >> (down - (pos & 7))) & mask] if pos < safe else None
        if found is not None and pos + found[0] <= safe:
            out[line : line + 4] = found[1:]
            pos += found[0]
            line += 4
            continue
        bits.pos = pos
        if g["count1table"]:
            if bits.pos + 4 > end:
                break
            if bits.pos + 4 > bits.total and not compat:
                return S["HUFFMAN_FAIL"], out
            raw = bits.read(4)
            quad = [1 - ((raw >> s) & 1) for s in (3, 2, 1, 0)]
        else:
            quad = _code(bits, QUADS, end)
            if quad is None:
                if end > bits.total and not compat:
                    return S["HUFFMAN_FAIL"], out
                break
        for k, v in enumerate(quad):
            out[line + k] = -v if v and bits.pos < end and bits.read(1) else v
        line += 4
        pos = bits.pos
    bits.pos = max(bits.pos, pos)
    if bits.pos < end:
        bits.skip(end - bits.pos)
    return 0, out


def zero_start(values: list[int]) -> int:
    return next((i for i in range(len(values), 0, -1) if values[i - 1]), 0)


def decode_granules(main: bytes, info: dict, version: int, channels: int, rate: int, books: dict, compat: bool = False) -> tuple[int, list[dict]]:
    """(status, granules with scalefac_l, scalefac_s, coef and zero_start) of a frame's main data."""
    bits, done = Bits(main), []
    info = info | {"granules": [dict(g) for g in info["granules"]]}
    for i, g in enumerate(info["granules"]):
        granule, channel = divmod(i, channels)
        start = bits.pos
        g["scalefac_l"], g["scalefac_s"] = scalefactors(bits, version, info, granule, channel, channels)
        if bits.error:
            return S["NEED_MORE_DATA"], []
        used = bits.pos - start
        if used > g["part2_3_length"]:
            return S["HUFFMAN_FAIL"], []
        status, coef = spectrum(bits, rate, g, g["part2_3_length"] - used, books, compat)
        if status:
            return status, []
        bits.error = False
        if bits.pos - start < g["part2_3_length"]:
            bits.skip(g["part2_3_length"] - (bits.pos - start))
        done.append(g | {"gr": granule, "ch": channel, "coef": coef, "zero_start": zero_start(coef)})
    return 0, done


# --- Many frames in step -----------------------------------------------------------------------------

#: Marks bits that hold no code with its signs: more bits than any granule has.
NONE = 1 << 14
_ZEROS = [0] * 22, [[0] * 3] * 13
_packed: dict[int, tuple] = {}


def _fields(found, none: int) -> int:
    """A look-up's entry as one number: bits, and eight bits for each value."""
    return none << 32 if found is None else found[0] << 32 | sum((v + 128) << (8 * i) for i, v in enumerate(found[1:]))


def _tables(books: dict, wanted) -> tuple[np.ndarray, np.ndarray]:
    """Look-ups of the pair tables (as far as wanted) and of the quadruples, kept while books is alive."""
    known = _packed.get(id(books))
    if known is None or known[0] is not books:
        quads = np.array([[_fields(f, NONE) for f in ahead(codes)] for codes in (QUADS, PLAIN_QUADS)], np.int64)
        _packed.clear()
        known = _packed[id(books)] = books, np.full((32, 1 << AHEAD), NONE << 32, np.int64), quads, set()
    _, pairs, quads, made = known
    for t in set(wanted) - made:
        codes, linbits = books.get(t, (None, 0))
        if codes is not None:
            pairs[t] = [_fields(f, NONE) for f in ahead(codes, linbits > 0)] if codes else _fields((0, 0, 0), NONE)
        made.add(t)
    return pairs.ravel(), quads.ravel()


def _in_step(main: bytes, pos, end, first, second, most, select, quad, books: dict) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients (n, 576), whether all codes were short ones that end in time) of granules at bit
    positions pos to end of main, which holds all of them."""
    pairs, quads = _tables(books, np.unique(select).tolist())
    order = np.argsort(-most, kind="stable")
    pos, end, first, second, most, select, quad = (x[order] for x in (pos, end, first, second, most, select, quad))
    d = np.frombuffer(main + bytes(4), np.uint8).astype(np.int64)
    windows = (d[:-3] << 24) | (d[1:-2] << 16) | (d[2:-1] << 8) | d[3:]
    down, mask = 32 - AHEAD, (1 << AHEAD) - 1
    n, steps = len(pos), int(most[0]) // 2
    found, late = np.full((steps, n), _fields((0, 0, 0), NONE), np.int64), np.zeros(n, bool)
    active, edges = np.searchsorted(-most, -2 * np.arange(steps), side="left"), {0, *first.tolist(), *second.tolist()}
    for step in range(steps):
        if 2 * step in edges:
            of = np.where(2 * step < first, select[:, 0], np.where(2 * step < second, select[:, 1], select[:, 2])) << AHEAD
        k = active[step]
        p = pos[:k]
        e = pairs[of[:k] + ((windows[p >> 3] >> (down - (p & 7))) & mask)]
        found[step, :k] = e
        p = p + (e >> 32)
        late[:k] |= p > end[:k]
        np.minimum(p, end[:k], out=pos[:k])
    coef = np.zeros((n, 576), np.int16)
    coef[:, 0 : 2 * steps : 2], coef[:, 1 : 2 * steps : 2] = (found.T & 255) - 128, ((found.T >> 8) & 255) - 128
    line, i = most.copy(), np.nonzero(~late & (most + 4 <= 576) & (pos < end))[0]
    while len(i):
        p = pos[i]
        e = quads[(quad[i] << AHEAD) + ((windows[p >> 3] >> (down - (p & 7))) & mask)]
        p = p + (e >> 32)
        late[i] = p > end[i]
        pos[i] = np.minimum(p, end[i])
        i, e = i[~late[i]], e[~late[i]]
        for j in range(4):
            coef[i, line[i] + j] = ((e >> (8 * j)) & 255) - 128
        line[i] += 4
        i = i[(line[i] + 4 <= 576) & (pos[i] < end[i])]
    back = np.argsort(order)
    return coef[back], ~late[back]


def decode_many(frames: list[tuple], books: dict, compat: bool = False) -> tuple[list, np.ndarray]:
    """decode_granules() of each (main data, side information, version, channels, rate), and the
    coefficients of all their granules: a granule has its row in place of coef."""
    granules: list = []  # of the frames whose granules lie within the data: [frame, granule, first bit, last bit, regions]
    mains, at, out = [], 0, []
    for f, (main, info, version, channels, rate) in enumerate(frames):
        start, bits, mine = 0, None, []
        if sum(g["part2_3_length"] for g in info["granules"]) <= 8 * len(main):
            info = info | {"granules": [dict(g) for g in info["granules"]]}
            for i, g in enumerate(info["granules"]):
                granule, channel = divmod(i, channels)
                used = 0
                if g["plain_factors"]:
                    g["scalefac_l"], g["scalefac_s"] = _ZEROS
                else:
                    bits = bits or Bits(main)
                    bits.pos = start
                    g["scalefac_l"], g["scalefac_s"] = scalefactors(bits, version, info, granule, channel, channels)
                    used = bits.pos - start
                if used > g["part2_3_length"] or (bits and bits.error):
                    break
                g["gr"], g["ch"] = granule, channel
                end = start + g["part2_3_length"]
                mine.append((f, g, at + start + used, at + end, *regions(rate, g)))
                start = end
        if len(mine) == len(info["granules"]):
            granules += mine
            mains.append(main)
            at += 8 * len(main)
            out.append((0, [g for _, g, *_ in mine]))
        else:
            out.append(None)
    coef, good = np.zeros((0, 576), np.int16), np.zeros(0, bool)
    if granules:
        of, gs, *where = zip(*granules, strict=True)
        most = np.array([min(576, 2 * g["big_values"]) if a < b else 0 for g, a, b in zip(gs, where[0], where[1], strict=True)])
        coef, good = _in_step(b"".join(mains), *map(np.array, where), most, np.array([g["table_select"] for g in gs]), np.array([g["count1table"] for g in gs]), books)
        for f in {of[i] for i in np.nonzero(~good)[0]}:
            out[f] = None
        last = 576 - np.argmax(coef[:, ::-1] != 0, axis=1)
        for i, (g, end) in enumerate(zip(gs, np.where(coef.any(axis=1), last, 0).tolist(), strict=True)):
            g["row"], g["zero_start"] = i, end
    more = []
    for f, found in enumerate(out):
        if found is None:
            status, done = decode_granules(*frames[f], books, compat)
            for g in done:
                g["row"] = len(coef) + len(more)
                more.append(g.pop("coef"))
            out[f] = status, done
    return out, np.concatenate([coef, np.array(more, np.int16)]) if more else coef
