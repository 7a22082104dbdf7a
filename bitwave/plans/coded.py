"""Queries over coded audio: values derived from the shared tables are written as codes, frames and
streams, and read back by the operators. Their SQL states the values, or computes samples from them by
the format's formulas."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.bits import Bits
from ..operators import decode, entropy, hybrid, spectrum
from ..operators.frames import frame_index, trimmed
from ..sources import files
from .lenses import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


def _micro(x):
    return F.round(x * 1e6).cast("long")


# --- Writing ---------------------------------------------------------------------------------------


def pair_bits(codes: dict, linbits: int, x: int, y: int) -> str:
    """A pair of big values: code, then escape bits and sign of each. codes: {(x, y): code}."""
    if not codes:
        return ""
    out = codes[min(abs(x), 15), min(abs(y), 15)] if linbits else codes[abs(x), abs(y)]
    for v in (x, y):
        if linbits and abs(v) >= 15:
            out += f"{abs(v) - 15:0{linbits}b}"
        out += "" if v == 0 else "1" if v < 0 else "0"
    return out


def quad_bits(plain: bool, quad) -> str:
    at = sum(abs(v) << (3 - i) for i, v in enumerate(quad))
    return (f"{15 - at:04b}" if plain else tables.QUAD_CODES[at]) + "".join("" if v == 0 else "1" if v < 0 else "0" for v in quad)


def as_bytes(bits: str) -> bytes:
    size = -(-len(bits) // 8)
    return int("1" + bits.ljust(8 * size, "0"), 2).to_bytes(size + 1, "big")[1:]


def writers() -> dict[int, tuple[dict, int]]:
    return {t: ({xy: c for c, xy in codes.items()}, linbits) for t, (codes, linbits) in tables.codebooks().items()}


def mono_frame(granules: list[str], big_values: int, table_no: int, gain: int, begin: int = 0) -> bytes:
    """An MPEG-1 mono frame of 44.1 kHz with two granules of long blocks and no scalefactors."""
    word = 0xFFE00000 | 3 << 19 | 1 << 17 | 1 << 16 | 9 << 12 | 3 << 6
    side = f"{begin:09b}" + "0" * 9
    for g in granules:
        side += f"{len(g):012b}{big_values:09b}{gain:08b}" + "0000" + "0" + f"{table_no:05b}" * 3 + "0000" + "000" + "000"
    return (word.to_bytes(4, "big") + as_bytes(side) + as_bytes("".join(granules))).ljust(files.frame_length(word), b"\0")


# --- Entropy codes ----------------------------------------------------------------------------------

#: Every table with codes, and the largest value that it holds.
LARGEST = {1: 1, 2: 2, 3: 2, 5: 3, 6: 3, 7: 5, 8: 5, 9: 5, 10: 7, 11: 7, 12: 7, 13: 15, 15: 15} | {t: 14 + (1 << b) for t, b in tables.LINBITS.items()}
_books = list(LARGEST)
_pair_sql = f"""select {', '.join(KEYS)}, t as table_no, 0 as status, cast(l_orderkey * 31 % (2 * most + 1) - most as integer) as x, cast(l_suppkey * 7 % (2 * most + 1) - most as integer) as y
  from (select *, {_books}[(l_partkey + l_linenumber) % {len(_books)} + 1] as t, {list(LARGEST.values())}[(l_partkey + l_linenumber) % {len(_books)} + 1] as most from lineitem)"""


@query(_pair_sql)
def huffman_tables(spark, sf_dir):
    """A pair of big values by each table with codes, with escapes and signs, written and read."""
    which = F.expr(f"(l_partkey + l_linenumber) % {len(_books)} + 1").cast("int")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), which)
    df = table(spark, sf_dir, "lineitem").select(*KEYS, pick(_books).alias("table_no"), pick(LARGEST.values()).alias("most"))
    df = df.select(*KEYS, "table_no", F.expr("cast(l_orderkey * 31 % (2 * most + 1) - most as int)").alias("x"), F.expr("cast(l_suppkey * 7 % (2 * most + 1) - most as int)").alias("y"))

    def run(batches):
        write, books = writers(), tables.codebooks()
        g = {"window_switching": 0, "region0_count": 0, "region1_count": 0, "big_values": 1, "count1table": 0}
        for batch in batches:
            out = []
            for t, x, y in zip(*[c.to_pylist() for c in batch.columns[4:]], strict=True):
                code = pair_bits(*write[t], x, y)
                status, v = entropy.spectrum(Bits(as_bytes(code)), 44100, g | {"table_select": [t] * 3}, len(code), books)
                out.append((status, v[0], v[1]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *[pa.array(c, pa.int32()) for c in zip(*out, strict=True)]] if out else [*batch.columns[:5], *[pa.array([], pa.int32())] * 3], [*KEYS, "table_no", "status", "x", "y"])

    return df.mapInArrow(run, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, table_no int, status int, x int, y int")


_quad = "case when {0} % 3 = 0 then 0 when {0} % 3 = 1 then 1 else -1 end"
_quads = [f"cast({_quad.format(x)} as integer)" for x in ("l_orderkey", "l_partkey", "l_suppkey", "(l_orderkey + l_linenumber)")]


@query(f"select {', '.join(KEYS)}, cast(l_partkey % 2 as integer) as plain, 0 as status, {', '.join(f'{q} as v{i}' for i, q in enumerate(_quads))} from lineitem")
def count1_quads(spark, sf_dir):
    """A quadruple of small values by either table, with signs, written and read."""
    df = table(spark, sf_dir, "lineitem").selectExpr(*KEYS, "cast(l_partkey % 2 as int) as plain", *[f"{q} as v{i}" for i, q in enumerate(_quads)])

    def run(batches):
        books = tables.codebooks()
        g = {"window_switching": 0, "region0_count": 0, "region1_count": 0, "big_values": 0, "table_select": [1] * 3}
        for batch in batches:
            out = []
            for plain, *quad in zip(*[c.to_pylist() for c in batch.columns[4:]], strict=True):
                code = quad_bits(bool(plain), quad)
                status, v = entropy.spectrum(Bits(as_bytes(code)), 44100, g | {"count1table": plain}, len(code), books)
                out.append((status, *v[:4]))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *[pa.array(c, pa.int32()) for c in columns]], [*KEYS, "plain", "status", *[f"v{i}" for i in range(4)]])

    return df.mapInArrow(run, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, plain int, status int, v0 int, v1 int, v2 int, v3 int")


# --- Side information and scalefactors ----------------------------------------------------------------

#: Of the first granule of a mono frame: name, SQL and bits with and without block switching.
_side = {
    "part2_3_length": ("l_partkey * 3 % 4096", 12), "big_values": ("l_suppkey * 11 % 289", 9), "global_gain": ("l_orderkey % 256", 8), "scalefac_compress": ("l_partkey % 16", 4), "window_switching": ("l_orderkey % 2", 1),
    "block_type": ("l_linenumber % 4", 2), "mixed": ("l_suppkey % 2", 1), "table0": ("l_partkey % 32", 5), "table1": ("l_suppkey % 32", 5), "table2": ("l_orderkey % 32", 5),
    "gain0": ("l_orderkey % 8", 3), "gain1": ("l_partkey % 8", 3), "gain2": ("l_suppkey % 8", 3), "region0_count": ("l_orderkey % 16", 4), "region1_count": ("l_suppkey % 8", 3),
    "preflag": ("l_partkey % 2", 1), "scalefac_scale": ("l_suppkey // 2 % 2", 1), "count1table": ("l_orderkey // 2 % 2", 1),
}
_switched, _plain_only = {"block_type", "mixed", "gain0", "gain1", "gain2"}, {"table2", "region0_count", "region1_count"}


def _side_sql(name: str) -> str:
    e = _side[name][0]
    if name in _switched:
        return f"cast(case when l_orderkey % 2 = 1 then {e} else 0 end as integer) as {name}"
    if name == "table2":
        return f"cast(case when l_orderkey % 2 = 1 then 0 else {e} end as integer) as table2"
    if name == "region0_count":
        return f"cast(case when l_orderkey % 2 = 0 then {e} when l_linenumber % 4 = 2 and l_suppkey % 2 = 0 then 8 else 7 end as integer) as region0_count"
    if name == "region1_count":
        return f"cast(case when l_orderkey % 2 = 0 then {e} else 0 end as integer) as region1_count"
    return f"cast({e} as integer) as {name}"


@query(f"select {', '.join(KEYS)}, 0 as status, cast(l_partkey % 512 as integer) as main_data_begin, cast(l_suppkey % 16 as integer) as scfsi, {', '.join(map(_side_sql, _side))} from lineitem")
def side_info_fields(spark, sf_dir):
    """Side information of MPEG-1 mono frames: the frame's fields and those of its first granule."""
    bit = lambda e, n: f"lpad(bin(cast({e.replace('//', 'div')} as bigint)), {n}, '0')"
    part = lambda names: ", ".join(bit(*_side[n]) for n in names)
    head = part(["part2_3_length", "big_values", "global_gain", "scalefac_compress", "window_switching"])
    switched, plain = part(["block_type", "mixed", "table0", "table1", "gain0", "gain1", "gain2"]), part(["table0", "table1", "table2", "region0_count", "region1_count"])
    bits = f"concat({bit('l_partkey % 512', 9)}, '00000', {bit('l_suppkey % 16', 4)}, {head}, if(l_orderkey % 2 = 1, concat({switched}), concat({plain})), {part(['preflag', 'scalefac_scale', 'count1table'])}, repeat('0', 59))"
    data = f"unhex(concat({', '.join(f'''lpad(conv(substring(b, {8 * i + 1}, 8), 2, 16), 2, '0')''' for i in range(17))}))"
    df = table(spark, sf_dir, "lineitem").selectExpr(*KEYS, f"{bits} as b").select(*KEYS, F.expr(data).alias("data"))

    def run(batches):
        for batch in batches:
            out = []
            for data in batch.column(4).to_pylist():
                status, info = entropy.side_info(data, 3, 1)
                g = info["granules"][0]
                flat = g | {f"table{i}": t for i, t in enumerate(g["table_select"])} | {f"gain{i}": t for i, t in enumerate(g["subblock_gain"])}
                out.append((status, info["main_data_begin"], sum(b << (3 - i) for i, b in enumerate(info["scfsi"][0])), *[flat[n] for n in _side]))
            columns = zip(*out, strict=True) if out else [[]] * (3 + len(_side))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *[pa.array(c, pa.int32()) for c in columns]], [*KEYS, "status", "main_data_begin", "scfsi", *_side])

    return df.mapInArrow(run, f"l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, status int, main_data_begin int, scfsi int, {', '.join(f'{n} int' for n in _side)}")


_slens = lambda i: str([s[i] for s in tables.SLEN])
#: Factors of an order: long ones by band, short ones by band and window; a few bits each, by scalefac_compress.
_factor_sql = f"""with o as (select o_orderkey, cast(o_custkey % 16 as integer) as c, cast(o_orderkey % 3 as integer) as kind from orders),
  n as (select *, {_slens(0)}[c + 1] as a, {_slens(1)}[c + 1] as b from o),
  x as (select o_orderkey, kind, 0 as gr, 'long' as form, unnest(range(0, 22)) as band, 0 as win, a, b from n where kind = 0
    union all select o_orderkey, kind, 1, 'long', unnest(range(0, 22)), 0, a, b from n where kind = 0
    union all select o_orderkey, kind, 0, 'long', unnest(range(0, 8)), 0, a, b from n where kind = 2
    union all select o_orderkey, kind, 0, 'short', s % 12, s // 12, a, b from (select *, unnest(range(0, 36)) as s from n where kind = 1)
    union all select o_orderkey, kind, 0, 'short', 3 + s % 9, s // 9, a, b from (select *, unnest(range(0, 27)) as s from n where kind = 2)),
  w as (select *, case when form = 'long' then case when band >= 21 then 0 when band < 11 or kind = 2 then a else b end else case when band < 6 then a else b end end as bits,
    case when gr = 1 and (band < 6 or band between 11 and 15) then 0 else gr end as from_gr from x)
  select o_orderkey, gr, form, cast(band as integer) as band, cast(win as integer) as win, cast(case when bits = 0 then 0 else (o_orderkey + 5 * band + 3 * win + 2 * from_gr) % (1 << bits) end as integer) as factor from w"""


@query(_factor_sql)
def scalefactor_values(spark, sf_dir):
    """Scalefactors of long, short and mixed blocks; a second long granule shares two of its four parts."""
    df = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "cast(o_custkey % 16 as int) as c", "cast(o_orderkey % 3 as int) as kind")

    def run(batches):
        for batch in batches:
            out = []
            for key, c, kind in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                g = {"scalefac_compress": c, "window_switching": int(kind > 0), "block_type": 2 if kind else 0, "mixed": int(kind == 2)}
                a, b = tables.SLEN[c]
                value = lambda band, win, gr, n: f"{(key + 5 * band + 3 * win + 2 * gr) % (1 << n):0{n}b}" if n else ""  # noqa: B023, E731
                written = "".join(value(band, 0, 0, a if band < 11 or kind else b) for band in range((21, 0, 8)[kind]))
                written += "".join(value(band, win, 0, a if band < 6 else b) for band in range(12, 12) or (range(12) if kind == 1 else range(3, 12) if kind else ()) for win in range(3))
                if kind == 0:  # of the second granule only the parts that scfsi does not share
                    written += "".join(value(band, 0, 1, a if band < 11 else b) for band in (*range(6, 11), *range(16, 21)))
                bits, info = Bits(as_bytes(written)), {"scfsi": [[1, 0, 1, 0]], "granules": [dict(g), dict(g)]}
                long, short = entropy.scalefactors(bits, 3, info, 0, 0, 1)
                info["granules"][0]["scalefac_l"] = long
                out += [(key, 0, "long", i, 0, v) for i, v in enumerate(long[: (22, 0, 8)[kind]])]
                out += [(key, 0, "short", i, w, short[i][w]) for i in (range(12) if kind == 1 else range(3, 12) if kind else ()) for w in range(3)]
                if kind == 0:
                    out += [(key, 1, "long", i, 0, v) for i, v in enumerate(entropy.scalefactors(bits, 3, info, 1, 0, 1)[0])]
            for i in range(0, len(out), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[i : i + 50_000], strict=True), (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["o_orderkey", "gr", "form", "band", "win", "factor"])

    return df.mapInArrow(run, "o_orderkey long, gr int, form string, band int, win int, factor int")


# --- Spectra ------------------------------------------------------------------------------------------


def _of_vectors(spark, sf_dir, make):
    """(vec_id, pos, value) of make(vec_id, 64 numbers), which gives 576 numbers."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                ids = batch.column(0).slice(a, 64).to_numpy()
                x = [make(int(i), np.array(v, np.float64)) for i, v in zip(ids, batch.column(1).slice(a, 64).to_pylist(), strict=True)]
                flat = np.concatenate([np.empty(0), *x])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, 576)), pa.array(np.tile(np.arange(576, dtype=np.int32), len(x))), pa.array(flat)], ["vec_id", "pos", "value"])

    return df.mapInArrow(run, "vec_id long, pos int, value double").select("vec_id", "pos", _micro(F.col("value")).alias("value"))


def _coefficients(v: np.ndarray) -> list[int]:
    return np.trunc(v[np.arange(576) % 64] * 9).astype(int).tolist()


_coef_sql = "cast(trunc(embedding[i % 64 + 1]::double * 9) as integer)"
_short_bands = ", ".join(f"({s}, {b}, {e})" for s, (b, e) in enumerate(zip(tables.SHORT_BANDS[44100][:12], tables.SHORT_BANDS[44100][1:13], strict=True)))
_long_bands = "[" + ", ".join(str(int(b)) for b in tables.band_of_line(44100)) + "]"
#: By vector: short blocks (even) or mixed ones; gains and factors follow from the number.
_short_lines = f"""with b(band, first, stop) as (values {_short_bands}),
  s as (select band, win, first + j as f, 3 * first + case when mixed = 1 then 3 * j + win else win * (stop - first) + j end as i, mixed
    from (select *, unnest(range(0, stop - first)) as j from b), range(0, 3) t(win), range(0, 2) u(mixed) where band >= 3 * mixed),
  m as (select mixed, band, win, i, f // 6 * 18 + f % 6 * 3 + win as o from s where i < 576 and f // 6 * 18 + f % 6 * 3 + win < 576)"""
_power = "case when {0} = 0 then 0 else sign({0}) * power(abs({0}), {1!r}) end".format("v", 4 / 3)


@query(f"""{_short_lines}, e as (select vec_id, vec_id % 2 as mixed, embedding from embeddings),
  short as (select vec_id, o as pos, {_power} * power(2, 0.25 * (190 + vec_id % 12 - 214) - (2 * ((vec_id + win) % 3) + 0.5 * (1 + vec_id % 2) * ((band + win + vec_id) % 5))) as x
    from (select vec_id, m.*, {_coef_sql} as v from e join m using (mixed))),
  long as (select vec_id, i as pos, {_power} * power(2, 0.25 * (190 + vec_id % 12 - 214) - 0.5 * (1 + vec_id % 2) * ((band + vec_id) % 4)) as x
    from (select vec_id, i, {_long_bands}[i + 1] as band, {_coef_sql} as v from (select vec_id, embedding, unnest(range(0, 36)) as i from e where mixed = 1))),
  every as (select vec_id, unnest(range(0, 576)) as pos from embeddings)
  select vec_id, cast(pos as integer) as pos, cast(round(coalesce(x, 0) * 1e6) as bigint) as value from every left join (select * from short union all select * from long) using (vec_id, pos)""")
def requantise_blocks(spark, sf_dir):
    """Lines of short and mixed blocks: reordered, with gains by window and factors by band and window."""

    def make(i, v):
        g = {"coef": _coefficients(v), "global_gain": 190 + i % 12, "scalefac_scale": i % 2, "preflag": 0, "window_switching": 1, "block_type": 2, "mixed": i % 2, "subblock_gain": [(i + w) % 3 for w in range(3)]}
        return spectrum.requantise(44100, g | {"scalefac_l": [(b + i) % 4 for b in range(22)], "scalefac_s": [[(b + w + i) % 5 for w in range(3)] for b in range(13)]})

    return _of_vectors(spark, sf_dir, make)


_half = repr(float(np.sqrt(0.5)))
_ratio = lambda i: "[" + ", ".join(repr(x[i]) for x in [*tables.intensity_ratios(), (1.0, 0.0)]) + "]"
_stereo_sql = f"""with e as (select vec_id, vec_id % 4 as ext, vec_id * 37 % 577 as start, embedding, unnest(range(0, 576)) as i from embeddings),
  p as (select vec_id, ext, start, i, embedding[i % 64 + 1]::double as l, embedding[(i * 7 + 3) % 64 + 1]::double as r, {_long_bands}[i + 1] as band from e),
  q as (select *, case when band < 21 then least((band + vec_id) % 9, 7) else 7 end as place from p)
  select vec_id, cast(i as integer) as pos, cast(round(case when ext = 0 then l when ext = 2 then (l + r) * {_half} when i < start then case when ext = 3 then (l + r) * {_half} else l end when place < 7 then l * {_ratio(0)}[place + 1] else l end * 1e6) as bigint) as l,
    cast(round(case when ext = 0 then r when ext = 2 then (l - r) * {_half} when i < start then case when ext = 3 then (l - r) * {_half} else r end when place < 7 then l * {_ratio(1)}[place + 1] else r end * 1e6) as bigint) as r from q"""


@query(_stereo_sql)
def stereo_modes(spark, sf_dir):
    """Plain, intensity, middle-side and both together over whole granules of long blocks."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                ids, out = batch.column(0).slice(a, 64).to_numpy(), []
                for i, v in zip(ids.tolist(), batch.column(1).slice(a, 64).to_pylist(), strict=True):
                    v, n = np.array(v, np.float64), np.arange(576)
                    g = {"window_switching": 0, "block_type": 0, "mixed": 0, "zero_start": i * 37 % 577, "scalefac_l": [min((b + i) % 9, 7) for b in range(22)], "scalefac_s": [[0] * 3] * 13}
                    out.append(spectrum.stereo(44100, 1, i % 4, g, [v[n % 64], v[(n * 7 + 3) % 64]]))
                left, right = (np.concatenate([np.empty(0), *[x[c] for x in out]]) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, 576)), pa.array(np.tile(np.arange(576, dtype=np.int32), len(out))), pa.array(left), pa.array(right)], ["vec_id", "pos", "l", "r"])

    return df.mapInArrow(run, "vec_id long, pos int, l double, r double").select("vec_id", "pos", _micro(F.col("l")).alias("l"), _micro(F.col("r")).alias("r"))


#: Lines of a vector's granule and of the one before, and the block type by vec_id: long, short, stop.
_kinds = ((0, 0), (1, 2), (1, 3))
_blocks_sql = """with e as (select vec_id, vec_id % 3 as kind, embedding from embeddings),
  x as (select vec_id, kind, sb, k, embedding[(18 * sb + k) % 64 + 1]::double as now, embedding[(18 * sb + k + 11) % 64 + 1]::double as old from e, range(0, 32) s(sb), range(0, 18) t(k)),
  y as (select vec_id, kind, sb, i, sum(now * cos(pi() / 72 * (2 * i + 19) * (2 * k + 1))) as a, sum(old * cos(pi() / 72 * (2 * (18 + i) + 19) * (2 * k + 1))) as h from x, range(0, 9) u(i) where kind <> 1 group by all),
  w as (select *, case when kind = 0 then sin(pi() / 36 * (17 - i + 0.5)) when i < 6 then 1 else sin(pi() / 12 * (11 - i + 0.5)) end as near, case when kind = 0 then sin(pi() / 36 * (i + 0.5)) when i < 6 then 0 else sin(pi() / 12 * (i - 6 + 0.5)) end as far from y),
  long as (select vec_id, sb, i as t, h * near + a * far as v from w union all select vec_id, sb, 17 - i, h * far - a * near from w),
  z as (select vec_id, sb, win, i, sum(now * cos(pi() / 24 * (2 * i + 7) * (2 * (k // 3) + 1))) as a, sum(old * cos(pi() / 24 * (2 * i + 7) * (2 * (k // 3) + 1))) as o
    from (select *, k % 3 as win from x where kind = 1), range(0, 12) u(i) group by all),
  short as (select vec_id, sb, t, sum(v) as v from (select vec_id, sb, 6 + 6 * win + i as t, a * sin(pi() / 12 * (i + 0.5)) as v from z union all select vec_id, sb, 6 * win + i - 12, o * sin(pi() / 12 * (i + 0.5)) from z) where t between 0 and 17 group by all),
  joined as (select * from long union all select * from short)
  select vec_id, cast(32 * t + sb as integer) as pos, cast(round(case when t % 2 = 1 and sb % 2 = 1 then -v else v end * 1e6) as bigint) as value from joined"""


@query(_blocks_sql)
def subband_blocks(spark, sf_dir):
    """Inverse transforms, windows, overlap and frequency inversion of long, short and stop blocks."""

    def make(i, v):
        switching, kind = _kinds[i % 3]
        n, one = np.arange(576), lambda x: np.array([x])
        args = one(kind), one(switching), one(0)
        return hybrid.subbands(v[n % 64][None], *args, v[(n + 11) % 64][None], *args).ravel()

    return _of_vectors(spark, sf_dir, make)


_window = "[" + ", ".join(repr(float(x)) for x in tables.published_window()) + "]"
#: From s(key, t, k, x): subbands at times 0, 1, ... to out(key, sample, y); times before 0 are silent.
_synthesis_ctes = f"""v as (select key, t, i, sum(x * 2 * cos((16 + i) * (2 * k + 1) * pi() / 64)) as y from s, range(0, 64) u(i) group by all),
  out as (select key, 32 * (t + d) + i % 32 as sample, sum(y * {_window}[cast(64 * (d // 2) + i + 1 as bigint)]) as y from (select *, unnest(range(0, 16)) as d from v) where (d % 2 = 0 and i < 32) or (d % 2 = 1 and i >= 32) group by all)"""


@query(f"""with s as (select s_suppkey as key, t, k, ((s_suppkey * 31 + t * 17 + k * 7) % 201 - 100) / 100.0::double as x from supplier, range(0, 36) a(t), range(0, 32) b(k)),
  {_synthesis_ctes} select key as s_suppkey, cast(sample - 576 as integer) as pos, cast(round(y * 1e6) as bigint) as value from out where sample between 576 and 1151""")
def synthesis_granule(spark, sf_dir):
    """576 samples from the subbands of a granule and of the one before, by the published window."""

    def run(batches):
        t, k = np.arange(36)[:, None], np.arange(32)[None, :]
        for batch in batches:
            ids = batch.column(0).to_numpy()
            x = ((ids[:, None, None] * 31 + t * 17 + k * 7) % 201 - 100) / 100
            y = hybrid.synthesis(x[:, 18:], x[:, :18])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, 576)), pa.array(np.tile(np.arange(576, dtype=np.int32), len(ids))), pa.array(y.ravel())], ["s_suppkey", "pos", "value"])

    out = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey")).mapInArrow(run, "s_suppkey long, pos int, value double")
    return out.select("s_suppkey", "pos", _micro(F.col("value")).alias("value"))


# --- Bytes to samples ---------------------------------------------------------------------------------

#: Frames of a stream, pairs and quadruples of a granule, its table and gain; the frames with damage.
N_FRAMES, PAIRS, QUADS, TABLE, GAIN = 4, 60, 10, 7, 176


def streams(spark, sf_dir):
    """A coded mono stream for each supplier. Of every fifth the second frame has no valid header, of every
    seventh the third one points before the reservoir."""
    keys = decode.by_stream(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey")), "s_suppkey")

    def run(batches):
        codes, linbits = writers()[TABLE]
        for batch in batches:
            content = []
            for s in batch.column(0).to_pylist():
                frames = []
                for f in range(N_FRAMES):
                    granules = []
                    for g in (2 * f, 2 * f + 1):
                        big = [(s * 7 + g * 5 + line * 3) % 11 - 5 for line in range(2 * PAIRS)]
                        small = [(s + g + line) % 3 - 1 for line in range(2 * PAIRS, 2 * PAIRS + 4 * QUADS)]
                        granules.append("".join(pair_bits(codes, linbits, *big[i : i + 2]) for i in range(0, len(big), 2)) + "".join(quad_bits(False, small[i : i + 4]) for i in range(0, len(small), 4)))
                    frame = mono_frame(granules, PAIRS, TABLE, GAIN, begin=400 if f == 2 and s % 7 == 0 else 0)
                    frames.append(b"\x55" * len(frame) if f == 1 and s % 5 == 0 else frame)
                content.append(b"junk" + b"".join(frames))
            yield pa.RecordBatch.from_arrays([pa.array(map(str, batch.column(0).to_pylist()), pa.string()), pa.array(content, pa.binary())], ["stream_id", "content"])

    return keys.mapInArrow(run, "stream_id string, content binary")


_lost = "(f = 1 and s % 5 = 0 or f = 2 and s % 7 = 0)"
#: Good granules numbered as they are decoded, their lines after antialiasing, subbands with overlap.
_decode_ctes = f"""c as (select cast(s_suppkey as bigint) as s, f, 2 * f + h as g from supplier, range(0, {N_FRAMES}) a(f), range(0, 2) b(h)),
  good as (select s, f, g, row_number() over (partition by s order by g) - 1 as n from c where not {_lost}),
  coef as (select s, f, g, n, i, case when i < {2 * PAIRS} then (s * 7 + g * 5 + i * 3) % 11 - 5 when i < {2 * PAIRS + 4 * QUADS} then (s + g + i) % 3 - 1 else 0 end as v from good, range(0, 576) a(i)),
  xr as (select s, n, i, {_power} * power(2, 0.25 * ({GAIN} - 214)) as x from coef),
  part as (select *, i % 18 as low, case when i % 18 >= 10 and i < 558 then 17 - i % 18 when i % 18 < 8 and i >= 18 then i % 18 end as k from xr),
  smooth as (select p.s, p.n, p.i, case when p.k is null then p.x when p.low >= 10 then p.x * {{cos}}[p.k + 1] - q.x * {{sin}}[p.k + 1] else p.x * {{cos}}[p.k + 1] + q.x * {{sin}}[p.k + 1] end as x
    from part p left join xr q on q.s = p.s and q.n = p.n and q.i = case when p.low >= 10 then p.i + 1 + 2 * p.k else p.i - 1 - 2 * p.k end),
  y as (select s, n, i // 18 as sb, j, sum(x * cos(pi() / 72 * (2 * j + 19) * (2 * (i % 18) + 1))) as a, sum(x * cos(pi() / 72 * (2 * (18 + j) + 19) * (2 * (i % 18) + 1))) as h from smooth, range(0, 9) u(j) group by all),
  w as (select y.s, y.n, y.sb, y.j, y.a, coalesce(o.h, 0) as h, sin(pi() / 36 * (17 - y.j + 0.5)) as near, sin(pi() / 36 * (y.j + 0.5)) as far from y left join y o on o.s = y.s and o.n = y.n - 1 and o.sb = y.sb and o.j = y.j),
  sub as (select s, n, sb, j as t, h * near + a * far as v from w union all select s, n, sb, 17 - j, h * far - a * near from w),
  s as (select s as key, 18 * n + t as t, sb as k, case when t % 2 = 1 and sb % 2 = 1 then -v else v end as x from sub)"""
_decode_ctes = _decode_ctes.replace("{cos}", "[" + ", ".join(repr(x[0]) for x in tables.butterflies()) + "]").replace("{sin}", "[" + ", ".join(repr(x[1]) for x in tables.butterflies()) + "]")
#: Frames as they are found: the lost header leaves no frame, so those behind it move up.
_frame_no = "f - cast(f > 1 and s % 5 = 0 as integer)"
_samples = "cast(round_even(greatest(least(y * 32768, 32767), -32768), 0) as smallint)"


@query(f"""with {_decode_ctes}, {_synthesis_ctes}
  select cast(key as varchar) as stream_id, cast({_frame_no} as bigint) as frame_no, cast(576 * (g % 2) + sample % 576 as integer) as pos, {_samples} as pcm16
  from out join good on good.s = key and good.n = sample // 576""")
def decode_coded(spark, sf_dir):
    """Coded streams with junk, a damaged frame and a broken reservoir, to samples."""
    out = decode.pcm_sources(streams(spark, sf_dir))
    return out.select("stream_id", "frame_no", F.posexplode("pcm16").alias("pos", "pcm16"))


@query(f"""with {_decode_ctes}, {_synthesis_ctes}
  select cast(key as varchar) as stream_id, count(*) as samples, min({_samples}) as low, max({_samples}) as high, cast(sum({_samples}) as bigint) as total from out join good on good.s = key and good.n = sample // 576 group by 1""")
def decode_frames(spark, sf_dir):
    """The same from a table of frames in any order."""
    out = decode.pcm_frames(files.scan_frames(streams(spark, sf_dir)))
    sample = out.select("stream_id", F.explode("pcm16").alias("v"))
    return sample.groupBy("stream_id").agg(F.count("*").alias("samples"), F.min("v").alias("low"), F.max("v").alias("high"), F.sum("v").alias("total"))


@query(f"""with {_decode_ctes}, c as (select s, f, {_frame_no} as frame_no, {_lost} as lost from (select cast(s_suppkey as bigint) as s, unnest(range(0, {N_FRAMES})) as f from supplier))
  select cast(s as varchar) as stream_id, cast(frame_no as bigint) as frame_no, cast(case when f = 2 and s % 7 = 0 then -5 else 0 end as integer) as status from c where not (f = 1 and s % 5 = 0)""".replace(f"with {_decode_ctes}, c as", "with c as"))
def frame_status(spark, sf_dir):
    """Whether each frame that is found can be decoded: a damaged one is no frame, a broken reservoir tells."""
    out = decode.granules(files.scan_frames(streams(spark, sf_dir)))
    return out.groupBy("stream_id", "frame_no").agg(F.max("status").alias("best"), F.min("status").alias("worst")).select("stream_id", "frame_no", F.when(F.col("worst") < 0, F.col("worst")).otherwise(F.col("best")).alias("status"))


_trim = "s_suppkey * 37 % 1000", "s_suppkey * 53 % 900"


@query(f"""with {_decode_ctes}, {_synthesis_ctes},
  p as (select key, cast(1152 * ({_frame_no}) + 576 * (g % 2) + sample % 576 as bigint) as place, {_samples} as v, key * 37 % 1000 as front, 1152 * ({N_FRAMES} - cast(key % 5 = 0 as integer)) - key * 53 % 900 as stop from out join good on good.s = key and good.n = sample // 576)
  select cast(key as varchar) as stream_id, count(*) as samples, min(place) as first_at, max(place) as last_at, cast(sum(v) as bigint) as total from p where place >= front and place < stop group by 1""")
def gapless_samples(spark, sf_dir):
    """Samples without what the encoder has put before and behind them."""
    found = files.scan_frames(streams(spark, sf_dir))
    # Narrow rows of the index, not contents, go through the windows.
    index = frame_index(found.drop("content")).withColumn("s_suppkey", F.col("stream_id").cast("long"))
    keep = trimmed(index, *[F.expr(e) for e in _trim]).select("stream_id", "frame_no", "sample_offset", "keep_from", "keep_to")
    out = decode.pcm_frames(found).join(keep, ["stream_id", "frame_no"])
    each = out.select("stream_id", "sample_offset", "keep_from", "keep_to", F.posexplode("pcm16").alias("i", "v")).withColumn("at", F.col("sample_offset") + F.col("i"))
    each = each.where((F.col("i") >= F.col("keep_from")) & (F.col("i") < F.col("keep_to")))
    return each.groupBy("stream_id").agg(F.count("*").alias("samples"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.sum("v").alias("total"))


@query(f"""with {_decode_ctes}
  select cast(coef.s as varchar) as stream_id, cast({_frame_no.replace("f -", "coef.f -").replace("f > 1 and s", "coef.f > 1 and coef.s")} as bigint) as frame_no, cast(g % 2 as integer) as gr, {GAIN} as global_gain, cast(count(*) filter (v <> 0) as integer) as non_zero, cast(coalesce(max(i + 1) filter (v <> 0), 0) as integer) as zero_start,
    cast(sum(v * (i + 1)) as bigint) as weighted from coef group by all""")
def granule_lines(spark, sf_dir):
    """What is known of each good granule, with its coefficients."""
    out = decode.granules(files.scan_frames(streams(spark, sf_dir))).where("status = 0")
    weighted = F.aggregate(F.transform("coef", lambda v, i: (v * (i + 1)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("stream_id", "frame_no", "gr", "global_gain", "non_zero", "zero_start", weighted.alias("weighted"))


@query(f"""with {_decode_ctes}
  select cast(key as varchar) as stream_id, cast({_frame_no.replace("s %", "key %")} as bigint) as frame_no, cast(g % 2 as integer) as gr, cast(32 * (s.t % 18) + k as integer) as pos, cast(round(x * 1e6) as bigint) as value
  from s join good on good.s = key and good.n = s.t // 18""")
def subband_values(spark, sf_dir):
    """Subband samples of each good granule, after overlap and frequency inversion."""
    out = decode.subband_samples(files.scan_frames(streams(spark, sf_dir)))
    return out.select("stream_id", "frame_no", "gr", F.posexplode("samples").alias("pos", "v")).select("stream_id", "frame_no", "gr", "pos", _micro(F.col("v")).alias("value"))


#: Each frame is a stream of its own: what points back cannot be decoded, and nothing overlaps from before.
_single_ctes = _decode_ctes.replace("cast(s_suppkey as bigint) as s, f, 2 * f + h as g", f"cast(s_suppkey as bigint) * {N_FRAMES} + f as s, cast(s_suppkey as bigint) as s0, f, 2 * f + h as g")
_single_ctes = _single_ctes.replace(f"where not {_lost}", f"where not {_lost.replace('s %', 's0 %')}").replace("good as (select s, f, g,", "good as (select s, s0, f, g,").replace("coef as (select s, f, g, n, i,", "coef as (select s, f, g, n, i, s0,").replace("(s * 7 + g * 5", "(s0 * 7 + g * 5").replace("(s + g + i)", "(s0 + g + i)")


@query(f"""with {_single_ctes}, {_synthesis_ctes}
  select cast(s0 as varchar) as stream_id, cast({_frame_no.replace("s %", "s0 %")} as bigint) as frame_no, count(*) as samples, min({_samples}) as low, max({_samples}) as high, cast(sum({_samples}) as bigint) as total from out join good on good.s = key and good.n = sample // 576 group by 1, 2""")
def decode_single_frames(spark, sf_dir):
    """Each frame by itself."""
    out = decode.single_frames(files.scan_frames(streams(spark, sf_dir)))
    sample = out.select("stream_id", "frame_no", F.explode("pcm16").alias("v"))
    return sample.groupBy("stream_id", "frame_no").agg(F.count("*").alias("samples"), F.min("v").alias("low"), F.max("v").alias("high"), F.sum("v").alias("total"))


#: Times that decode_music plays a stream's frames.
REPEATS = 60
_music_ctes = _decode_ctes.replace(f"range(0, {N_FRAMES}) a(f)", f"range(0, {2 * N_FRAMES}) a(f)").replace(_lost, f"(f % {N_FRAMES} = 1 and s % 5 = 0 or f % {N_FRAMES} = 2 and s % 7 = 0)")
_music_ctes = _music_ctes.replace("g * 5 + i * 3", f"g % {2 * N_FRAMES} * 5 + i * 3").replace("(s + g + i)", f"(s + g % {2 * N_FRAMES} + i)")


@query(f"""with {_music_ctes}, {_synthesis_ctes},
  p as (select key, f // {N_FRAMES} as turn, {_samples} as v from out join good on good.s = key and good.n = sample // 576)
  select cast(key as varchar) as stream_id, cast(sum(case when turn = 0 then 1 else {REPEATS - 1} end) as bigint) as samples, min(v) as low, max(v) as high, cast(sum(cast(v as bigint) * case when turn = 0 then 1 else {REPEATS - 1} end) as bigint) as total from p group by 1""")
def decode_music(spark, sf_dir):
    """Long streams of coded frames: those of streams() over and over. A granule depends on the one before
    only, so from the second turn on all turns are alike, which the SQL makes use of."""
    long = streams(spark, sf_dir).select("stream_id", F.expr(f"unhex(repeat(hex(content), {REPEATS}))").alias("content"))
    out = decode.pcm_sources(long, columns=("stream_id", "pcm16"))
    total = F.aggregate("pcm16", F.lit(0).cast("long"), lambda a, x: a + x)
    return out.groupBy("stream_id").agg(F.sum(F.size("pcm16")).alias("samples"), F.min(F.array_min("pcm16")).alias("low"), F.max(F.array_max("pcm16")).alias("high"), F.sum(total).alias("total"))
