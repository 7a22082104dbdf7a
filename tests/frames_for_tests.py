"""A small writer of test frames: silent ones, and ones with table 1 pairs and table B quadruples."""

from __future__ import annotations

from bitwave.functions import tables


def word(version=3, layer=1, protection=1, bitrate=9, rate=0, padding=0, mode=0, extension=0, emphasis=0) -> int:
    return 0xFFE00000 | version << 19 | layer << 17 | protection << 16 | bitrate << 12 | rate << 10 | padding << 9 | mode << 6 | extension << 4 | emphasis


def frame(pairs=(), quads=(), gain=210, version=3, mode=3, begin=0, block=None, extra=b"", **fields) -> bytes:
    """Every granule and channel holds the same pairs and quads."""
    from bitwave.sources.files import frame_length

    w = word(version=version, mode=mode, **fields)
    size, channels = frame_length(w), 1 if mode == 3 else 2
    one = version == 3
    codes = tables.PAIR_CODES[1]
    sign = lambda v: "" if v == 0 else "1" if v < 0 else "0"
    main = "".join(codes[abs(x), abs(y)] + sign(x) + sign(y) for x, y in pairs)
    main += "".join("".join("0" if v else "1" for v in q) + "".join(map(sign, q)) for q in quads)
    bits = f"{begin:0{9 if one else 8}b}" + "0" * ((5 if channels == 1 else 3) if one else (1 if channels == 1 else 2))
    if one:
        bits += "0" * 4 * channels
    for _ in range((2 if one else 1) * channels):
        bits += f"{len(main):012b}{len(pairs):09b}{gain:08b}" + ("0000" if one else "0" * 9)
        if block is None:
            bits += "0" + "00001" * 3 + "0000" + "000"
        else:
            bits += f"1{block[0]:02b}{block[1]}" + "00001" * 2 + "000" * 3
        bits += ("0" if one else "") + "0" + "1"
    side = int(bits, 2).to_bytes(len(bits) // 8, "big")
    body = main * ((2 if one else 1) * channels)
    body = int("1" + body + "0" * (-len(body) % 8), 2).to_bytes(len(body) // 8 + 1 + (len(body) % 8 > 0), "big")[-(-(-len(body) // 8)) :] if body else b""
    head = w.to_bytes(4, "big") + (b"" if fields.get("protection", 1) else b"\0\0")
    return (head + side + body + extra).ljust(size, b"\0")[:size]
