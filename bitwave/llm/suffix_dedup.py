"""Removal of repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if it lies in a LENGTH-byte string that starts anywhere else too. Suffixes count only up
to LENGTH bytes, so equal suffixes are what is looked for.

1. Equal texts are one text with a count. Every LENGTH-byte window of a text has an anchor: its
   K-byte string with the least hash, the leftmost of equals. Equal windows have equal anchors at
   equal offsets, so windows whose anchor occurs once in the corpus are not repeated and drop out.
   Only anchors' hashes (about one for 170 bytes) are shuffled for this.
2. Neighbouring windows of one anchor form a suffix of LENGTH + CELL - 1 bytes at most; a window
   within it is a shift of it. All windows of such a cell share its core, whose hash picks the
   target partition, so equal windows meet. Windows of an anchor that occurs over HOT times stand
   alone, so that contexts of a common passage spread over all partitions.
3. A task sorts its suffixes into runs. Common prefixes of neighbours in a run already mark repeated
   windows; equal suffixes become one. Each run is front-coded (length of the prefix shared with
   the predecessor, then the rest) and compressed, and so exchanged.
4. A partition merges its runs with a loser tree that keeps the common prefix of each head with the
   last winner: heads with different prefix lengths are ordered by these numbers, heads with equal
   ones are compared from there on, never before. A common prefix of LENGTH + t with a neighbour
   marks windows 0 to t. Windows not marked so in cells with several suffixes are sorted once more,
   each at its own offset, and marked by equal neighbours.
5. Marked windows give the spans to remove, per text and then per row.

Beside the removal each row tells whether it holds a passage of PASSAGE words or more, separators
included, that another document holds too; these are often shorter than LENGTH bytes. Windows of PASSAGE
words have anchors as well (their MARK words with the least hash), and windows whose anchor occurs in one
text only drop out; the others meet by a 64-bit hash. This takes nothing away.

Defined results: a null text is empty; texts shorter than LENGTH bytes lose nothing; equal rows give
equal rows and lose everything if they are long enough; extra columns are ignored; an empty table
gives an empty result. A text is one row, so one task holds one text at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, partitions, stored, text_or_empty

LENGTH, K, CELL = 400, 64, 32
#: Words of a passage, and of its anchor.
PASSAGE, MARK = 50, 20
#: Occurrences of an anchor from which its windows stand alone: fewer suffixes that share a core are a
#: small part of a target partition.
HOT = 4096
#: Bytes of suffixes in a run, and in a target partition on average, at most.
RUN_BYTES, TARGET_BYTES = 32 << 20, 24 << 20
#: Positions hashed at once.
BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
U = np.uint64

_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for i, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(size, b, U)
            p[0] = 1
            _powers[i : i + 1] = [np.cumprod(p, dtype=U)]
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


class Hashes:
    """Polynomial hashes of the substrings of a text."""

    def __init__(self, data: bytes):
        n = len(data)
        power, self.inverse = _tables(n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum((np.frombuffer(data, np.uint8).astype(U) + U(1)) * power[:n], dtype=U, out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return mixed((self.sums[start + length] - self.sums[start]) * self.inverse[start] + U(LENGTH))


def least(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of each `width` neighbours, the leftmost of equals (in 40 bits)."""
    found = []
    for a in range(0, len(h) - width + 1, BLOCK):
        part = h[a : min(len(h), a + BLOCK + width - 1)]
        n, m = len(part) - width + 1, len(part)
        padded = np.full(-(-m // width) * width, ~U(0))
        padded[:m] = (part & ~U(0xFFFFFF)) | np.arange(m, dtype=U)
        grid = padded.reshape(-1, width)
        left = np.minimum.accumulate(grid, axis=1).ravel()
        right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        found.append(a + (np.minimum(right[:n], left[width - 1 : width - 1 + n]) & U(0xFFFFFF)).astype(np.int64))
    return np.concatenate(found) if found else np.empty(0, np.int64)


def anchors(data: bytes, hashes: Hashes | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Hashes | None]:
    """(position, hash, first window, last window) of each anchor, ascending."""
    n = len(data)
    if n < LENGTH:
        none = np.empty(0, np.int64)
        return none, none.astype(U), none, none, None
    hashes, found, width = hashes or Hashes(data), [], LENGTH - K + 1
    for a in range(0, n - LENGTH + 1, BLOCK):
        b = min(n - LENGTH + 1, a + BLOCK)  # windows a .. b - 1 hold the K-byte strings a .. b + width - 2
        found.append(a + least(hashes.of(np.arange(a, b + width - 1), K), width))
    at = np.concatenate(found)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    where = at[first]
    return where, hashes.of(where, K), first, np.append(first[1:] - 1, len(at) - 1), hashes


SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def passages(data: bytes, hashes: Hashes | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash of the anchor) of each run of PASSAGE words."""
    space = SPACE[np.frombuffer(data, np.uint8)]
    edge = np.diff(np.concatenate(([1], space, [1])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(starts) < PASSAGE:
        none = np.empty(0, np.int64)
        return none, none, none.astype(U)
    h = (hashes or Hashes(data)).of(starts[: 1 - MARK], ends[MARK - 1 :] - starts[: 1 - MARK])
    return starts[: len(starts) - PASSAGE + 1], ends[PASSAGE - 1 :], h[least(h, PASSAGE - MARK + 1)]


def cells(data: bytes, flagged: dict[int, bool]):
    """(key, suffix, start, offset of the anchor from start, alone) of the windows whose anchor is
    flagged; the flag tells whether each stands alone."""
    where, h, first, last, hashes = anchors(data) if flagged else anchors(b"")
    for i in np.flatnonzero(np.isin(h, np.fromiter(flagged, U, len(flagged)))).tolist():
        a, p1, p2 = int(where[i]), int(first[i]), int(last[i])
        width = 1 if flagged[int(h[i])] else CELL
        number = np.arange((a - p2) // width, (a - p1) // width + 1)
        low = np.maximum(p1, a - (number * width + width - 1))
        high = np.minimum(p2, a - number * width)
        core = hashes.of(a - number * width, LENGTH - width + 1)
        keys = mixed(core + mixed(number.astype(U) + U(width)))
        for key, s, e in zip(keys.tolist(), low.tolist(), high.tolist(), strict=True):
            yield key, data[s : e + LENGTH], s, a - s, width == 1


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix of a and b, which agree in the first `at` bytes."""
    end = min(len(a), len(b))
    if a[at:end] == b[at:end]:
        return end
    step = 8
    while a[at : at + step] == b[at : at + step]:
        at += step
        step *= 2
    while step > 1:
        step //= 2
        if a[at : at + step] == b[at : at + step]:
            at += step
    return at


def prefixes(strings: list[bytes]) -> np.ndarray:
    """Common prefix of each string with the one before it, 0 for the first."""
    out = np.zeros(len(strings), np.int64)
    width = LENGTH + CELL
    for a in range(0, len(strings) - 1, 8192):
        part = strings[a : a + 8193]
        size = np.array([len(s) for s in part])
        grid = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in part), np.uint8).reshape(-1, width)
        differ = grid[1:] != grid[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        out[a + 1 : a + len(part)] = np.minimum(first, np.minimum(size[1:], size[:-1]))
    return out


#: shared: bytes in common with the predecessor; rest: the others; known: 1 if all windows are marked,
#: 2 if the window stands alone; text: place in the run's list of texts.
ENTRY = np.dtype([("shared", "<u2"), ("rest", "<u2"), ("offset", "<u2"), ("known", "u1"), ("start", "<u4"), ("text", "<u4")])


def packed(strings: list[bytes], shared: np.ndarray, entries: np.ndarray, texts: list[bytes]) -> bytes:
    """A front-coded, compressed run: columns of the entries, texts, then what each string adds."""
    entries["shared"] = shared
    entries["rest"] = [len(s) for s in strings] - shared
    head = len(strings).to_bytes(8, "little") + len(texts).to_bytes(8, "little")
    data = head + b"".join(entries[c].tobytes() for c in ENTRY.names) + b"".join(texts) + b"".join(s[k:] for s, k in zip(strings, shared.tolist(), strict=True))
    return len(data).to_bytes(8, "little") + pa.Codec("zstd").compress(data, asbytes=True)


def unpacked(blob: bytes) -> tuple[list[bytes], np.ndarray, list[bytes]]:
    data = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    n, m = (int.from_bytes(data[i : i + 8], "little") for i in (0, 8))
    entries, at = np.zeros(n, ENTRY), 16
    for c in ENTRY.names:
        entries[c] = np.frombuffer(data, ENTRY[c], n, at)
        at += n * ENTRY[c].itemsize
    texts = [data[i : i + 32] for i in range(at, at + 32 * m, 32)]
    strings, at, last = [], at + 32 * m, b""
    for k, rest in zip(entries["shared"].tolist(), entries["rest"].tolist(), strict=True):
        last = last[:k] + data[at : at + rest]
        at += rest
        strings.append(last)
    return strings, entries, texts


class LoserTree:
    """Merges sorted runs; pops (run, index in the run, common prefix with the string before)."""

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.size = max(1, 1 << max(0, len(runs) - 1).bit_length())
        self.head = [r[0][0] if r[0] else None for r in runs] + [None] * (self.size - len(runs))
        self.shared = [0] * self.size
        self.loser = [0] * self.size
        win = list(range(self.size))
        nodes = [0] * self.size + win
        for node in range(self.size - 1, 0, -1):
            nodes[node], self.loser[node] = self.play(nodes[2 * node], nodes[2 * node + 1])
        self.top = nodes[1] if self.size > 1 else 0

    def play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix becomes the one it shares with the winner."""
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        k, m = self.shared[a], self.shared[b]
        if k != m:  # the head that shares more with the last winner is the smaller one
            return (a, b) if k > m else (b, a)
        k = common(x, y, k)
        if x[k : k + 1] < y[k : k + 1] or (len(x) == k == len(y) and a < b):
            self.shared[b] = k
            return a, b
        self.shared[a] = k
        return b, a

    def __iter__(self):
        while self.head[self.top] is not None:
            run = self.top
            yield run, self.at[run], self.shared[run]
            strings, shared = self.runs[run]
            self.at[run] = i = self.at[run] + 1
            if i < len(strings):
                self.head[run], self.shared[run] = strings[i], shared[i]
            else:
                self.head[run] = None
            node, winner = (run + self.size) // 2, run
            while node:
                winner, self.loser[node] = self.play(winner, self.loser[node])
                node //= 2
            self.top = winner


def marked_by_prefix(size: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """How many windows from the start of each sorted suffix occur in a neighbour too."""
    best = np.maximum(shared, np.append(shared[1:], 0))
    return np.clip(np.minimum(best, size) - LENGTH + 1, 0, None)


def joined(windows) -> list[tuple[bytes, int, int]]:
    """(text, first, stop) sorted, with ranges that touch made one."""
    out: list[list] = []
    for text, first, stop in sorted(windows):
        if out and out[-1][0] == text and first <= out[-1][2]:
            out[-1][2] = max(out[-1][2], stop)
        else:
            out.append([text, first, stop])
    return [tuple(x) for x in out]


class Runs:
    """Collects suffixes of a task; gives rows (target, run, text, first, stop)."""

    def __init__(self, targets: int):
        self.targets, self.held, self.bytes = targets, [], 0

    def add(self, text: bytes, data: bytes, flagged: dict[int, bool]):
        for key, suffix, start, offset, alone in cells(data, flagged):
            self.held.append((suffix, key, start, offset, text, alone))
            self.bytes += len(suffix) + 120
            if self.bytes > RUN_BYTES:
                yield from self.flush()

    def flush(self):
        by: dict[int, list] = {}
        for x in self.held:
            by.setdefault(x[1] % self.targets, []).append(x)
        self.held, self.bytes, windows = [], 0, []
        for target in sorted(by):
            rows = sorted(by.pop(target), key=lambda x: (x[0], x[4], x[2]))
            strings = [x[0] for x in rows]
            shared, size = prefixes(strings), np.array([len(s) for s in strings])
            marked = marked_by_prefix(size, shared)
            windows += [(rows[i][4], rows[i][2], rows[i][2] + int(marked[i])) for i in np.flatnonzero(marked).tolist()]
            # Equal suffixes become one; what it shares with its predecessor is the first one's.
            first = np.append(True, (shared[1:] < size[1:]) | (size[1:] != size[:-1]))
            keep = np.flatnonzero(first)
            known = marked[keep] == size[keep] - LENGTH + 1
            names: dict[bytes, int] = {}
            entries = np.zeros(len(keep), ENTRY)
            entries["start"], entries["offset"] = [rows[i][2] for i in keep], [rows[i][3] for i in keep]
            entries["known"] = known + 2 * np.array([rows[i][5] for i in keep])
            entries["text"] = [0 if k else names.setdefault(rows[i][4], len(names)) for i, k in zip(keep.tolist(), known.tolist(), strict=True)]
            entries["start"][known] = 0
            yield target, packed([strings[i] for i in keep], shared[keep], entries, list(names)), None, None, None
        for text, a, b in joined(windows):
            yield int.from_bytes(text[:8], "little") % self.targets, None, text, a, b


def merge(blobs: list[bytes]):
    """(text, first window, window after the last) of windows marked in a target partition."""
    runs, parts, names = [], [], []
    for blob in blobs:
        strings, entries, texts = unpacked(blob)
        runs.append((strings, entries["shared"].tolist()))
        entries["text"] += len(names)
        names += texts
        parts.append(entries)
    if not runs:
        return []
    order = list(LoserTree(runs))
    strings = [runs[r][0][i] for r, i, _ in order]
    shared = np.array([k for _, _, k in order])
    base = np.cumsum([0] + [len(p) for p in parts])
    entries = np.concatenate(parts)[[base[r] + i for r, i, _ in order]]
    del runs, parts
    size = np.array([len(s) for s in strings])
    marked = marked_by_prefix(size, shared)
    known, alone = entries["known"] & 1 == 1, entries["known"] & 2 == 2
    text, start, offset = entries["text"].tolist(), entries["start"].tolist(), entries["offset"].tolist()
    out = [(names[text[i]], start[i], start[i] + int(marked[i])) for i in np.flatnonzero((marked > 0) & ~known).tolist()]
    # Windows that no aligned neighbour has: sort those of a cell once more, each at its own offset.
    # A cell's suffixes share its core, which no window of it leaves out.
    open_ = ~known & ~alone & (marked < size - LENGTH + 1)
    if not open_.any():
        return joined(out)
    groups: dict[tuple[int, bytes], list[int]] = {}
    for i in np.flatnonzero(~alone).tolist():
        number, low = divmod(offset[i], CELL)
        groups.setdefault((number, strings[i][low : low + LENGTH - CELL + 1]), []).append(i)
    for group in groups.values():
        if len(group) < 2 or not open_[group].any():
            continue
        at: dict[int, list] = {}
        wanted = {offset[i] - t for i in group if open_[i] for t in range(int(marked[i]), len(strings[i]) - LENGTH + 1)}
        for i in group:
            for t in range(len(strings[i]) - LENGTH + 1):
                if offset[i] - t in wanted:
                    at.setdefault(offset[i] - t, []).append((strings[i][t : t + LENGTH], i, t))
        for windows in at.values():
            if len(windows) > 1:
                windows.sort(key=lambda w: w[0])
                same = [x[0] == y[0] for x, y in zip(windows, windows[1:], strict=False)]
                for (_, i, t), left, right in zip(windows, [False, *same], [*same, False], strict=True):
                    if (left or right) and open_[i]:
                        out.append((names[text[i]], start[i] + t, start[i] + t + 1))
    return joined(out)


def spans(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte spans covered by ranges of windows, merged."""
    out: list[list[int]] = []
    for s, e in sorted(windows):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e + LENGTH - 1)
        else:
            out.append([s, e + LENGTH - 1])
    return [(s, e) for s, e in out]


def text_key() -> Column:
    return F.sha2(text_or_empty().cast("binary"), 256)


def repeated_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts with their number of rows, candidate texts, marked windows by text)."""
    spark = docs.sparkSession
    doc_key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_key")
    rows = docs.select(doc_key, text_key().alias("text_key"), F.xxhash64(text_or_empty()).alias("text_no"), text_or_empty().alias("text"))

    def lists(found: list[np.ndarray]) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(f) for f in found]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *found])))

    def look(batches):
        for batch in batches:
            size, found, marks, worded = [], [], [], []
            for data in (t.encode() for t in batch.column(3).to_pylist()):
                hashes = Hashes(data)
                start, _, mark = passages(data, hashes)
                size.append(len(data))
                found.append(anchors(data, hashes)[1].view(np.int64))
                marks.append(np.unique(mark).view(np.int64))
                worded.append(len(start) > 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(size, pa.int64()), pa.array(worded, pa.bool_()), lists(found), lists(marks)], ["doc_key", "text_key", "text_no", "n_bytes", "worded", "anchors", "marks"])

    seen = stored(rows.mapInArrow(look, "doc_key string, text_key string, text_no long, n_bytes long, worded boolean, anchors array<long>, marks array<long>"), "suffix-anchors")
    texts = seen.groupBy("text_key", "text_no").agg(F.count("*").alias("n"), F.min("doc_key").alias("doc_key"), F.first("n_bytes").alias("n_bytes"), F.first("worded").alias("worded"))
    texts = stored(texts, "suffix-texts")
    # Anchors of one row for each text. The short number stands for the text from here on: should two
    # texts share one, they share candidates, which only adds some.
    of = seen.join(texts.select("text_key", "doc_key"), ["text_key", "doc_key"], "left_semi").dropDuplicates(["text_key", "doc_key"])
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(c).alias("xs")) for i, c in enumerate(("anchors", "marks"))])
    each = of.select("text_no", F.inline(kinds)).select("text_no", "kind", F.explode("xs").alias("anchor"))
    twice = stored(each.groupBy("kind", "anchor").agg(F.count("*").alias("n")).where("n > 1").select("kind", "anchor", (F.col("n") > HOT).alias("hot")), "suffix-repeated-anchors")
    flagged = stored(each.join(twice, ["kind", "anchor"]), "suffix-flagged")
    cases = {"cool": "kind = 0 and not hot", "hot": "kind = 0 and hot", "marks": "kind = 1"}
    flagged = flagged.groupBy("text_no").agg(*[F.collect_set(F.when(F.expr(c), F.col("anchor"))).alias(n) for n, c in cases.items()])
    flagged = stored(texts.select("text_key", "text_no", "doc_key").join(flagged, "text_no"), "suffix-candidates")
    chosen = rows.drop("text_no").join(flagged, ["text_key", "doc_key"]).dropDuplicates(["text_key", "doc_key"])
    chosen = stored(chosen.select("text_key", "text_no", "text", *cases), "suffix-candidate-texts")
    forget(seen, twice)

    amount = chosen.agg(F.sum(F.size("cool") * F.lit(170 * 14) + F.size("hot") * F.lit(170 * 400))).first()[0] or 0
    targets = int(max(partitions(spark), -(-amount // TARGET_BYTES)))

    def cut(batches):
        runs, rows = Runs(targets), []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["target", "run", "text", "first", "stop"])

        for batch in batches:
            for key, text, cool, hot in zip(*[batch.column(c).to_pylist() for c in ("text_key", "text", "cool", "hot")], strict=True):
                flags = dict.fromkeys((x & (2**64 - 1) for x in cool), False) | dict.fromkeys((x & (2**64 - 1) for x in hot), True)
                for row in runs.add(bytes.fromhex(key), text.encode(), flags):
                    rows.append(row)
                    if len(rows) > 2000:
                        yield batch_of(rows)
                        rows = []
        rows += runs.flush()
        for i in range(0, len(rows), 2000):
            yield batch_of(rows[i : i + 2000])

    def join(batches):
        blobs, target = [], None
        for batch in batches:
            for t, blob, text, first, stop in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if blob is None:
                    passed.append((text, first, stop))
                    continue
                if t != target:
                    yield from given(merge(blobs))
                    blobs, target = [], t
                blobs.append(blob)
            yield from given(passed)
            passed.clear()
        yield from given(merge(blobs))

    passed: list = []

    def given(rows):
        for i in range(0, len(rows), 50_000):
            part = rows[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part, strict=True), (pa.binary(), pa.int64(), pa.int64()), strict=True)], ["text", "first", "stop"])

    made = chosen.where(F.size("cool") + F.size("hot") > 0).mapInArrow(cut, "target int, run binary, text binary, first long, stop long")
    dealt = made.repartitionById(targets, F.col("target")).sortWithinPartitions("target")
    return texts, chosen, dealt.mapInArrow(join, "text binary, first long, stop long")


def sharing(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """text_key (a row each) of the texts that hold a passage which another document holds too."""

    def cut(batches):
        for batch in batches:
            numbers, windows = [np.empty(0, np.int64)], [np.empty(0, U)]
            for number, text, marks in zip(*[batch.column(c).to_pylist() for c in ("text_no", "text", "marks")], strict=True):
                data = text.encode()
                hashes = Hashes(data)
                start, end, mark = passages(data, hashes)
                at = np.flatnonzero(np.isin(mark, np.array(marks, np.int64).view(U)))
                windows.append(np.unique(hashes.of(start[at], end[at] - start[at])))
                numbers.append(np.full(len(windows[-1]), number, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(numbers)), pa.array(np.concatenate(windows).view(np.int64))], ["text_no", "window"])

    windows = stored(chosen.where(F.size("marks") > 0).select("text_no", "text", "marks").mapInArrow(cut, "text_no long, window long"), "suffix-passages")
    again = windows.groupBy("window").agg(F.min("text_no").alias("low"), F.max("text_no").alias("high")).where("low <> high").select("window")
    found = stored(windows.join(again, "window").select("text_no").distinct(), "suffix-sharing")
    forget(windows)
    return found.join(texts, "text_no").select("text_key").union(texts.where("n > 1 and worded").select("text_key")).distinct()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and shares_passage (0 or 1: a passage of PASSAGE
    words or more is in another document too) for each row of docs."""
    texts, chosen, windows = repeated_windows(docs)
    windows = stored(windows.groupBy(F.lower(F.hex("text")).alias("text_key")).agg(F.collect_list(F.struct("first", "stop")).alias("windows")), "suffix-windows")
    single = windows.join(texts.where("n = 1").select("text_key"), "text_key").join(chosen.select("text_key", "text"), "text_key").select("text_key", "text", "windows")

    def cut(batches):
        for batch in batches:
            out = []
            for key, text, found in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                data, kept, done = text.encode(), hashlib.sha256(), 0
                gone = spans([(w["first"], w["stop"]) for w in found])
                for s, e in gone:
                    kept.update(data[done:s])
                    done = e
                kept.update(data[done:])
                out.append((key, sum(e - s for s, e in gone), len(gone), kept.hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["text_key", "n_removed", "n_spans", "kept"])

    lost = single.mapInArrow(cut, "text_key string, n_removed long, n_spans long, kept string")
    copies = texts.where((F.col("n") > 1) & (F.col("n_bytes") >= LENGTH)).select("text_key", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept"))
    lost = stored(lost.unionByName(copies), "suffix-removed")
    text = text_or_empty().cast("binary")
    rows = docs.select("doc_id", text_key().alias("text_key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    shared = stored(sharing(texts, chosen).withColumn("shared", F.lit(1)), "suffix-sharing")
    out = rows.join(lost, "text_key", "left").join(shared, "text_key", "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept", "whole").alias("kept_sha256"), F.coalesce("shared", F.lit(0)).alias("shares_passage"))
