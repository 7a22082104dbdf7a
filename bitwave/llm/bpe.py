"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are cut at safe boundaries before encoding: between a character that is surely not white
space and a following space or newline. No match of the split pattern holds white space after
another character, and no part of it looks back, so both sides encode as they would in the whole.
A stretch without such a boundary is split by the pattern here, and a single match of over
LONG_PIECE bytes is merged with a heap (n log n) instead of the library's scan.
Decoding joins the raw bytes of the ids, so cut characters come back whole.

The rank file is read on the driver and its bytes, of a checked size, go to the executors.

Defined results: a null text counts as empty and has no ids; equal rows give equal rows; extra
columns are ignored by encode_documents; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Characters from which a text is cut, and the size of the cuts.
LONG_TEXT, CUT = 100_000, 50_000
#: Bytes from which a single match is merged with a heap.
LONG_PIECE = 2_000
#: Texts whose ids are held at once.
SLICE = 256
#: Bytes of a rank file that are sent to all executors, at most.
MOST_RANK_BYTES = 64 << 20
#: A boundary after a letter, digit or common mark, before a space or newline.
WIDE_GAP = re.compile(rf"\s{{{LONG_PIECE}}}")
SAFE = re.compile(r"(?<=[0-9A-Za-z.,;:!?)%*#&$-])(?=[ \n])")


class Coder:
    def __init__(self, rank_file: bytes, pattern: str):
        import regex
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.names = {i: str(i) for i in self.bytes_of}

    def pieces(self, text: str):
        """Parts of text that encode on their own."""
        at = 0
        while len(text) - at > LONG_TEXT:
            cut = SAFE.search(text, at + CUT)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    @staticmethod
    def plain(piece: str) -> bool:
        """Whether no match of the pattern can be over LONG_PIECE characters long."""
        if len(piece) <= LONG_PIECE:
            return True
        words = [len(w) for w in piece.split()]
        return max(words, default=0) <= LONG_PIECE and (len(piece) - sum(words) - len(words) <= LONG_PIECE or not WIDE_GAP.search(piece))

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in self.pieces(text):
            if self.plain(piece):
                ids += self.own.encode_ordinary(piece)
                continue
            for match in self.pattern.finditer(piece):
                ids += self.merge(match[0].encode()) if len(match[0]) > LONG_PIECE // 4 else self.own.encode_ordinary(match[0])
        return ids

    def merge(self, piece: bytes) -> list[int]:
        """Merges of a single match: always the lowest rank, the leftmost of equals."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        after, before, end, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), bytearray(b"\1") * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := self.ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j], end[i], after[i] = 0, stop, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if 0 <= a and b < n and (r := self.ranks.get(piece[a : end[b]])) is not None:
                    heapq.heappush(heap, (r, a, end[b]))
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : end[i]]])
            i = after[i]
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def _coder(rank_file: bytes, pattern: str) -> Coder:
    return Coder(rank_file, pattern)


def rank_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MOST_RANK_BYTES + 1)
    if len(data) > MOST_RANK_BYTES:
        raise ValueError(f"{path} is larger than {MOST_RANK_BYTES} bytes")
    return data


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with one more column, ids (array of int), in place of any of that name."""
    docs = docs.drop("ids")
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(rank_bytes(path))
    at = docs.columns.index("text")

    def run(batches):
        coder = _coder(sent.value, pattern)
        for whole in batches:
            for a in range(0, whole.num_rows, SLICE):  # a batch's ids take much more room than its texts
                batch = whole.slice(a, SLICE)
                ids = [np.array(coder.encode(t or ""), np.int32) for t in batch.column(at).to_pylist()]
                ends = np.append(0, np.cumsum([len(x) for x in ids]))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "ids"])

    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("ids", ArrayType(IntegerType()))]))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encoding, then decoding of the ids."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(rank_bytes(path))

    def run(batches):
        coder = _coder(sent.value, pattern)
        for batch in batches:
            counts, ids_sha, out_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = coder.encode(text or "")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(coder.names.__getitem__, ids)).encode()).hexdigest())
                out_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
