"""Exact top-k by inner product: tiles of queries times tiles of a vector shard, merged as a tree.

Vectors are dealt to shards of about SHARD_BYTES, and every query goes to every shard in the same
exchange. A task holds one shard, streams the queries past it and multiplies tiles of both. A partial
selection keeps the best of a tile, the task the best of its shard, and two rounds of merging (branches
of shards, then the root) leave k per query. Nothing is collected or broadcast.

Products are exact: float64 matrix products while all partial sums stay below 2**53, else 64-bit
integers, else integers of any size (some microseconds for each component).

Defined results: a row whose vec_id or vector is null, or whose vector holds a null or non-finite
component, takes no part. Vectors of different lengths are not compared. Only a query's own row is no
candidate: of rows with equal vec_id each is answered by itself and meets the others, equal vectors too.
Order is by exact scores; a score beyond 64 bits is shown as the nearest long. Empty tables give an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored

TILE, QUERY_TILE = 4096, 512
#: Bytes of vectors in a shard, about, and in one that is not split further for the sake of more tasks.
SHARD_BYTES, SMALL_BYTES = 64 << 20, 1 << 20
SCALE = 256
LONG = 2**63
LOW = np.iinfo(np.int64).min


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that fit, as int64; the others, as integers of any size) of floor(SCALE * x); the first has
    a row for each of x, zeros where it belongs to the second, which is a dict by row."""
    with np.errstate(over="ignore"):
        y = np.floor(SCALE * x)
    small = (np.abs(y) < 2**31).all(axis=1)
    large = {int(i): [int(v) * SCALE if abs(v) >= 2**53 else math.floor(SCALE * v) for v in x[i].tolist()] for i in np.flatnonzero(~small)}
    return np.where(small[:, None], y, 0).astype(np.int64), large


def matrices(lists: pa.ListArray):
    """(rows, matrix) by vector length and size of the components: int64, or object where too large."""
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        x, large = scaled(values[starts[at][:, None] + np.arange(dim)[None, :]])
        big = np.zeros(len(at), bool)
        big[list(large)] = True
        if not big.all():
            yield at[~big], x[~big]
        if large:
            wide = np.empty((len(large), dim), object)
            wide[:] = [large[i] for i in sorted(large)]
            yield at[big], wide


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products: int64, or object where they may not fit."""
    if q.dtype != object and c.dtype != object:
        bound = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(1, q.shape[1])
        if bound < 2**53:
            return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
        if bound < LONG:
            return q @ c.T
    if not q.shape[1]:
        return np.zeros((len(q), len(c)), np.int64)
    return q.astype(object) @ c.astype(object).T


def best(score: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k best of (score, at): high scores first, ties to the smaller number."""
    if score.dtype != object and score.shape[1] > 4 * k:
        # The k-th best score bounds the selection; columns above it and, from the left, equal ones stay.
        kth = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k, None]
        above, level = score > kth, score == kth
        level &= np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)
        _, keep = np.nonzero(above | level)
        keep = keep.reshape(len(score), k)
        score, at = np.take_along_axis(score, keep, 1), np.take_along_axis(at, keep, 1)
    if score.dtype == object:
        order = np.array([sorted(range(score.shape[1]), key=lambda j, i=i: (-score[i, j], at[i, j]))[:k] for i in range(len(score))], int).reshape(len(score), -1)
    else:
        order = np.lexsort((at, ~score), axis=1)[:, :k]  # ~x falls as x rises, without overflow
    return np.take_along_axis(score, order, 1), np.take_along_axis(at, order, 1)


class Shard:
    """The candidates of a task, by vector length and size of the components."""

    def __init__(self, k: int):
        self.k, self.parts, self.ready = k, [], None

    def add(self, ids: np.ndarray, copies: np.ndarray, lists: pa.ListArray) -> None:
        for at, x in matrices(lists):  # of equal rows more than k + 1 can't matter
            n = np.minimum(copies[at], self.k + 1)
            self.parts.append((np.repeat(ids[at], n), np.repeat(x, n, axis=0)))

    def groups(self):
        if self.ready is None:
            by: dict = {}
            for ids, x in self.parts:
                by.setdefault((x.shape[1], x.dtype == object), []).append((ids, x))
            self.ready, self.parts = {}, []
            for key, parts in by.items():
                ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                order = np.argsort(ids, kind="stable")
                self.ready.setdefault(key[0], []).append((ids[order], x[order]))
        return self.ready

    def answer(self, ids: np.ndarray, lists: pa.ListArray):
        """(rows, scores, ids, own) of the k + 1 best for each tile of queries; own tells equal rows."""
        for at, q in matrices(lists):
            for c_ids, c in self.groups().get(q.shape[1], ()):
                for b in range(0, len(q), QUERY_TILE):
                    part, score, found = q[b : b + QUERY_TILE], None, None
                    for a in range(0, len(c), TILE):
                        s = products(part, c[a : a + TILE])
                        s, n = best(s, np.broadcast_to(np.arange(a, a + s.shape[1]), s.shape), self.k + 1)
                        score, found = (s, n) if score is None else best(np.hstack([score, s]), np.hstack([found, n]), self.k + 1)
                    rows = at[b : b + QUERY_TILE]
                    same = c_ids[found] == ids[rows][:, None]
                    i, j = np.nonzero(same)
                    same[i, j] = (c[found[i, j]] == part[i]).all(axis=1) if c.dtype == part.dtype else False
                    yield rows, score, c_ids[found], same


def _sortable(v: int) -> bytes:
    """Bytes that sort as the integer v."""
    size = (abs(v).bit_length() + 7) // 8
    return (32768 + size).to_bytes(2, "big") + v.to_bytes(size, "big") if v >= 0 else (32768 - size).to_bytes(2, "big") + (v + (1 << 8 * size)).to_bytes(size, "big")


#: side is -1 for scores above a long, 1 below; fall = -1 - score, so ascending order is that of ranks.
ENTRY = "side int, fall long, far binary, vec_id long, own boolean"


def _entries(score: np.ndarray, ids: np.ndarray, own: np.ndarray) -> list[pa.Array]:
    flat, far = score.ravel(), None
    side = np.zeros(len(flat), np.int32)
    if score.dtype == object:
        out = [v >= LONG or v < -LONG for v in flat]
        far = [_sortable(-1 - v) if o else None for v, o in zip(flat, out, strict=True)]
        side = np.array([(1 if v < 0 else -1) if o else 0 for v, o in zip(flat, out, strict=True)], np.int32)
        flat = np.array([-1 if o else int(v) for v, o in zip(flat, out, strict=True)], np.int64)
    return [pa.array(side), pa.array(~flat.astype(np.int64)), pa.array(far if far else [None] * len(flat), pa.binary()), pa.array(ids.ravel()), pa.array(own.ravel())]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """query_id, rank, vec_id and score of the k best other rows of each query; see the module."""
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
    # Equal rows are one with a count, so no vector is hot.
    rows = stored(rows.groupBy("vec_id", "embedding").agg(F.count("*").alias("copies")), "distinct-vectors")
    size = rows.agg(F.sum(F.lit(8).cast("long") * (1 + F.size("embedding")))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes), min(partitions(spark), -(-size // SMALL_BYTES)))
    # Each query row is one of its own; copies of it are answered once and shown as often as they stand.
    place = rows.select(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "*")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "*")
    dealt = place.union(asked).withColumn("key", F.xxhash64("embedding")).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind")
    names = ["query_id", "key", "vector", "copies", "branch", *[x.split()[0] for x in ENTRY.split(", ")]]
    kind = rows.schema["embedding"].dataType.simpleString()
    branches = max(1, math.isqrt(shards))

    def run(batches):
        held, now = None, None
        for batch in batches:
            shard, kinds, ids, lists, copies, keys = batch.columns
            marks = shard.to_numpy() * 2 + kinds.to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(marks)) + 1, [len(marks)]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b <= a:
                    continue
                if now != marks[a] // 2:
                    now, held = marks[a] // 2, Shard(k)
                part, some = ids.to_numpy()[a:b], lists.slice(a, b - a)
                if marks[a] % 2 == 0:
                    held.add(part, copies.to_numpy()[a:b], some)
                    continue
                for rows, score, found, own in held.answer(part, some):
                    at = pa.array(np.repeat(rows, score.shape[1]))
                    head = [pa.array(part).take(at), keys.slice(a, b - a).take(at), some.take(at), copies.slice(a, b - a).take(at), pa.array(np.full(len(at), now % branches, np.int32))]
                    yield pa.RecordBatch.from_arrays([*head, *_entries(score, found, own)], names)

    found = dealt.mapInArrow(run, f"query_id long, key long, vector {kind}, copies long, branch int, {ENTRY}")
    fields = ["side", "fall", "far", "vec_id", "own"]
    # Vectors of one id are told apart by themselves; the key only makes the grouping cheap.
    who = ["query_id", "key", "vector", "copies"]
    first = lambda xs: F.slice(F.array_sort(xs), 1, k + 1).alias("best")
    part = found.groupBy(*who, "branch").agg(first(F.collect_list(F.struct(*fields))))
    whole = part.groupBy(*who).agg(first(F.flatten(F.collect_list("best"))))
    # One of the equal rows is the query itself.
    own = F.array_position(F.transform("best", lambda x: x["own"]), True).cast("int")
    rest = F.when(own > 0, F.filter("best", lambda x, i: i != own - 1)).otherwise(F.col("best"))
    each = whole.select("query_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"), F.slice(rest, 1, k).alias("best"))
    out = each.select("query_id", F.posexplode("best").alias("at", "x"))
    score = F.when(F.col("x.side") < 0, F.lit(LONG - 1)).when(F.col("x.side") > 0, F.lit(LOW.item() if hasattr(LOW, "item") else LOW)).otherwise(-1 - F.col("x.fall"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), score.cast("long").alias("score"))
