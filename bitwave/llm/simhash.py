"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: 64 bits, each the majority vote of the XXH64 values of all word shingles of a text.
Search: the 64 bits are grouped into partitions, correlated bits together; each partition gets its
own threshold from -1 (left out) upwards, and any two fingerprints within `distance` bits agree in
at least one partition within its threshold if the thresholds add up to distance - parts + 1. A
dynamic programme picks partitions' thresholds by candidate counts estimated on a bounded sample.

Buckets: every distinct fingerprint is probed under its signatures (the partition's bits with up to
threshold of them flipped on one side). Small buckets are verified pair by pair. In buckets of over
BUCKET rows no pairs are made: a member links to its 64 one-bit neighbours instead, and two
fingerprints within two bits meet in at least one of those values. This is exact for distance 2.

Defined results: a null text counts as empty; texts without words have fingerprint zero and link as
any other; equal rows give equal rows; a null doc_id takes part and is never a component_id unless
all of its component are null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import similar
from .common import fewer, forget, fresh, stored, text_or_empty

BITS = 64
#: Fingerprints looked at for bit correlations and candidate estimates, at most.
SAMPLE = 4096
#: Members up to which a bucket is verified pair by pair.
BUCKET = 32


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    import xxhash

    parts = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not parts:
        return 0
    line = b" ".join(parts)
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(line, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        starts = np.concatenate(([0], ends[: -words]))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], seed) for a, b in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)]
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        block = np.array(hashes[at : at + 65536], dtype="<u8")
        votes += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, text_key (a hash of the text) and fp (long: the 64 bits) of each row of docs."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["doc_id", "text_key", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_key"), "text").mapInArrow(run, f"doc_id {kind}, text_key long, fp long")


def bits_of(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def grouped_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in groups of nearly equal size; each group grows by the bit most correlated with it."""
    bits = bits_of(sample).astype(float)
    bits -= bits.mean(axis=0) if len(bits) else 0
    scale = np.sqrt((bits**2).sum(axis=0))
    corr = np.abs(bits.T @ bits) / np.maximum(np.outer(scale, scale), 1e-9)
    left, groups = list(range(BITS)), []
    for i in range(parts):
        size = BITS // parts + (i < BITS % parts)
        group = [left.pop(0)]
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            left.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def allocate(sample: np.ndarray, rows: int, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed: the cheapest plan over 1 to distance + 2
    partitions. The cost of a plan is the signatures it writes and the candidates it is estimated to
    meet; for each number of partitions a dynamic programme spreads the threshold budget."""
    best: tuple[float, list] = (math.inf, [])
    sample = np.unique(sample)
    for parts in range(1, distance + 3):
        groups = grouped_bits(sample, parts)
        budget = distance - parts + 1

        def cost(group: list[int], t: int) -> float:
            if t < 0:
                return 0.0
            probes = sum(math.comb(len(group), k) for k in range((t + 1) // 2 + 1))
            n, near = len(sample), 0.0
            if n > 1:
                keys = bits_of(sample)[:, group]
                if t == 0:
                    _, seen = np.unique(np.packbits(keys, axis=1), axis=0, return_counts=True)
                    near = float((seen * (seen - 1) / 2).sum()) / (n * (n - 1) / 2)
                else:
                    some = keys[:512].astype(np.float32)
                    apart = some.sum(1)[:, None] + some.sum(1)[None, :] - 2 * some @ some.T
                    near = max(0.0, float((apart <= t).sum() - len(some))) / max(1, len(some) * (len(some) - 1))
            near = max(near, probes / 2 ** len(group))
            return rows * (1 + probes) * 2.0 + near * rows * (rows - 1) / 2

        # state: budget left -> (cost, thresholds so far); each partition takes -1 .. distance
        states = {budget: (0.0, [])}
        for group in groups:
            costs = {t: cost(group, t) for t in range(-1, distance + 1)}
            after: dict[int, tuple[float, list]] = {}
            for left, (spent, chosen) in states.items():
                for t, c in costs.items():
                    if left - t not in after or spent + c < after[left - t][0]:
                        after[left - t] = (spent + c, [*chosen, t])
            states = after
        if 0 in states and states[0][0] < best[0]:
            best = (states[0][0], [(g, t) for g, t in zip(groups, states[0][1], strict=True) if t >= 0])
    return best[1]


def signatures(fps: np.ndarray, plan: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fps, partition, key). Each side flips up to half of a partition's threshold, rounded
    up, so any two fingerprints within the threshold in that partition share a key."""
    at, part, keys = [], [], []
    for p, (group, t) in enumerate(plan):
        base = fps & np.uint64(sum(1 << b for b in group))
        for k in range((t + 1) // 2 + 1):
            for flips in itertools.combinations(group, k):
                keys.append(base ^ np.uint64(sum(1 << b for b in flips)))
                at.append(np.arange(len(fps)))
                part.append(np.full(len(fps), p, np.int32))
    return np.concatenate(at), np.concatenate(part), np.concatenate(keys)


def links(distinct: DataFrame, rows: int, distance: int = 2) -> DataFrame:
    """Edges (a, b) between fingerprints whose components are those of all pairs within distance."""
    if distance > 2:
        raise ValueError("buckets of any size are exact up to distance 2")
    share = min(1.0, SAMPLE / max(rows, 1))
    picked = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1_000_003)) < share * 1_000_003).select("fp").limit(2 * SAMPLE)
    plan = allocate(np.array([r.fp for r in picked.collect()], np.int64).view(np.uint64), rows, distance)

    def probe(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at, part, key = signatures(fps, plan)
            for i in range(0, len(at), 100_000):
                s = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(part[s]), pa.array(key[s].view(np.int64)), pa.array(fps[at[s]].view(np.int64))], ["part", "key", "fp"])

    probes = distinct.select("fp").mapInArrow(probe, "part int, key long, fp long")
    sizes = probes.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    each = len(signatures(np.zeros(1, np.uint64), plan)[0])  # a fingerprint's signatures
    members = stored(probes.join(sizes, ["part", "key"]), "bucket-members", rows * each)
    small = members.where(F.col("n") <= BUCKET).groupBy("part", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = small.select(F.posexplode("fps").alias("i", "a"), "fps").select("a", F.explode(F.slice("fps", F.col("i") + 2, F.lit(BUCKET))).alias("b"))
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).distinct()
    # In a larger bucket a member meets the others in the values one bit from it (and its own).
    flip = F.array(F.lit(0).cast("long"), *[F.lit(np.array([1 << b], np.uint64).view(np.int64).item()).cast("long") for b in range(BITS)])
    large = members.where(F.col("n") > BUCKET).select("fp").distinct()
    meets = large.select("fp", F.explode(F.transform(flip, lambda m: F.col("fp").bitwiseXOR(m))).alias("at"))
    firsts = stored(meets.groupBy("at").agg(F.count("*").alias("n"), F.min("fp").alias("b")).where("n > 1").select("at", "b"), "meeting-points", rows * (BITS + 1))
    stars = meets.join(firsts, "at").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return pairs.union(stars)


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node of its component. rows: a bound
    of the number of edges, if known.
    Alternating large and small stars, each round written to the shared folder; the number of rounds
    grows with the logarithm of the longest path."""
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links", rows)
    state = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    seen = state(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stored(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star", seen[0])
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edge = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
        small = large.join(low, "u").select(F.explode(F.array(edge("u", "m"), edge("v", "m"))).alias("e")).select("e.*").where("u <> v")
        before, edges = edges, stored(small.distinct(), "small-star", 2 * seen[0])
        forget(before, large)
        if (now := state(edges)) == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, text_key, fp, root (of the component, a fingerprint) and component_id of each row of docs."""
    rows = stored(fingerprints(docs, words), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints", rows.count())
    n = distinct.count()
    roots = components(links(distinct, n, distance))
    of = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    of = stored(of, "roots", n)
    first = of.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = stored(of.join(first, "root").select("fp", "root", "component_id"), "members", n)
    return rows.join(of, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def simhash_components(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that are first in their group by doc_id, text and then the other columns: one of
    each group. Nulls come last. Groups are the components of texts that are similar by similar.py;
    texts without words are one group."""
    rows = stored(similar.described(docs), "shingled")
    edges, n = similar.similar_links(docs, rows), rows.count()
    groups = components(edges, edges.count()).select("node", F.col("root").alias("group"))
    doc, text, nth = (fresh(docs, c) for c in ("bw_doc", "bw_text", "bw_nth"))
    order = F.struct(F.col("doc_id").isNull().alias("null_id"), F.col("doc_id"), F.col("text_key"))
    first = rows.groupBy("node").agg(F.min(order).alias("o")).join(groups, "node", "left")
    keep = first.groupBy(F.coalesce("group", "node").alias("root")).agg(F.min("o").alias("o"))
    keep = stored(keep.select(F.coalesce(F.col("o.doc_id").cast("string"), F.lit("")).alias(doc), F.col("o.text_key").alias(text)), "kept", n)
    forget(rows)
    keyed = docs.select("*", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(doc), F.xxhash64(text_or_empty()).alias(text))
    by = Window.partitionBy(doc, text).orderBy(*[c for c, kind in docs.dtypes if "map" not in kind and "variant" not in kind])
    out = keyed.join(keep, [doc, text], "left_semi").withColumn(nth, F.row_number().over(by)).where(F.col(nth) == 1).select(*docs.columns)
    return fewer(out, n, similar.SET_ROWS)
