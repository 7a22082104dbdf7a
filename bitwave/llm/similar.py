"""Near copies at a similarity: texts whose sets of five-word shingles have a Jaccard similarity of
SIMILARITY or more. Every link is decided by the two sets (as 64-bit hashes, in integers).

Candidates that cannot be missed: with the shingles of all texts in one order, two texts that are
similar enough share one of the first shingles of either (about a fifth), and the first one they share
stands so early in both that enough are left after it. The order puts shingles that are frequent in a
sample of SAMPLE texts last, so a template's shingles are no candidates for texts that have enough of
their own; any order gives the same links.

A large group of near copies would still be all pairs. So two kinds of few candidates come first: SimHash
fingerprints within a few bits (found by the pigeonhole partitions of simhash.py), and for each shared
first shingle the text that has the fewest rare shingles before it, the likely template, with every
other. The texts that these link are one group from there on, and what is compared after that are pairs
of different groups only; these are all compared: pair by pair where a first shingle is that of CROWD texts
at most. The texts that meet at others are joined once more among themselves, by the first shingles in the
order of their exact frequency there. A family's own shingles then come last, and texts with many changes
of their own no longer meet.

A pair's sets are fetched only if a bound allows the similarity: shingles are counted in CLASSES classes
by their hash, and two texts have at most the lesser count of each class in common.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, stored, text_or_empty

WORDS, SIMILARITY = 5, 0.8
#: Texts whose shingles are counted for the order of shingles, and frequent shingles kept, at most.
SAMPLE, FREQUENT = 65536, 1 << 18
CLASSES = 64
#: Rows of keys that are sent to all executors, at most (16 bytes each).
MOST_SENT = 1_000_000
#: Texts that share a first shingle up to which all pairs of different groups are candidates at once.
CROWD = 32
#: Words whose hashes a task remembers, at most.
MOST_KNOWN = 50_000
#: Rows with sets of shingles that a task writes at most, where a bound of a table's rows is known.
SET_ROWS = 4096
#: The same for rows that are made from two sets each.
PAIR_ROWS = 1024
RATIO = np.uint64(0x9E3779B97F4A7C15)
_known: dict[bytes, int] = {}


def word_hashes(text: str | None) -> np.ndarray:
    """XXH64 of each word; A-Z count as a-z and ASCII white space splits."""
    import xxhash

    words = (text or "").encode().lower().split()
    out = []
    for w in words:
        h = _known.get(w)
        if h is None:
            h = xxhash.xxh64_intdigest(w)
            if len(_known) < MOST_KNOWN:
                _known[w] = h
        out.append(h)
    return np.array(out, np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """A hash of each run of words, of all words in a shorter text; none without words."""
    of = word_hashes(text)
    if not len(of):
        return of
    width = min(words, len(of))
    h = np.zeros(len(of) - width + 1, np.uint64)
    for i in range(width):
        h = h * RATIO + of[i : len(of) - width + 1 + i]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def node_of(distinct: np.ndarray) -> int:
    """Names a set of shingles; texts of one set are one node."""
    import xxhash

    return xxhash.xxh64_intdigest(distinct.tobytes())


def majority(h: np.ndarray) -> int:
    """The SimHash fingerprint of shingle hashes: a bit is 1 if set in over half of them."""
    votes = np.zeros(64, np.int64)
    for a in range(0, len(h), 65536):
        votes += np.unpackbits(h[a : a + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view("<u8")[0])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64(text_or_empty()).alias("text_key"), "text")


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of shingles that occur in four texts or more of a sample, by hash."""
    share = int(min(1.0, SAMPLE / max(docs.count(), 1)) * 1_000_003)
    picked = _texts(docs).where(F.pmod("text_key", F.lit(1_000_003)) <= share).dropDuplicates(["text_key"]).select("text")

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                found = [np.unique(shingles(t)) for t in batch.column(0).slice(a, 256).to_pylist()]
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    seen = stored(picked.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 4"), "frequent-shingles")
    counts = seen.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    forget(seen)
    h, n = counts["h"].to_numpy().view(np.uint64), counts["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefix(h: np.ndarray, often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first of distinct hashes in the common order: enough of them to meet any similar set."""
    count = np.zeros(len(h), np.int64)
    if len(often[0]) and len(h):
        at = np.minimum(np.searchsorted(often[0], h), len(often[0]) - 1)
        count = np.where(often[0][at] == h, often[1][at], 0)
    s = Fraction(str(SIMILARITY))
    least = -(-len(h) * s.numerator // s.denominator)
    return h[np.lexsort((h, count))][: len(h) - least + 1]


def described(docs: DataFrame) -> DataFrame:
    """doc_id and text_key of each row of docs, node, n (distinct shingles), fp (SimHash of five-word
    shingles), first (the first shingles in order) and classes (their counts by class)."""
    often = docs.sparkSession.sparkContext.broadcast(frequent(docs))

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                batch = whole.slice(a, 2048)
                nodes, sizes, fps, firsts, classes = [], [], [], [], []
                for text in batch.column(2).to_pylist():
                    every = shingles(text)
                    h = np.unique(every)
                    nodes.append(node_of(h))
                    sizes.append(len(h))
                    fps.append(majority(every))
                    firsts.append(prefix(h, often.value).view(np.int64))
                    classes.append(np.bincount((h >> np.uint64(58)).astype(np.int64), minlength=CLASSES).astype(np.int32))
                long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                ends = pa.array(np.append(0, np.cumsum([len(f) for f in firsts])), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(firsts)))
                counts = pa.ListArray.from_arrays(pa.array(np.arange(len(classes) + 1) * CLASSES, pa.int32()), pa.array(np.concatenate(classes)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), long(nodes), pa.array(sizes, pa.int32()), long(fps), lists, counts], ["doc_id", "text_key", "node", "n", "fp", "first", "classes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_key"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, node long, n int, fp long, first array<long>, classes array<int>")


def _enough(common: Column, n_a: Column, n_b: Column) -> Column:
    """Whether sets of n_a and n_b shingles with so many in common reach SIMILARITY."""
    s = Fraction(str(SIMILARITY))
    return common * (s.numerator + s.denominator) >= (n_a + n_b) * s.numerator


def similar_links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of nodes of SIMILARITY or more; rows is
    described(docs), stored."""
    from .simhash import components, links

    # One row for each node: exact copies go no further.
    nodes = stored(rows.groupBy("node").agg(F.min("text_key").alias("text_key"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("first").alias("first"), F.first("classes").alias("classes")).where("n > 0"), "similar-nodes", rows.count(), SET_ROWS)
    size, total = nodes.agg(F.count("*"), F.coalesce(F.sum(F.size("first")), F.lit(0))).first()
    each = nodes.select("node", "n", F.posexplode("first").alias("at", "h"))
    # The lead is the first by position; a row alone has neither a lead nor a follower.
    by = Window.partitionBy("h").orderBy("at", "node")
    lead = F.first(F.struct("node", "n", "at")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    members = each.select("*", lead.alias("lead"), F.lead("node").over(by).alias("next")).where(F.col("next").isNotNull() | (F.col("node") != F.col("lead.node")))
    members = stored(members.drop("next"), "shared-shingles", total)

    def checked(pairs: DataFrame, what: str) -> DataFrame:
        """Those of distinct pairs (a, b) that are similar. Sets are made again from one text of a node."""
        pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "pairs")
        side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"{x}n"), F.col("classes").alias(f"{x}c"))
        most = F.aggregate(F.zip_with("ac", "bc", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
        left = stored(pairs.join(side("a"), "a").join(side("b"), "b").where(_enough(most, F.col("an"), F.col("bn"))).select("a", "b"), "possible-pairs", pairs.count())
        n = left.count()
        of = sets(left.select(F.col("a").alias("node")).union(left.select("b")).distinct(), min(2 * n, size))
        side = lambda x: of.select(F.col("node").alias(x), F.col("shingles").alias(f"{x}s"))
        both = left.join(side("a"), "a").join(side("b"), "b")
        out = stored(both.where(_enough(F.size(F.array_intersect("as", "bs")), F.size("as"), F.size("bs"))).select("a", "b"), what, n, PAIR_ROWS)
        forget(pairs, left, of)
        return out

    def sets(wanted: DataFrame, most: int) -> DataFrame:
        """node and shingles of the wanted nodes, most of them at most."""
        wanted = stored(wanted.join(nodes.select("node", "text_key"), "node"), "wanted-texts", most)
        n = wanted.count()
        few = F.broadcast(wanted) if n <= MOST_SENT else wanted  # else all texts are exchanged
        texts = _texts(docs).join(few, "text_key").dropDuplicates(["node"]).select("node", "text")
        return stored(texts.mapInArrow(_sets, "node long, shingles array<long>"), "shingle-sets", n, SET_ROWS)

    def _sets(batches):
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([np.unique(shingles(text)).view(np.int64)], pa.list_(pa.int64()))], ["node", "shingles"])

    # Fingerprints within the distance, nodes of one fingerprint, and members of a bucket with its lead.
    prints = stored(nodes.groupBy("fp").agg(F.min("node").alias("a"), F.max("node").alias("z")), "fingerprint-nodes", size)
    of = lambda x: prints.select(F.col("fp").alias(f"{x}_fp"), F.col("a").alias(x))
    near_prints = links(prints.select("fp"), prints.count()).toDF("a_fp", "b_fp").join(of("a"), "a_fp").join(of("b"), "b_fp").select("a", "b")
    same_print = nodes.select("fp", F.col("node").alias("b")).join(prints.where("a <> z"), "fp").select("a", "b")
    lead = lambda c: F.col("lead").getField(c)
    left = F.least(lead("n") - lead("at"), F.col("n") - F.col("at"))
    stars = members.where((F.col("node") != lead("node")) & _enough(left, F.col("n"), lead("n"))).select(lead("node").alias("a"), F.col("node").alias("b"))
    near = checked(near_prints.union(same_print).union(stars), "near-links")
    groups = components(near, near.count())

    # All pairs of different groups that share a first shingle early enough.
    grouped = stored(members.select("h", "node", "n", "at").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node")), "grouped-shingles", total)
    apart = grouped.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m")).where("low <> high").select("h", "m")
    open_ = stored(grouped.join(apart, "h"), "shingles-apart", total)

    def early(rows: DataFrame) -> DataFrame:
        side = lambda x: rows.select("h", *[F.col(c).alias(f"{x}{c}") for c in ("node", "n", "at", "root")])
        left = F.least(F.col("an") - F.col("aat"), F.col("bn") - F.col("bat"))
        pairs = side("a").join(side("b"), "h").where((F.col("anode") < F.col("bnode")) & (F.col("aroot") != F.col("broot")) & _enough(left, F.col("an"), F.col("bn")))
        return pairs.select(F.col("anode").alias("a"), F.col("bnode").alias("b"))

    pairs = early(open_.where(F.col("m") <= CROWD))
    crowd = stored(open_.where(F.col("m") > CROWD).select("node", "n", "root").distinct(), "crowd", size)
    if n := crowd.count():
        of = sets(crowd.select("node"), n)
        each = of.select("node", F.explode("shingles").alias("h"))
        # Shingles of one text alone come first in the order; only their number matters.
        ranked = each.join(each.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "h").join(crowd, "node")
        by = Window.partitionBy("node")
        ranked = ranked.withColumn("at", (F.col("n") - F.count("*").over(by) + F.row_number().over(by.orderBy("m", "h")) - 1).cast("int"))
        s = Fraction(str(SIMILARITY))
        least = F.ceil(F.col("n") * s.numerator / s.denominator)
        pairs = pairs.union(early(stored(ranked.where(F.col("at") <= F.col("n") - least).select("h", "node", "n", "at", "root"), "crowd-shingles", total)))
    others = checked(pairs, "other-links")
    forget(members, grouped, open_, prints, nodes)
    return near.union(others)
