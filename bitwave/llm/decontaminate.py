"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over neighbouring words: words under a 1 are hashed, words under a 0 may differ.
Seed hashes of all documents meet those of the benchmark in one join; every hit names a benchmark item
and a diagonal (difference of positions). Hits are verified word by word along their diagonal: a
document is contaminated if a window of WINDOW words (the whole item, if shorter) agrees in MATCH of
its positions at least. Items of 5 or 6 words have masks of their own, which one substitution anywhere
leaves a hit of. Documents with hits are cut into overlapping blocks, and a hit meets the block that it
lies in, so a document of n words with n hits costs n and not n * n. Everything is a DataFrame expression.

Seeds are made only where the first two words may both occur in the benchmark, by a bit set of its
word hashes of a fixed size; that leaves out no hit.

The benchmark's seeds are sent to all executors only up to MOST_SENT rows; beyond that both sides are
shuffled, where a common seed is one row of the benchmark's side per position and Spark splits large
partitions of the other side.

Defined results: a null text counts as empty; texts and items of fewer words than the shortest mask
have no seeds and never match; equal rows give equal rows; null ids take part; extra columns are
ignored; an empty table on either side leaves every document clean.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored, text_or_empty

#: Every mask begins with two ones.
MASKS = ("11111", "110111", "1101011", "11001011")
SHORT_MASKS, SHORT = ("111", "11011"), (5, 6)
#: Words in a block of a document, without the overlap.
BLOCK = 512
WINDOW, MATCH = 13, 0.8
#: Rows of a side that is sent to all executors, at most (some 40 bytes each).
MOST_SENT = 1_000_000
#: Bits of the word filter, a constant in the plan.
FILTER_BITS = 1 << 16
WORDS = r"[\p{L}\p{N}]+"


def word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0)), lambda w: F.xxhash64(w))


def seeds(words: Column, starts: Column, masks: tuple = MASKS) -> Column:
    """array<struct<at, seed>>: of each start the hash of every mask that fits; seed is null else."""

    def at(i: Column) -> Column:
        return F.array(*[F.struct(i.alias("at"), F.when(i + len(m) <= F.size(words), F.xxhash64(F.lit(m), *[F.get(words, i + o) for o, c in enumerate(m) if c == "1"])).alias("seed")) for m in masks])

    return F.flatten(F.transform(starts, at))


def every_start(words: Column, masks: tuple = MASKS) -> Column:
    least = min(map(len, masks))
    return F.when(F.size(words) >= least, F.sequence(F.lit(0), F.size(words) - least)).otherwise(F.array().cast("array<int>"))


def _bits(known: DataFrame) -> Column:
    """A bit set of FILTER_BITS bits as a constant: those of the benchmark's words by their hashes."""
    slot = F.col("word").bitwiseAND(F.lit(FILTER_BITS - 1).cast("long")).cast("int")
    found = np.zeros(FILTER_BITS, bool)
    found[[r.slot for r in known.select(slot.alias("slot")).distinct().collect()]] = True
    return F.array(*[F.lit(x).cast("long") for x in np.packbits(found, bitorder="little").view(np.int64).tolist()])


def _likely_starts(words: Column, bits: Column) -> Column:
    """Starts whose first two words, which no mask leaves out, may both be the benchmark's."""
    low = lambda h: h.bitwiseAND(F.lit(FILTER_BITS - 1).cast("long")).cast("int")
    flags = F.transform(words, lambda h: F.getbit(F.get(bits, F.shiftright(low(h), 6)), low(h).bitwiseAND(63)))
    both = F.zip_with(flags, F.slice(flags, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: a + F.coalesce(b, F.lit(0).cast("tinyint")))
    return F.filter(F.transform(both, lambda x, i: F.when(x == 2, i)), lambda i: i.isNotNull())


def _keys() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_key"), F.xxhash64(text_or_empty()).alias("text_key")]


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_SENT else df


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_key, text_key, item, matched (words) and width of each verified overlap: the best window of
    each diagonal with a hit."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), word_hashes(text_or_empty()).alias("item_words")).distinct()
    items = stored(items, "benchmark-items")
    seeded = lambda rows, masks: rows.select("item", F.inline(seeds(F.col("item_words"), every_start(F.col("item_words"), masks), masks))).where("seed is not null")
    short = items.where(F.size("item_words").isin(*SHORT))
    known = seeded(items, MASKS).union(seeded(short, SHORT_MASKS))
    masks = MASKS + (() if short.isEmpty() else SHORT_MASKS)
    known = stored(known.select("seed", "item", F.col("at").alias("item_at")), "benchmark-seeds")
    bits = _bits(items.select(F.explode("item_words").alias("word")))
    words = docs.select(*_keys(), word_hashes(text_or_empty()).alias("words"))
    words = words.select("doc_key", "text_key", "words", _likely_starts(F.col("words"), bits).alias("starts"))
    tried = words.select("doc_key", "text_key", F.inline(seeds(F.col("words"), F.col("starts"), masks))).where("seed is not null")
    hits = tried.join(_sent(known, known.count()), "seed").select("doc_key", "text_key", "item", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    hits = stored(hits, "benchmark-hits")
    found = hits.select("doc_key", "text_key").distinct()
    near = docs.select(*_keys(), text_or_empty().alias("text")).join(_sent(found, hits.count()), ["doc_key", "text_key"], "left_semi")
    near = near.dropDuplicates(["doc_key", "text_key"]).select("doc_key", "text_key", word_hashes(F.col("text")).alias("words"))
    reach = items.agg(F.max(F.size("item_words"))).first()[0] or 0
    block = lambda i: F.struct(i.alias("block"), F.slice("words", i * BLOCK + 1, BLOCK + reach).alias("part"))
    blocks = near.where(F.size("words") > 0).select("doc_key", "text_key", F.inline(F.transform(F.sequence(F.lit(0), F.expr(f"(size(words) - 1) div {BLOCK}").cast("int")), block)))
    placed = hits.withColumn("block", F.expr(f"greatest(diagonal, 0) div {BLOCK}").cast("int"))
    pairs = blocks.join(placed, ["doc_key", "text_key", "block"]).withColumn("shift", F.col("diagonal") - F.col("block") * BLOCK).join(_sent(items, items.count()), "item")
    same = F.transform("item_words", lambda w, j: F.coalesce((F.when(j + F.col("diagonal") >= 0, F.get("part", j + F.col("shift"))) == w).cast("int"), F.lit(0)))
    width = F.least(F.size("item_words"), F.lit(WINDOW))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("same") - F.col("width") + 1), lambda i: F.aggregate(F.slice("same", i, F.col("width")), F.lit(0), lambda a, x: a + x)))
    out = pairs.select("doc_key", "text_key", "item", same.alias("same"), width.alias("width")).select("doc_key", "text_key", "item", "width", best.alias("matched"))
    return out.where(F.col("matched") >= F.ceil(F.lit(MATCH) * F.col("width")))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, contaminated (0 or 1), n_items and most_matched (words)."""
    found = overlaps(docs, benchmark).groupBy("doc_key", "text_key").agg(F.countDistinct("item").alias("n"), F.max("matched").alias("most"))
    rows = docs.select("doc_id", *_keys()).join(stored(found, "contaminated"), ["doc_key", "text_key"], "left")
    return rows.select("doc_id", F.col("n").isNotNull().cast("int").alias("contaminated"), F.coalesce("n", F.lit(0)).cast("long").alias("n_items"), F.coalesce("most", F.lit(0)).cast("int").alias("most_matched"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a verified overlap; the columns stay."""
    found = stored(overlaps(docs, benchmark).select("doc_key", "text_key").distinct(), "contaminated")
    doc, text = fresh(docs, "bw_doc"), fresh(docs, "bw_text")
    found = found.toDF(doc, text)
    doc_key, text_key = _keys()
    return docs.select("*", doc_key.alias(doc), text_key.alias(text)).join(found, [doc, text], "left_anti").select(*docs.columns)
