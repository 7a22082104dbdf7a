"""Secret scan by linking parts: identifiers, secrets and endpoints that stand near each other.

Base spans come from three fixed patterns. Weak candidates (identifier assignments, long mixed
tokens, endpoints) count only if a complementary part lies within SCOPE code points: a secret
needs an identifier or an endpoint, an identifier or an endpoint needs a secret.

Each kind's matches are read once: the pieces between them and the matches themselves, as lengths, whose
running sums are the positions. The interval join runs as a sweep: all parts of a text are put in order of
position and each takes the nearest complementary part before and after it (running extremes in either
order), so a text with n parts costs n log n and no pairs are made. Everything is a Catalyst expression.

Defined results: a null text counts as empty; an empty text has no spans and the digest of the
empty string; equal rows give equal results; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored, text_or_empty

#: Code points between complementary parts, at most.
SCOPE = 256
#: Order of kinds among spans with one start.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")


def either_case(words: str) -> str:
    """ASCII letters outside escapes as two-letter classes, alike for Java and RE2."""
    return re.sub(r"[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", words)


ASSIGN = f"(?:{either_case('password|passwd|secret|token|api_?key')})" r"""["']?\x20*[:=]\x20*["']?"""
VALUE = r"[A-Za-z0-9+/_.=-]+"
PATTERNS = {
    "assign": ASSIGN + VALUE,
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "identifier": f"(?:{either_case('client|user|account|access')})_?(?:{either_case('id|name|key')})" r"""["']?\x20*[:=]\x20*["']?""" + r"[A-Za-z0-9@+/_.-]{4,}",
    "secret": r"[A-Za-z0-9+/]{32,}",
    "endpoint": r"[a-z][a-z0-9+]{1,9}://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]{4,}",
}
#: A part of each kind stands only in a text with a match of this.
GATES = {"assign": ASSIGN + "[A-Za-z0-9+/_.=-]", "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}", "identifier": PATTERNS["identifier"], "secret": "[A-Za-z0-9+/]{32}", "endpoint": "[a-z0-9+]://"}


def lengths(text: Column, kind: str) -> Column:
    """array<struct<gap, size, ok>> of the leftmost non-overlapping matches, in code points: the text
    between a match and the one before, the match, and whether it counts."""
    pattern = PATTERNS[kind]

    def ok(hit: Column) -> Column:
        if kind == "assign":
            return F.length(F.regexp_replace(hit, "^" + ASSIGN, "")) >= 6
        if kind == "secret":
            return hit.rlike("[a-z]") & hit.rlike("[A-Z]") & hit.rlike("[0-9]")
        return F.lit(True)

    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("size"), ok(h).alias("ok")))
    none = F.array().cast("array<struct<gap:int,size:int,ok:boolean>>")
    return F.when(text.rlike(GATES[kind]), F.filter(both, lambda x: x["size"].isNotNull())).otherwise(none)


def joined(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(name, s["s_kind"] + 1), s["s_start"].cast("string"), s["s_end"].cast("string"))), ",")


def _keys() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_key"), F.xxhash64(text_or_empty()).alias("text_key")]


def secret_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row of docs: doc_id, base and linked (arrays of start, kind, end by position)."""
    text, by_text = text_or_empty(), ["doc_key", "text_key"]
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), lengths(text, k).alias("xs")) for i, k in enumerate(KINDS)])
    found = docs.select(*_keys(), F.inline(kinds)).where(F.size("xs") > 0).dropDuplicates([*by_text, "kind"])
    found = stored(found, "secret-lengths")
    # One exchange by text serves all windows.
    each = found.repartition(partitions(docs.sparkSession), *by_text).select(*by_text, "kind", F.posexplode("xs").alias("i", "x"))
    upto = F.sum(F.col("x.gap") + F.col("x.size")).over(Window.partitionBy(*by_text, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    parts = each.withColumn("end", upto).where("x.ok").select(*by_text, "kind", (F.col("end") - F.col("x.size")).alias("start"), "end")
    order = ["start", "kind", "end"]
    before = Window.partitionBy(*by_text).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*by_text).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    is_secret, is_base = F.col("kind").isin(KINDS.index("assign"), KINDS.index("hex"), KINDS.index("secret")), F.col("kind") < 3
    sides = {"secret": is_secret, "other": ~is_secret, "base": is_base}
    near = parts.select("*", *[F.max(F.when(c, F.col("end"))).over(before).alias(f"{n}_before") for n, c in sides.items()])
    near = near.select("*", *[F.min(F.when(c, F.col("start"))).over(after).alias(f"{n}_after") for n, c in sides.items()])
    side = lambda what: (F.coalesce(F.col("start") - F.col(f"{what}_before") <= scope, F.lit(False)) | F.coalesce(F.col(f"{what}_after") - F.col("end") <= scope, F.lit(False)))
    apart = F.coalesce(F.col("base_before") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("base_after") >= F.col("end"), F.lit(True))
    kept = near.where(is_base | (apart & F.when(is_secret, side("other")).otherwise(side("secret"))))
    span = F.struct(F.col("start").alias("s_start"), F.col("kind").alias("s_kind"), F.col("end").alias("s_end"))
    spans = kept.groupBy(*by_text).agg(F.array_sort(F.collect_list(F.when(is_base, span))).alias("base"), F.array_sort(F.collect_list(F.when(~is_base, span))).alias("linked"))
    none = F.array().cast("array<struct<s_start:int,s_kind:int,s_end:int>>")
    rows = docs.select("doc_id", *_keys()).join(stored(spans, "secret-spans"), by_text, "left")
    return rows.select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("linked", none).alias("linked"))


def scan(docs: DataFrame) -> DataFrame:
    """The digest rows of secret_spans: counts by base kind, digest of base spans, all spans."""
    count = lambda k: F.size(F.filter("base", lambda s: s["s_kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return secret_spans(docs).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "linked")).alias("spans"))
