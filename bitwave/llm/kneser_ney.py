"""Quality by an interpolated modified Kneser-Ney model over characters, trained on trusted text.

The n-grams are of characters (ORDER of them): word n-grams of a corpus are nearly all distinct, so
joining them with counts would move several times the corpus, while the distinct character n-grams
of a block of texts are a small part of it. A gram is a long of four 16-bit characters, the leading
ones zero for shorter grams; characters beyond the first plane share its private area.

Training: tasks count the grams of trusted texts, counts are summed by gram, continuation counts,
context sums and discounts are joins and aggregates over these tables, all sharded by gram.
Scoring: texts are dealt in compressed chunks to blocks of about BLOCK_BYTES, a block asks for its
distinct grams, the join with the model answers, and the block scores its texts. A chunk's block
depends on its task and number, not on a key, so repeated rows spread. Both must be the same again if an
executor is lost, so rows that come out of an exchange, in no fixed order, are stored first.

A quarter of the trusted documents, by a hash of doc_id, is not trained on (all are, and set the limits
too, where that would leave nothing on either side). A document is kept if its perplexity is at most the
QUANTILE of those of its language, times exp(SLACK / characters); languages without any take the quantile
over all of them. A text that repeats a common word looks good to so short an n-gram: see the README.

Defined results: null or empty texts have no perplexity and are not kept; a null lang is a language
of its own; a doc_id is trusted if any of its labels has quality 1; a null doc_id is never trusted;
equal rows give equal rows; extra columns are ignored; without trusted text all perplexities are
null and every text that is not empty is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty

ORDER = 4
QUANTILE = 0.99
#: Nats that a text may exceed the limit by, shared among its characters: the start of a text is hard
#: to predict, which weighs on short ones.
SLACK = 6.0
BLOCK_BYTES, CHUNK_BYTES = 24 << 20, 1 << 20
#: Rows of trusted ids that are sent to all executors, at most (8 bytes each).
MOST_SENT = 4_000_000
U = np.uint64


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(highest-order grams of all texts one after the other, number of grams of each text)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    pad = "\x02" * (ORDER - 1)
    codes = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes > 0xFFFF, 0xE000 + (codes * np.uint32(2654435761) >> np.uint32(19)) % 6400, np.maximum(codes, 1)).astype(U)
    whole = np.zeros(max(0, len(codes) - ORDER + 1), U)
    for i in range(ORDER):
        whole = (whole << U(16)) | codes[i : len(codes) - ORDER + 1 + i]
    # A gram counts if its last character is a text's own: every text follows a pad of ORDER - 1.
    step = sizes + ORDER - 1
    starts = np.cumsum(step) - step
    own = np.ones(len(whole), bool)
    for i in range(1, ORDER):
        at = starts[1:] - i
        own[at[(at >= 0) & (at < len(whole))]] = False
    return whole[own], sizes


def suffix(g: np.ndarray, k: int) -> np.ndarray:
    return g & U((1 << 16 * k) - 1)


def _count(docs: DataFrame) -> DataFrame:
    """(gram, n) of the texts, summed."""

    def run(batches):
        found, counts = np.empty(0, U), np.empty(0, np.int64)

        def rows():
            for i in range(0, len(found), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(found[i : i + 100_000].view(np.int64)), pa.array(counts[i : i + 100_000])], ["gram", "n"])

        for batch in batches:
            for part in _chunks(batch.column(0).to_pylist()):
                g, c = np.unique(grams(part)[0], return_counts=True)
                both, at = np.unique(np.concatenate([found, g]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, c]), len(both)).astype(np.int64)
                found = both
                if len(found) > 2_000_000:
                    yield from rows()
                    found, counts = np.empty(0, U), np.empty(0, np.int64)
        yield from rows()

    return docs.select(text_or_empty().alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _chunks(texts: list[str]):
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= CHUNK_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def _tail(k: int) -> Column:
    return F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1).cast("long")) if k < 4 else F.col("gram")


def train(trusted: DataFrame) -> DataFrame | None:
    """The model: gram, logp (null if the gram is only a context), backoff (null if it is no context)."""
    counts = {ORDER: stored(_count(trusted), "kn-counts")}
    size = {ORDER: counts[ORDER].count()}
    if not size[ORDER]:
        return None
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct grams that end so
        counts[k] = stored(counts[k + 1].select(_tail(k).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")), "kn-counts", size[k + 1])
        size[k] = counts[k].count()
    model, lower = None, None
    for k in range(1, ORDER + 1):
        row = counts[k].agg(*[F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)], F.count("*").alias("all")).first()
        y = row.n1 / (row.n1 + 2 * row.n2) if row.n1 and row.n2 else 0.5
        d = [max(0.05, min(i - 0.05, i - (i + 1) * y * row[f"n{i + 1}"] / row[f"n{i}"])) if row[f"n{i}"] else 0.5 * i for i in (1, 2, 3)]
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        context = F.shiftrightunsigned("gram", 16)
        sums = counts[k].groupBy(context.alias("context")).agg(F.sum("n").alias("s"), F.sum(cut).alias("mass"))
        sums = stored(sums.select("context", "s", (F.col("mass") / F.col("s")).alias("backoff")), "kn-contexts", size[k])
        p = counts[k].select("gram", (F.col("n") - cut).alias("held"), context.alias("context")).join(sums, "context")
        if k == 1:  # below single characters stands the uniform choice among those seen and one unseen
            p = p.select("gram", (F.col("held") / F.col("s") + F.col("backoff") / (row["all"] + 1)).alias("p"))
        else:
            low = lower.select(F.col("gram").alias("tail"), F.col("p").alias("low"))
            p = p.withColumn("tail", _tail(k - 1)).join(low, "tail").select("gram", (F.col("held") / F.col("s") + F.col("backoff") * F.col("low")).alias("p"))
        lower = stored(p, "kn-probabilities", size[k])
        none = F.lit(None).cast("double")
        part = lower.select("gram", F.log("p").alias("logp"), none.alias("backoff")).union(sums.select(F.col("context").alias("gram"), none.alias("logp"), F.log("backoff").alias("backoff")))
        if k == 1:  # the empty context holds what an unseen character gets
            part = part.withColumn("logp", F.when(F.col("gram") == 0, F.col("backoff") - math.log(row["all"] + 1)).otherwise(F.col("logp")))
        model = part if model is None else model.union(part)
    return stored(model.groupBy("gram").agg(F.max("logp").cast("float").alias("logp"), F.max("backoff").cast("float").alias("backoff")), "kn-model", 2 * sum(size.values()))


def _packed(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, chunk): compressed Arrow streams of doc_id, lang and text."""

    def run(batches):
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))

        def chunk(batch):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
                out.write_batch(batch)
            block = (task * 7919 + number) % blocks
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "chunk"])

        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(2)).to_numpy())
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + CHUNK_BYTES)))
                yield chunk(batch.slice(a, b - a))
                a, number = b, number + 1

    return docs.select("doc_id", "lang", text_or_empty().cast("binary").alias("text")).mapInArrow(run, "block int, chunk binary")


def _rows(table: pa.Table):
    for chunk in table.column("chunk"):
        for batch in pa.ipc.open_stream(chunk.as_buffer()):
            yield batch, [t.decode() for t in batch.column(2).to_pylist()]


def _asked(table: pa.Table) -> pa.Table:
    """The block's distinct grams of every order."""
    found = np.empty(0, U)
    for _, texts in _rows(table):
        found = np.union1d(found, grams(texts)[0])
    every = [np.zeros(1, U), found]
    for k in range(1, ORDER + 1):
        ends = np.unique(suffix(found, k)) if k < ORDER else found
        every += [ends, np.unique(ends >> U(16))]
    every = np.unique(np.concatenate(every))
    block = table.column("block")[0].as_py() if table.num_rows else 0
    return pa.table({"block": pa.array(np.full(len(every), block, np.int32)), "gram": pa.array(every.view(np.int64))})


def log_probabilities(g: np.ndarray, known: np.ndarray, logp: np.ndarray, backoff: np.ndarray) -> np.ndarray:
    """Of highest-order grams; known is sorted, logp and backoff are NaN where the model has none."""

    def look(ids, values):
        at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        return np.where(known[at] == ids, values[at], np.nan)

    unseen = look(np.zeros(1, U), logp)[0]
    out = np.full(len(g), unseen)
    for k in range(1, ORDER + 1):
        ids = suffix(g, k) if k < ORDER else g
        own = look(ids, logp)
        if k > 1:
            out = out + np.nan_to_num(look(ids >> U(16), backoff), nan=0.0)
        out = np.where(np.isnan(own), out, own)
    return out


def perplexities(docs: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, lang, n (characters) and nats (mean negative log probability, null without characters)."""
    docs = docs.select("doc_id", "lang", "text")
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = stored(docs, "kn-texts")
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    packed = _packed(docs, blocks)
    asked = packed.groupBy("block").applyInArrow(_asked, "block int, gram long")
    # One gram is asked for once by a block at most, so no gram is hot.
    answers = asked.join(model, "gram").select("block", "gram", "logp", "backoff")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("gram").to_numpy().view(U))
        known = right.column("gram").to_numpy().view(U)[order]
        logp, backoff = (right.column(c).to_numpy().astype(float)[order] for c in ("logp", "backoff"))
        ids, langs, sizes, nats = [], [], [], []
        for batch, texts in _rows(left):
            g, n = grams(texts)
            each, at = np.unique(g, return_inverse=True)  # few of a chunk's grams are distinct
            lp = log_probabilities(each, known, logp, backoff)[at] if len(known) else np.zeros(len(g))
            ends = np.cumsum(n)
            sums = np.append(0.0, np.cumsum(lp))
            total = sums[ends] - sums[ends - n]
            ids.append(batch.column(0))
            langs.append(batch.column(1))
            sizes.append(n)
            nats.append(np.where(n > 0, -total / np.maximum(n, 1), np.nan))
        flat = np.concatenate(nats)
        return pa.table({"doc_id": pa.chunked_array(ids), "lang": pa.chunked_array(langs), "n": pa.array(np.concatenate(sizes)), "nats": pa.array(flat, mask=np.isnan(flat))})

    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"doc_id {kind}, lang string, n long, nats double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, perplexity, threshold and keep (0 or 1) for each row of docs."""
    trusted = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    n, m = trusted.count(), trusted.where(part).count()
    seen, unseen = (trusted.where(~part), trusted.where(part)) if 0 < m < n else (trusted, trusted)
    sent = lambda ids: F.broadcast(ids) if n <= MOST_SENT else ids
    model = train(docs.join(sent(seen), "doc_id", "left_semi")) if n else None
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select("doc_id", none.alias("perplexity"), none.alias("threshold"), (F.length(text_or_empty()) > 0).cast("int").alias("keep"))
    scores = stored(perplexities(docs, model), "kn-scores")
    # Quantiles from counts in bins of a thousandth of a nat: their number is bounded, whatever the rows.
    marked = scores.where("nats is not null").join(sent(unseen), "doc_id", "left_semi").select(F.coalesce("lang", F.lit("")).alias("lang_key"), F.floor(F.col("nats") * 1000).cast("int").alias("bin"))
    bins = stored(marked.groupBy("lang_key", "bin").agg(F.count("*").alias("c")), "kn-bins", scores.count())

    def cut(keys):
        from pyspark.sql import Window

        running = bins.groupBy(*keys, "bin").agg(F.sum("c").alias("c"))
        by = Window.partitionBy(*keys).orderBy("bin")
        running = running.select(*keys, "bin", F.sum("c").over(by).alias("upto"), F.sum("c").over(Window.partitionBy(*keys)).alias("total"))
        return running.where(F.col("upto") >= QUANTILE * F.col("total")).groupBy(*keys).agg(F.min("bin").alias("bin"))

    limit = lambda b: F.exp((b + 1) / 1000)
    overall = bins.groupBy("bin").agg(F.sum("c").alias("c")).orderBy("bin").collect()
    total, upto, pooled = sum(r.c for r in overall), 0, None
    for r in overall:
        upto += r.c
        if pooled is None and upto >= QUANTILE * total:
            pooled = r.bin
    by_lang = stored(cut(["lang_key"]).select("lang_key", limit(F.col("bin")).alias("own")), "kn-limits", bins.count())
    out = scores.withColumn("lang_key", F.coalesce("lang", F.lit(""))).join(by_lang, "lang_key", "left")
    threshold = F.coalesce("own", limit(F.lit(pooled)) if pooled is not None else F.lit(None).cast("double")) * F.exp(SLACK / F.greatest("n", F.lit(1)))
    perplexity = F.exp("nats")
    return out.select("doc_id", perplexity.alias("perplexity"), threshold.alias("threshold"), F.when(F.col("nats").isNull(), 0).otherwise(F.coalesce((perplexity <= threshold).cast("int"), F.lit(1))).alias("keep"))
