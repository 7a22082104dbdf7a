"""Toxicity by FTRL-proximal logistic regression over hashed words, word pairs and skip-grams.

Features of a text are the presence of hashed unigrams, bigrams and one-word skip-grams. Training
takes labelled rows outside the held-out fold, at most MOST_ROWS of them (picked by a hash of their
id, the bound is a parameter), one pass after another with per-coordinate rates. L1 leaves few
weights other than zero; only those go to the executors, as two short arrays of a bounded size.

Labels, language, source and doc_id are no inputs of a score. Scores are shifted so that 0.3, the
decision threshold, is where F1 is best on the calibration rows (a part of the training fold that
the weights did not see).

Defined results: a null or empty text has the score of the bias alone; a null doc_id is not held out
and never labelled; a doc_id labelled more than once counts once, with its highest label; equal rows
give equal rows; extra columns are ignored; without any label the score is 0 for all.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Labelled rows that are learned from, at most (picked by a hash).
MOST_ROWS = 8_000
SPACE = 1 << 20
#: Words whose hashes a task remembers, at most.
MOST_KNOWN = 50_000
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")
_known: dict[str, int] = {}


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers of a text."""
    hashes = []
    for w in WORD.findall((text or "").lower()):
        h = _known.get(w)
        if h is None:
            h = zlib.crc32(w.encode())
            if len(_known) < MOST_KNOWN:
                _known[w] = h
        hashes.append(h)
    one = np.array(hashes, np.uint64)
    mix = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)  # noqa: E731  20 bits
    pairs = (one[:-1] << np.uint64(1)) + one[1:] * np.uint64(0x100000001B3) + np.uint64(1)
    skips = (one[:-2] << np.uint64(1)) + one[2:] * np.uint64(0x100000001B3) + np.uint64(2)
    return np.unique(np.concatenate([mix(one), mix(pairs), mix(skips)])).astype(np.int32)


@dataclass
class Model:
    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        w = np.zeros(SPACE, np.float32)
        w[self.index] = self.weight
        return w


def train(rows: list[tuple[np.ndarray, int]], held: list[tuple[np.ndarray, int]], alpha=0.3, beta=1.0, l1=8.0, l2=1.0, passes=3) -> Model:
    """FTRL-proximal on rows; held sets the shift that puts the best F1 at THRESHOLD."""
    z, n = np.zeros(SPACE + 1), np.zeros(SPACE + 1)
    order = np.random.default_rng(7)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        penalty = np.where(i == SPACE, 0.0, l1)
        return np.where(np.abs(zi) <= penalty, 0.0, -(zi - np.sign(zi) * penalty) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(passes):
        for k in order.permutation(len(rows)):
            x, y = rows[k]
            i = np.append(x, SPACE)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - step * w
            n[i] += g * g
    full = weights(np.arange(SPACE + 1))
    index = np.flatnonzero(full[:SPACE])
    model = Model(index.astype(np.int32), full[index].astype(np.float32), float(full[SPACE]))
    if held and any(y for _, y in held) and not all(y for _, y in held):
        dense = model.dense()
        raw = np.array([dense[x].sum() + model.bias for x, _ in held])
        y = np.array([y for _, y in held])
        cuts = np.unique(raw)
        cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
        best = max(cuts[:: max(1, len(cuts) // 400)], key=lambda c: 2 * (y[raw >= c].sum()) / max(1, y.sum() + (raw >= c).sum()))
        model.bias += float(np.log(THRESHOLD / (1 - THRESHOLD)) - best)
    return model


def fold() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    small_batches(docs.sparkSession)
    labels = labels.where("toxic is not null and doc_id is not null").where(fold() != 2).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, most_rows / max(1, labels.count()))
    picked = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)
    # most_rows (with the spread of the hash) bounds this side, so it is small enough to send.
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def run(batches):
        for batch in batches:
            x = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([v.tobytes() for v in x], pa.binary())], ["doc_id", "toxic", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = []
    for r in sorted(found.mapInArrow(run, f"doc_id {kind}, toxic int, x binary").collect(), key=lambda r: (r.doc_id, bytes(r.x))):
        x = np.frombuffer(r.x, np.int32)
        rows.append((str(r.doc_id), x, int(r.toxic > 0)))
    if not rows:
        return Model(np.empty(0, np.int32), np.empty(0, np.float32), -50.0)
    calibration = [zlib.crc32(b"c" + d.encode()) % 4 == 0 for d, _, _ in rows]
    return train([(x, y) for (_, x, y), c in zip(rows, calibration, strict=True) if not c] or [(x, y) for _, x, y in rows], [(x, y) for (_, x, y), c in zip(rows, calibration, strict=True) if c])


def with_score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with one more column, toxic_score (double from 0 to 1), in place of any of that name."""
    docs = docs.drop("toxic_score")
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        model = sent.value
        dense, bias = model.dense(), model.bias
        for batch in batches:
            scores = [1 / (1 + np.exp(-np.clip(float(dense[features(t)].sum(dtype=np.float64)) + bias, -35, 35))) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "toxic_score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("toxic_score", DoubleType())]))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    out = with_score(docs.select("doc_id", "text"), learn(docs, labels))
    score = F.col("toxic_score")
    return out.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))
