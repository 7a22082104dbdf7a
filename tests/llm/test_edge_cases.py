"""Null ids, repeated rows, very long texts, empty tables and clashing columns, operator by operator."""

import random
import zlib

import numpy as np
import pytest

from bitwave.llm import bpe, decontaminate, kneser_ney, pii, secrets, simhash, suffix_dedup, toxicity

LONG = "some words in a row. " * 60_000
ROWS = [(1, "write to a.b@mail.example.com"), (1, "write to a.b@mail.example.com"), (None, "token=abcdef12"), (None, "token=abcdef12"), (None, None), (2, ""), (3, LONG), (3, LONG)]


def frame(spark):
    rows = [(*r, "en", "k", 5, 6, "x", 7.0) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, text_key string, n long, node long, spans string, toxic_score double").repartition(3)


def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


def bench(spark):
    return spark.createDataFrame([(1, "some words in a row some words", 1, "t"), (None, None, 2, "t")], "item_id long, text string, words int, item string")


OPERATORS = {
    "op1": lambda s, d: kneser_ney.quality(d, labels(s)), "op2": lambda s, d: secrets.scan(d), "op4": lambda s, d: bpe.encode_documents(d, *tokenizer()), "op5": lambda s, d: pii.personal_data(d),
    "op6": lambda s, d: decontaminate.contamination(d, bench(s)), "op8": lambda s, d: suffix_dedup.remove_repeats(d), "op9": lambda s, d: toxicity.score_documents(d, labels(s)), "op10": lambda s, d: simhash.simhash_components(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_defined_results(spark, name):
    df = frame(spark)
    rows = [tuple(r.asDict().items()) for r in OPERATORS[name](spark, df).collect()]
    ids = sorted(str(dict(r)["doc_id"]) for r in rows)
    assert ids == sorted(str(i) for i, _ in ROWS)
    assert 4 <= len(set(rows)) <= 5  # equal rows give equal rows; those without an id may be alike
    empty = OPERATORS[name](spark, df.limit(0))
    assert empty.collect() == [] and empty.columns == [k for k, _ in rows[0]]


def test_pipeline_of_no_documents_and_of_clashing_columns(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    tokenizer()
    for name, rows in (("none", []), ("some", [(i, f"text {i} of its own words w{i}", "en", "s", 9, 1, "a", "b") for i in range(6)])):
        path = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node int, text_key string, ids string").write.parquet(f"{path}/documents.parquet")
        labels(spark).limit(0).write.parquet(f"{path}/labels.parquet")
        bench(spark).write.parquet(f"{path}/benchmark.parquet")
        assert {r.doc_id for r in pipeline.run(spark, path).collect()} == {r[0] for r in rows}


def test_ftrl_against_plain_loops():
    """Weights of FTRL-proximal, coordinate by coordinate in plain Python."""
    r, order = random.Random(2), np.random.default_rng(7)
    rows = [(np.array(sorted(r.sample(range(40), 6)), np.int32), int(r.random() < 0.3)) for _ in range(120)]
    alpha, beta, l1, l2 = 0.3, 1.0, 0.5, 1.0
    z, n, bias = {}, {}, toxicity.SPACE

    def weight(i):
        penalty, zi = (0.0 if i == bias else l1), z.get(i, 0.0)
        return 0.0 if abs(zi) <= penalty else -(zi - (penalty if zi > 0 else -penalty)) / ((beta + n.get(i, 0.0) ** 0.5) / alpha + l2)

    for _ in range(3):
        for k in order.permutation(len(rows)):
            x, y = [*rows[k][0].tolist(), bias], rows[k][1]
            w = {i: weight(i) for i in x}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in x:
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - ((n[i] ** 0.5 - before**0.5) / alpha) * w[i]
    model = toxicity.train(rows, [], alpha, beta, l1, l2)
    want = {i: weight(i) for i in range(40) if weight(i)}
    assert dict(zip(model.index.tolist(), model.weight.tolist(), strict=True)) == pytest.approx(want, rel=1e-4)
    assert model.bias == pytest.approx(weight(bias)) and 0 < len(want) < 40


def test_features_against_plain_hashing():
    text, mask = "One two three, TWO one é", 2**64 - 1
    h = [zlib.crc32(w.encode()) for w in ("one", "two", "three", "two", "one", "é")]
    mix = lambda x: ((x * 0x9E3779B97F4A7C15) & mask) >> 44
    pair = lambda a, b, k: ((a << 1) + b * 0x100000001B3 + k) & mask
    want = {mix(x) for x in h} | {mix(pair(a, b, 1)) for a, b in zip(h, h[1:], strict=False)} | {mix(pair(a, b, 2)) for a, b in zip(h, h[2:], strict=False)}
    assert set(toxicity.features(text).tolist()) == want and len(toxicity.features(None)) == 0
