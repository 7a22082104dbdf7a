"""Operators over pages, vectors and groups of documents, and the pipeline."""

import hashlib
import math
import random

import numpy as np
import pytest
import xxhash

from bitwave.llm import simhash, topk, warc
from bitwave.llm.common import shared_path


# --- Archives -------------------------------------------------------------------------------------


def expected(pages):
    first, out = {}, []
    data = [(p, u, (h or "").encode()) for p, u, h in pages]
    for p, _, d in data:
        if len(d) >= 100 and p is not None:
            first[d] = min(first.get(d, p), p)
    seen = set()
    for p, _, d in data:
        revisit = len(d) >= 100 and p is not None and (first[d] < p or (p, d) in seen)
        seen.add((p, d))
        out.append((-1 if p is None else p, len(d), hashlib.sha256(d).hexdigest(), "revisit" if revisit else "response", first[d] if revisit else -1))
    return sorted(out)


def pages():
    r = random.Random(1)
    body = ["<p>é" + "x" * n for n in (95, 96, 97, 500, 20_000)]
    rows = [(i * 7 - 300, f"http://h.example/{i}", r.choice(body) if i % 2 else f"page {i} " * r.randint(0, 400)) for i in range(300)]
    return rows + [(5000, None, None), (5001, "u", ""), (None, "n", body[4]), (8, "a", body[3]), (8, "b", body[3]), (8, "c", "other"), (2**40, "far", body[3])]


def test_archives_round_trip(spark):
    rows = pages()
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string").repartition(6)
    got = warc.round_trip(df).collect()
    assert sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in got) == expected(rows)
    assert warc.round_trip(df.limit(0)).collect() == []


def test_archives_are_deterministic_and_roll(spark, tmp_path):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string")
    found = []
    for i, n in enumerate((2, 7)):
        uri = f"file://{tmp_path}/{i}"
        manifest = warc.write_archives(df.repartition(n), uri, roll_bytes=2000).orderBy("file").collect()
        found.append([(r.file, r.records, r.bytes, r.sha256) for r in manifest])
        names = sorted(p.name for p in (tmp_path / str(i)).glob("part-*"))
        assert names == [r.file for r in manifest] and not (tmp_path / str(i) / "_temporary").exists()
        for r in manifest:
            assert hashlib.sha256((tmp_path / str(i) / r.file).read_bytes()).hexdigest() == r.sha256
    assert found[0] == found[1] and len(found[0]) > 3


@pytest.mark.parametrize("far", [2**50, None])
def test_shards_have_about_equal_bytes(spark, tmp_path, far):
    """One id far away, or a third of the rows without an id."""
    r = random.Random(3)
    rows = [(i if far or i % 3 else None, f"u{i}", f"{r.random()} " * 100) for i in range(3000)] + [(far, "far", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    sizes = {}
    for m in warc.write_archives(df, f"file://{tmp_path}/{far}", roll_bytes=50_000).collect():
        sizes[m.shard] = sizes.get(m.shard, 0) + m.bytes
    assert len(sizes) >= 20 and max(sizes.values()) < 2 * sum(sizes.values()) / len(sizes)


# --- Top k ----------------------------------------------------------------------------------------


def whole(c):
    """floor(256 * c) of a double, whatever its size."""
    c = float(np.float32(c))
    return int(c) * 256 if abs(c) >= 2**53 else math.floor(256 * c)


def brute_top(rows, k=5):
    good = [(i, [whole(c) for c in x]) for i, x in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    out = []
    for n, (q, mine) in enumerate(good):
        if q % 50 == 0:
            all_ = sorted((-sum(a * b for a, b in zip(mine, x, strict=True)), i) for m, (i, x) in enumerate(good) if m != n and len(x) == len(mine))
            out += [(q, at + 1, i, max(-(2**63), min(2**63 - 1, -s))) for at, (s, i) in enumerate(all_[:k])]
    return sorted(out)


def vectors():
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=6).round(1).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.5] * 6) for i in range(200)]  # ties
    rows += [(1, None), (2, [float("nan")] * 6), (3, [1.0, None] + [0.0] * 4), (450, [1.0, 2.0, 3.0]), (None, [1.0] * 6), (451, [1.0, 1.0, 1.0]), (2050, [float("inf")] * 6), (-50, [3.0] * 6), (100, [9.0] * 6)]
    return rows + [(150, rows[150][1])] * 3 + [(500, []), (501, [])]


@pytest.mark.parametrize("shard", [topk.SHARD_BYTES, 300])
def test_top_k(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "TILE", 64)
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, score int, rank string").repartition(5)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, shard_bytes=shard).collect()) == brute_top(rows)
    assert topk.top_k(df.limit(0)).collect() == []
    few = spark.createDataFrame([(50, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(few).collect()] == [(50, 1, 1, 131072)]


def test_top_k_of_large_vectors(spark):
    """Every finite vector takes part; order is exact beyond 64 bits too."""
    r = random.Random(4)
    rows = [(50, [1.0, 0.0]), (1, [9e6, 0.0]), (2, [1.0, 1.0]), (100, [1e30, -1e30]), (3, [1e30, 1e30]), (4, [3e38, 0.0]), (5, [-3e38, 1.0]), (6, [3e38, 1.0]), (150, [2.0**60, 3.0])]
    rows += [(10 + i, [r.choice([1.0, 2.0**40, 1e20, -1e20, 5e8]), r.uniform(-9, 9)]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df).collect()) == brute_top(rows)


def test_products_beyond_doubles():
    big = np.array([[2**31 - 1] * 4], np.int64)
    assert topk.products(big, big)[0, 0] == 4 * (2**31 - 1) ** 2
    a = np.array([[2**29, 3]], np.int64)
    assert topk.products(a, a)[0, 0] == 2**58 + 9
    values = sorted([0, 1, -1, 255, 256, -255, -256, -257, 2**64, -(2**64), 2**200, -(2**200), 2**2000])
    assert sorted(values, key=topk._sortable) == values


# --- SimHash --------------------------------------------------------------------------------------


def brute_fingerprint(text, words=3):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, distance=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def texts_with_copies():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdÉé") for _ in range(r.randint(1, 6)))
    out = [None, "", " \t\n", "one", "One two", "a b c d", "A B c"]
    for _ in range(60):
        w = [word() for _ in range(r.randint(60, 300))]
        out.append(" ".join(w))
        for _ in range(r.randint(0, 8)):
            x = list(w)
            x[r.randrange(len(x))] = word()
            out.append(" ".join(x))
    return out + out[5:40]


def test_simhash(spark):
    rows = texts_with_copies()
    df = spark.createDataFrame([(1000 - i, t, 1, "k") for i, t in enumerate(rows)], "doc_id long, text string, fp int, root string").repartition(4)
    got = {r.doc_id: r for r in simhash.simhash_components(df).collect()}
    fps = [brute_fingerprint(t) for t in rows]
    groups = brute_components(fps)
    smallest = {}
    for i, g in enumerate(groups):
        smallest[g] = min(smallest.get(g, 10**9), 1000 - i)
    for i in range(len(rows)):
        assert got[1000 - i].fingerprint == f"{fps[i]:016x}"
        assert got[1000 - i].component_id == smallest[groups[i]]
    assert len(set(groups)) < len(set(fps))
    assert simhash.drop_near_duplicates(df).columns == df.columns
    assert simhash.simhash_components(df.limit(0)).collect() == []


@pytest.mark.parametrize("bucket", [1, 3, 32])
def test_links_in_large_buckets(spark, monkeypatch, bucket):
    """Chains and balls of fingerprints, also where every bucket counts as large."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    r = random.Random(bucket)
    fps = set()
    for _ in range(25):
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 40)):
            fps.add(x)
            for b in r.sample(range(64), r.randint(1, 3)):
                x ^= 1 << b
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.array([x], np.uint64).view(np.int64)[0]),) for x in fps], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, len(fps))).collect()}
    signed = [int(np.array([x], np.uint64).view(np.int64)[0]) for x in fps]
    groups = brute_components(fps)
    want, got = {}, {}
    for s, g in zip(signed, groups, strict=True):
        want.setdefault(g, set()).add(s)
        got.setdefault(roots.get(s, s), set()).add(s)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_thresholds_cover_the_distance():
    r = np.random.default_rng(1)
    sample = r.integers(0, 2**63, 3000).astype(np.uint64)
    for rows in (10, 10**5, 10**8, 10**11):
        plan = simhash.allocate(sample, rows, 2)
        bits = [b for g, _ in plan for b in g]
        assert len(bits) == len(set(bits))
        for _ in range(300):
            flips = set(r.choice(64, 2, replace=False).tolist())
            assert any(len(flips & set(g)) <= t for g, t in plan)


def test_repeated_rows_stay_once(spark):
    df = spark.createDataFrame([(1, "x y z", "a"), (1, "x y z", "b"), (None, "x y z", "c"), (2, "other words here now", "d"), (None, "", "e"), (None, "", "e")], "doc_id long, text string, lang string")
    assert sorted((r.doc_id or 0, r.text, r.lang) for r in simhash.drop_near_duplicates(df).collect()) == [(0, "", "e"), (1, "x y z", "a"), (2, "other words here now", "d")]


# --- Pipeline -------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    P = pytest.importorskip("public_tokenizers")
    import tiktoken

    from bitwave.llm import bpe

    r = random.Random(11)
    word = lambda: "".join(r.choice("bcdfgklmnoprstuvaei") for _ in range(r.randint(2, 7)))
    prose = lambda n=80: " ".join(word() for _ in range(n))
    item = prose(30)
    docs = [prose() for _ in range(300)]
    toxic = list(range(0, 300, 5))
    for i in toxic:
        docs[i] += " vilest rubbish"
    n = len(docs)
    docs += [docs[1], docs[2], docs[3]]  # copies
    docs += [f"{prose()} {item} {prose()}"]  # a leak
    docs += [prose() + " write to someone.here@mail.example.com now", "", None]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(docs)]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(250)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    state, columns = spark.read.parquet(f"{path}/documents.parquet"), None
    columns = state.columns
    for i, (name, stage) in enumerate(pipeline.STAGES):
        state = stage(spark, state, path)
        state.write.parquet(f"{path}/stage{i}")
        state = spark.read.parquet(f"{path}/stage{i}")
        if i < 4:
            assert state.columns == columns, name
    out = {r.doc_id: r for r in pipeline.run(spark, path).collect()}
    assert set(out) == {r.doc_id for r in state.collect()}
    gone = set(range(n + 6)) - set(out)
    assert set(toxic) <= gone and {n, n + 1, n + 2, n + 3} <= gone
    clean = set(range(300)) - set(toxic)
    assert len(clean - gone) >= len(clean) - 3
    assert "@" not in out[n + 4].text and "<email>" in out[n + 4].text and out[n + 4].n_chars == len(out[n + 4].text)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.Coder(bpe.rank_bytes(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN).ranks, special_tokens={})
    for r_ in out.values():
        assert list(r_.ids) == own.encode_ordinary(r_.text or "") and r_.n_tokens == len(r_.ids)


def test_shared_folder(spark):
    assert shared_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
