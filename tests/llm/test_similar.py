"""Similar texts against brute force over all pairs of shingle sets."""

import random

import pytest

from bitwave.llm import simhash, similar


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def family(r, count, words, own, copies):
    """Texts with runs of own words in one template, and for some of them copies with changed words."""
    word = lambda: "".join(r.choice("abcdefghik") for _ in range(6))
    template, texts = [word() for _ in range(words)], []
    for k in range(count):
        x = list(template)
        at = r.randrange(words - own)
        x[at : at + own] = [word() for _ in range(own)]
        texts.append(" ".join(x))
        if k % 4 == 0:
            for _ in range(copies):
                y = list(x)
                for i in r.sample(range(words), 3):
                    y[i] = word()
                texts.append(" ".join(y))
    return texts


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    return family(r, 60, 150, 60, 1) + family(r, 40, 150, 20, 1) + family(r, 30, 120, 100, 2)


def groups(texts):
    """Least index of the component of each text, by all pairs of similarity 0.8 or more."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("sample", [8192, 0])
def test_families_by_exact_similarity(spark, monkeypatch, texts, sample):
    monkeypatch.setattr(similar, "SAMPLE", sample)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3).cache()
    rows = similar.described(df).cache()
    edges = similar.similar_links(df, rows).collect()
    text = {r.node: texts[r.doc_id] for r in rows.collect()}
    for e in edges:  # every link is similar
        a, b = shingles(text[e.a]), shingles(text[e.b])
        assert len(a & b) >= 0.8 * len(a | b) - 1e-9
    root = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    group = {r.doc_id: root.get(r.node, r.node) for r in rows.collect()}
    want = groups(texts)
    assert len({(group[i], want[i]) for i in range(len(texts))}) == len(set(want)) == len(set(group.values()))
    assert 1 < len(set(want)) < len(texts)
    kept = {r.doc_id for r in simhash.drop_near_duplicates(df).collect()}
    assert kept == set(want)


def test_one_family_in_one_bucket(spark):
    """A thousand copies of one text, each with its own few changes: links by all pairs, few candidates."""
    r = random.Random(9)
    texts = family(r, 1, 100, 1, 0)
    for k in range(1000):
        x = texts[0].split()
        for i in r.sample(range(100), k % 6):
            x[i] = f"w{r.randrange(10**6)}"
        texts.append(" ".join(x))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in simhash.drop_near_duplicates(df).collect()} == set(groups(texts))


def test_small_tables_have_few_files(spark, monkeypatch, texts, tmp_path):
    """Every file costs its executor processes: tables with a known bound are not spread over all partitions."""
    from bitwave.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for module in (simhash, similar):
        monkeypatch.setattr(module, "forget", lambda *tables: None)
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
        kept = simhash.drop_near_duplicates(df)
        assert {r.doc_id for r in kept.collect()} == set(groups(texts))
        assert kept.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
        files = {p.name.rsplit("-", 1)[0]: len(list(p.glob("part-*"))) for p in tmp_path.iterdir()}
        most = 2 * spark.sparkContext.defaultParallelism
        assert {"similar-nodes", "shared-shingles", "links", "large-star", "small-star", "shingle-sets", "kept"} <= set(files)
        assert {what: n for what, n in files.items() if n > most} == {what: n for what, n in files.items() if n > most and what in ("pairs", "frequent-shingles")}
        numbers = spark.range(0, 1000, 1, 40)
        assert sorted(r.id for r in common.stored(numbers, "numbers", 1000, 50).collect()) == list(range(1000))
        assert sorted(len(list(p.glob("part-*"))) for p in tmp_path.glob("numbers-*")) == [20]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_defined_cases(spark):
    rows = [(5, None, 1), (4, "", 1), (7, " \n ", 1), (3, "One two", 1), (None, "one TWO", 1), (None, "three", 2), (None, "three", 2), (9, "x " * 200_000, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int")
    assert sorted(((r.doc_id or 0), (r.text or "").strip()[:5], r.node) for r in simhash.drop_near_duplicates(df).collect()) == [(0, "three", 2), (3, "One t", 1), (4, "", 1), (9, "x x x", 3)]
    assert simhash.drop_near_duplicates(df.limit(0)).collect() == []
