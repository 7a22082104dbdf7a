import hashlib
import random
import re
from collections import Counter

import pytest

from bitwave.llm import suffix_dedup as S


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + S.LENGTH] for d in data for i in range(len(d) - S.LENGTH + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - S.LENGTH + 1):
            if seen[d[i : i + S.LENGTH]] > 1:
                gone[i : i + S.LENGTH] = b"\1" * S.LENGTH
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), bytes(gone).replace(b"\0", b" ").split().__len__(), hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (80, 95, 120, 150, 200)]
    out = [None, "", "short", "a" * 1500, "ab" * 900, "a" * 399, "a" * 400]
    out += [prose(60) + r.choice(passages) + prose(60) for _ in range(60)]
    for _ in range(12):  # near copies of one text, each with a few words changed
        words = random.Random(9).choices(passages[4].split() + passages[3].split(), k=400)
        for _ in range(r.randint(0, 5)):
            words[r.randrange(400)] = word()
        out.append(" ".join(words))
    whole = prose(300)
    out += [whole, whole, whole, prose(10) + whole, passages[0] + passages[0]]
    common = prose(100)
    out += [prose(30) + common + prose(30) for _ in range(300)]  # a hot passage in many contexts
    cut = prose(200).encode()
    out += [prose(40) + cut[a : a + n].decode(errors="ignore") + prose(40) for a in range(0, 500, 23) for n in (398, 401, 460)]
    return out


def brute_shared(texts, words=50):
    windows = []
    for t in texts:
        d = (t or "").encode()
        at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", d)]
        windows.append({d[at[i][0] : at[i + words - 1][1]] for i in range(len(at) - words + 1)})
    seen = Counter(w for x in windows for w in x)
    return [int(any(seen[w] > 1 for w in x)) for x in windows]


@pytest.mark.parametrize("run, target", [(S.RUN_BYTES, S.TARGET_BYTES), (100_000, 50_000)])
@pytest.mark.parametrize("hot", [S.HOT, 100])
def test_against_brute_force(spark, monkeypatch, hot, run, target):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "RUN_BYTES", run)
    monkeypatch.setattr(S, "TARGET_BYTES", target)
    rows = texts()
    r = random.Random(6)
    word = lambda: "".join(r.choice("klmno") for _ in range(r.randint(1, 4)))
    for n in (48, 49, 50, 51, 52, 60):  # short words: passages far below LENGTH bytes
        p = "\n ".join(word() for _ in range(n))
        rows += [f"{word()} {word()} {p} {word()}", f"{word()} {p}", f"{p}{p}"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, text_key string").repartition(5)
    found = S.remove_repeats(df).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found}
    shared = brute_shared(rows)
    assert [i for i, w in enumerate(shared) if dict((r.doc_id, r.shares_passage) for r in found)[i] != w] == []
    assert 350 < sum(shared) < len(rows) - 15
    want = brute(rows)
    assert [i for i, w in enumerate(want) if got[i] != w] == []
    assert sum(w[1] for w in want) > 100_000


def test_repeated_rows_null_ids_and_no_rows(spark):
    t = "xy" * 300
    df = spark.createDataFrame([(1, t), (1, t), (None, "abc")], "doc_id long, text string")
    rows = S.remove_repeats(df).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in rows) == [(0, 3, 0, 0), (1, 600, 600, 1), (1, 600, 600, 1)]
    assert S.remove_repeats(df.limit(0)).collect() == []


def test_loser_tree_and_front_coding():
    r = random.Random(1)
    pool = ["".join(r.choice("ab") for _ in range(r.randint(0, 12))).encode() for _ in range(300)]
    runs = [sorted(r.choices(pool, k=n)) for n in (0, 1, 40, 100, 7)]
    runs = [x for x in runs if x]
    prefix = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    tree = S.LoserTree([(x, S.prefixes(x).tolist()) for x in runs])
    out = [(runs[k][i], n) for k, i, n in tree]
    strings = [s for s, _ in out]
    assert strings == sorted(s for x in runs for s in x)
    assert [n for _, n in out[1:]] == [prefix(a, b) for a, b in zip(strings, strings[1:], strict=False)]
    import numpy as np

    back, _, names = S.unpacked(S.packed(runs[1], S.prefixes(runs[1]), np.zeros(len(runs[1]), S.ENTRY), [b"x" * 32]))
    assert back == runs[1] and names == [b"x" * 32]
