"""Each gate lets every text through that its pattern finds something in."""

import re

import pytest

from bitwave.llm import secrets

SECRET = "Ab3dEf6hIj9kLm2nOp5qRs8tUv1wXy4z"


@pytest.mark.parametrize("kind, text", [("assign", "api_key = 'x"), ("access", "AKIA" + "A1" * 8), ("hex", "0a" * 12), ("identifier", "user_id: abcd"), ("secret", SECRET), ("endpoint", "s3://bucket/key"), ("endpoint", "socks5://host"), ("endpoint", "c++://host"), ("endpoint", "https://host")])
def test_gates_cover_patterns(kind, text):
    assert re.search(secrets.PATTERNS[kind], text) and re.search(secrets.GATES[kind], text)


def test_endpoint_with_digit_links(spark):
    df = spark.createDataFrame([(1, f"s3://bucket/key {SECRET}"), (2, f"https://bucket/key {SECRET}")], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in secrets.scan(df).collect()}
    assert spans == {1: "endpoint:0:15,secret:16:48", 2: "endpoint:0:18,secret:19:51"}


def test_many_parts_in_one_text(spark):
    """Cost grows with the parts of a text, not with their square; results as by plain matching."""
    import time

    one = f"token=abcdef12 client_id=abcd1234 {SECRET} https://host/path "
    took = []
    for n in (2_000, 20_000):
        df = spark.createDataFrame([(1, one * n)], "doc_id long, text string")
        began = time.time()
        r = secrets.scan(df).first()
        took.append(time.time() - began)
        spans = r.spans.split(",")
        assert r.n_assign == n and len(spans) == 4 * n and spans[-1] == f"endpoint:{len(one) * n - 18}:{len(one) * n - 1}"
    assert took[1] < 10 * max(took[0], 1.5)
