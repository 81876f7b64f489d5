import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import fim

SCHEMA = "doc_id long, text string, n string, form string, output string"


def plain_version(doc_id, text):
    """The contract, unit by unit."""
    text = text or ""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[i:i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or any(m in text for m in fim.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def test_against_the_plain_version(spark):
    texts = ["", None, "a", "ab", "naïve 😀 é text", "x\r\n\x00 \ny", "a <P> b", "<S>", "half <M", "<", "P>", "<P" * 5, "S>" * 5, "long 😀 " * 60_000]
    rows = [(i, texts[i % len(texts)], "x", "y", "z") for i in range(600)] + [(None, "no id", "x", "y", "z"), (None, None, "x", "y", "z")] + [(7, "twice", "x", "y", "z")] * 2
    df = fim.transform(spark.createDataFrame(rows, SCHEMA))
    got = df.select("*", fim.restored().alias("restored")).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[-1])
    want = sorted(((i, *plain_version(i, t)[:4], plain_version(i, t)[4], t or "") for i, t, *_ in rows), key=key)
    assert sorted((tuple(r) for r in got), key=key) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1), st.integers(1, 7))
def test_blocks_cut_as_one_match(text, h1, h2, block):
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    assert fim.Units(block=block).cut(text, h1, h2) == fim.Units().cut(text, h1, h2) == (n, a, b)


def test_other_units():
    u = fim.Units(r"\S+\s*")
    assert u.cut("one two  three", 1, 3) == (3, 4, 14)
    assert fim.Units(r"\S+\s*", block=1).cut("one two  three", 2, 7) == (3, 9, 14)
    assert u.cut(" leading", 1, 2) is None and fim.Units(r"\S+\s*", block=1).cut(" leading", 1, 2) is None
    assert fim.Units(r"\X").cut("éa", 1, 1) == (2, 2, 2)


def test_marks_must_be_marks(spark):
    with pytest.raises(ValueError):
        fim.transform(spark.createDataFrame([], SCHEMA), marks=("<P>", "S", "<M>"))


def test_empty_table_and_other_marks(spark):
    assert fim.transform(spark.createDataFrame([], SCHEMA)).collect() == []
    marks = ("<|pre|>", "<|suf|>", "<|mid|>")
    df = fim.transform(spark.createDataFrame([(i, f"text {i} <P>", "x", "y", "z") for i in range(50)], SCHEMA), marks=marks)
    got = df.select("doc_id", "form", fim.restored(marks=marks).alias("t")).collect()
    assert all(r["t"] == f"text {r['doc_id']} <P>" for r in got) and {r["form"] for r in got} >= {"psm"}
